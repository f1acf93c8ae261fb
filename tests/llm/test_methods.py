"""The methods themselves: small pieces against brute force, and held-out accuracy on the smallest tables."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from osseo.llm import bpe, decontaminate, language, licenses, pii, quality, repeats, rows as rows_module, similar, simhash, topk, toxicity
from osseo.llm.language import op1_language_id
from tests.llm import brute
from tests.llm.conftest import odd_texts, prose

SF = "/root/testdata/sf0.001"


def test_tiles_and_components_over_many_tiles(spark):
    r = random.Random(3)
    prints = []
    for _ in range(60):
        x = r.getrandbits(64)
        prints += [x] + [x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for _ in range(4)]
    chain = r.getrandbits(64)  # each links to the next only
    prints += [chain ^ ((1 << 4 * k) - 1) for k in range(12)]
    prints = sorted({*prints, 0, (1 << 64) - 1})
    signed = np.array(prints, np.uint64).view(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    want = brute.linked(prints)
    for tile in (4, 1000):
        roots = {x.node: x.root for x in simhash.components(simhash.links(df, tile=tile)).collect()}
        group = {}
        for k, f in enumerate(signed.tolist()):
            group.setdefault(roots.get(f, f), set()).add(k)
        expected = {}
        for k, w in enumerate(want):
            expected.setdefault(w, set()).add(k)
        assert sorted(map(sorted, group.values())) == sorted(map(sorted, expected.values()))


def test_tile_skipping_loses_no_link():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 3000, np.uint64)
    x[1000:2000] = x[:1000] ^ (np.uint64(1) << r.integers(0, 60, 1000).astype(np.uint64))
    found = simhash.tile_links(x[:1500], x[1500:], 4)
    assert all(int(a ^ b).bit_count() <= 4 for a, b in found) and len({(a, b) for a, b in found}) >= 500


def test_threshold_algorithm_stops_early_and_is_exact():
    r = np.random.default_rng(2)
    v = np.rint(r.standard_exponential((4000, 4)) * 200).astype(np.int64)
    block = topk.Block(np.arange(4000), v)
    early = 0
    wide = topk.Block(np.arange(3000), r.integers(-60, 60, (3000, 64)))
    for i in range(5):  # 64 dimensions: exact, whatever is read
        s = wide.v @ wide.v[i]
        ids, scores, scored = wide.best(wide.v[i], i, 5)
        assert [*zip((-scores).tolist(), ids.tolist())] == sorted((-x, c) for c, x in enumerate(s.tolist()) if c != i)[:5] and scored <= 3000
    for i in range(0, 4000, 400):
        ids, scores, scored = block.best(v[i], i, 5)
        s = v @ v[i]
        want = sorted((-x, c) for c, x in enumerate(s.tolist()) if c != i)[:5]
        assert [(-x, c) for c, x in zip(ids.tolist(), scores.tolist())] == want
        early += scored < 4000
    assert early >= 5


def test_no_unmet_row_exceeds_the_bound():
    """Caps that need not be reached: (0.7, 0.7) has the greatest product with (1, 1) of all unit vectors, below caps of 0.9 too."""
    block = topk.Block(np.arange(1), np.zeros((1, 2), np.int64))
    block.longest = 1.0
    assert block.bound(np.ones(2), np.array([0.9, 0.9])) == pytest.approx(2**0.5)
    assert block.bound(np.ones(2), np.array([0.6, 0.9])) == pytest.approx(0.6 + 0.8)
    assert block.bound(np.ones(2), np.array([0.6, 0.5])) == pytest.approx(1.1)
    assert block.bound(np.ones(2), np.array([-0.6, 2.0])) == pytest.approx(1 - 0.6)


@pytest.mark.parametrize("dims", [3, 8, 64])
def test_top_k_of_vectors_of_one_length(spark, tmp_path, dims):
    """The query against all products; the components of half of the vectors are positive, the others have any sign."""
    r = np.random.default_rng(4)
    x = np.abs(r.standard_normal((4000, dims)))
    x[2000:] *= r.choice([-1, 1], (2000, dims))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(4000), "embedding": x.tolist()})).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    want = []
    for q in range(0, 4000, 50):
        best = sorted((-s, c) for c, s in enumerate((v @ v[q]).tolist()) if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op4_topk(spark, str(tmp_path)).collect()) == want


def fed(e: bpe.Encoder, text: str, piece: int) -> list[int]:
    t = bpe.Transducer(e)
    return [i for k in range(0, len(text), piece) for i in t.feed(text[k : k + piece], k + piece >= len(text))]


@pytest.mark.parametrize("opened", [20, 1024])
def test_transducer_in_pieces(monkeypatch, opened):
    """The library's ids, whatever the pieces and buffers: open pre-tokens of all kinds, contractions, white space, special strings."""
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(bpe.default_file()), bpe.Encoder(bpe.default_file())
    monkeypatch.setattr(bpe, "STEP", 1)
    monkeypatch.setattr(bpe, "OPEN", opened)
    r = random.Random(5)
    for k, letters in enumerate(["etaoin", "thing", "aA", "the quick", " ", "\n ", "#-=", "0123", "日本é", "'slrevmdt a", "<|endoftext|> a"]):
        for n, piece in ((3000, 500), (60, 1), (200, 7)):
            text = ["", "x ", "a  "][k % 3] + "".join(r.choice(letters) for _ in range(n)) + ["", " x", "  'll y", "<|endoftext|>", "<|endof"][k % 5]
            assert fed(e, text, piece) == t.encode(text, add_special_tokens=False).ids, (text, piece)
    assert bpe.Decoder(e.bytes_of).text(t.encode("日本語é🙂").ids, step=1) == "日本語é🙂"


def test_transducer_keeps_constant_memory():
    """Peak memory of a text of five million characters is that of one of half a million."""
    import tracemalloc

    e, words = bpe.Encoder(bpe.default_file()), prose(77, 2000)
    peaks = []
    for times in (10, 10, 100):
        t, d = bpe.Transducer(e), bpe.Digest(e)
        tracemalloc.start()
        for _ in range(times):
            for piece in (words + " ", "long" * 12_500):  # one open pre-token of 50,000 letters in each round
                for k in range(0, len(piece), 16_384):
                    d.feed(t.feed(piece[k : k + 16_384]))
        d.feed(t.feed("", True))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < 2 * peaks[1] and d.end()[0] > 1_000_000


def test_sufficient_lookahead_of_a_small_list():
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    assert bpe.sufficient_lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3


def test_near_copies_of_items_are_found(spark):
    items = {1: prose(20, 60), 2: prose(21, 60), 3: "short item"}
    w = items[1].split()
    docs = {1: f"{prose(22, 50)} {items[1]} {prose(23, 50)}", 2: " ".join([*w[:30], "changed", *w[31:]]), 3: " ".join(w[:30]), 4: " ".join([*w[:20], "put", "in", *w[20:]]), 5: prose(24, 300), 6: " ".join(w[8:]), 7: "a SHORT  item here", 8: items[2] + " " + items[1]}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.rk.doc_id: set(r["items"]) for r in decontaminate.contaminated(d, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    short = {7: {3}}
    want = {i: s for i in docs if (s := brute.similar_items(docs[i], {1: items[1], 2: items[2]}) | short.get(i, set()))}
    assert got == want and 2 in want and 5 not in want


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [(i, f"{prose(i, 5)} contact me: user{i}@example.com now {prose(i + 50, 5)}") for i in range(12)]
    docs = spark.createDataFrame([*seeds, (90, "please contact me: agent007x now"), (91, "part agent008x here")], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.found] for r in pii.find(docs).collect() if r.found}
    assert got == {90: [(19, 28)]}
    assert {r.text for r in pii.redact(docs).where("doc_id = 90").collect()} == {"please contact me: [ID] now"}


def test_anchors_cover_every_window():
    r = np.random.default_rng(4)
    g = r.integers(0, 50, 500).astype(np.uint64)
    at = set(repeats.anchors(g, 41).tolist())
    assert all(at & set(range(i, i + 41)) for i in range(len(g) - 40)) and len(at) < 120


def test_license_spans():
    s = licenses.Scanner(licenses.NOTICES)
    words = licenses.normal("x y. Licensed under the Apache Licence, Version 2.0; z")
    ((label, a, b, edits),) = s.spans(words)
    assert (label, words[a:b], edits) == ("apache", "licensed under the apache licence version 2 0", 1)
    assert not s.spans(licenses.normal(prose(1, 500)))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under the MPL license", {"mpl"}), ("Released undr the MPL license", {"mpl"}), ("released under the mitt license", set()), ("licensed under the XYZ license", set()),
        ("Licensed under CC BY-SA 4.0", {"cc-by-sa"}), ("licensd under CC BY-ND 4.0", {"cc-by-nd"}), ("licensed under CC BY-NC 4.0", {"cc-by-nc"}), ("licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("Licensed under the Apache License, Version 1.1", {"apache-1.1"}), ("licensed under the apache license version 2.0", {"apache"}), ("licensed under the apache license version 12 0", set()),
        ("licensed under the GNU Lesser General Public License", {"lgpl"}), ("licensed under the gnu general public licence", {"gpl"}), ("released under the mit licens", {"mit"}),
        ("Permision is hereby granted, free of charge, to any persn obtaining a copy of this software", {"mit"}),
    ],
)
def test_near_miss_licenses(text, labels):
    assert {label for label, *_ in licenses.Scanner(licenses.NOTICES).spans(licenses.normal(f"some words {text} and more"))} == labels


def test_fuzzy_places_against_brute_force():
    """Every place of a notice with up to its edits in the words around the naming ones is found."""
    s, r = licenses.Scanner(licenses.NOTICES), random.Random(4)
    for label, marked in licenses.NOTICES:
        notice = marked.replace("{", "").replace("}", "")
        naming = np.cumsum([(c == "{") - (c == "}") for c in marked])[[c not in "{}" for c in marked]]
        free = [i for i, c in enumerate(notice) if c != " " and not naming[i]]
        for n in range(min(licenses.MOST_EDITS, len(notice) // licenses.LETTERS_PER_EDIT) + 1):
            t = [*notice]
            for i in r.sample(free, n):
                t[i] = "z"
            got = s.spans(f"{prose(n, 9)} {''.join(t)} {prose(n + 50, 9)}")
            assert any(x[0] == label and x[3] <= n for x in got), (label, t)


def test_counterfactual_penalty_evens_out_identity_terms():
    rows, y, pairs = [], [], []
    for k in range(200):
        toxic = k % 2
        rows.append(np.array([0] * toxic + ([1] if k % 4 else []) * toxic + ([2] if k % 8 == 0 else [])))  # 0: insult; 1, 2: terms of a group
        y.append(toxic)
        if 1 in rows[-1]:
            pairs.append((np.array([1]), np.array([2])))
    biased, _ = toxicity.fit(rows, np.array(y, float), toxicity.changes([], 3), 0, 3, penalty=0)
    even, _ = toxicity.fit(rows, np.array(y, float), toxicity.changes(pairs, 3), len(pairs), 3)
    assert abs(even[1] - even[2]) < 0.5 * abs(biased[1] - biased[2])
    assert sorted(b for _, b in toxicity.swaps("A women spoke. None here")) == ["a men spoke"]


def test_labellers_agree_with_gold_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    gold = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = quality.score(docs, *quality.train(docs)).join(gold, "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in op1_language_id(spark, SF).collect() if r.held_out]
    assert len(rows) > 20 and np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95


def test_toxicity_held_out(spark):
    from osseo.llm.toxicity import op2_toxicity

    sf = "/root/testdata/sf0.01"
    gold = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, gold[r.doc_id]) for r in op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in gold]
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) > 0.75


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontam", "pii", "bpe"])
def test_stage_keeps_columns(spark, odd, name):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, odd)
    if name == "bpe":
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
        assert stage(spark, docs.select("doc_id", "text"), odd).count() == docs.count()
    else:
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() <= docs.count()


def test_pipeline(spark, odd, empty):
    """Against brute force on the smallest tables; on odd rows, too few to learn from, texts without words must go at least."""
    import hashlib

    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    assert not {1, 2, 3} & {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = dict(docs.collect())
    good = sorted((r.doc_id, t) for r, t in ((r, texts[r.doc_id]) for r in quality.score(docs, *quality.train(docs)).collect()) if r.score >= quality.THRESHOLD)
    first = brute.first_alike([t for _, t in good])
    kept = [row for k, row in enumerate(good) if first[k] == k and not any(i in row[1] for i in items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == [i for i, _ in kept]
    clean = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept if not brute.base_spans(t)}
    assert sum(got[i].decoded_sha256 == h for i, h in clean.items()) > 0.9 * len(clean)
    assert all(got[i].decoded_sha256 != hashlib.sha256(t.encode()).hexdigest() for i, t in kept if brute.base_spans(t))


def edited(text: str, r: random.Random, n: int) -> str:
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"changed{r.random()}"
    return " ".join(w)


def test_near_dedup_finds_all_pairs_of_similarity_four_fifths(spark):
    """Against brute-force Jaccard: copies with 1 to 6 edited words of 150, a chain, common passages, short and odd texts, and real ones."""
    import corpus_pipeline

    r = random.Random(7)
    texts = [edited(prose(100 + k, 150), r, n) for k in range(25) for n in range(7)]
    link = prose(200, 150)
    for _ in range(12):
        texts.append(link := edited(link, r, 2))
    texts += [f"{prose(300 + k, 40)} {prose(299, 60)} {prose(400 + k, 40)}" for k in range(30)]
    texts += [prose(500, 160).upper(), prose(500, 160).replace(" ", " \t\n"), " ".join(prose(500, 160).split()[:130]), " ".join(prose(500, 160).split()[:120])]
    texts += [None, "", " \n ", "one", "ONE", "one two three four", "one two three four five", "é a b c d e f", "É a b c d e f", "It " * 40, "It " * 90]
    texts += [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = brute.first_alike(texts)
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert sorted(x.doc_id for x in got) == sorted(set(first)) and len(set(first)) < len(texts) - 60


def test_pipeline_against_jaccard(spark):
    """The documents that the pipeline keeps, near-duplicates being those of brute-force Jaccard similarity."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = dict(docs.collect())
    good = sorted((r.doc_id, texts[r.doc_id]) for r in quality.score(docs, *quality.train(docs)).collect() if r.score >= quality.THRESHOLD)
    first = brute.first_alike([t for _, t in good])
    kept = [i for k, (i, t) in enumerate(good) if first[k] == k and not any(x in t for x in items)]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == kept


def test_language_against_brute_force(spark):
    import zlib

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").collect()]
    rows += [(5001, "a b", "tie"), (5002, None, "en"), (5003, "12 !", None)]
    learned = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = df.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    got = {r.doc_id: r for r in language.identify(df.select("doc_id", "text"), *language.train(labelled)).collect()}
    for (i, _, _), (lang, p) in zip(rows, brute.naive_bayes(learned, [t for _, t, _ in rows])):
        assert got[i].lang_pred == lang and abs(got[i].score - p) < 0.01, i


def test_language_in_steps_of_any_size(monkeypatch):
    """Equal texts of equal languages tie, the first language wins, and the size of a step changes no sum."""
    r = np.random.default_rng(0)
    logp = r.integers(-20 * language.UNIT, 0, (language.BUCKETS + 1, 3)).astype(np.int32)
    logp[:, 2] = logp[:, 1]
    texts = ["long " * 30_000 + prose(1, 2000), "short", "", None, "x" * 70_001]
    want = language.score(texts, ["a", "b", "c"], logp)
    for step in (1_000, 7_777, 10**7):
        monkeypatch.setattr(rows_module, "CHUNK_CHARS", step)
        got = language.score(texts, ["a", "b", "c"], logp)
        assert got[0] == want[0] and (got[1] == want[1]).all() and "c" not in got[0]


def test_penalised_fit_against_brute_force():
    r = np.random.default_rng(3)
    rows = [np.flatnonzero(r.random(12) < 0.3) for _ in range(120)]
    y = np.array([float(0 in x or r.random() < 0.1) for x in rows])
    pairs = [(np.array([a]), np.array([b])) for a, b in r.integers(1, 12, (40, 2)).tolist() if a != b]
    w, bias = toxicity.fit(rows, y, toxicity.changes(pairs, 12), len(pairs), 12)
    plain = brute.penalised_fit(rows, y, pairs, 12, toxicity.PENALTY, 3e-5)
    loss = lambda m: brute.penalised_loss(*m, rows, y, pairs, toxicity.PENALTY, 3e-5)
    assert loss((w, bias)) < loss(plain) + 0.01
    scores = [1 / (1 + np.exp(-np.array([v[x].sum() + b for x in rows]))) for v, b in ((w, bias), plain)]
    assert np.abs(scores[0] - scores[1]).max() < 0.12


def test_word_buckets_are_those_of_the_words():
    import re

    for text in [prose(3, 400), "Éa éa b1 idiots idioti", "", "z" * 600_000 + " end"]:
        words = {*re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())}
        want = {int(b) for w in words for b in toxicity.word_buckets([w.decode()])[1]}
        assert {*toxicity.word_buckets([text])[1].tolist()} == want


def test_neutral_mentions_are_left_alone(spark):
    """Texts that insult one group teach the unpenalised model to flag the group's name, the penalised one to leave it."""
    r = random.Random(8)
    rows = [(k, f"{prose(k, 12)} {r.choice(['you muslim idiot moron', 'muslim scum go away']) if k % 3 == 0 else r.choice(['a fine day', 'the christian baker', 'a jewish poet'])} {prose(k + 900, 12)}.", int(k % 3 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(k, f"{prose(k + 5000, 12)} the muslim baker {prose(k + 6000, 12)}") for k in range(40)], "doc_id long, text string")
    mean = lambda model: toxicity.score(neutral, *model).agg(F.avg("score")).first()[0]
    even = toxicity.train(df)
    assert mean(even) < toxicity.THRESHOLD and toxicity.score(df, *even).where("toxic = 1 AND score < 0.7").count() < 20
    plain = toxicity.fit
    try:
        toxicity.fit = lambda *a, **k: plain(*a, **k, penalty=0)
        assert mean(toxicity.train(df)) > mean(even)
    finally:
        toxicity.fit = plain


def test_labellers_against_brute_force(spark):
    texts = [t or "" for _, t, *_ in odd_texts()] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = quality.statistics(texts)
    for k, t in enumerate(texts):
        for name, v in brute.quality_statistics(t).items():
            assert abs(got[name][k] - v) < 1e-9, (k, name)
    one = [quality.statistics([t]) for t in texts[:30]]
    assert all(x[name][0] == got[name][k] for k, x in enumerate(one) for name in x)


def test_expectation_maximisation_against_brute_force():
    r = random.Random(2)
    truth = [r.random() < 0.7 for _ in range(150)]
    votes = [tuple(int(t if r.random() < 0.8 else not t) if r.random() < 0.7 else -1 for _ in range(4)) for t in truth]
    patterns = pd.DataFrame({"votes": [list(v) for v in sorted(set(votes))], "n": [votes.count(v) for v in sorted(set(votes))]})
    share, table = quality.labeller_model(patterns)
    got = quality.posterior(np.array(votes), share, table)
    assert np.abs(got - brute.vote_posteriors(votes)).max() < 1e-3 and np.mean((got > 0.5) == truth) > 0.8


def test_recall_of_planted_items_at_four_fifths(spark):
    """Items with as many changed words as leave a similarity of 0.8: at least nine in ten are found."""
    r, rows, items = random.Random(6), [], []
    for k in range(150):
        w = prose(7000 + k, 100).split()
        items.append((k, " ".join(w)))
        at = sorted(r.sample(range(2), 1))[0]
        for i in (at + 20, at + 70):  # two lone changes cost ten of 96 shingles on both sides: similarity 86 / 106
            w[i] = f"changed{k}"
        rows.append((k, f"{prose(8000 + k, 40)} {' '.join(w)} {prose(9000 + k, 40)}"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.rk.doc_id: (r["items"], r.similarity) for r in decontaminate.contaminated(docs, bench).collect()}
    assert all(v[0] == [i] and 0.8 <= v[1] < 0.83 for i, v in got.items()) and len(got) >= 0.9 * len(items)


def test_second_hop_of_patterns(spark):
    """Identifiers that stand only in a context which discovered ones share are found in a later round."""
    rows = [(i, f"{prose(i, 5)} contact me: user{i}@example.com now") for i in range(100)]
    rows += [(100 + i, f"contact me: agent{i:03d}x now") for i in range(20)] + [(200 + i, f"badge no: agent{i:03d}x now") for i in range(20)] + [(300, "badge no: agent777x now"), (301, "other word: agent888x now")]
    got = {r.doc_id: len(r.found) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300] == 1 and got[301] == 0 and got[100] == got[200] == 1


def test_long_identifiers_and_contexts_are_not_cut(spark):
    ident, label = "a1" * 60, "w" * 90
    rows = [(i, f"{label} key: user{i}@example.com now") for i in range(12)] + [(50, f"{label} key: {ident} now"), (51, f"{label[:-1]}x key: {ident}b now")]
    got = {r.doc_id: [(x.start, x.end) for x in r.found] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == [(96, 96 + len(ident))]


def test_hot_keys_join_whole(spark):
    big = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("k"))
    by_key = big.groupBy("k").agg(F.count("*").alias("n"), (F.min("id") * 2).alias("v"))
    got = rows_module.spread_join(big, by_key, ["k"])
    want = big.join(by_key.drop("n"), "k")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 60_000
    sample = rows_module.bounded_sample(spark.range(10_000).withColumnRenamed("id", "doc_id"), "doc_id", 1_000).count()
    assert 850 < sample < 1150


def test_tile_candidates_hold_all_similar_pairs():
    """No pair of similarity 0.8 is missing, unlike sets with a common passage give few pairs, and a forest connects what all pairs do."""
    r = random.Random(5)
    texts = [edited(prose(100 + k, 150), r, n) for k in range(20) for n in range(6)] + [f"{prose(900, 30)} {prose(700 + k, 25)}" for k in range(60)] + ["a b c d e f", "a b c d e f g", "a b c d e"]
    texts += [f"{prose(900, 30)} {prose(800 + k, 4_000)}" for k in range(12)] + [edited(prose(800, 4_000), r, 60)]  # longer sets than sketches have places
    sets = similar.shingle_sets(texts)
    rows = pd.DataFrame({"sk": np.arange(len(sets)), "n": [len(s) for s in sets], "sketch": [similar.sketch(s) for s in sets], "low": [np.arange(16)] * len(sets), "h": 0, "root": np.arange(len(sets)), "is_left": True, "alone": True})
    pairs = lambda rows, forest: set(map(tuple, similar.tile_candidates(rows, forest).to_numpy().tolist()))
    every, forest = pairs(rows, False), pairs(rows, True)
    alike = {(i, j) for i, j in combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert len(alike) > 50 and alike <= every and len(every) < 1.5 * len(alike) + 20 and forest <= every and len(forest) < len(sets)

    def groups(links):
        top = list(range(len(sets)))
        for i, j in links:
            top = [top[i] if x == top[j] else x for x in top]
        return {frozenset(k for k in range(len(top)) if top[k] == x) for x in top}

    assert groups(every) == groups(forest)
    left = rows.sk % 2 == 0
    assert pairs(rows.assign(is_left=left, alone=False), False) == {(i, j) for i, j in every if (i + j) % 2}
    assert not pairs(rows.assign(root=0), False)
    # all meet at 3 before 5, and only the first half at 4 as well; so at 5 no pair is left, and at 4 neither
    assert not pairs(rows.assign(h=5), False) and pairs(rows.assign(low=[np.full(16, (1 << 63) - 1)] * len(rows), h=5), False) == every
    half = [np.array([4, 5] + [(1 << 63) - 1] * 14) if k < len(rows) // 2 else np.array([5] + [(1 << 63) - 1] * 15) for k in range(len(rows))]
    assert pairs(rows.assign(low=half, h=5), False) == {(i, j) for i, j in every if j >= len(rows) // 2}


@pytest.mark.parametrize("shared, own", [(4, 1), (8, 2), (12, 3), (16, 2), (60, 9), (90, 22), (400, 50)])
def test_sketches_lose_no_pair_at_four_fifths(shared, own):
    """Sets of a similarity of 0.8 or little more, of all sizes."""
    r = np.random.default_rng(shared)
    for _ in range(300):
        h = np.unique(r.integers(0, 1 << 63, shared + own, dtype=np.uint64))
        a, b = h, np.unique(h[r.permutation(len(h))[:shared]])
        if 5 * len(b) >= 4 * len(a):
            s = [similar.sketches([similar.sketch(x)]) for x in (a, b)]
            assert similar.alike((np.array([len(a)]), np.array([len(b)])), tuple(s)).all()
            rows = pd.DataFrame({"sk": [1, 2], "n": [len(a), len(b)], "sketch": [similar.sketch(a), similar.sketch(b)], "low": [np.arange(16)] * 2, "h": 0, "root": [1, 2], "is_left": True, "alone": True})
            assert len(similar.tile_candidates(rows, False)) == 1


def test_language_memory_does_not_grow_with_languages():
    """Half a million characters and 200 languages in blocks, equal to one block."""
    import tracemalloc

    r = np.random.default_rng(1)
    names = [f"l{k:03}" for k in range(200)]
    logp = r.integers(-9_000, -10, (language.BUCKETS + 1, 200)).astype(np.int32)
    texts = ["".join(chr(97 + k) for k in r.integers(0, 26, 494_000)), "short text", None, "x", ""]
    tracemalloc.start()
    got = language.score(texts, names, logp)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    few = language.score(texts[1:], names[:3], logp[:, :3])
    whole = language.SUMS
    try:
        language.SUMS = 7
        again = language.score(texts[1:], names[:3], logp[:, :3])
    finally:
        language.SUMS = whole
    assert again[0] == few[0] and (again[1] == few[1]).all() and got[0][2] == "und"


def test_pii_reaches_patterns_many_hops_away(spark):
    """Pattern k stands around eight values that are known once pattern k - 1 is confident, and one that leads on; 25 hops."""
    spans = "array<struct<kind: string, start: int, end: int, value: string, pattern: string>>"
    values = [f"v{k:02}" for k in range(34)]
    seeds = [("email", 0, 1, v, "seeds") for v in values[:8]]
    rows = [(0, seeds, [])] + [(k + 1, [], [("id", 0, 1, v, f"p{k:02}") for v in values[k : k + 9]]) for k in range(25)] + [(99, [], [("id", 0, 1, v, "other") for v in ("v00", "v01", "v02", "x", "y")])]
    got = {r.pattern for r in pii.confident_patterns(spark.createDataFrame(rows, f"rk long, base {spans}, ids {spans}")).collect()}
    assert got == {"seeds", *(f"p{k:02}" for k in range(25))}
