"""Every query over odd and over empty tables."""

import math

import pytest

from osseo.llm.queries import QUERIES
from tests.llm import brute


@pytest.fixture(scope="module")
def got(spark, odd):
    return {name: query(spark, odd).collect() for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op4_topk", "op11_vector_codes"}))
def test_one_row_per_document_row(spark, odd, got, name):
    ids = [r.doc_id for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id").collect()]
    key = lambda x: (x is None, x or 0)
    assert sorted((r.doc_id for r in got[name]), key=key) == sorted(ids, key=key)


def texts(spark, odd):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{odd}/documents.parquet").where("doc_id IS NOT NULL").collect()}


def by_id(rows):
    return {r.doc_id: r for r in rows if r.doc_id is not None}


def test_language(got):
    rows = by_id(got["op1_language_id"])
    assert [rows[i].lang_pred for i in (1, 2, 3, 19)] == ["und"] * 4 and rows[18].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows.values())


def test_toxicity(got):
    rows = by_id(got["op2_toxicity"])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())


def test_simhash(spark, odd, got):
    known, rows = texts(spark, odd), by_id(got["op3_simhash"])
    ids = sorted(known)
    prints = [brute.fingerprint(known[i]) for i in ids]
    assert [int(rows[i].fingerprint, 16) for i in ids] == prints
    assert [rows[i].component_id for i in ids] == [ids[k] for k in brute.linked(prints)]


def test_top_k(spark, odd, got):
    v = {}
    for r in spark.read.parquet(f"{odd}/embeddings.parquet").collect():
        if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            v[r.vec_id] = [math.floor(256 * x) for x in r.embedding]
    want = []
    for q in sorted(i for i in v if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got["op4_topk"]) == want


def test_bpe(spark, odd, got):
    from tokenizers import Tokenizer

    from osseo.llm.bpe import default_file

    t, rows = Tokenizer.from_file(default_file()), by_id(got["op5_bpe"])
    for i, text in texts(spark, odd).items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False)))


def test_decontamination(spark, odd, got):
    rows = by_id(got["op6_decontamination"])
    assert {i: r["items"] for i, r in rows.items() if r.contaminated} == {8: "1,5", 9: "1,5", 18: "4"}


def test_pii(spark, odd, got):
    rows = by_id(got["op7_pii"])
    for i, text in texts(spark, odd).items():
        base = brute.base_spans(text)
        assert rows[i].base_sha256 == brute.sha(",".join(base)), i
        assert [rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone")]
        assert (rows[i].spans + ",").startswith(",".join(base))


def test_quality(got):
    rows = by_id(got["op8_quality"])
    assert all(rows[i].score == 0 and not rows[i].keep for i in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_repeats(spark, odd, got):
    rows = by_id(got["op9_substring_dedup"])
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in rows.items()} == brute.repeats(texts(spark, odd))


def test_licenses(spark, odd, got):
    rows = by_id(got["op10_license_scan"])
    for i, text in texts(spark, odd).items():
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_facts(text)
        assert {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} - {""} and 0 <= r.score <= 1
    assert rows[15].labels == "" and rows[26].labels == "apache" and 0.8 < rows[26].score < 1 and rows[26].spans == "apache:0:7:2"


def test_vector_codes(spark, odd, got):
    rows = spark.read.parquet(f"{odd}/embeddings.parquet").collect()
    want = brute.vector_codes([(r.vec_id, r.embedding, None) for r in rows])
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got["op11_vector_codes"]), key=order) == sorted(want, key=order)


def test_rules(spark, odd, got):
    rows = by_id(got["op12_quality_rules"])
    for i, text in texts(spark, odd).items():
        want = brute.rule_facts(text)
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words, rows[i].base_failed) == want, i
        assert not (rows[i].kept and rows[i].base_failed)


def test_alignment(spark, odd, got):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[n] for n in names) for r in got["op13_alignment"]), key=key) == sorted(brute.alignment(documents), key=key)
