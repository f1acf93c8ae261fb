"""Operators 11 to 13 against brute force, beyond the odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from osseo.llm import align, codes, ledger
from tests.conftest import SF
from tests.llm import brute


def test_alignment_of_a_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = align.op13_alignment(spark, SF).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(brute.alignment([(r.doc_id, r.text) for r in rows]))


def adversarial(n: int) -> list[str]:
    r = random.Random(5)
    parts = ["a", "é", "é", " ", "  ", "\n", "\t", "\r\n", "▁", " ", "　", "\x85", "\x1c", "\x00", "日本", "'s", "'ll", "<s>", "</s>", "<0x41>", "<unk>", "<|endoftext|>", "1234", "x1y2", "🙂", "﻿", "​", "the", "tion", "....", "�"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_alignment_of_adversarial_texts(spark):
    documents = [*enumerate(adversarial(1_500))]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    seen = align.kept(docs)
    want = {d[0]: d for d in brute.alignment(documents)}
    for r in seen.collect():
        assert (r.n_a, r.n_b, r.n_groups, r.groups_sha256) == (*want[r.doc_id][1:4], want[r.doc_id][7]), documents[r.doc_id]
    table = align.link_table(seen).collect()
    assert len({(r.a, r.b) for r in table}) == len(table) and sum(r.n for r in table) == sum(w[4] for w in want.values())
    assert sum(r.n for r in table if r.best) == sum(w[5] for w in want.values())


def test_alignment_forgets_segments_and_takes_long_ones(monkeypatch):
    texts = [brute_text(k) for k in range(30)] + ["b" * 100_000, "word " * 20_000, " \n", None, ""]
    want = [(w[1], w[2], w[3], w[7]) for w in brute.alignment([*enumerate(texts)])]
    known = align.Aligner(align.default_file(), align.default_pieces())

    def facts(texts):
        got = known.counted(texts)
        return [*zip(got["n_a"].tolist(), got["n_b"].tolist(), got["n_groups"].tolist(), got["groups_sha256"])]

    assert facts(texts) == want and facts(texts) == want
    monkeypatch.setattr(align, "STORED", 10)
    monkeypatch.setattr(align, "STRING", 30)
    assert [facts([t])[0] for t in texts] == want
    assert len(known.slots) == len(known.groups) <= 40 and known.ordered is not None and all(len(e) == len(known.groups) + 1 and e[-1] == len(v) for e, v in zip(known.ends, known.links))


def brute_text(seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeinorst") for _ in range(r.randint(1, 6))) for _ in range(20))


def test_forgetting_keeps_what_came_again(monkeypatch):
    known = align.Aligner(align.default_file(), align.default_pieces())
    first = known.counted(["one two three four", "one two"])
    monkeypatch.setattr(align, "STORED", 4)
    known.forget()
    assert [*known.slots] == [] or {*known.slots} == {" one", " two"}
    again = known.counted(["one two three four", "one two"])
    assert again["groups_sha256"] == first["groups_sha256"] and again["same"].equals(first["same"]) and again["pairs_n"].equals(first["pairs_n"])


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e13])
def test_codes_of_hot_vectors(spark, scale):
    """A third of the rows are one vector, others lie near it, and ties are common; large components need Python integers."""
    r = random.Random(9)
    vectors = [[r.randint(-3, 3) * scale / 8 for _ in range(8)] for _ in range(60)]
    rows = [(k, vectors[0] if k % 3 == 0 else [x + r.choice([0, 0, scale / 512]) for x in vectors[k % 60]], None if k % 5 == 0 else k % 3, "x") for k in range(420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")
    log = []
    coded, books = codes.compressed(codes.quantised(df), entries=40, kept=4, log=log)
    got = {(x.vec_id, x.code.hex(), x.error) for x in coded.collect()}
    assert got == {(i, c, min(e, 2**63 - 1)) for i, c, e, *_ in brute.vector_codes([x[:3] for x in rows], entries=40)}
    assert len(log) == codes.ROUNDS and any(looked[1 : codes.MOST + 1].sum() for _, looked in log)


def test_bounds_are_bounds():
    r = np.random.default_rng(3)
    x, book = r.integers(-500, 500, (300, 6)), r.integers(-500, 500, (64, 6))
    state, error = codes.Bounds.searched(x, book, 8)
    for b in (8, 5, 16, 6, 6):
        new = book + r.integers(-30, 31, book.shape)
        state, error, looked = state.moved(x, new, codes._root(codes.distances(new, book), True), b)
        book, exact = new, codes.all_distances(x, new)
        assert (state.near[:, 0] == exact.argmin(1)).all() and (error == exact.min(1)).all() and state.near.shape[1] == b
        root = np.sqrt(np.take_along_axis(exact, state.near.astype(int), 1))
        assert ((state.low[:, :-1] <= root) | np.isinf(state.low[:, :-1])).all()
        others = exact.copy()
        np.put_along_axis(others, state.near.astype(int), np.iinfo(np.int64).max, 1)
        assert (state.low[:, -1] <= np.sqrt(others.min(1))).all()
    assert (looked <= 6).any() and (looked == 7).any()


def test_adapted():
    looked = np.zeros(codes.MOST + 2, int)
    looked[[1, 2, codes.MOST + 1]] = 90, 10, 5
    assert codes.adapted(looked, 16) == codes.LEAST
    looked[codes.MOST + 1] = 50
    assert codes.adapted(looked, 16) == 32


def test_ablations_against_the_texts(spark):
    rows = ledger.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    bits = [(r.source, r.failed) for r in rows.select("source", "failed").collect()]
    kept = lambda failed, p: not failed & p.hard and (failed & p.soft).bit_count() <= p.allowed
    want = {}
    for source, failed in bits:
        for v, p in ledger.POLICIES.items():
            for rule, bit in ledger.BITS.items():
                if bit & (p.hard | p.soft):
                    w = want.setdefault((source, v, rule), [0] * 4)
                    w[0] += 1
                    w[1] += bool(failed & bit)
                    w[2] += kept(failed, p)
                    w[3] += kept(failed & ~bit, p) and not kept(failed, p)
    got = {(r.source, r.policy, r.rule): [r.n_rows, r.n_failed, r.n_kept, r.n_gained] for r in ledger.ablations(rows, ("source",)).collect()}
    assert got == want
    # a policy reads the ledger only, and an older version gives what it gave
    judged = ledger.judged(rows, "1")
    assert judged.where(F.col("kept") != (F.col("failed") == 0)).isEmpty() and judged.first().policy == "1"


def test_rules_keep_clean_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = ledger.op12_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    wrong = sum(r["count"] for r in got if r.quality == 1 and not r.base_failed and not r.kept) + sum(r["count"] for r in got if r.quality == 0 and r.kept)
    assert wrong == 0
