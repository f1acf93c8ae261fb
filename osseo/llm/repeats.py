"""Operator 9, substring deduplication by seed and extend.

Seeds are winnowed anchors: hashes of GRAM words, chosen so that any LENGTH consecutive words hold one. Documents are joined
on anchors that stand in two different texts; there each match is extended both ways, to every run of LENGTH words that
holds the anchor, and runs that start in a document with a smaller doc_id as well are kept. Their union in a document is its
set of maximal repeats over the length threshold, whose words are removed. Whole copies of a text (but the smallest) are
found first, by a hash of all words, and need no anchors.

Each stage moves hashes, not texts; the texts cross the network once. Sums over an anchor or run hash are pre-aggregated
before the shuffle and hold one row each, so neither a group of copies nor a very common passage gathers in one task.

Defined results: null and empty texts have no words; a null doc_id is never smaller than another, and its words stay;
repeated rows (same doc_id and text) get equal results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm.rows import byte_class, chunks, map_texts, mix, powers, row_key, saved, span_hashes, spread_join, table, word_spans, written

LENGTH = 50
GRAM = 10
_WORD_BYTE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
RK = ["doc_id", "t1", "t2"]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def hashed_words(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Two hashes of each word of all texts, and the first word of each text (with the number of words at the end)."""
    data, starts, ends, owner = word_spans(texts, _WORD_BYTE)
    return [span_hashes(data, starts, ends, b) for b in _BASES], np.searchsorted(owner, np.arange(len(texts) + 1))


def run_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of each run of ``length`` words; a shorter input gives none."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words) + 1, base)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((words | np.uint64(1)) * up[: len(words)], out=total[1:])
    return mix((total[length:] - total[:n]) * down[:n])


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the least of some ``window`` consecutive ones (all of equal least ones)."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    low = _slide(grams, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, low, pad]), window, np.maximum) == grams)


def _surveyed(length: int, gram: int):
    def batch(texts: list) -> dict:
        plain = [t or "" for t in texts]
        both, first = hashed_words(plain)
        out: dict = {"n_words": np.diff(first), "seq1": [], "seq2": [], "all_sha256": [], "anchors": []}
        for k, text in enumerate(plain):
            own = [h[first[k] : first[k + 1]] for h in both]
            out["all_sha256"].append(sha256(b" ".join(text.encode().split())).hexdigest())
            for name, h, base in zip(("seq1", "seq2"), own, _BASES, strict=True):
                out[name].append(int(run_hashes(h, len(h), base).view(np.int64)[0]) if len(h) else 0)
            grams = run_hashes(own[0], gram, _BASES[1])
            out["anchors"].append(np.unique(grams[anchors(grams, length - gram + 1)]).view(np.int64))
        return out

    return batch


def survey(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, row key, number and hashes of all words, their digest, and the distinct anchors of each text."""
    keyed = docs.select("doc_id", row_key().alias("rk"), "text")
    kinds = {"n_words": T.LongType(), "seq1": T.LongType(), "seq2": T.LongType(), "all_sha256": T.StringType(), "anchors": T.ArrayType(T.LongType())}
    return map_texts(keyed, kinds, _surveyed(length, gram))


def _runs(length: int, gram: int):
    """Rows (doc_id, t1, t2, h1, h2, start; the first three are the row key) of the runs around the shared anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in chunks(batch.column("text").to_pylist()):
                both, first = hashed_words(texts)
                shared = batch.column("shared").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                parts: list[tuple] = []
                for k in range(hi - lo):
                    own = [h[first[k] : first[k + 1]] for h in both]
                    grams = run_hashes(own[0], gram, _BASES[1])
                    at = np.flatnonzero(np.isin(grams.view(np.int64), shared[k]))
                    n = len(own[0]) - length + 1
                    if n <= 0 or not len(at):
                        continue
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, np.clip(at + gram - length, 0, n), 1)
                    np.add.at(change, np.clip(at + 1, 0, n), -1)
                    starts = np.flatnonzero(np.cumsum(change[:n]) > 0)
                    parts.append((k, starts, run_hashes(own[0], length, _BASES[0])[starts], run_hashes(own[1], length, _BASES[1])[starts]))
                if parts:
                    of = np.repeat([lo + p[0] for p in parts], [len(p[1]) for p in parts])
                    joined = [np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(pa.array(of)) for c in RK), pa.array(joined[1].view(np.int64)), pa.array((joined[2] >> np.uint64(33)).astype(np.int32)), pa.array(joined[0].astype(np.int32))],
                        names=[*RK, "h1", "h2", "start"],
                    )

    return run


def _cut(length: int):
    """Number of removed words, digest and text of the kept ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                removed, digests, texts = [], [], []
                for text, starts in zip(part.column("text").to_pylist(), part.column("starts").to_numpy(zero_copy_only=False), strict=True):
                    words = text.encode().split()
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    removed.append(int(gone.sum()))
                    digests.append(sha256(kept).hexdigest())
                    texts.append(kept.decode())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in RK), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts)], names=[*RK, "n_removed", "kept_sha256", "kept_text"])

    return run


def removed_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Row key, doc_id, n_words, n_removed, kept_sha256, and kept_text of the rows that lose some but not all words (else null)."""
    seen = saved(survey(docs, length, gram))
    long_rows = seen.where(F.col("n_words") >= length)
    first = saved(long_rows.groupBy("seq1", "seq2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi"))
    copies = spread_join(long_rows, first, ["seq1", "seq2"]).where("doc_id > lo").select("rk").distinct()
    seeds = long_rows.select("rk", "seq1", F.explode("anchors").alias("anchor"))
    shared = saved(seeds.groupBy("anchor").agg(F.min("seq1").alias("a"), F.max("seq1").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", "n"))
    at = spread_join(seeds.select("rk", "anchor"), shared, ["anchor"]).groupBy("rk").agg(F.collect_set("anchor").alias("shared"))  # no more than a text has
    wanted = at.join(copies, "rk", "left_anti")
    # the one time that texts are dealt; what follows reads the rows with shared anchors only
    texts = written(docs.select(row_key().alias("rk"), "text").join(wanted.hint("merge"), "rk").select("rk.*", "text", "shared"))
    runs = saved(texts.mapInArrow(_runs(length, gram), "doc_id long, t1 long, t2 long, h1 long, h2 int, start int"))
    least = saved(runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h1", "h2", "lo", "n"))
    found = spread_join(runs, least, ["h1", "h2"]).where("doc_id > lo").groupBy(*RK).agg(F.collect_set("start").alias("starts"))  # no more than a text has
    cut = texts.select(*RK, "text").join(found.hint("merge"), RK).mapInArrow(_cut(length), "doc_id long, t1 long, t2 long, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(RK)
    cut = cut.select(F.struct(*RK).alias("rk"), "n_removed", "kept_sha256", "kept_text")
    out = seen.select("rk", "doc_id", "n_words", "all_sha256").join(copies.withColumn("copy", F.lit(True)), "rk", "left").join(cut, "rk", "left")
    whole = F.coalesce("copy", F.lit(False))
    return out.select(
        "rk",
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
