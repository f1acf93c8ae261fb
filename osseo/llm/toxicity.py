"""Operator 2, toxicity: a counterfactual-regularised classifier.

Words and word beginnings are hashed to buckets. Over the labelled rows Spark counts, per bucket, the toxic and other documents that hold it;
the buckets that tell most (by signed log-odds) and those of all identity terms become features. A logistic model is fitted
to a bounded sample of labelled rows with a second loss: each labelled sentence with an identity term is repeated with that
term swapped for each other of its group, and the squared change of the score is penalised. Mentions of a group as such so
get no weight of their own. Scoring is one sparse dot product per whole text.

Defined results: null and empty texts score as the model's text without any feature; texts of any length count whole, each
word once; repeated rows score alike; without labels of both kinds all scores are the share of label 1 (0 if there is none);
a null doc_id is neither held out nor learned from; a label row counts for each document row with its doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm.rows import bounded_sample, byte_class, chunks, map_texts, mix, small, span_hashes, table, word_spans

BUCKETS = 1 << 20
FEATURES = 2048
#: Labelled rows that the fit reads at most (in expectation; chosen by a hash of doc_id).
TRAIN_ROWS = 20_000
#: A bucket is a candidate feature from so many labelled documents on.
LEAST_DOCS = 5
PENALTY = 4.0
#: Bytes of word beginnings that are features too: they catch stems whose endings vary.
BEGINNINGS = (4, 6)
THRESHOLD = 0.7
# Identity terms by group; a term may be swapped for any other of its group.
IDENTITY = [
    ["women", "men"],
    ["woman", "man"],
    ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "lesbian", "bisexual", "straight", "transgender"],
    ["immigrant", "citizen", "refugee", "native"],
    ["immigrants", "citizens", "refugees", "natives"],
    ["old", "young", "elderly"],
    ["disabled", "deaf", "blind"],
]
_WORD_BYTE = byte_class(lambda b: 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b >= 0x80)
_SENTENCE = regex.compile(r"[^.!?\n]+")


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each different word, and each different word beginning, of each text (lower case; whole texts)."""
    data, starts, ends, at = word_spans([t.lower() for t in texts], _WORD_BYTE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = [at * BUCKETS + (span_hashes(data, starts, ends) >> np.uint64(44)).astype(np.int64)]
    for size in BEGINNINGS:
        longer = ends - starts > size
        h = mix(span_hashes(data, starts[longer], starts[longer] + size) + np.uint64(size))
        keys.append(at[longer] * BUCKETS + (h >> np.uint64(44)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key // BUCKETS, key % BUCKETS


def swaps(text: str) -> Iterator[tuple[str, str]]:
    """Sentences of the text that hold identity terms, each with every swapped version."""
    groups = {t: g for g in IDENTITY for t in g}
    for sentence in _SENTENCE.findall(text.lower()):
        for word in set(regex.findall(r"\w+", sentence)) & groups.keys():
            for other in groups[word]:
                if other != word:
                    yield sentence, regex.sub(rf"\b{word}\b", other, sentence)


def in_turn(items: Iterable, size: int) -> Iterator[list]:
    """The items in lists of ``size`` at most."""
    held: list = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def bucket_counts(labelled: DataFrame) -> DataFrame:
    """bucket, docs with label 1 and docs that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, _, texts in chunks(batch.column("text").to_pylist()):
                of, bucket = word_buckets([t or "" for t in texts])
                sums[0] += np.bincount(bucket[toxic[lo + of] == 1], minlength=BUCKETS)
                sums[1] += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["bucket", "toxic", "docs"])

    return labelled.select("text", "toxic").mapInArrow(run, "bucket int, toxic long, docs long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))


def chosen_buckets(counts: DataFrame, docs: int, toxic: int, features: int) -> np.ndarray:
    """The buckets that tell most: the highest log-likelihood ratio of label and presence; and all identity terms."""
    a, n = F.col("toxic"), F.col("docs")
    part = lambda x, total: F.when(x > 0, x * F.log(x / (total + 1e-9))).otherwise(0.0)
    gain = part(a, n * toxic / docs) + part(n - a, n * (docs - toxic) / docs) + part(toxic - a, (docs - n) * toxic / docs) + part(docs - toxic - n + a, (docs - n) * (docs - toxic) / docs)
    # beyond chance for the number of buckets tried: twice the gain is a chi-square of one degree
    best = counts.where(n >= LEAST_DOCS).select("bucket", gain.alias("gain")).where("gain > 8").orderBy(F.col("gain").desc(), "bucket").limit(features).toPandas()
    return np.unique(np.concatenate([best.bucket.to_numpy(np.int64), word_buckets([" ".join(t for g in IDENTITY for t in g)])[1]]))


def changes(pairs: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """i * n + j and value of the non-zero entries of the sum of d d^T, d the change of the n features in each swapped pair."""
    total: Counter[int] = Counter()
    for a, b in pairs:
        d = [(k, 1) for k in set(a.tolist()) - set(b.tolist())] + [(k, -1) for k in set(b.tolist()) - set(a.tolist())]
        for i, x in d:
            for j, y in d:
                total[i * n + j] += x * y
    return np.array([*total], np.int64), np.array([*total.values()], np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray, swapped: tuple[np.ndarray, np.ndarray], pairs: int, n: int, penalty: float = PENALTY, l2: float = 3e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss (both classes weigh the same) + l2 + penalty * mean squared change of the score over the swapped pairs.

    ``swapped``: what ``changes`` gives for all ``pairs`` pairs; the mean square is a quadratic form of the weights.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    row, column = swapped[0] // n, swapped[0] % n
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias, v, vb = np.zeros(n), 0.0, np.zeros(n), 0.0
    gw, gb = np.full(n, 1e-8), 1e-8  # sums of squares, for steps of each weight's own size
    for _ in range(rounds):
        z = np.bincount(at, w[col], len(rows)) + bias
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(col, r[at], n) + l2 * w
        if pairs:
            grad += penalty * 2 / pairs * np.bincount(row, swapped[1] * w[column], n)
        gw, gb = 0.95 * gw + 0.05 * grad**2, 0.95 * gb + 0.05 * r.sum() ** 2
        v, vb = 0.9 * v + grad / np.sqrt(gw), 0.9 * vb + r.sum() / np.sqrt(gb)
        w, bias = w - 0.01 * v, bias - 0.01 * vb
    return w, bias


def train(labelled: DataFrame, features: int = FEATURES, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets (ascending), their weights and the bias; ``labelled`` has doc_id, text, toxic (0 or 1)."""
    known = labelled.where("toxic IN (0, 1)")
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not 0 < total.toxic < total.n:
        return np.zeros(0, np.int64), np.zeros(0), 30.0 if total.n and total.toxic == total.n else -30.0
    buckets = chosen_buckets(bucket_counts(known), total.n, total.toxic, features)
    context = labelled.sparkSession.sparkContext
    chosen = context.broadcast(buckets)

    def held(texts: list[str]) -> list[np.ndarray]:
        of, bucket = word_buckets(texts)
        ok = np.isin(bucket, chosen.value)
        return np.split(np.searchsorted(chosen.value, bucket[ok]), np.searchsorted(of[ok], np.arange(1, len(texts))))

    def batch(texts: list) -> dict:
        own = [t or "" for t in texts]
        return {"x": [r.tolist() for r in held(own)]}

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = Counter(), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                for some in in_turn(swaps(text or ""), 256):
                    at = held([t for pair in some for t in pair])
                    total.update(dict(zip(*map(np.ndarray.tolist, changes(zip(at[::2], at[1::2]), len(buckets))))))
                    pairs += len(some)
        keys = [-1, *total]  # the number of pairs goes under -1
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([pairs, *total.values()], pa.int64())], names=["entry", "value"])

    sample = bounded_sample(known, "doc_id", train_rows).select("toxic", "text")
    got = map_texts(sample, {"x": T.ArrayType(T.IntegerType())}, batch).collect()  # a bounded sample, reduced to features
    sums = sample.select("text").mapInArrow(swapped, "entry long, value long").groupBy("entry").agg(F.sum("value").alias("value")).toPandas()  # the square of the features at most
    entry, value = sums.entry.to_numpy(np.int64), sums.value.to_numpy(np.int64)
    y = np.array([r.toxic for r in got], float)
    if not 0 < y.sum() < len(y):
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((total.toxic + 0.5) / (total.n - total.toxic + 0.5)))
    form = entry >= 0
    w, bias = fit([np.array(r.x, np.int64) for r in got], y, (entry[form], value[form]), int(value[~form].sum()), len(buckets))
    return buckets, w, bias


def score(docs: DataFrame, buckets: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """Adds score (0 to 1) to ``docs`` and drops its text."""
    model = docs.sparkSession.sparkContext.broadcast((buckets, weights))

    def batch(texts: list) -> dict:
        names, w = model.value
        of, bucket = word_buckets([t or "" for t in texts])
        at = np.minimum(np.searchsorted(names, bucket), max(len(names) - 1, 0))
        z = np.bincount(of, np.where(names[at] == bucket, w[at], 0.0), len(texts)) if len(names) else np.zeros(len(texts))
        return {"score": 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))}

    return map_texts(docs, {"score": T.DoubleType()}, batch)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = lambda c: F.crc32(F.col(c).cast("string")) % 3
    learnable = labels.where(part("doc_id") != 1).where("toxic IN (0, 1)").select("doc_id", "toxic")
    model = train(docs.where(part("doc_id") != 1).select("doc_id", "text").join(small(learnable, 200_000), "doc_id"))
    scored = score(docs.select("doc_id", F.coalesce(part("doc_id") == 1, F.lit(False)).alias("held_out"), "text"), *model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
