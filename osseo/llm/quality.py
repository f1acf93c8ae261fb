"""Operator 8, quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every whole text. Expectation-maximisation over the counts of all
vote patterns (a table of bounded size, from all documents) estimates how often each labeller votes what on good and bad
documents, and gives every pattern a posterior. Posteriors then train a hashed linear scorer over word shapes on a bounded
sample of documents, and the scorer judges all of them.

Defined results: null and empty texts, and texts without a word, score 0 and are rejected; texts of any length count whole;
repeated rows score alike; an empty table gives an empty result; extra columns are ignored by the query and kept by filters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm.rows import bounded_sample, byte_class, map_texts, span_hashes, table, word_spans

BUCKETS = 1 << 14
#: Documents that the scorer's fit reads at most (in expectation; chosen by a hash of doc_id). The vote counts read all.
TRAIN_ROWS = 20_000
THRESHOLD = 0.5
SMOOTHING = 10
_WORD_BYTE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_LETTER, _UPPER, _DIGIT, _POINT, _SYMBOL, _SPACE = range(6)
_KIND = np.array(
    [
        _SPACE if b == 0x20 or 0x09 <= b <= 0x0D else _UPPER if 0x41 <= b <= 0x5A else _LETTER if 0x61 <= b <= 0x7A or b >= 0x80 else _DIGIT if 0x30 <= b <= 0x39 else _POINT if chr(b) in ".,;:?!'\"()-" else _SYMBOL
        for b in range(256)
    ],
    np.uint8,
)
# each kind but letters, upper case and digits keeps its own byte in a word's shape
_SHAPE = np.array([_KIND[b] if _KIND[b] in (_LETTER, _UPPER, _DIGIT) else max(b, 6) for b in range(256)], np.uint8)
LABELLERS = ["symbols", "upper_case", "repeated_words", "distinct_words", "exclamations", "bare_symbols", "repeated_lines", "sentences"]
GOOD, BAD, NONE = 1, 0, -1


def _per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n)


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """Shares and counts that the labellers look at, for each text."""
    raw = [t.encode() for t in texts]
    data, starts, ends, owner = word_spans(texts, _WORD_BYTE)
    n, kind = len(texts), _KIND[data]
    of_byte = np.repeat(np.arange(n), [len(r) + 1 for r in raw])
    kinds = np.bincount(of_byte * 6 + kind, minlength=n * 6).reshape(n, 6)
    hashes, words = span_hashes(data, starts, ends), _per_text(owner, n)
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])]) if len(hashes) else np.zeros(0, bool)
    by = np.lexsort((hashes, owner))
    fresh = np.concatenate([[True], (hashes[by][1:] != hashes[by][:-1]) | (owner[by][1:] != owner[by][:-1])]) if len(hashes) else np.zeros(0, bool)
    letters = np.concatenate([[0], np.cumsum((kind <= _DIGIT).astype(np.int64))])
    bare = letters[ends] == letters[starts]
    tail = (kind[ends - 1] == _SYMBOL) if len(ends) else np.zeros(0, bool)
    lines = [[x for x in r.split(b"\n") if len(x) >= 20] for r in raw]
    again = np.array([len(x) - len({*x}) for x in lines], float)
    ended = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    shout = (data[ends - 1] == ord("!")) if len(ends) else np.zeros(0, bool)
    shown = np.maximum(kinds[:, :5].sum(1), 1)
    some = np.maximum(words, 1)
    return {
        "words": words,
        "symbols": kinds[:, _SYMBOL] / shown,
        "upper_case": kinds[:, _UPPER] / np.maximum(kinds[:, _UPPER] + kinds[:, _LETTER], 1),
        "repeated_words": _per_text(owner, n, same) / some,
        "distinct_words": _per_text(owner[by], n, fresh) / np.sqrt(some),
        "exclamations": _per_text(owner, n, shout) / some,
        "bare_symbols": _per_text(owner, n, bare | tail) / some,
        "repeated_lines": again / np.maximum([len(x) for x in lines], 1),
        "sentences": _per_text(owner, n, ended) / some,
    }


def votes(texts: list[str]) -> np.ndarray:
    """Text x labeller: GOOD, BAD or NONE."""
    s = statistics(texts)
    enough = s["words"] >= 50
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
    out = [
        pick(s["symbols"] > 0.05, s["symbols"] < 0.02),
        pick(s["upper_case"] > 0.3, s["upper_case"] < 0.15),
        pick(s["repeated_words"] > 0.2, s["repeated_words"] < 0.05),
        pick(enough & (s["distinct_words"] < 2), enough & (s["distinct_words"] > 4)),
        pick(s["exclamations"] > 0.3, s["exclamations"] < 0.05),
        pick(s["bare_symbols"] > 0.2, s["bare_symbols"] < 0.05),
        pick(s["repeated_lines"] > 0.3, s["repeated_lines"] < 0.1),
        pick(enough & ((s["sentences"] < 0.005) | (s["sentences"] > 0.6)), (s["sentences"] > 0.01) & (s["sentences"] < 0.4)),
    ]
    got = np.stack(out, 1)
    got[s["words"] == 0] = BAD
    return got


def labeller_model(patterns: pd.DataFrame, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents, and P(vote | class) as class x labeller x vote (BAD, GOOD, NONE), by EM over vote patterns."""
    v, n = np.array(patterns.votes.tolist(), np.int64), patterns.n.to_numpy(float)
    p = np.where((v == BAD).any(1), 0.1, 0.9)
    share, table_of = 0.5, np.full((2, v.shape[1], 3), 1 / 3)
    column = np.arange(v.shape[1])
    for _ in range(rounds):
        share = (n @ p + 1) / (n.sum() + 2)
        for c, weight in ((GOOD, n * p), (BAD, n * (1 - p))):
            for vote in (BAD, GOOD, NONE):
                table_of[c, :, vote] = (weight @ (v == vote) + 0.1) / (weight.sum() + 0.3)
        fit = lambda c: np.log(table_of[c, column, v]).sum(1)
        new = 1 / (1 + np.exp(np.clip(fit(BAD) - fit(GOOD) + np.log((1 - share) / share), -50, 50)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return share, table_of


def posterior(v: np.ndarray, share: float, table_of: np.ndarray) -> np.ndarray:
    column = np.arange(v.shape[1])
    fit = [np.log(table_of[c, column, v]).sum(1) for c in (BAD, GOOD)]
    return 1 / (1 + np.exp(np.clip(fit[0] - fit[1] + np.log((1 - share) / share), -50, 50)))


def shape_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and smoothed share among the text's words of each word shape and each pair of shapes.

    SMOOTHING words without a shape are added to each text, so that very short ones stay near the prior.
    A word's shape is its bytes by kind, runs collapsed; a word that equals the one before has a shape of its own.
    """
    data, starts, ends, owner = word_spans(texts, _WORD_BYTE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    shape = _SHAPE[data]
    first = np.zeros(len(data), bool)
    first[starts] = True
    keep = np.concatenate([[True], shape[1:] != shape[:-1]]) | first
    moved = np.concatenate([[0], np.cumsum(keep)])
    h = span_hashes(shape[keep], moved[starts], moved[ends])
    words = span_hashes(data, starts, ends)
    one_text = owner[1:] == owner[:-1]
    h[1:][(words[1:] == words[:-1]) & one_text] = 1
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xD1342543DE82EF95))[one_text]
    both = np.concatenate([owner * BUCKETS + (h >> np.uint64(51)).astype(np.int64), owner[1:][one_text] * BUCKETS + BUCKETS // 2 + (pairs >> np.uint64(51)).astype(np.int64)])
    key, n = np.unique(both, return_counts=True)
    return key // BUCKETS, key % BUCKETS, n / (np.bincount(owner, minlength=len(texts)) + SMOOTHING)[key // BUCKETS]


def fit_linear(at: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels y; the bias is the log-odds of their mean, so a text without evidence gets the prior."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    w, v, squares = np.zeros(BUCKETS), np.zeros(BUCKETS), np.full(BUCKETS, 1e-10)
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(np.bincount(at, w[col] * x, len(y)) + bias, -30, 30))) - y) / len(y)
        g = np.bincount(col, r[at] * x, BUCKETS) + l2 * w
        squares = 0.95 * squares + 0.05 * g**2
        v = 0.9 * v + g / np.sqrt(squares)
        w = w - 0.02 * v
    return w, bias


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias of the scorer; ``docs`` has doc_id and text."""
    voted = map_texts(docs.select("doc_id", "text"), {"votes": T.ArrayType(T.IntegerType())}, lambda texts: {"votes": _lists(votes([t or "" for t in texts]))})
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).toPandas()  # 3 ** labellers patterns at most
    if patterns.empty:
        return np.zeros(BUCKETS), 0.0
    share, table_of = labeller_model(patterns)

    def batch(texts: list) -> dict:
        own = [t or "" for t in texts]
        of, bucket, x = shape_features(own)
        ends = np.searchsorted(of, np.arange(len(own) + 1)).astype(np.int32)
        arrays = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return {"p": posterior(votes(own), share, table_of), "bucket": arrays(bucket.astype(np.int32)), "x": arrays(x)}

    kinds = {"p": T.DoubleType(), "bucket": T.ArrayType(T.IntegerType()), "x": T.ArrayType(T.DoubleType())}
    got = map_texts(bounded_sample(docs.select("doc_id", "text"), "doc_id", train_rows), kinds, batch).drop("doc_id").toPandas()  # a bounded sample, reduced to shapes
    if got.empty:
        return np.zeros(BUCKETS), 0.0
    at = np.repeat(np.arange(len(got)), got.bucket.map(len))
    return fit_linear(at, np.concatenate(got.bucket.tolist()).astype(np.int64), np.concatenate(got.x.tolist()).astype(float), got.p.to_numpy())


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.astype(np.int32).ravel()))


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher is better) to ``docs`` and drops its text (a field of a struct stays)."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def batch(texts: list) -> dict:
        own = [t or "" for t in texts]
        of, bucket, x = shape_features(own)
        z = np.bincount(of, model.value[bucket] * x, len(own)) + bias
        some = np.bincount(of, minlength=len(own)) > 0
        return {"score": np.where(some, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)}

    return map_texts(docs, {"score": T.DoubleType()}, batch, text)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *train(docs)).select("doc_id", "score", (F.col("score") >= THRESHOLD).alias("keep"))
