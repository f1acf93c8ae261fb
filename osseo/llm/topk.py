"""Operator 4, exact top-k inner products by the threshold algorithm.

Candidates are cut into blocks and stay there; queries come by as a stream. A block sorts its rows once per dimension; for a
query the lists are read from the end that the sign of the query's component favours, in steps whose length follows the size
of that component. Rows met are scored whole. No unmet row can exceed the bound: the greatest product with the query of any
vector whose components are at most the values at the reading positions and whose length is at most that of the block's
longest row. Reading stops once the k-th score is above the bound (not merely equal: an unmet row might tie with a smaller
id) or no row is unmet. A query's k best of each block meet in a window, with the number of rows that were scored for it.

Defined results: vectors that are null, or hold null or non-finite components, take no part; only vectors of one length are
compared; repeated rows (same vec_id and vector) count once; rows with the query's vec_id are not its candidates; ties go to
the smaller vec_id; a query without candidates gives no row; a null vec_id takes no part; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from osseo.llm.rows import table

#: Rows of a block of candidates (in expectation; rows are dealt by a hash).
BLOCK = 8192


class Block:
    """Candidate rows with their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.v, self.order, 0)
        self.f = self.v.astype(np.float64)
        self.longest = float(np.sqrt((self.f * self.f).sum(1).max(initial=0)))
        self.exact = float(np.abs(self.v).max(initial=0))

    def bound(self, weight: np.ndarray, caps: np.ndarray) -> float:
        """The greatest sum of weight * x over vectors x of length ``longest`` at most with x <= caps; weights are positive.

        With caps from 0 on, the best x is min(caps, s * weight) for the s that uses up the length, or caps if they are no longer
        than that; a negative cap is paid in full, the rest is as if alone.
        """
        below = float(weight @ np.minimum(caps, 0))
        free = np.maximum(caps, 0)
        order = np.argsort(free / weight)
        w, c = weight[order], free[order]
        capped = np.concatenate([[0.0], np.cumsum(c * c)])
        left = np.concatenate([np.cumsum((w * w)[::-1])[::-1], [0.0]])
        # those components are at their caps that s * weight reaches before min(caps, s * weight) is ``longest``; others share what length is left
        j = int(np.searchsorted(capped[:-1] + (c / w) ** 2 * left[:-1], self.longest**2))
        return below + float(w[:j] @ c[:j] + np.sqrt(max(self.longest**2 - capped[j], 0) * left[j]))

    def best(self, query: np.ndarray, own: int, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best candidates for the query (not ``own``), and how many rows were scored."""
        n, dims = self.v.shape
        fast = self.exact * float(np.abs(query).max(initial=0)) * max(1, dims) < 2**53
        live = np.flatnonzero(query)
        down, weight = query[live] > 0, np.abs(query[live]).astype(np.float64)
        pace = weight / weight.max(initial=1)
        seen = np.zeros(n, bool)
        top_ids, top_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, scored, q = np.zeros(len(live), np.int64), 0, query.astype(np.float64)
        while True:
            upto = np.minimum(n, depth + np.ceil(step * pace).astype(np.int64))
            met = np.full(n, not len(live))  # a query of zeros has no list: all rows score 0
            for d, high, a, b in zip(live.tolist(), down.tolist(), depth.tolist(), upto.tolist()):
                met[self.order[n - b : n - a, d] if high else self.order[a:b, d]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            scored += len(new)
            s = np.rint(self.f[new] @ q).astype(np.int64) if fast else self.v[new] @ query
            ids = self.ids[new]
            keep = ids != own
            top_ids, top_scores = np.concatenate([top_ids, ids[keep]]), np.concatenate([top_scores, s[keep]])
            at = np.lexsort((top_ids, -top_scores))[:k] if len(top_ids) <= 4 * k else _first(top_ids, top_scores, k)
            top_ids, top_scores = top_ids[at], top_scores[at]
            if scored == n:
                return top_ids, top_scores, scored
            caps = np.where(down, self.sorted[np.maximum(n - upto, 0), live], -self.sorted[np.minimum(upto, n) - 1, live])
            if len(top_ids) == k and top_scores[-1] > self.bound(weight, caps.astype(np.float64)) + 1e-6 * self.longest * (1 + weight.sum()):
                return top_ids, top_scores, scored
            depth, step = upto, step * 4


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, and how many rows were scored for the query; both inputs have vec_id and v, an array of long without nulls."""
    asked = queries.dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-vectors.count() // block))
    # a candidate goes to its block only, after which the queries (which every candidate must meet) stream by
    left = vectors.dropDuplicates(["vec_id", "v"]).select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"), F.lit(False).alias("asks"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(True).alias("asks"), "vec_id", "v")
    both = left.unionByName(right).withColumn("dims", F.size("v"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, lists = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("b", "dims", "asks")], 1)
            ids = batch.column("vec_id").to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if hi == lo:
                    continue
                b, dims, asks = keys[lo].tolist()
                if key != (b, dims):
                    key, held, lists = (b, dims), [], None
                v = batch.column("v").slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, dims)
                if not asks:
                    held.append((ids[lo:hi], v))
                elif held:
                    lists = lists or Block(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]))
                    for own, q in zip(ids[lo:hi].tolist(), v):
                        got, scores, scored = lists.best(q, own, k)
                        out += zip([own] * len(got), got.tolist(), scores.tolist(), [scored] + [0] * (len(got) - 1), strict=True) if len(got) else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["query_id", "vec_id", "score", "scored"])

    dealt = both.repartition("b", "dims").sortWithinPartitions("b", "dims", "asks")
    best = dealt.mapInArrow(search, "query_id long, vec_id long, score long, scored long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, floor(scale * component) by component, of the rows whose components are all finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0")).drop("scored")


OP4_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
