"""Operator 11, vector code compression: product quantisation with Drake and Hamerly's adaptive bounds.

Vectors of integers are cut into parts, and each part position has a codebook that a few rounds of k-means move. Rounds keep, for
every part of every vector, its ``b`` closest entries in order of a lower bound on their distance, the assigned one first, and one
outer bound below which no other entry lies. When the entries have moved, each bound falls by the movement of its entry (the outer
one by the greatest movement). The distance to the assigned entry, an exact integer, is then compared with the bounds: kept entries
that could be as near are verified by exact integer distances, and where the outer bound leaves room for any other entry, all
are. So the codes are those of a full search, ties to the lower index included. Each round tells how many kept entries were looked
at, and the next one keeps fewer or more of them (``adapted``).

The state goes from round to round as a Parquet table in the shared folder, written in the same pass that sums the parts of each
entry; a task leaves one row of sums a part position. Codebooks are ENTRIES x length integers, whatever the input.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of other lengths are filled up
with zeros to the greatest length, rounded up to a multiple of PARTS; repeated rows each count and get equal codes; the codebook of
fewer rows than ENTRIES is as long as the rows; a null vec_id is the last of the order; further columns are ignored; an empty
table gives an empty result. Components beyond the range of a long after scaling stay at its end, and so does an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from osseo.llm.rows import deleted, passing, saved, shared_folder, spread_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that the first round keeps with each part, and the least and most that later ones do.
KEPT, LEAST, MOST = 16, 4, 32
#: Rows that one step of a task compares with all entries.
STEP = 2_048
_LONG = np.iinfo(np.int64)
_SCHEMA = "vec_id long, label_key struct<label:{label}>, v array<long>, near binary, low binary, error long, part int, sums array<decimal(38,0)>, counts array<long>, looked array<long>"


def quantised(embeddings: DataFrame, scale: int = SCALE, label: str = "label") -> DataFrame:
    """vec_id, label_key (a struct, so that nulls are equal) and v, floor(scale * component), of rows with finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    named = F.struct(F.col(label).alias("label")) if label in embeddings.columns else F.struct(F.lit(None).cast("int").alias("label"))
    ends = [F.lit(float(x)) for x in (_LONG.min, _LONG.max)]
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, ends[1]), ends[0])))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), named.alias("label_key"), whole.alias("v"))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and y, which broadcast; Python integers where 64 bits could overflow."""
    if _wide(x, y):
        return ((x.astype(object) - y.astype(object)) ** 2).sum(-1)
    return ((x - y) ** 2).sum(-1)


def _wide(*arrays: np.ndarray) -> bool:
    """Whether squared distances of such components can leave 60 bits."""
    most = max((max(-int(a.min()), int(a.max())) for a in arrays if a.size), default=0)
    return (2 * most) ** 2 * max((a.shape[-1] for a in arrays), default=1) >= 1 << 60


def all_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Rows x entries, exact squared distances: by products of doubles where these are exact."""
    most = max([max(-int(a.min()), int(a.max())) for a in (x, book) if a.size], default=0)
    if 4 * most**2 * max(x.shape[1], 1) >= 1 << 53:
        return np.stack([distances(x, c) for c in book], 1)
    f, c = x.astype(np.float64), book.astype(np.float64)
    return ((f * f).sum(1)[:, None] - 2 * (f @ c.T) + (c * c).sum(1)).astype(np.int64)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of exact squared distances, surely not below (``up``) or not above them, as float32."""
    r = np.sqrt(d.astype(np.float64)) * (1 + 1e-12 if up else 1 - 1e-12)
    s = r.astype(np.float32)
    return np.where(s < r, np.nextafter(s, np.float32(np.inf)), s) if up else np.where(s > r, np.nextafter(s, np.float32(-np.inf)), s)


class Bounds:
    """near: rows x b entries, the assigned one first; low: their lower bounds, and the outer bound as the last column."""

    def __init__(self, near: np.ndarray, low: np.ndarray):
        self.near, self.low = near, low

    @staticmethod
    def searched(x: np.ndarray, book: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """Bounds after a search of all entries, and the exact distances to the nearest."""
        near, low, error = [], [], []
        b = min(b, len(book))
        for k in range(0, len(x), STEP):
            d = all_distances(x[k : k + STEP], book)
            order = np.argsort(d, axis=1, kind="stable")[:, : b + 1]  # of equal distances the lower index is first
            sorted_d = np.take_along_axis(d, order, 1)
            near.append(order[:, :b].astype(np.uint8))
            outer = _root(sorted_d[:, b:], False) if len(book) > b else np.full((len(d), 1), np.inf, np.float32)
            low.append(np.concatenate([_root(sorted_d[:, :b], False), outer], 1))
            error.append(sorted_d[:, 0])
        return Bounds(np.concatenate(near), np.concatenate(low)), np.concatenate(error)

    def moved(self, x: np.ndarray, book: np.ndarray, step: np.ndarray, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
        """Bounds and distances after the entries of ``book`` have moved by up to ``step``, and how many entries of each row were
        looked at (one more than are kept: all). The new bounds keep ``b`` entries.
        """
        have = self.near.shape[1]
        low = np.concatenate([self.low[:, :have] - step[self.near], self.low[:, have:] - step.max(initial=0)], 1).astype(np.float64)
        low = np.where(np.isinf(low), np.float32(np.inf), np.nextafter(low.astype(np.float32), np.float32(-np.inf)))
        error = distances(x, book[self.near[:, 0]])
        reach = _root(error, True)
        open_ = low[:, :have] <= reach[:, None]
        open_[:, 0] = True
        full = low[:, have] <= reach
        looked = np.where(full, have + 1, open_.sum(1))
        # kept entries that may be as near: exact distances, and the lower index of equal ones
        near, rest = self.near.copy(), ~full
        row, col = np.nonzero(open_ & rest[:, None])
        d = np.full(open_.shape, -1, object if error.dtype == object else np.int64)
        d[row, col] = distances(x[row], book[near[row, col]]) if len(row) else 0
        known = d >= 0
        low[:, :have] = np.where(known, _root(np.where(known, d, 0), False), low[:, :have])
        # in order of the bounds, which are exact where known; then the nearest goes first
        order = np.argsort(low[:, :have], axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        low[:, :have] = np.take_along_axis(low[:, :have], order, 1)
        if rest.any():
            at = np.flatnonzero(rest)
            some = np.where(d[at] >= 0, d[at], d[at].max() + 1)
            least = some.min(1)
            best = np.where(some == least[:, None], near[at].astype(np.int64), 256).argmin(1)
            error[at] = least
            first = (at, np.zeros(len(at), np.int64))
            for values in (near, low):
                moved = values[at, best]
                for k in range(have - 1, 0, -1):  # entries before the best one go one place back
                    back = best >= k
                    values[at[back], k] = values[at[back], k - 1]
                values[first] = moved
        # fewer entries: the bounds of those left out join the outer one; more: rooms whose bound is never reached
        if b < have:
            low = np.concatenate([low[:, :b], low[:, b:].min(1, keepdims=True)], 1)
            near = near[:, :b]
        elif b > have:
            low = np.concatenate([low[:, :have], np.full((len(x), b - have), np.inf, np.float32), low[:, have:]], 1)
            near = np.concatenate([near, np.repeat(near[:, :1], b - have, 1)], 1)
        if full.any():
            again, error[full] = Bounds.searched(x[full], book, b)
            near[full], low[full] = again.near, again.low
        return Bounds(near, low), error, looked


def adapted(looked: np.ndarray, b: int) -> int:
    """How many entries the next round keeps: ``looked`` counts the parts by how many were looked at, the last place all entries.

    As many as 19 of 20 of the parts that needed no search of all entries looked at, and twice as many as now if one in five did.
    """
    if not looked.sum():
        return b
    if looked[-1] * 5 > looked.sum():
        return min(2 * b, MOST)
    upto = np.cumsum(looked[:-1])
    return int(np.clip(np.searchsorted(upto, -(-19 * upto[-1] // 20)), LEAST, b))


def _cut(v: list | np.ndarray, length: int) -> np.ndarray:
    """Rows as parts: rows x PARTS x length / PARTS."""
    return np.asarray(v, np.int64).reshape(len(v), PARTS, length // PARTS)


def _assign(books: np.ndarray, before: np.ndarray | None, b: int, sums: bool):
    """A pass over the state: new bounds and errors of all rows, and in the last row of a task for each part the sums of its entries."""
    entries = books.shape[1]
    steps = None if before is None else np.stack([_root(distances(x, y), True) for x, y in zip(books, before)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.shape, object)
        counts, looked, schema = np.zeros(books.shape[:2], np.int64), np.zeros(MOST + 2, np.int64), None
        for batch in batches:
            schema, rows = batch.schema, batch.num_rows
            if not rows:
                continue
            v = _cut(batch.column("v").flatten().to_numpy().reshape(rows, -1), books.shape[0] * books.shape[2])
            near, low, errors = [], [], np.zeros(rows, object)
            held = None
            if steps is not None:
                raw = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(rows, PARTS, -1) for c, t in (("near", np.uint8), ("low", np.float32))]
                held = [Bounds(raw[0][:, p], raw[1][:, p]) for p in range(PARTS)]
            for p, book in enumerate(books):
                x = v[:, p]
                if held is None:
                    state, d = Bounds.searched(x, book, b)
                else:
                    state, d, seen = held[p].moved(x, book, steps[p], b)
                    seen = np.where(seen > held[p].near.shape[1], MOST + 1, seen)
                    looked += np.bincount(seen, minlength=MOST + 2)
                near.append(state.near)
                low.append(state.low)
                errors = errors + d.astype(object)
                if sums:
                    of = state.near[:, 0].astype(np.int64)
                    counts[p] += np.bincount(of, minlength=entries)
                    order = np.argsort(of, kind="stable")
                    used, first = np.unique(of[order], return_index=True)
                    sorted_x = x[order]
                    total[p, used] += np.add.reduceat(sorted_x.astype(object) if _wide(x) else sorted_x, first, axis=0)
            near_all, low_all = (np.ascontiguousarray(np.stack(a, 1)) for a in (near, low))
            as_bytes = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            nothing = lambda t: pa.nulls(rows, t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label_key"), batch.column("v"), as_bytes(near_all), as_bytes(low_all), pa.array([min(e, _LONG.max) for e in errors], pa.int64()),
                 nothing(pa.int32()), nothing(pa.list_(pa.decimal128(38, 0))), nothing(pa.list_(pa.int64())), nothing(pa.list_(pa.int64()))],
                names=[*NAMES],
            )
        if sums and schema is not None:
            n = len(books)
            nothing = lambda c: pa.nulls(n, schema.field(c).type)
            decimals = pa.array([[int(i) for i in t.ravel()] for t in total], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays(
                [nothing("vec_id"), nothing("label_key"), nothing("v"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                 pa.array(range(n), pa.int32()), decimals, pa.array(counts.tolist(), pa.list_(pa.int64())), pa.array([looked.tolist()] + [[0] * len(looked)] * (n - 1), pa.list_(pa.int64()))],
                names=[*NAMES],
            )

    return run


NAMES = ["vec_id", "label_key", "v", "near", "low", "error", "part", "sums", "counts", "looked"]


def _summed(state: DataFrame, column: str) -> pd.DataFrame:
    """part, i and n: the sums of an array column over the rows of all tasks; as many rows as codebooks have components."""
    each = state.where("part IS NOT NULL").select("part", F.posexplode(column).alias("i", "x"))
    return each.groupBy("part", "i").agg(F.sum("x").alias("n")).toPandas()


def _filled(summed: pd.DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros((shape[0], int(np.prod(shape[1:]))), object)
    out[summed["part"].to_numpy(int), summed["i"].to_numpy(int)] = [int(x) for x in summed["n"]]
    return out.reshape(shape)


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, kept: int = KEPT, log: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label_key, code (an array of entry numbers, as a binary) and error of each row, and the codebooks, part x entry x component.

    ``vectors`` is what ``quantised`` gives. ``log`` gets (kept entries, parts by entries looked at) of each round.
    """
    spark = vectors.sparkSession
    length = vectors.agg(F.max(F.size("v")).alias("n")).first().n or 0
    length = -(-length // PARTS) * PARTS
    full = vectors.select("vec_id", "label_key", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v"))).alias("v"))
    first = full.orderBy(F.isnull("vec_id"), "vec_id", "v").limit(entries).select("v").collect()  # ``entries`` rows
    books = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, length // PARTS).swapaxes(0, 1)
    schema = _SCHEMA.format(label=vectors.schema["label_key"].dataType["label"].dataType.simpleString())
    folder = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    state, before, b, last = full, None, min(kept, max(len(first), 1)), None
    for k in range(rounds + 1):
        path = f"{folder}/{k}"
        state.mapInArrow(_assign(books, before, b, k < rounds), schema).write.parquet(path)
        written = spark.read.schema(schema).parquet(passing(spark, path))
        state = written.where("part IS NULL").select("vec_id", "label_key", "v", "near", "low", "error")
        if last:
            deleted(spark, last)
        last = path
        if k == rounds:
            break
        n, total = _filled(_summed(written, "counts"), books.shape[:2]), _filled(_summed(written, "sums"), books.shape)
        looked = _summed(written, "looked").groupby("i")["n"].sum().reindex(range(MOST + 2), fill_value=0).to_numpy(np.int64)
        if log is not None:
            log.append((b, looked))
        b = adapted(looked, b)
        mean = np.where(n[..., None] > 0, total // np.maximum(n, 1)[..., None], books.astype(object))
        before, books = books, mean.astype(np.int64)
    code = [F.substring("near", F.lit(p) * (F.length("near") / PARTS).cast("int") + 1, F.lit(1)) for p in range(PARTS)]
    return state.select("vec_id", "label_key", F.concat(*code).alias("code"), "error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(quantised(table(spark, sf_dir, "embeddings")))
    books_hash = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = saved(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    return spread_join(coded, sums, ["label_key"]).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_hash).alias("codebooks_sha256"))


def _sql() -> str:
    """The plain search of all entries in every round."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d
  FROM (SELECT x.r, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{k} c USING (p)) GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS v FROM (
      SELECT p, e, i, CAST(floor_div AS BIGINT) AS m FROM (
        SELECT p, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) / count(*) AS floor_div
        FROM (SELECT a.p, a.e, unnest(x.v) AS y, generate_subscripts(x.v, 1) AS i FROM a{k} a JOIN x USING (r, p)) GROUP BY p, e, i)) GROUP BY p, e) m USING (p, e))""")
    return f"""
WITH q AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda z: CAST(floor({SCALE} * CAST(z AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0)),
x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM q, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {ENTRIES}),{",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS}),
o AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o JOIN q USING (r), h
"""


OP11_SQL = _sql()
