"""Operator 3, SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts.

Documents become 64-bit fingerprints, equal fingerprints become one row, and rows are dealt into groups that share one of
RADIUS + 1 bit blocks (two fingerprints within the radius agree in one block at least, so no pair is lost). A group is cut
into tiles of TILE rows in order of population count. Tiles are compared pair by pair, whole, with exclusive-or and bit
counts; tile pairs whose population counts differ by more than the radius are skipped. Groups beyond one tile are spread:
each of their tile pairs is a task group of its own, so no task holds more than two tiles. A tile pair yields a spanning
forest of its links, never all pairs, and the links' components are found by repeated label exchange in Spark.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows share a fingerprint; a
null doc_id never names a component unless all of its documents have none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from osseo.llm.rows import map_texts, saved, spread_join, table, written

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Rows of a tile at most (but for ties of hashes); a task compares two tiles at a time.
TILE = 16_384
#: Rows of a sub-tile, the unit that population counts skip inside a task.
STRIP = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of the text's word shingles."""
    words = text.encode().lower().split() if text else []  # bytes split at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest, seed = xxhash.xxh64_intdigest, SEED
    n = len(starts)
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    n = len(h)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bits of little-endian bytes: place i holds bit i
        ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.flatnonzero(2 * ones > n).astype(np.uint64)[:, None] == np.arange(64, dtype=np.uint64)).any(0).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of each text as a signed long ``fp``, and drops the text."""

    def batch(texts: list) -> dict:
        return {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, {"fp": T.LongType()}, batch)


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one tile (right is None) or between two, as pairs of fingerprints.

    Both are sorted by population count here; pairs of strips whose counts lie further apart than the radius are skipped.
    """
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    both = left if right is None else np.concatenate([left, right := right[np.argsort(np.bitwise_count(right), kind="stable")]])
    other, shift = (left, 0) if right is None else (right, len(left))
    forest, out = Forest(len(both)), []
    ones_l, ones_r = np.bitwise_count(left).astype(np.int16), np.bitwise_count(other).astype(np.int16)
    for a in range(0, len(left), STRIP):
        x = left[a : a + STRIP]
        for b in range(a if right is None else 0, len(other), STRIP):
            y = other[b : b + STRIP]
            if ones_r[b] > ones_l[a + len(x) - 1] + radius:
                break
            if ones_r[b + len(y) - 1] < ones_l[a] - radius:
                continue
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            # each round joins every row to one neighbour of another tree, so a dense group takes a few rounds, not all its pairs
            while near.any():
                tops = [np.array([forest.top(k) for k in range(first, first + len(z))]) for first, z in ((a, x), (shift + b, y))]
                near &= tops[0][:, None] != tops[1][None, :]
                rows = np.flatnonzero(near.any(1))
                for i, j in zip(rows.tolist(), near[rows].argmax(1).tolist(), strict=True):
                    if forest.join(a + i, shift + b + j):
                        out.append((both[a + i], both[shift + b + j]))
    return out


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within the radius; ``prints``: distinct fp."""
    blocks, width = radius + 1, -(-64 // (radius + 1))
    piece = lambda k: F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << min(width, 64 - k * width)) - 1)
    dealt = prints.select("fp", F.bit_count("fp").cast("int").alias("ones"), F.posexplode(F.array(*(piece(k) for k in range(blocks)))).alias("block", "part"))
    # how many rows of each population count a group has: 65 entries at most
    counts = dealt.groupBy("block", "part", "ones").agg(F.count("*").alias("n"))
    groups = counts.groupBy("block", "part").agg(F.sum("n").alias("rows"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int")))).alias("tiles")).where("rows > 1")
    single = F.col("rows") <= tile
    # (radius + 1) * 2**width groups at most, whatever the input: 40,960 for radius 4
    placed = dealt.join(F.broadcast(groups) if blocks << width <= 1 << 17 else groups, ["block", "part"]).withColumn("salt", F.when(single, 0).otherwise(F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("ones"))).cast("int")))
    # in a large group, tile (p, s) meets (q, t) for q from p to p + radius; each row goes to all pairs that its tile is in
    near = F.filter(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.col("ones") + d), lambda q: F.map_contains_key("tiles", q))
    mates = F.flatten(F.transform(near, lambda q: F.transform(F.sequence(F.lit(0), F.element_at("tiles", q) - 1), lambda t: F.struct(q.alias("ones"), t.alias("salt")))))
    own = F.struct("ones", "salt")
    pairs = F.when(single, F.array(F.struct(F.struct(F.lit(0).alias("ones"), F.lit(0).alias("salt")).alias("lo"), F.struct(F.lit(0).alias("ones"), F.lit(0).alias("salt")).alias("hi")))).otherwise(
        F.transform(mates, lambda m: F.struct(F.least(own, m).alias("lo"), F.greatest(own, m).alias("hi")))
    )
    tasks = placed.select("fp", "block", "part", "ones", "salt", single.alias("single"), F.explode(pairs).alias("pair")).select(
        "fp", F.xxhash64("block", "part", "pair").alias("task"), (F.col("single") | (own == F.col("pair.lo"))).alias("is_left"), (F.col("pair.lo") == F.col("pair.hi")).alias("alone")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf.fp.to_numpy().view(np.uint64)
        alone, is_left = pdf.alone.to_numpy(), pdf.is_left.to_numpy()
        found = tile_links(fp, None, radius) if alone.all() else tile_links(fp[is_left], fp[~is_left], radius)
        got = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    return by_task(tasks, compare)


def by_task(tasks: DataFrame, compare) -> DataFrame:
    """Applies ``compare`` to the rows of each task; many small tasks of a partition share one call into Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def finish(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            ids = rows.task.to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            bounds = [0, *cuts.tolist(), len(rows)]
            out = [compare(rows.iloc[x:y]) for x, y in zip(bounds, bounds[1:]) if y - x > 1]
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), schema=schema, preserve_index=False)

        for batch in batches:
            part = batch.to_pandas()
            if part.empty:
                continue
            last = part.task.iloc[-1]
            open_rows = part[part.task == last]
            closed = part[part.task != last]
            if held and held[0].task.iloc[0] == last:
                held.append(open_rows)
                continue
            rows = pd.concat([*held, closed]) if held else closed
            held = [open_rows]
            if len(rows):
                yield from finish(rows)
        if held:
            yield from finish(pd.concat(held))

    return tasks.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for each node of the undirected edges; the root is the smallest node of its component.

    Alternates the large-star and small-star steps, whose rounds grow with the logarithm of the component sizes; each round is
    written to the checkpoint folder, which keeps plans short and survives lost executors. Edges go there as a table, as a
    checkpoint would hand its plan's constraints on, which double every round.
    """
    edges = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    print_of = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = print_of(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")))
        # large star: larger neighbours of u link to the smallest neighbour
        large = spread_join(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large)
        # small star: u (the larger end) and its smaller neighbours link to the smallest of them
        low2 = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low2, ["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small)
        before, last = print_of(edges), before
        if before == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` (distinct fp and more) with ``root``, one fingerprint for all that links reach."""
    roots = components(links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without text, with ``fp`` and component_id, the smallest doc_id within reach of links."""
    known = saved(fingerprints(docs, shingle))
    classes = saved(_rooted(saved(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))), radius))
    least = saved(classes.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = saved(spread_join(classes, least, ["root"]).select("fp", "rows", "component_id"))
    return spread_join(known, named, ["fp"], "rows")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
