"""Near-duplicates: operator 3's fingerprints and tiles find candidates, exact Jaccard similarity of word shingles links them.

Texts become sets of hashed shingles, and equal sets become one row (a class) with a sketch of the set: SimHash fingerprints of
WORDS words, and parities of its shingles in FOLD places, which differ between two sets in no more places than the sets do. In any fixed order
of shingles, two sets of similarity s share a shingle among the first n - ceil(s * n) + 1 of each, so only these prefixes are
dealt by shingle. The order puts shingles that are common in a sample last; it decides the work only, never the result.

Of the classes that meet at a shingle, each is first compared with one of them. Groups that links do not connect yet are cut
into tiles, and pairs of tiles are compared whole by exclusive-or and bit counts of the fingerprints, skipping strips whose
population counts lie too far apart; sizes and parities of the sets must allow the similarity too. A tile pair first
yields a spanning forest of its candidates; what these leave apart is looked through once more, with all candidates. All
candidates are verified by the whole sets. So a group of near copies takes about as many verifications as it has members, and
unlike documents that share a passage take none. Classes that meet at several shingles are candidates at the first of these: each
brings the first LOWEST shingles at which it meets others, and what both have among these before the shingle at hand is compared there.

RADIUS leaves room for the fingerprints: at a similarity of 0.8 they differ in 39 of 256 bits on average, with a deviation of 6, so
that less than one pair in a million millions at exactly 0.8 lies beyond it, while unlike sets differ in 128 with a deviation of 8.
Sets below SMALL shingles, whose fingerprints vary more, are compared by sizes and parities alone.

Defined results: null, empty and white-space texts have no shingles and are alike; texts of fewer words than a shingle are
one shingle; repeated rows are alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from osseo.llm.rows import bounded_sample, byte_class, map_texts, mix, packed, powers, saved, small, span_hashes, spread_join, written
from osseo.llm.simhash import STRIP, Forest, by_task, components, majority

SHINGLE = 5
#: Similarity from which texts are near-duplicates, as a fraction of integers.
SIMILAR = (4, 5)
#: Texts whose shingles are counted for the order, and the number of common shingles that are sent to workers at most.
SAMPLE_ROWS = 5_000
COMMON = 500_000
BROADCAST_ROWS = 1_000_000
#: Words of a fingerprint, and bits in which those of candidates differ at most, for sets from SMALL shingles on.
WORDS, RADIUS, SMALL = 4, 80, 16
#: Places of the parities of a set.
FOLD = 1024
#: Shingles that a class brings along, the first in order of those at which it meets others.
LOWEST = 16
#: Rows of a tile at most (but for ties of hashes); a task compares two tiles at a time.
TILE = 8_192
_WORD = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def shingle_sets(texts: list, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    parts = [t.encode().lower() if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    edge = np.diff(np.concatenate(([0], _WORD[data].view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = span_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        first = np.arange(a, max(b - size, a) + 1 if b > a else a)
        out.append(np.unique(span_hashes(words[a:b], first - a, np.minimum(first + size, b) - a, 0xD6E8FEB86659FD93)))
    return out


def _key(s: np.ndarray) -> int:
    """A hash of the set."""
    up = powers(len(s) + 1)[0]
    return int(span_hashes(s, np.array([0]), np.array([len(s)]))[0] ^ up[len(s)])


def least_common(n: int) -> int:
    """The shingles that a set of n shares with any set as similar as SIMILAR."""
    return -(-SIMILAR[0] * n // SIMILAR[1])


def _common(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that two texts of a sample hold, and how many do."""
    sets = map_texts(bounded_sample(rows, "rk", SAMPLE_ROWS), {"sh": T.ArrayType(T.LongType())}, lambda texts: {"sh": [s.view(np.int64) for s in shingle_sets(texts, size)]})
    counts = sets.select(F.explode("sh").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "h").limit(COMMON).toPandas()
    h = counts.h.to_numpy(np.int64).view(np.uint64)
    at = np.argsort(h)
    return h[at], counts.n.to_numpy(np.int64)[at]


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set by one of which all similar sets can be found."""
    rank = np.zeros(len(s), np.int64)
    if len(common) and len(s):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))[: len(s) - least_common(len(s)) + 1]]


def sketch(s: np.ndarray) -> bytes:
    """The fingerprint of the set, WORDS words for as many hashes of its shingles, and the parities of its shingles in FOLD places."""
    prints = [majority(s if k == 0 else mix(s + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for k in range(WORDS)]
    odd = np.bincount((s % np.uint64(FOLD)).astype(np.int64), minlength=FOLD) & 1
    return np.array(prints, np.uint64).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def sketches(column) -> np.ndarray:
    """Rows x words of sketches."""
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, WORDS + FOLD // 64)


def alike(n: tuple[np.ndarray, np.ndarray], s: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether sizes and sketches of pairs allow that their sets are as similar as SIMILAR."""
    p, q = SIMILAR
    few, many = np.minimum(*n), np.maximum(*n)
    apart = np.bitwise_count(s[0] ^ s[1])
    near = (apart[:, :WORDS].sum(1, dtype=np.int64) <= RADIUS) | (few < SMALL)
    return (few * q >= many * p) & near & (apart[:, WORDS:].sum(1, dtype=np.int64) * (q + p) <= (n[0] + n[1]) * (q - p))


def _near(fp: np.ndarray, n: np.ndarray):
    """Blocks of pairs of rows (i, j), i not above j in an order of its own, that fingerprints and sizes do not rule out."""
    # sets below SMALL can only be similar to sets below this
    most = SMALL * SIMILAR[1] // SIMILAR[0]
    little, large = np.flatnonzero(n < most), np.flatnonzero(n >= SMALL)
    for rows, by_print in ((little, False), (large, True)):
        ones = np.bitwise_count(fp[rows]).sum(1, dtype=np.int16)
        order = np.argsort(ones if by_print else n[rows], kind="stable")
        rows, ones = rows[order], ones[order]
        for x in range(0, len(rows), STRIP):
            a = rows[x : x + STRIP]
            for y in range(x, len(rows), STRIP):
                b = rows[y : y + STRIP]
                if by_print:
                    if ones[y] > ones[x + len(a) - 1] + RADIUS:
                        break
                    near = sum(np.bitwise_count(fp[a, None, k] ^ fp[None, b, k]).astype(np.uint16) for k in range(WORDS)) <= RADIUS
                else:
                    near = np.minimum(n[a, None], n[None, b]) < SMALL
                i, j = np.nonzero(near)
                keep = i + x < j + y
                yield a[i[keep]], b[j[keep]]


def tile_candidates(rows: pd.DataFrame, forest: bool) -> pd.DataFrame:
    """Pairs (a, b) of a tile (``alone``) or between two (``is_left`` or not), of different roots, that may be similar.

    With ``forest`` only as many as connect all roots that they connect together. Pairs that meet before at a shingle below ``h``
    in both their lists ``low`` are left to it.
    """
    held, low, h = sketches(rows.sketch), np.stack(rows.low.to_numpy()).astype(np.int64), int(rows.h.iloc[0])
    sk, n, left = rows.sk.to_numpy(), rows.n.to_numpy(np.int64), rows.is_left.to_numpy()
    alone = bool(rows.alone.all())
    labels, root = np.unique(rows.root.to_numpy(), return_inverse=True)
    tree, out = Forest(len(labels)), []
    for i, j in _near(held[:, :WORDS], n):
        keep = (root[i] != root[j]) & (alone | (left[i] != left[j]))
        i, j = i[keep], j[keep]
        keep = alike((n[i], n[j]), (held[i], held[j]))
        i, j = i[keep], j[keep]
        keep = ~((low[i][:, :, None] == low[j][:, None, :]) & (low[i] < h)[:, :, None]).any((1, 2))
        i, j = i[keep], j[keep]
        while forest and len(i):  # each round joins every row to one other of another tree
            first = np.unique(i, return_index=True)[1]
            out += [(sk[k], sk[m]) for k, m in zip(i[first].tolist(), j[first].tolist(), strict=True) if tree.join(root[k], root[m])]
            top = np.array([tree.top(k) for k in range(len(labels))])
            keep = top[root[i]] != top[root[j]]
            i, j = i[keep], j[keep]
        out += zip(sk[i].tolist(), sk[j].tolist(), strict=True)
    got = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": got.min(1), "b": got.max(1)})


def _candidates(met: DataFrame, found: DataFrame, classes: DataFrame, forest: bool, tile: int) -> DataFrame:
    """Pairs of classes (a, b) that meet at a shingle, may be similar, and that the links found do not connect yet."""
    here = saved(_rooted(met, found))
    same = (F.bit_xor(F.xxhash64("sk")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "sk")).alias("s2"))
    groups = here.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *same).where("low < high")
    # shingles at which the same classes meet count once
    groups = saved(groups.groupBy("n", "s1", "s2").agg(F.min("h").alias("h")).select("h", "n", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    placed = saved(spread_join(here, groups, ["h"]))
    # a class meets others at no more shingles than its prefix has; lists are filled up with a value that no shingle is below
    first = F.slice(F.concat(F.array_sort(F.collect_list("h")), F.array_repeat(F.lit((1 << 63) - 1), LOWEST)), 1, LOWEST)
    often = written(classes.join(placed.groupBy("sk").agg(F.count("*").alias("times"), first.alias("low")), "sk").select("sk", "n", "sketch", "low", "times"))
    placed = spread_join(placed, often, ["sk"], "times").withColumn("own", F.pmod(F.xxhash64("sk"), F.col("tiles")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    tasks = tasks.select("sk", "root", "n", "sketch", "low", "h", F.xxhash64("h", lo, hi).alias("task"), (F.col("own") == lo).alias("is_left"), (lo == hi).alias("alone"))
    return by_task(tasks, lambda rows: tile_candidates(rows, forest)).distinct()


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) whose sizes and sketches allow that they are similar."""
    side = lambda s: classes.select(F.col("sk").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = tuple(batch.column(f"n_{s}").to_numpy().astype(np.int64) for s in "ab")
                keep = pa.array(alike(n, tuple(sketches(batch.column(f"s_{s}").to_pylist()) for s in "ab")))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Those of the pairs of classes (a, b) whose sets are similar."""
    pairs = saved(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sk")).distinct().join(classes.select("sk", F.col("first.rk").alias("rk")), "sk")
    texts = rows.select("rk", "text").join(small(saved(wanted), BROADCAST_ROWS), "rk")
    # repeated rows give a set more than once, and so a link
    sets = written(map_texts(texts, {"sh": T.ArrayType(T.LongType())}, lambda ts: {"sh": [s.view(np.int64) for s in shingle_sets(ts, size)]}).select("sk", "sh"))
    # the pairs go to the sets of their one side, and those sets to the few of the other
    right = sets.select(F.col("sk").alias("b"), F.col("sh").alias("y")).join(small(pairs, BROADCAST_ROWS), "b")
    left = sets.select(F.col("sk").alias("a"), F.col("sh").alias("x")).join(small(saved(pairs.select("a").distinct()), BROADCAST_ROWS), "a", "left_semi")
    both = right.join(left, "a")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("t"))
    return saved(shared.where(F.col("c") * SIMILAR[1] >= (F.col("t") - F.col("c")) * SIMILAR[0]).select("a", "b").distinct())


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(components(links).withColumnRenamed("node", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component (null last; one, if rows are repeated)."""
    rows = packed(docs)
    common = docs.sparkSession.sparkContext.broadcast(_common(rows.select("rk", "text"), size))
    added = {"sk": T.LongType(), "n": T.IntegerType(), "sketch": T.BinaryType(), "prefix": T.ArrayType(T.LongType())}

    def batch(texts: list) -> dict:
        sets = shingle_sets(texts, size)
        keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
        return {"sk": keys, "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets], "prefix": [prefix(s, *common.value).view(np.int64) for s in sets]}

    known = written(map_texts(rows.select("doc_id", "rk", "text"), added, batch))
    classes = written(known.groupBy("sk").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "rk")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    # copies deal their shingles too; they go once it is known where different classes meet
    dealt = known.select("sk", F.explode("prefix").alias("h"))
    groups = saved(dealt.groupBy("h").agg(F.min("sk").alias("low"), F.max("sk").alias("high"), F.count("*").alias("n")).where("low < high").drop("high"))
    met = written(spread_join(dealt, groups, ["h"]).distinct())
    stars = saved(_possible(met.where("sk <> low").select(F.col("low").alias("a"), F.col("sk").alias("b")).distinct(), classes))
    met, tried = met.drop("low"), stars
    found = _verified(stars, classes, rows, size)
    for forest in (True, False):
        more = saved(_candidates(met, found, classes, forest, tile).join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        tried = tried.unionByName(more)
        found = found.unionByName(_verified(more, classes, rows, size))
    kept = _rooted(classes.select("sk", "first"), found).groupBy("root").agg(F.min("first").alias("first")).select("first.rk")
    return rows.select("rk", "row").join(kept, "rk").dropDuplicates(["rk"]).select("row.*")
