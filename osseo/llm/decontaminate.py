"""Operator 6, benchmark decontamination; DataFrame and SQL functions only.

Only a window that shares a word shingle with an item can be similar to it, so shingles that stand in the benchmark mark the
places: there, in the rows that have any, windows of the items' sizes are cut from the documents and given SimHash fingerprints. Fingerprints are cut
into RADIUS + 1 blocks; items and windows meet where a block agrees, which finds all fingerprints within the radius. Pairs
within it are verified by the exact weighted similarity of their shingles (each weighted by its number of occurrences):
the sum of the smaller weights over the sum of the larger ones.

The radius leaves room for the spread of 64-bit fingerprints at a similarity of 0.8 (mean near 10 bits, deviation near 3).

Defined results: null and empty texts are clean; items without words match nothing, items of fewer than SHINGLE words match
where their words stand consecutively; a window may be cut off by the start or end of its text; repeated rows get equal
results; without items all documents are clean; further columns are ignored by the query and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from osseo.llm.rows import packed, row_key, saved, small, table

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 16
#: Benchmark shingles or block keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows with windows that are broadcast at most (a few hundred bytes each); more are joined by a shuffle of the texts.
BROADCAST_WINDOWS = 50_000
WORDS = r"CASE WHEN text RLIKE '[^\\x20\\x09-\\x0D]' THEN split(regexp_replace(lower(text), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', ''), '[\\x20\\x09-\\x0D]+') ELSE CAST(array() AS array<string>) END"
FINGERPRINT = """
  aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN 2 * aggregate({a}, 0L, (n, h) -> n + (shiftright(h, b) & 1L)) > size({a})
    THEN shiftleft(1L, b) ELSE 0L END)"""


def _shingles(size: str) -> str:
    """SQL for the hashes of all shingles of ``size`` (at most SHINGLE) of an array ``words``."""
    cases = " ".join(f"WHEN {k} THEN transform(sequence(0, size(words) - {k}), i -> xxhash64({k}, {', '.join(f'words[i + {j}]' for j in range(k))}))" for k in range(1, SHINGLE + 1))
    return f"CASE WHEN size(words) >= {size} THEN CASE {size} {cases} END ELSE CAST(array() AS array<bigint>) END"


def _blocks(fp: str, radius: int) -> F.Column:
    """Block number and value of each of radius + 1 blocks of a fingerprint."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.posexplode(F.array(*(F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])))).alias("block", "part")


def matches(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """rk, start (word), item_id and similarity of the windows of ``docs`` (rk, text) that are like an item (item_id, text).

    Items of fewer than SHINGLE words have shingles of their own size; the size is part of every hash and key.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", F.expr(WORDS).alias("words")).where("size(words) > 0").select("item_id", "words", F.least(F.lit(SHINGLE), F.size("words")).alias("k"), F.size("words").alias("n"))
    known = saved(items.select("item_id", "k", "n", F.expr(_shingles("k")).alias("sh")))
    sizes = sorted(r.k for r in known.select("k").distinct().collect()) or [SHINGLE]  # SHINGLE at most
    # the outer form: the plain one infers a filter on the array's size, which would repeat the work of making it
    seeds = known.select("k", "n", F.posexplode_outer("sh").alias("offset", "h")).distinct()
    worded = docs.select("rk", F.expr(WORDS).alias("words"))
    of_sizes = F.array(*(F.struct(F.lit(k).alias("k"), F.expr(_shingles(str(k))).alias("sh")) for k in sizes))
    hashed = worded.select("rk", F.explode(of_sizes).alias("s")).select("rk", F.col("s.k").alias("dk"), F.posexplode_outer("s.sh").alias("pos", "h"))
    windows = saved(hashed.join(small(seeds, BROADCAST_ROWS), "h").where("k = dk").select("rk", "k", "n", (F.col("pos") - F.col("offset")).alias("start")).distinct())
    # only rows with a window are cut into shingles again
    marked = windows.groupBy("rk").agg(F.collect_set(F.struct("k", "n", "start")).alias("windows"))  # no more than a text has
    cut = docs.join(small(saved(marked), BROADCAST_WINDOWS), "rk").select("rk", "windows", F.expr(WORDS).alias("words")).select("rk", "windows", of_sizes.alias("s"))
    each = cut.select("rk", F.explode(F.expr("flatten(transform(s, x -> transform(filter(windows, w -> w.k = x.k), w -> struct(w.k AS k, w.start AS start, slice(x.sh, greatest(w.start, 0) + 1, w.n - w.k + 1 + least(w.start, 0)) AS w))))")).alias("x"))
    printed = saved(each.select("rk", "x.*").select("rk", "k", "start", "w", F.expr(FINGERPRINT.format(a="w")).alias("fp")))
    targets = known.select("item_id", "k", F.col("sh").alias("v"), F.expr(FINGERPRINT.format(a="sh")).alias("ifp"))
    keys = targets.select("item_id", "k", "ifp", F.size("v").alias("total"), _blocks("ifp", radius))
    blocks = printed.select("rk", "k", "start", "w", "fp", _blocks("fp", radius))
    near = blocks.join(small(keys, BROADCAST_ROWS), ["k", "block", "part"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    # weighted shingles: how often the window and the item hold each; windows of one place differ in length, so the window itself is a key
    pairs = near.select("rk", "start", "item_id", "w", "total").distinct().select("rk", "start", "item_id", F.size("w").alias("size"), "total", F.explode("w").alias("h"))
    counted = pairs.groupBy("rk", "start", "item_id", "size", "total", "h").agg(F.count("*").alias("x"))
    weights = known.select("item_id", F.explode("sh").alias("h")).groupBy("item_id", "h").agg(F.count("*").alias("y"))
    common = counted.join(small(weights, BROADCAST_ROWS), ["item_id", "h"]).groupBy("rk", "start", "item_id", "size", "total").agg(F.sum(F.least("x", "y")).alias("common"))
    return common.select("rk", "start", "item_id", (F.col("common") / (F.col("size") + F.col("total") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= similar)


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """rk, the items found and the highest similarity of each contaminated row; ``docs`` has doc_id and text."""
    rows = docs.where("text IS NOT NULL").select(row_key().alias("rk"), "text")
    return matches(rows, benchmark, similar, radius).groupBy("rk").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))  # no more than there are items


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = contaminated(docs.select("doc_id", "text"), benchmark).select("rk")
    return packed(docs).select("rk", "row").join(found, "rk", "left_anti").select("row.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    every = docs.select("doc_id", row_key().alias("rk")).join(found, "rk", "left")
    return every.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
