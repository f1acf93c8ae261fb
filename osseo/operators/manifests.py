"""Manifests: exact duplicates, summaries, folds, labels, and lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from osseo.functions.columns import positions


def mark_duplicates(manifest: DataFrame) -> DataFrame:
    """Adds dup_group (dense number by hash), dup_count and is_canonical (smallest rel_path of the group).

    Groups are aggregated first, so a hash that many files share is one row when it is numbered and joined.
    """
    groups = manifest.groupBy("pixel_md5").agg(F.count("*").alias("dup_count"), F.min("rel_path").alias("_first"))
    return manifest.join(positions(groups, ["pixel_md5"], "dup_group"), "pixel_md5").withColumn("is_canonical", F.col("rel_path") == F.col("_first")).drop("_first")


def summary(manifest: DataFrame) -> DataFrame:
    """One row: files, different contents, studies, and least, median (whole) and most files of a study."""
    per = manifest.groupBy("study_dir").agg(F.count("*").alias("n"))
    sizes = per.agg(F.count("*").alias("studies"), F.min("n").alias("frames_min"), F.median("n").cast("long").alias("frames_median"), F.max("n").alias("frames_max"))
    return manifest.agg(F.count("*").alias("files"), F.count_distinct("pixel_md5").alias("distinct_md5")).crossJoin(sizes)  # one row each


def value_counts(df: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """column, value, n, rank of the most frequent values of each column, by one pass with grouping sets."""
    named = df.select(*(F.col(c).cast("string").alias(c) for c in columns))
    counted = named.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = F.coalesce(*(F.when(F.col("g") == (2 ** len(columns) - 1) - 2 ** (len(columns) - 1 - i), F.lit(c)) for i, c in enumerate(columns)))
    value = F.coalesce(*(F.when(which == c, F.col(c)) for c in columns))
    rows = counted.select(which.alias("column"), value.alias("value"), "n")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def folds(manifest: DataFrame, n: int = 5, seed: int = 20260915) -> DataFrame:
    """study, fold: studies in the order of a seeded hash, dealt in turn, so all files of a study share a fold."""
    studies = manifest.select("study_dir").distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "study_dir")))
    return positions(studies, ["_h", "study_dir"], "position").select(F.col("study_dir").alias("study"), (F.col("position") % n).cast("int").alias("fold"))


def labels_long(wide: DataFrame, regions: dict[str, list[str]]) -> DataFrame:
    """study, region, flags_or, violation_type: a row for each region of which at least one flag is known."""
    parts = [
        F.struct(F.lit(region).alias("region"), F.coalesce(*(F.col(f) for f in flags)).isNotNull().alias("known"), F.greatest(*(F.coalesce(F.col(f), F.lit(0)) for f in flags), F.lit(0)).alias("flags_or"),
                 F.concat_ws("|", *(F.when(F.col(f) == 1, F.lit(f)) for f in flags)).alias("violation_type"))
        for region, flags in regions.items()
    ]
    return wide.select("study", F.explode(F.array(*parts)).alias("r")).where("r.known").select("study", "r.region", F.col("r.flags_or").cast("int").alias("flags_or"), "r.violation_type")


def with_verdicts(labels: DataFrame, recorded: DataFrame) -> DataFrame:
    """``labels`` (from ``labels_long``) with verdict_itog, the recorded verdict (study, region, verdict) or else flags_or, and verdict_mismatch."""
    verdict = F.coalesce(F.col("verdict").cast("int"), F.col("flags_or"))
    return labels.join(recorded.select("study", "region", "verdict"), ["study", "region"], "left").withColumn("verdict_itog", verdict).withColumn("verdict_mismatch", (verdict != F.col("flags_or")).cast("int")).drop("verdict")


def with_folds(labels: DataFrame, dealt: DataFrame) -> DataFrame:
    """``labels`` with the fold of their study, for training only; studies without a fold are left out."""
    return labels.join(dealt.select("study", "fold"), "study")


def declared_and_stray(declared: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """key, state: found, missing (declared but not listed) or stray (listed but not declared)."""
    part = lambda df, other, how, state: df.select(key).join(other.select(key), key, how).select(key, F.lit(state).alias("state"))
    return part(declared, listed, "left_semi", "found").unionByName(part(declared, listed, "left_anti", "missing")).unionByName(part(listed, declared, "left_anti", "stray"))


def lookup(df: DataFrame, cache: DataFrame, key: str, value: str, live) -> DataFrame:
    """``df`` with ``value`` from the cache, else from ``live`` (an expression or a function of the rows that miss)."""
    joined = df.join(cache.select(key, F.col(value).alias("_cached")), key, "left")
    if callable(live) and not hasattr(live, "isNull"):
        hit = joined.where("_cached IS NOT NULL").withColumn(value, F.col("_cached")).drop("_cached")
        return hit.unionByName(live(joined.where("_cached IS NULL").drop("_cached")), allowMissingColumns=True)
    return joined.withColumn(value, F.coalesce("_cached", live)).drop("_cached")
