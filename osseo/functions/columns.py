"""Column helpers with the conventions of the measurements: sentinels, clipping, ranks, text."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: What a numeric model input holds when it was not measured.
ABSENT = -1.0

# Violation codes, and the texts and names of regions that a report must show.
VIOLATIONS = {
    "spine_coverage": "Некорректная укладка",
    "spine_axis": "Не выровнена ось позвоночника",
    "spine_artifact": "Присутствуют посторонние предметы",
    "hip_positioning": "Некорректная укладка",
    "hip_rotation": "Некорректная укладка",
    "hip_roi_coverage": "Некорректная область интереса",
}
REGION_NAMES = {"spine": "Поясничный отдел позвоночника", "hip_right": "Проксимальный отдел бедра", "hip_left": "Проксимальный отдел бедра", "unknown": ""}
NO_REGION = "анатомическая область не определена"


def number(c: Column) -> Column:
    """The value as a double; null, NaN, infinite and non-numeric values become ABSENT."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(ABSENT)).otherwise(v)


def clip(c: Column, low: float, high: float) -> Column:
    """Limits the value and keeps null null, unlike least() and greatest() alone."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def scaled_round(v: Column, digits: int) -> Column:
    """The value to that many digits as SQL engines round doubles: v times 10^digits as a double, halves away from zero.

    round() alone takes the decimal text of v: 36.995 is 36.99 here (3699.4999999999995) and 37.0 there.
    """
    return F.round(v * 10.0**digits) / 10.0**digits


def share_below(v: Column, reference: Column) -> Column:
    """The share of the reference values that are strictly below v."""
    return F.size(F.filter(reference, lambda r: r < v)) / F.greatest(F.size(reference), F.lit(1))


def violation_text(codes: Column) -> Column:
    """Texts of the codes, in order, each once, joined by semicolons; unknown codes are dropped."""
    texts = F.create_map(*(F.lit(x) for pair in VIOLATIONS.items() for x in pair))
    return F.array_join(F.array_distinct(F.filter(F.transform(codes, lambda c: F.try_element_at(texts, c)), lambda t: t.isNotNull())), ";")


def region_name(region: Column) -> Column:
    """The name of a region that a report shows; empty for others."""
    names = F.create_map(*(F.lit(x) for pair in REGION_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, region), F.lit(""))


def first_existing(features: Column, *names: str) -> Column:
    """The first named entry that the map has (even if not a number), else ABSENT."""
    out = F.lit(ABSENT)
    for name in reversed(names):
        out = F.when(F.map_contains_key(features, name), number(F.try_element_at(features, F.lit(name)))).otherwise(out)
    return out


def resolved(features: Column, name: str, centre: float | None = None) -> Column:
    """A feature by name: as it is, without _mean/_min/_max, as distance from a centre (_dev), or with a suffix added."""
    base, _, suffix = name.rpartition("_")
    if suffix in ("mean", "min", "max"):
        return first_existing(features, name, base)
    if suffix == "dev" and centre is not None:
        value = first_existing(features, base, f"{base}_mean")
        return F.when(value == ABSENT, ABSENT).otherwise(F.abs(value - centre))
    return first_existing(features, name, f"{name}_mean", f"{name}_max", f"{name}_min")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session on one machine (tests) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir", None)
        if found is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``df``, dealt by ``keys`` and saved in a way that plans know: what groups by these keys needs no other shuffle.

    Adaptive plans do not tell how their rows are dealt, so this one is not adaptive.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return saved(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the running sums of ``sums`` (name to value) in a global order, without moving all rows to one task.

    Rows are dealt by ranges of the order; a row's sum is that in its partition plus those of earlier partitions, of which
    there are as many as partitions. Rows that are equal in the order must not be spread over the sums (group first).
    """
    held = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumns({f"_{n}": v for n, v in sums.items()}))
    parts = held.groupBy("_part").agg(*(F.sum(f"_{n}").alias(n) for n in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_before") for n in sums))
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(F.broadcast(offsets), "_part").withColumns({n: F.sum(f"_{n}").over(local) + F.col(f"_{n}_before") for n in sums})
    return out.drop("_part", *(f"_{n}" for n in sums), *(f"_{n}_before" for n in sums))


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the global position (from 0) of each row in the order, without moving all rows to one task."""
    return running(df, [F.col(c) for c in order], {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
