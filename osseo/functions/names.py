"""Names of feature columns that people read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# What suffixes add to a name, and the name of an embedding's component.
SUFFIXES = {"mean": "в среднем", "min": "минимум", "max": "максимум", "asym": "разница сторон", "diff": "разница со второй стороной", "dev": "отклонение от нормы"}
COMPONENT = "компонента {} эмбеддинга снимка"
#: Suffixes that a column's name can hold one after another.
NESTED = 3


def display_names(columns: DataFrame, names: DataFrame) -> DataFrame:
    """feature, name: the name of each feature (column ``feature``) by the dictionary ``names`` (feature, name, each feature once).

    The longest part of a column that the dictionary has counts, and each suffix after it adds its word in brackets, the innermost
    first; components of embeddings have names of their own, with any suffix. What has no name keeps its column's.
    """
    words = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    component = F.regexp_extract("base", r"^emb([0-9]+)(_.*)?$", 1)
    # every way to take suffixes off, none first
    level = columns.select("feature", F.col("feature").alias("base"), F.lit("").alias("added"), F.lit(0).alias("off"))
    ways = level
    for k in range(1, NESTED + 1):
        last = F.regexp_extract("base", r"_([a-z]+)$", 1)
        level = level.where(last.isin(*SUFFIXES)).select("feature", F.regexp_replace("base", r"_[a-z]+$", "").alias("base"), F.concat(F.lit(" ("), words[last], F.lit(")"), F.col("added")).alias("added"), F.lit(k).alias("off"))
        ways = ways.unionByName(level)
    known = ways.join(F.broadcast(names.select(F.col("feature").alias("base"), "name")), "base", "left")  # a dictionary of feature names
    plain = F.when(component != "", F.replace(F.lit(COMPONENT), F.lit("{}"), component))
    found = known.withColumn("text", F.coalesce(F.concat("name", "added"), F.when(F.col("off") == 0, plain)))
    best = found.where("text IS NOT NULL").groupBy("feature").agg(F.min(F.struct(F.col("name").isNull().alias("made"), "off", "text")).alias("b"))
    return columns.select("feature").distinct().join(best, "feature", "left").select("feature", F.coalesce("b.text", "feature").alias("name"))
