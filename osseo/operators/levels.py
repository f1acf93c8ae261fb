"""Names of spine levels, counted from the row where the crests of the pelvis begin beside the column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FRAME = "frame_id"
# The rows whose centres place the column, its half width, where crests are looked for, the least row of a profile
# that holds them, the share of the greatest row and the least count of the first one, levels kept above and below the crest,
# the level at the crest, and the limits of two flags.
COLUMN_ROWS, COLUMN_HALF, LEAST_HALF = (0.35, 0.65), 0.16, 4
CREST_FROM, CREST_NEEDED, CREST_SHARE, CREST_LEAST = 0.5, 3, 0.15, 2.0
ABOVE, BELOW, AT_CREST = 4, 2, 4
IN_FRAME, WHOLE_BODY = 0.97, 0.7


def column_middle(column: DataFrame) -> DataFrame:
    """frame_id, h, w, top, c: size, first row of the column mask, and the column's middle (null without middle rows); ``column`` has filled rows."""
    size = column.groupBy(FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.min(F.when(F.col("m"), F.col("y"))).alias("top"))
    rows = column.where("m").groupBy(FRAME, "y").agg(((F.min("x") + F.max("x")) / 2).alias("cx"))
    lo, hi = (F.floor(F.lit(s) * F.col("h")) for s in COLUMN_ROWS)
    middle = rows.join(size, FRAME).where((F.col("y") >= lo) & (F.col("y") < hi)).groupBy(FRAME).agg(F.floor(F.median("cx")).alias("c"))
    return size.join(middle, FRAME, "left")


def side_profile(masked: DataFrame, middle: DataFrame) -> DataFrame:
    """frame_id, y, n of the rows from the middle of the frame down: mask pixels beside the column (rows without any are left out)."""
    half = F.greatest(F.lit(LEAST_HALF), F.floor(F.lit(COLUMN_HALF) * F.col("w")))
    beside = (F.col("x") < F.col("c") - half) | (F.col("x") >= F.col("c") + half)
    low = F.col("y") >= F.floor(F.lit(CREST_FROM) * F.col("h"))
    return masked.where("m").join(middle.where("c IS NOT NULL"), FRAME).where(beside & low).groupBy(FRAME, "y").agg(F.count("*").alias("n"))


def crests(masked: DataFrame, middle: DataFrame, soft=None) -> DataFrame:
    """frame_id, crest: the first row whose lateral mass reaches its share of the greatest one.

    ``soft`` gives a more generous mask for the frames (a table of frame_id) in which no row beside the column holds CREST_NEEDED pixels.
    """
    from osseo.operators.pixels import first_exceedance

    profile = side_profile(masked, middle)
    found = first_exceedance(profile, "n", CREST_SHARE, CREST_LEAST, CREST_NEEDED)
    if soft is not None:
        poor = middle.where("c IS NOT NULL").join(found, FRAME, "left_anti")
        found = found.unionByName(first_exceedance(side_profile(soft(poor.select(FRAME)), poor), "n", CREST_SHARE, CREST_LEAST, CREST_NEEDED))
    return found.select(FRAME, F.col("y").alias("crest"))


def spine_levels(masked: DataFrame, column: DataFrame, discs: DataFrame, soft=None) -> DataFrame:
    """Levels of the ``discs`` (frame_id, y) of each frame, the disc nearest to the crests being L4/L5.

    At most ABOVE discs above it and BELOW below it are levels, others are dropped. no_levels is 1 (and the rest null) with fewer than two
    discs or without crests. Names of levels count up downwards: 4 is L4/L5, 0 is Th12/L1.
    """
    middle = column_middle(column)
    found = discs.groupBy(FRAME).agg(F.array_sort(F.collect_list(F.col("y").cast("double"))).alias("d")).where("size(d) >= 2")  # as many as an image has rows
    at = found.join(crests(masked, middle, soft), FRAME).withColumn("gap", F.transform("d", lambda y: F.abs(y - F.col("crest"))))
    at = at.withColumn("k", F.array_position("gap", F.array_min("gap")).cast("int") - 1).withColumn("extra", F.greatest(F.col("k") - ABOVE, F.lit(0)))
    at = at.withColumn("kept", F.slice("d", F.col("extra") + 1, F.least(F.col("k"), F.lit(ABOVE)) + BELOW + 1)).withColumn("k", F.least(F.col("k"), F.lit(ABOVE)))
    steps = F.expr("array_sort(transform(sequence(1, size(kept) - 1), i -> kept[i] - kept[i - 1]))")
    at = at.withColumn("steps", F.when(F.size("kept") > 1, steps).otherwise(F.array(F.lit(1.0)))).withColumn("step", F.expr("(steps[(size(steps) - 1) div 2] + steps[size(steps) div 2]) / 2"))
    top, one = F.col("top_level").cast("double"), lambda c: c.cast("double")
    out = middle.join(at, FRAME, "left").withColumn("top_level", F.lit(AT_CREST) - F.col("k"))
    room = (F.col("kept")[0] - F.col("top")) / F.greatest(F.col("step"), F.lit(1.0))
    return out.select(
        FRAME, F.col("crest").isNull().cast("double").alias("no_levels"), (F.col("crest") / F.col("h")).alias("crest_rel"), one(F.size("d") - F.size("kept")).alias("levels_dropped"), top.alias("top_vertebra"),
        one((F.col("top_level") <= 1) & (room > WHOLE_BODY)).alias("l1_visible"), one(F.col("crest") < F.lit(IN_FRAME) * F.col("h")).alias("crest_in_frame"), one(F.size("kept") - F.col("k") - 1).alias("levels_below_crest"),
    ).withColumn("levels_dropped", F.when(F.col("no_levels") == 0, F.col("levels_dropped"))).withColumn("levels_below_crest", F.when(F.col("no_levels") == 0, F.col("levels_below_crest")))
