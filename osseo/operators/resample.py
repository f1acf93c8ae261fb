"""Frames on other grids: a target grid's cells join the source cells that they weigh, first across, then down."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from osseo.operators.measures import smoothed

FRAME = "frame_id"
# The device's pixel in mm, across and down; a network's input size, the deviation and radius of the blur before the
# column is looked for, the share of the width that its window takes and the least width, and the percentiles of the input.
PIXEL_MM, INPUT = (0.6, 1.05), (384, 288)
BLUR, REACH, WINDOW_SHARE, WINDOW_LEAST, LEVELS = 3.0, 12, 10, 5, (0.02, 0.98)


def _weights(sizes: DataFrame, source: str, target: str, name: str, linear: bool) -> DataFrame:
    """frame_id, name, _to, weight: the one or two source places that each target place takes; sizes has both lengths."""
    cells = sizes.select(FRAME, F.col(source).alias("n"), F.col(target).alias("m"), F.explode(F.sequence(F.lit(0), F.col(target) - 1)).alias("_to"))
    if not linear:
        return cells.select(FRAME, "_to", F.least(F.floor(F.col("_to") * F.col("n") / F.col("m")), F.col("n") - 1).cast("int").alias(name), F.lit(1.0).alias("weight"))
    at = (F.col("_to") + 0.5) * F.col("n") / F.col("m") - 0.5
    first = F.floor(at)
    share = F.when((first < 0) | (first >= F.col("n") - 1), 0.0).otherwise(at - first)
    first = F.least(F.greatest(first, F.lit(0)), F.col("n") - 1).cast("int")
    both = cells.select(FRAME, "_to", F.array(F.struct(first.alias("p"), (1 - share).alias("w")), F.struct((first + 1).alias("p"), share.alias("w"))).alias("c"))
    return both.select(FRAME, "_to", F.explode("c").alias("c")).where("c.w > 0").select(FRAME, "_to", F.col("c.p").alias(name), F.col("c.w").alias("weight"))


def resized(pixels: DataFrame, targets: DataFrame, value: str = "v", linear: bool = True) -> DataFrame:
    """frame_id, y, x, value on grids of h2 x w2 (``targets``: frame_id, h2, w2): between the nearest cells, or the cell at the place.

    Places are those of cell middles; beyond the middles of the outer cells these hold.
    """
    sizes = pixels.groupBy(FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).join(targets, FRAME)
    across = pixels.select(FRAME, "y", "x", value).join(_weights(sizes, "w", "w2", "x", linear), [FRAME, "x"]).groupBy(FRAME, "y", F.col("_to").alias("x")).agg(F.sum(F.col(value) * F.col("weight")).alias(value))
    return across.join(_weights(sizes, "h", "h2", "y", linear), [FRAME, "y"]).groupBy(FRAME, F.col("_to").alias("y"), "x").agg(F.sum(F.col(value) * F.col("weight")).alias(value)).select(FRAME, "y", "x", value)


def isotropic(pixels: DataFrame, value: str = "v") -> DataFrame:
    """The frames with square pixels: narrower in the ratio of the device's pixel, as high as before."""
    size = pixels.groupBy(FRAME).agg((F.max("y") + 1).alias("h2"), F.greatest(F.lit(1), F.bround((F.max("x") + 1) * F.lit(PIXEL_MM[0] / PIXEL_MM[1])).cast("int")).alias("w2"))
    return resized(pixels, size, value)


def column_place(pixels: DataFrame, value: str = "v") -> DataFrame:
    """frame_id, column: where the mean of the blurred columns, averaged over a tenth of the width, is greatest (first wins)."""
    h = pixels.groupBy(FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    # a blur down the frame only changes how much the rows near its ends count in the mean
    norm = sum(math.exp(-k * k / (2 * BLUR * BLUR)) for k in range(-REACH, REACH + 1))
    taps = h.where(F.col("h") > REACH).select(FRAME, "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("to")).withColumn("k", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))))
    at = F.col("to") + F.col("k")
    rows = taps.withColumn("y", F.when(at < 0, -at).when(at >= F.col("h"), 2 * F.col("h") - 2 - at).otherwise(at)).groupBy(FRAME, "y").agg((F.sum(F.exp(-F.col("k") * F.col("k") / (2 * BLUR * BLUR))) / norm).alias("share"))
    mean = pixels.join(rows, [FRAME, "y"], "left").groupBy(FRAME, "x").agg((F.sum(F.coalesce("share", F.lit(1.0)) * F.col(value)) / F.count("*")).alias("m"))
    soft = smoothed(mean.select(FRAME, F.col("x").alias("y"), "m"), "m", BLUR, REACH)
    width = F.greatest(F.lit(WINDOW_LEAST), F.expr(f"w div {WINDOW_SHARE}"))
    profile = soft.groupBy(FRAME).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "smooth"))), lambda s: s["smooth"]).alias("p")).join(h.select(FRAME, width.alias("k")), FRAME)  # as long as the image is wide
    near = F.expr("transform(sequence(0, size(p) - 1), i -> round(aggregate(slice(p, greatest(i + (k - 1) div 2 - k + 1, 0) + 1, least(i + (k - 1) div 2, size(p) - 1) - greatest(i + (k - 1) div 2 - k + 1, 0) + 1), 0D, (a, v) -> a + v) / k, 9))")
    return profile.withColumn("s", near).select(FRAME, (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("column"))


def column_crop(pixels: DataFrame, value: str = "v", size: tuple[int, int] = INPUT) -> DataFrame:
    """frame_id, y, x, value on the grid of a network's input: as high as it, cut about the column, zeros beside a narrow frame, and
    stretched between two percentiles to [0, 1].
    """
    height, width = size
    whole = pixels.groupBy(FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    scale = F.lit(height) / F.col("h")
    targets = whole.select(FRAME, F.lit(height).alias("h2"), F.greatest(F.lit(1), F.bround(F.col("w") * scale).cast("int")).alias("w2"))
    start = column_place(pixels, value).join(whole, FRAME).join(targets.select(FRAME, "w2"), FRAME).select(FRAME, F.when(F.col("w2") >= width, F.greatest(F.lit(0), F.least(F.bround(F.col("column") * scale).cast("int") - width // 2, F.col("w2") - width))).otherwise(0).alias("x0"))
    piece = resized(pixels, targets, value).join(start, FRAME).withColumn("x", F.col("x") - F.col("x0")).where((F.col("x") >= 0) & (F.col("x") < width))
    grid = whole.select(FRAME, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select(FRAME, "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    full = grid.join(piece.select(FRAME, "y", "x", value), [FRAME, "y", "x"], "left").select(FRAME, "y", "x", F.coalesce(value, F.lit(0.0)).alias(value))
    ends = full.groupBy(FRAME).agg(F.percentile(value, F.array(*map(F.lit, LEVELS))).alias("e"))
    stretched = (F.col(value) - F.col("e")[0]) / (F.col("e")[1] - F.col("e")[0] + 1e-9)
    return full.join(ends, FRAME).select(FRAME, "y", "x", F.least(F.greatest(stretched, F.lit(0.0)), F.lit(1.0)).alias(value))
