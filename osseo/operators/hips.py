"""Measurements of hip frames in the frame of the femoral shaft, on a mask of one bone with filled rows.

``bone`` is the long relation (frame_id, y, x, z, m); all operators keep every frame: what cannot be measured is -1, or the
set's ``empty`` flag is 1. Frames are turned to the right side beforehand, so medial is towards greater x.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from osseo.operators.measures import rotated

FRAME = "frame_id"


def row_filled(masked: DataFrame) -> DataFrame:
    """The mask with every row filled between its outermost pixels: a cortical shell becomes a bone."""
    w = Window.partitionBy(FRAME, "y")
    end = lambda f: f(F.when(F.col("m"), F.col("x"))).over(w)
    return masked.withColumn("m", F.coalesce(F.col("x").between(end(F.min), end(F.max)), F.lit(False)))


def extent(bone: DataFrame) -> DataFrame:
    """frame_id, pixels, y_lo, y_hi and span (1 at least) of the mask; null without one."""
    y = F.when(F.col("m"), F.col("y"))
    got = bone.groupBy(FRAME).agg(F.count_if("m").alias("pixels"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi"))
    return got.withColumn("span", F.greatest(F.lit(1), F.col("y_hi") - F.col("y_lo")))


def shaft(bone: DataFrame) -> DataFrame:
    """``extent`` with the shaft's angle from the vertical and its foot (foot_x, foot_y: the centre of the lowest fifth, foot_n pixels).

    The angle is that of the line through the row middles below 60 percent; 0 with fewer than 20 rows, or 8 rows there.
    """
    facts = extent(bone)
    at = bone.where("m").join(facts, FRAME)
    rows = at.groupBy(FRAME, "y").agg(((F.min("x") + F.max("x")) / 2).alias("mid"), F.first(F.floor(F.col("y_lo") + 0.6 * (F.col("y_hi") - F.col("y_lo")))).alias("cut"))
    low = F.col("y") >= F.col("cut")
    line = rows.groupBy(FRAME).agg(F.count("*").alias("rows"), F.count_if(low).alias("low_rows"), F.regr_slope(F.when(low, F.col("mid")), F.when(low, F.col("y"))).alias("slope"))
    foot = at.where(F.col("y") >= F.floor(F.col("y_lo") + 0.8 * F.col("span"))).groupBy(FRAME).agg(F.avg("x").alias("foot_x"), F.avg("y").alias("foot_y"), F.count("*").alias("foot_n"))
    angle = F.when((F.col("rows") >= 20) & (F.col("low_rows") >= 8), F.degrees(F.atan("slope")))
    both = facts.join(line.select(FRAME, "rows", angle.alias("angle_deg")), FRAME, "left").join(foot, FRAME, "left")
    return both.fillna({"rows": 0, "angle_deg": 0.0, "foot_n": 0})


def _axes(x: str = "x", y: str = "y") -> tuple[F.Column, F.Column]:
    """Distances along the shaft (from the top of the bone) and across it (medial is positive)."""
    turn = F.radians("angle_deg")
    dx = F.col(x) - F.col("foot_x")
    return (F.col(y) - F.col("y_lo")) * F.cos(turn) + dx * F.sin(turn), dx * F.cos(turn) - (F.col(y) - F.col("foot_y")) * F.sin(turn)


def _tones(bone: DataFrame) -> DataFrame:
    return bone.where("m").groupBy(FRAME).agg(F.median("z").alias("mid"), (F.stddev_pop("z") + 1e-6).alias("scale"))


def medial_contrast(bone: DataFrame) -> DataFrame:
    """90th percentile and share above 1 of the z-scores medial of the shaft between 35 and 72 percent of the span."""
    s = shaft(bone)
    share = (F.col("y") - F.col("y_lo")) / F.col("span")
    zone = bone.where("m").join(s, FRAME).where("pixels >= 50 AND foot_n >= 10").where((_axes()[1] > 0) & (share > 0.35) & (share < 0.72))
    score = (F.col("z") - F.col("mid")) / F.col("scale")
    got = zone.join(_tones(bone), FRAME).groupBy(FRAME).agg(F.count("*").alias("n"), F.percentile(score, F.lit(0.9)).alias("p"), F.avg((score > 1).cast("double")).alias("b"))
    out = s.select(FRAME).join(got.where("n >= 20"), FRAME, "left")
    return out.select(FRAME, F.coalesce("p", F.lit(-1.0)).alias("med_prox_contrast"), F.coalesce("b", F.lit(-1.0)).alias("med_prox_bright_frac"), F.col("n").isNotNull().cast("double").alias("med_prox_ok"))


def grid(bone: DataFrame, widths: DataFrame, down: int = 4, across: int = 3) -> DataFrame:
    """frame_id, i, j, fill and intensity (in z-scores) of cells along and across the shaft; cells of fewer than 12 pixels hold -1.

    ``widths``: frame_id, shaft_w. Cells cover the upper three quarters of the span and 1.6 shaft widths on both sides; frames
    with too little bone have no cells (``empty_grid``).
    """
    along, side = _axes()
    i = F.floor(along / F.col("span") / 0.75 * down).cast("int")
    j = F.floor((side / F.col("shaft_w") + 1.6) / 3.2 * across).cast("int")
    at = bone.join(shaft(bone).where("pixels >= 50 AND foot_n >= 10").join(widths, FRAME), FRAME).withColumn("i", i).withColumn("j", j).where(F.col("i").between(0, down - 1) & F.col("j").between(0, across - 1))
    got = at.join(_tones(bone), FRAME).groupBy(FRAME, "i", "j").agg(F.count("*").alias("n"), F.avg(F.col("m").cast("double")).alias("fill"), F.avg(F.when(F.col("m"), (F.col("z") - F.col("mid")) / F.col("scale"))).alias("z"))
    few = F.col("n") < 12
    return got.select(FRAME, "i", "j", F.when(few, -1.0).otherwise(F.col("fill")).alias("fill"), F.when(few, -1.0).otherwise(F.coalesce("z", F.lit(-1.0))).alias("intensity"))


def grid_features(bone: DataFrame, widths: DataFrame, down: int = 4, across: int = 3) -> DataFrame:
    """The grid as one row a frame: g<i><j>_fill, g<i><j>_int and empty_grid."""
    cells = grid(bone, widths, down, across)
    here = lambda i, j: (F.col("i") == i) & (F.col("j") == j)
    wide = cells.groupBy(FRAME).agg(*(F.max(F.when(here(i, j), F.col(v))).alias(f"g{i}{j}_{n}") for i in range(down) for j in range(across) for v, n in (("fill", "fill"), ("intensity", "int"))))
    out = extent(bone).select(FRAME).join(wide.withColumn("empty_grid", F.lit(0.0)), FRAME, "left")
    empty = F.coalesce("empty_grid", F.lit(1.0))
    # a cell without any pixel of the frame is as one of too few
    return out.select(FRAME, *(F.when(empty == 0, F.coalesce(c, F.lit(-1.0))).alias(c) for c in wide.columns if c not in (FRAME, "empty_grid")), empty.alias("empty_grid"))


def femur_shape(bone: DataFrame) -> DataFrame:
    """Shaft width and how far the medial edge of the upright bone stands out beyond the shaft's edge line, between 30 and 70 percent."""
    angles = shaft(bone).select(FRAME, "angle_deg")
    upright = rotated(bone, angles.select(FRAME, (-F.col("angle_deg")).alias("angle_deg")))
    rows = upright.where("m").groupBy(FRAME, "y").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    ends = rows.groupBy(FRAME).agg(F.min("y").alias("y_lo"), (F.max("y") - F.min("y") + 1).alias("span"), F.count("*").alias("rows"))
    at = rows.join(ends, FRAME).withColumn("rel", (F.col("y") - F.col("y_lo")) / F.col("span")).withColumn("width", F.col("x_max") - F.col("x_min"))
    low, mid = F.col("rel") > 0.7, (F.col("rel") > 0.3) & (F.col("rel") < 0.7)
    edge = [F.when(low, F.col("x_max")), F.when(low, F.col("y"))]
    line = at.groupBy(FRAME).agg(
        F.first("rows").alias("rows"), F.count_if(low).alias("low_rows"), F.count_if(mid).alias("mid_rows"), F.median(F.when(low, F.col("width"))).alias("shaft_w"), F.regr_slope(*edge).alias("k"), F.regr_intercept(*edge).alias("c"),
        F.max(F.when(mid, F.col("width"))).alias("prox"), F.stddev_pop("width").alias("sd"),
    ).where("rows >= 20 AND low_rows >= 5 AND mid_rows >= 5")
    beyond = F.col("x_max") - F.col("k") * F.col("y") - F.col("c")
    out = at.drop("rows").where(mid).join(line, FRAME).groupBy(FRAME).agg(F.max(beyond).alias("most"), F.avg(F.greatest(beyond, F.lit(0.0))).alias("mean"))
    got = angles.join(line.join(out, FRAME), FRAME, "left")
    per_width = lambda c: F.when(F.col("shaft_w") > 0, c / F.col("shaft_w")).when(F.col("shaft_w").isNotNull(), 0.0)
    return got.select(
        FRAME, F.col("shaft_w").isNull().cast("double").alias("empty_femur"), F.when(F.col("shaft_w").isNotNull(), F.abs("angle_deg")).alias("shaft_angle_deg"), F.col("shaft_w").cast("double").alias("shaft_width_px"), F.col("most").alias("lt_protrusion_px"),
        per_width(F.col("most")).alias("lt_index"), F.col("mean").alias("lt_protrusion_mean"), per_width(F.col("prox")).alias("prox_width_ratio"), (F.col("sd") / (F.col("shaft_w") + 1e-6)).alias("width_profile_std"),
    )


def trochanter_density(bone: DataFrame) -> DataFrame:
    """Density of the medial half of each row between 25 and 55 percent of the span, over the shaft's: peak, mean, place and edge."""
    facts = shaft(bone)
    y0, y1 = F.floor(F.col("y_lo") + 0.25 * F.col("span")), F.floor(F.col("y_lo") + 0.55 * F.col("span"))
    at = bone.join(facts, FRAME)
    ref = at.where("m").groupBy(FRAME).agg(
        F.count_if(F.col("y") >= F.floor(F.col("y_lo") + 0.8 * F.col("span"))).alias("n_low"), F.median(F.when(F.col("y") >= F.floor(F.col("y_lo") + 0.8 * F.col("span")), F.col("z"))).alias("low"), F.median("z").alias("all"),
        F.count_if((F.col("y") >= y0) & (F.col("y") < y1)).alias("band"),
    ).select(FRAME, "band", F.greatest(F.when(F.col("n_low") > 20, F.col("low")).otherwise(F.col("all")), F.lit(1e-3)).alias("ref"))
    w = Window.partitionBy(FRAME, "y")
    banded = at.where("pixels >= 200 AND foot_n >= 10").where((F.col("y") >= y0) & (F.col("y") < y1))
    ends = banded.withColumn("b", F.max(F.when(F.col("m"), F.col("x"))).over(w)).withColumn("a", F.min(F.when(F.col("m"), F.col("x"))).over(w)).withColumn("k", F.count_if("m").over(w))
    half = ends.withColumn("h", F.floor(F.col("b") - 0.5 * (F.col("b") - F.col("a")))).where("k >= 6 AND b > h + 1 AND x BETWEEN h AND b")
    rows = half.groupBy(FRAME, "y").agg(F.max("z").alias("peak"), F.avg("z").alias("mean"), F.min(F.struct((-F.col("z")).alias("z"), "x")).alias("top"), F.first("b").alias("b"), F.first("h").alias("h"))
    rows = rows.withColumn("place", (F.col("b") - F.col("top.x")) / (F.col("b") - F.col("h"))).withColumn("step", F.abs(F.col("peak") - F.lag("peak").over(Window.partitionBy(FRAME).orderBy("y"))))
    got = rows.groupBy(FRAME).agg(F.count("*").alias("n"), F.max("peak").alias("peak"), F.avg("mean").alias("mean"), F.median("place").alias("place"), F.stddev_pop("place").alias("spread"), F.median("step").alias("step")).where("n >= 5")
    out = facts.select(FRAME).join(got.join(ref.where("band >= 40"), FRAME), FRAME, "left")
    return out.select(
        FRAME, F.col("n").isNull().cast("double").alias("lt_dens_empty"), (F.col("peak") / F.col("ref")).alias("lt_dens_peak"), (F.col("mean") / F.col("ref")).alias("lt_dens_mean"), F.col("place").alias("lt_dens_pos"),
        F.col("spread").alias("lt_dens_pos_std"), (F.col("step") / F.col("ref")).alias("lt_dens_grad"),
    )
