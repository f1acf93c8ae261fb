"""Landmarks of the upper femur from distances to the edge of its mask: the head's circle, the isthmus on the way to the shaft, the far side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from osseo.operators import hips as H
from osseo.operators.neighbourhood import distances

FRAME = "frame_id"
# Least numbers of mask pixels in all and in the foot, where the foot begins, how far down the head and the trochanter
# may lie, steps of the walk from the head to the foot, and the part of it where the isthmus may lie.
LEAST, FOOT_LEAST, FOOT, HEAD, TROCHANTER = 50, 10, 0.8, 0.45, 0.55
WALK, ISTHMUS = 120, (0.15, 0.75)
NAMES = ("prox_r_px", "prox_dist_ratio", "isthmus_ratio", "prox_axis_deg", "gt_offset_ratio", "prox_shaft_ratio")


def landmark_points(bone: DataFrame) -> DataFrame:
    """Positions and radii per frame: head (hx, hy, hr), isthmus (nx, ny, nr), trochanter's offset gt, foot (sx, sy), its median distance, the shaft's direction.

    ``bone`` has filled rows and is turned to a right femur. The head is the pixel with the greatest distance to the edge on the medial
    side of the shaft's axis (of the whole upper part, if there is none), the isthmus the place with the least one on the straight walk
    from the head to the foot, and the trochanter the pixel farthest to the lateral side; ties go to the first in scan order.
    """
    angle = H.shaft(bone).select(FRAME, F.radians("angle_deg").alias("a"))
    bounds = bone.groupBy(FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count_if("m").alias("n"), F.min(F.when(F.col("m"), F.col("y"))).alias("y_lo"), F.max(F.when(F.col("m"), F.col("y"))).alias("y_hi")).where(F.col("n") >= LEAST)
    d = distances(bone).join(bounds, FRAME).withColumn("span", F.greatest(F.lit(1), F.col("y_hi") - F.col("y_lo")))
    part = lambda share: F.col("y") < F.col("y_lo") + F.lit(share) * F.col("span")
    low = F.col("y") >= F.floor(F.col("y_lo") + F.lit(FOOT) * F.col("span"))
    foot = d.where(low).groupBy(FRAME).agg(F.avg("x").alias("sx"), F.avg("y").alias("sy"), F.median("d").alias("sd"), F.count("*").alias("fn")).where(F.col("fn") >= FOOT_LEAST)
    # lateral is to the left of a right femur's axis
    placed = d.join(foot, FRAME).join(angle, FRAME).withColumn("off", -((F.col("x") - F.col("sx")) * F.cos("a") - (F.col("y") - F.col("sy")) * F.sin("a")))
    first = lambda cond, value: F.max(F.when(cond, F.struct(value.alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))))
    off = F.round("off", 9)
    got = placed.groupBy(FRAME, "h", "w", "sx", "sy", "sd", "a").agg(first(part(HEAD) & (F.col("off") < 0), F.col("d")).alias("medial"), first(part(HEAD), F.col("d")).alias("upper"), F.max(F.when(part(TROCHANTER), off)).alias("gt_upper"), F.max(off).alias("gt_all"))
    head = F.coalesce("medial", "upper")
    got = got.select(FRAME, "h", "w", "sx", "sy", "sd", "a", (-head["y"]).alias("hy"), (-head["x"]).alias("hx"), head["v"].alias("hr"), F.coalesce("gt_upper", "gt_all").alias("gt")).where(F.col("hr") > 0)
    walk = got.select(FRAME, "h", "w", "sx", "sy", "hx", "hy", F.explode(F.sequence(F.lit(0), F.lit(WALK - 1))).alias("k")).withColumn("t", F.col("k") / F.lit(WALK - 1))
    walk = walk.where((F.col("t") > ISTHMUS[0]) & (F.col("t") < ISTHMUS[1])).withColumn("px", F.col("hx") + (F.col("sx") - F.col("hx")) * F.col("t")).withColumn("py", F.col("hy") + (F.col("sy") - F.col("hy")) * F.col("t"))
    cell = lambda c, size: F.least(F.greatest(F.col(c).cast("int"), F.lit(0)), F.col(size) - 1)
    walk = walk.withColumn("y", cell("py", "h")).withColumn("x", cell("px", "w")).join(d.select(FRAME, "y", "x", "d"), [FRAME, "y", "x"], "left")
    neck = walk.groupBy(FRAME).agg(F.min(F.struct(F.coalesce("d", F.lit(0.0)).alias("nr"), "k", F.col("px").alias("nx"), F.col("py").alias("ny"))).alias("n"))
    return got.join(neck, FRAME).select(FRAME, "hx", "hy", "hr", "n.nx", "n.ny", "n.nr", "gt", "sx", "sy", "sd", "a")


def femur_points(bone: DataFrame) -> DataFrame:
    """empty_lm, and NAMES where it is 0: the head's radius, its distance from the isthmus, the isthmus, the neck's angle to the shaft, the
    trochanter's offset and the head's width against the shaft's.
    """
    p = landmark_points(bone)
    vx, vy = F.col("hx") - F.col("nx"), F.col("hy") - F.col("ny")
    length = F.hypot(vx, vy)
    cosine = (vx * F.sin("a") + vy * F.cos("a")) / (length + 1e-6)
    got = p.select(
        FRAME, F.col("hr").alias("prox_r_px"), (length / (2 * F.col("hr"))).alias("prox_dist_ratio"), (F.col("nr") / F.col("hr")).alias("isthmus_ratio"), F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))).alias("prox_axis_deg"),
        (F.col("gt") / (2 * F.col("hr"))).alias("gt_offset_ratio"), (2 * F.col("hr") / (2 * F.col("sd") + 1e-6)).alias("prox_shaft_ratio"),
    )
    frames = bone.select(FRAME).distinct()
    return frames.join(got, FRAME, "left").select(FRAME, F.col("prox_r_px").isNull().cast("double").alias("empty_lm"), *NAMES)
