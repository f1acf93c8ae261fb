"""Measurements on row profiles, components, levels and landmarks (further feature sets), one group per frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from osseo.config import Rules

FRAME = "frame_id"
#: mm per pixel across and along, as the landmark rules use them.
LANDMARK_MM = (0.6, 0.73)


def frame_offset(masked: DataFrame) -> DataFrame:
    """How far the mask's centre lies from the middle column, as a share of the width."""
    got = masked.groupBy(FRAME).agg((F.avg(F.when(F.col("m"), F.col("x"))) / F.max("x") - 0.5).alias("cx_rel"))
    return got.select(FRAME, "cx_rel", F.abs("cx_rel").alias("cx_abs"))


def smoothed(rows: DataFrame, value: str, sigma: float, radius: int) -> DataFrame:
    """frame_id, y, smooth: the Gaussian mean over the rows around; beyond an end the profile is mirrored at it.

    A frame's profile is one array, as long as the image is high. Profiles of no more than ``radius`` rows stay as they are.
    """
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    at = lambda k: f"p[CASE WHEN i + ({k}) < 0 THEN -(i + ({k})) WHEN i + ({k}) >= size(p) THEN 2 * size(p) - 2 - (i + ({k})) ELSE i + ({k}) END].v"
    mean = " + ".join(f"{g / sum(weights)}D * {at(k)}" for k, g in zip(range(-radius, radius + 1), weights, strict=True))
    profile = rows.groupBy(FRAME).agg(F.array_sort(F.collect_list(F.struct("y", F.col(value).cast("double").alias("v")))).alias("p"))
    one = F.expr(f"transform(sequence(0, size(p) - 1), i -> struct(p[i].y AS y, CASE WHEN size(p) > {radius} THEN {mean} ELSE p[i].v END AS smooth))")
    return profile.select(FRAME, F.explode(one).alias("s")).select(FRAME, "s.y", "s.smooth")


def spacing(points: DataFrame, extent: DataFrame) -> DataFrame:
    """Number, mean step (over the span), its variation and the end gaps (in steps) of ordered points; extent: frame_id, y0, y1."""
    gaps = points.withColumn("gap", F.col("y") - F.lag("y").over(Window.partitionBy(FRAME).orderBy("y")))
    got = gaps.groupBy(FRAME).agg(F.count("*").alias("disc_n"), F.avg("gap").alias("step"), F.stddev_pop("gap").alias("sd"), F.min("y").alias("first"), F.max("y").alias("last")).join(extent, FRAME)
    return got.where("disc_n >= 2").select(
        FRAME, "disc_n", (F.col("step") / (F.col("y1") - F.col("y0"))).alias("disc_step_norm"), (F.col("sd") / F.col("step")).alias("disc_step_cv"), ((F.col("first") - F.col("y0")) / F.col("step")).alias("disc_top_gap"), ((F.col("y1") - F.col("last")) / F.col("step")).alias("disc_bot_gap")
    )


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """The point nearest to each frame's target (frame_id, t); the first one on a tie."""
    return points.join(targets, FRAME).groupBy(FRAME).agg(F.min(F.struct(F.abs(F.col("y") - F.col("t")).alias("d"), "y")).alias("b")).select(FRAME, F.col("b.y").alias("y"), F.col("b.d").alias("distance"))


def vertebra_levels(pixels: DataFrame, least_px: int = 50) -> DataFrame:
    """Place and shape of the bodies of a level map (frame_id, y, x, level; 1 on top, 0 none), in mean body heights; -1 where not measured.

    Levels of fewer than ``least_px`` pixels count for the asymmetry only. A body's width is the median of its rows, those without
    its pixels included. Slopes run over the places of the levels found, so a missing level does not stretch them.
    """
    size = pixels.groupBy(FRAME).agg((F.max("y") + 1).alias("h"))
    inside = pixels.where("level > 0")
    rows = inside.groupBy(FRAME, "level", "y").agg(F.count("*").alias("n"), F.sum("x").alias("xs"))
    level = rows.groupBy(FRAME, "level").agg(F.sum("n").alias("n"), F.min("y").alias("top"), F.max("y").alias("bottom"), (F.sum("xs") / F.sum("n")).alias("cx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("cy"), F.array_sort(F.collect_list("n")).alias("rows")).where(F.col("n") >= least_px)
    level = level.withColumn("height", F.col("bottom") - F.col("top") + 1).withColumn("rows", F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("height") - F.size("rows")), "rows"))
    level = level.withColumn("width", F.expr("(rows[(height - 1) div 2] + rows[height div 2]) / 2")).withColumn("aspect", F.col("height") / F.greatest("width", F.lit(1.0)))
    w = Window.partitionBy(FRAME)
    level = level.withColumn("unit", F.avg("height").over(w)).withColumn("axis", F.avg("cx").over(w)).withColumn("k", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("level")) - 1)
    line = level.groupBy(FRAME).agg(F.regr_slope("cx", "cy").alias("s"), F.regr_intercept("cx", "cy").alias("c"))
    ends = lambda f, name: f(F.struct("level", "cx", "cy", "top", "bottom")).alias(name)
    got = level.join(line, FRAME).groupBy(FRAME, "k", "unit", "axis").agg(
        ends(F.min, "a"), ends(F.max, "b"), F.max(F.abs(F.col("cx") - F.col("s") * F.col("cy") - F.col("c"))).alias("off"), F.median("aspect").alias("aspect"), F.regr_slope("aspect", "i").alias("aspect_slope"), F.regr_slope(F.col("width") / F.greatest("unit", F.lit(1.0)), F.col("i")).alias("width_slope"),
    )
    sides = inside.join(got.select(FRAME, "axis"), FRAME).groupBy(FRAME).agg(F.count_if(F.col("x") < F.floor("axis")).alias("left"), F.count_if(F.col("x") >= F.floor("axis")).alias("right"))
    out = size.join(got.join(sides, FRAME), FRAME, "left")
    pick = lambda least, c: F.when(F.col("k") >= least, c).otherwise(-1.0)
    return out.select(
        FRAME, pick(2, F.col("a.top") / F.col("unit")).alias("vl_gap_top_bodies"), pick(2, (F.col("h") - 1 - F.col("b.bottom")) / F.col("unit")).alias("vl_gap_bot_bodies"),
        pick(2, F.degrees(F.atan((F.col("b.cx") - F.col("a.cx")) / F.greatest(F.col("b.cy") - F.col("a.cy"), F.lit(1e-6))))).alias("vl_tilt_ends"), pick(3, F.col("off") / F.col("unit")).alias("vl_tilt_resid"), pick(2, F.col("aspect")).alias("vl_aspect_med"), pick(3, F.col("aspect_slope")).alias("vl_aspect_slope"),
        pick(3, F.col("width_slope")).alias("vl_width_slope"), pick(2, F.abs(F.col("left") - F.col("right")) / F.greatest(F.col("left") + F.col("right"), F.lit(1))).alias("vl_lr_asym"), pick(2, F.col("unit") / F.col("h")).alias("vl_body_h_px"),
    )


def phase(rows: DataFrame, periods: DataFrame, value: str = "zsum") -> DataFrame:
    """Phase of a profile at its period: the angle of one discrete Fourier coefficient."""
    turn = 2 * math.pi * F.col("y") / F.col("period")
    both = rows.join(periods.select(FRAME, "period"), FRAME)
    c = both.groupBy(FRAME).agg(F.sum(F.col(value) * F.cos(turn)).alias("re"), F.sum(-F.col(value) * F.sin(turn)).alias("im"))
    return c.select(FRAME, F.atan2("im", "re").alias("phase"), F.hypot("re", "im").alias("amplitude"))


# Fixed value: the share of the spine's quality head in its score.
SPINE_HEAD_SHARE = 0.3


def legacy_score(tilt: Column, artifact: Column, coverage: Column, rules: Rules, head: Column | None = None) -> Column:
    """The largest of the coverage as it is and of tilt and artifacts over twice their limits (limited to [0, 1]); with a head, 0.3 of it."""
    part = lambda v, limit: F.least(F.greatest(F.coalesce(v, F.lit(0.0)) / (2 * limit), F.lit(0.0)), F.lit(1.0))
    base = F.greatest(coverage, part(artifact, rules.artifact_threshold), part(tilt, rules.max_spine_tilt_deg))
    return base if head is None else (1 - SPINE_HEAD_SHARE) * base + SPINE_HEAD_SHARE * head


def region_guess(shape: DataFrame) -> DataFrame:
    """The older three-way guess, with a rounded confidence; ``shape`` has strength, bbox_aspect, col_span, profile_dip and lr_symmetry."""
    score = 0.6 * F.least(F.col("strength") / 0.35, F.lit(1.0)) + 0.4 * F.least(F.col("bbox_aspect") / 1.6, F.lit(1.0))
    both = (F.col("col_span") > 0.78) & (F.col("profile_dip") > 0.3) & (F.col("lr_symmetry") > 0.55)
    pick = lambda spine, two, one: F.when(F.col("score") > 0.62, spine).when(both, two).otherwise(one)
    sure = pick(F.least(F.col("score"), F.lit(1.0)), F.least(F.col("profile_dip") + 0.2, F.lit(1.0)), F.greatest(F.lit(0.3), 1 - F.col("score")))
    return shape.withColumn("score", score).select(FRAME, pick(F.lit("spine"), F.lit("hip_both"), F.lit("hip_single")).alias("guess"), F.bround(sure, 2).alias("confidence"))


def area_resized(pixels: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Pixels averaged over factor x factor blocks."""
    return pixels.groupBy(FRAME, F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x")).agg(F.avg(value).alias(value))


def rotated(masked: DataFrame, angles: DataFrame) -> DataFrame:
    """The frames turned by ``angle_deg`` (frame_id, angle_deg; counter-clockwise) about the middle of the frame.

    Each target pixel takes the source pixel nearest to where it comes from, so there are no holes; outside is dark and unmasked.
    """
    size = masked.groupBy(FRAME).agg(((F.max("x") + 1) / 2).alias("mx"), ((F.max("y") + 1) / 2).alias("my")).join(angles, FRAME)
    a = F.radians("angle_deg")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    near = lambda c: F.floor(F.round(c, 9) + 0.5).cast("int")
    wanted = masked.select(FRAME, "y", "x").join(size, FRAME).select(FRAME, F.col("y").alias("_y"), F.col("x").alias("_x"), near(F.col("mx") + dx * F.cos(a) - dy * F.sin(a)).alias("x"), near(F.col("my") + dx * F.sin(a) + dy * F.cos(a)).alias("y"))
    found = wanted.join(masked.select(FRAME, "y", "x", "z", "m"), [FRAME, "y", "x"], "left")
    return found.select(FRAME, F.col("_y").alias("y"), F.col("_x").alias("x"), F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("m", F.lit(False)).alias("m"))


# How sure a landmark must be, tissue that a frame must show beyond two of them, and the mask that a medial line needs.
LANDMARK_SURE, LANDMARK_ROOM, LINE_PIXELS, LINE_ROWS, LINE_FROM = 0.20, 30.0, 200, 10, 0.6


def medial_line(bone: DataFrame) -> DataFrame:
    """frame_id, k, c: the line x = k y + c along the medial edge of the lower part of a right femur's mask; none if that is too small."""
    size = bone.where("m").groupBy(FRAME).agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1")).where(F.col("n") > LINE_PIXELS)
    edge = bone.where("m").groupBy(FRAME, "y").agg(F.max("x").alias("x")).join(size, FRAME)
    edge = edge.where((F.col("y") >= F.floor(F.col("y0") + F.lit(LINE_FROM) * (F.col("y1") - F.col("y0")))) & (F.col("y") < F.col("y1")))
    got = edge.groupBy(FRAME).agg(F.regr_slope("x", "y").alias("k"), F.regr_intercept("x", "y").alias("c"), F.count("*").alias("rows"))
    return got.where(F.col("rows") > LINE_ROWS).select(FRAME, "k", "c")


def landmark_rules(points: Column, height: Column, line: Column | None = None) -> Column:
    """What the rules of placing a hip ask of its landmarks, in mm; null where a landmark is missing.

    ``points`` maps trochanter (the greater one's tip), ischium (lower edge), lesser (the lesser trochanter's peak), neck_upper and
    neck_lower (both edges of the neck) to struct x, y, conf; one below LANDMARK_SURE is missing. Without any points (null) lmk_empty is
    1. ``line`` is a struct k, c of ``medial_line``.
    """
    px, py = LANDMARK_MM

    def at(name: str) -> Column:
        p = F.try_element_at(points, F.lit(name))
        return F.when(p["conf"] >= LANDMARK_SURE, p)

    far = lambda a, b: F.hypot((a["x"] - b["x"]) * px, (a["y"] - b["y"]) * py)
    gt, isch, lt, upper, lower = (at(n) for n in ("trochanter", "ischium", "lesser", "neck_upper", "neck_lower"))
    some, above, below = points.isNotNull(), gt["y"] * py, (height - 1 - isch["y"]) * py
    dx, dy = (upper["x"] - lower["x"]) * px, (upper["y"] - lower["y"]) * py
    width = F.hypot(dx, dy)
    length = F.hypot(((upper["x"] + lower["x"]) / 2 - gt["x"]) * px, ((upper["y"] + lower["y"]) / 2 - gt["y"]) * py)
    out = F.lit(None).cast("double") if line is None else (lt["x"] - (line["k"] * lt["y"] + line["c"])) * px
    return F.struct(
        (~some).cast("double").alias("lmk_empty"), above.alias("lmk_above_gt_mm"), (above >= LANDMARK_ROOM).cast("double").alias("lmk_above_gt_ok"), below.alias("lmk_below_isch_mm"), (below >= LANDMARK_ROOM).cast("double").alias("lmk_below_isch_ok"),
        F.when(some, lt.isNull().cast("double")).alias("lmk_lt_absent"), out.alias("lmk_lt_out_mm"), width.alias("lmk_neck_w_mm"), F.abs(F.degrees(F.atan2(dx, dy + 1e-6))).alias("lmk_neck_ang"), length.alias("lmk_neck_len_mm"),
        F.when(width > 1, length / width).alias("lmk_neck_ratio"), far(upper, gt).alias("lmk_neck_to_gt_mm"), far(gt, lt).alias("lmk_gt_lt_mm"),
    )


def components_of_embedding(vectors: DataFrame, column: str = "embedding", k: int = 8) -> DataFrame:
    """vec_id and emb0..emb(k-1), the leading principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select("vec_id", array_to_vector(F.transform(column, lambda v: v.cast("double"))).alias("x"))
    got = PCA(k=k, inputCol="x", outputCol="p").fit(data).transform(data).withColumn("p", vector_to_array("p"))
    return got.select("vec_id", *(F.col("p")[i].alias(f"emb{i}") for i in range(k)))


def linear_contributions(features: Column, names: list[str], weights: list[float], means: list[float], top: int = 6) -> Column:
    """The features with the largest share in a linear head's score: name, value and weight * (value - mean)."""
    all_of = F.array(*(F.struct((-F.abs(w * (features[n] - m))).alias("order"), F.lit(n).alias("feature"), features[n].alias("value"), (w * (features[n] - m)).alias("impact")) for n, w, m in zip(names, weights, means, strict=True)))
    return F.transform(F.slice(F.array_sort(all_of), 1, top), lambda s: F.struct(s.feature.alias("feature"), s.value.alias("value"), s.impact.alias("impact")))
