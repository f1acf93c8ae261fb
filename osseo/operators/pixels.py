"""Operators on the long pixel relation (frame_id, y, x, v).

Everything is grouped by frame first, so one shuffle by frame_id serves a chain of operators; a group is one frame or one of
its rows, which bounds it by the image size. Percentiles are exact within a frame.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from osseo.functions.columns import clip

FRAME = "frame_id"


def histogram_mode(pixels: DataFrame, bins: int = 64) -> DataFrame:
    """frame_id, mode_bin: the fullest bin between minimum and maximum, the lowest among equals."""
    ends = pixels.groupBy(FRAME).agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    bin_of = F.least(F.floor(F.try_divide(F.col("v") - F.col("v_min"), F.col("v_max") - F.col("v_min")) * bins), F.lit(bins - 1))
    counts = pixels.join(ends, FRAME).groupBy(FRAME, F.coalesce(bin_of, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    return counts.groupBy(FRAME).agg(F.min(F.struct(-F.col("n"), F.col("bin"))).alias("m")).select(FRAME, F.col("m.bin").alias("mode_bin"))


def fix_polarity(pixels: DataFrame, monochrome1: bool = False) -> DataFrame:
    """Turns bright-background frames: v becomes max - v where the fullest of 64 bins is above 32 (and for MONOCHROME1 before)."""
    if monochrome1:
        pixels = pixels.join(pixels.groupBy(FRAME).agg(F.max("v").alias("top")), FRAME).select(FRAME, "y", "x", (F.col("top") - F.col("v")).alias("v"))
    facts = histogram_mode(pixels).join(pixels.groupBy(FRAME).agg(F.max("v").alias("top")), FRAME).select(FRAME, "top", (F.col("mode_bin") > 32).alias("inverted"))
    return pixels.join(facts, FRAME).select(FRAME, "y", "x", F.when(F.col("inverted"), F.col("top") - F.col("v")).otherwise(F.col("v")).alias("v"), "inverted")


def window_levels(pixels: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """frame_id, lo, hi: exact percentiles, or the extremes where they coincide."""
    got = pixels.groupBy(FRAME).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    flat = F.col("p")[1] <= F.col("p")[0]
    return got.select(FRAME, F.when(flat, F.col("v_min")).otherwise(F.col("p")[0]).alias("lo"), F.when(flat, F.col("v_max")).otherwise(F.col("p")[1]).alias("hi"))


def normalise(pixels: DataFrame) -> DataFrame:
    """Adds z, the value within the window, in [0, 1]; constant frames become zeros."""
    scaled = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    return pixels.join(window_levels(pixels), FRAME).withColumn("z", F.coalesce(clip(scaled, 0.0, 1.0), F.lit(0.0))).drop("lo", "hi")


def bright_mask(pixels: DataFrame, share: float = 0.8) -> DataFrame:
    """Normalised pixels with m, whether z is above the frame's percentile."""
    z = normalise(pixels)
    return z.join(z.groupBy(FRAME).agg(F.percentile("z", F.lit(share)).alias("cut")), FRAME).withColumn("m", F.col("z") > F.col("cut")).drop("cut")


def multi_otsu(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """frame_id, t1, t2: the bins that separate three classes with the greatest between-class variance (first wins).

    With two occupied bins both are the two-class threshold, the lower bin; a constant frame has its one bin (nothing above it).
    The search runs over the histogram, bins * bins / 2 pairs a frame, not over pixels.
    """
    counts = normalise(pixels).groupBy(FRAME, F.floor(F.col("z") * (bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(FRAME).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.select(FRAME, "bin", F.sum("n").over(w).cast("double").alias("cn"), F.sum(F.col("n") * F.col("bin")).over(w).cast("double").alias("cs"))
    whole = cumulated.groupBy(FRAME).agg(F.max("cn").alias("tn"), F.max("cs").alias("ts"), F.max("bin").alias("last"), F.min("bin").alias("first"))
    a = cumulated.select(FRAME, F.col("bin").alias("t1"), F.col("cn").alias("n1"), F.col("cs").alias("s1"))
    b = cumulated.select(FRAME, F.col("bin").alias("t2"), F.col("cn").alias("n2"), F.col("cs").alias("s2"))
    pairs = a.join(b, FRAME).join(whole, FRAME).where("t1 < t2 AND t2 < last")
    between = F.expr("s1 * s1 / n1 + (s2 - s1) * (s2 - s1) / (n2 - n1) + (ts - s2) * (ts - s2) / (tn - n2)")
    best = pairs.groupBy(FRAME).agg(F.min(F.struct((-F.round(between, 6)).alias("score"), "t1", "t2")).alias("b"))
    return whole.join(best, FRAME, "left").select(FRAME, *(F.coalesce(f"b.{t}", "first").alias(t) for t in ("t1", "t2")))


def row_profile(masked: DataFrame) -> DataFrame:
    """Per row of a frame: number, extent, centre, sum and weighted centre of the mask's pixels."""
    weight = F.col("z") + 1e-6
    rows = masked.where("m").groupBy(FRAME, "y").agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("x").alias("cx"), F.sum("z").alias("zsum"), (F.sum(F.col("x") * weight) / F.sum(weight)).alias("wx"))
    return rows


def column_profile(masked: DataFrame) -> DataFrame:
    return masked.where("m").groupBy(FRAME, "x").agg(F.count("*").alias("n"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.avg("z").alias("zmean"))


def silhouette(masked: DataFrame) -> DataFrame:
    """Bounding box, fill, aspect, margins, border contact and intensities of each frame's mask; empty is 1 (and the rest null or 0) without mask pixels.

    saturated_frac is the share of the whole frame at its greatest value; without background its mean counts as 0.
    """
    topped = masked.withColumn("_top", F.max("z").over(Window.partitionBy(FRAME)))
    size = topped.groupBy(FRAME).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.coalesce(F.avg(F.when(~F.col("m"), F.col("z"))), F.lit(0.0)).alias("bg_mean"), F.avg((F.col("z") >= F.col("_top") - 1e-6).cast("double")).alias("saturated_frac"))
    box = masked.where("m").groupBy(FRAME).agg(
        *(f(c).alias(f"{c}{n}") for c in ("x", "y") for f, n in ((F.min, 0), (F.max, 1))),
        F.count("*").alias("n"), F.avg("z").alias("int_mean"), F.stddev_pop("z").alias("int_std"), F.percentile("z", F.lit(0.95)).alias("int_p95"),
    )
    both = size.join(box, FRAME, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bw, bh = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    one = lambda c: c.cast("double")
    return both.select(
        FRAME, (F.col("n") / (F.col("w") * F.col("h"))).alias("area_frac"), (bh / bw).alias("bbox_aspect"), (F.col("n") / (bw * bh)).alias("fill"), (bw / F.col("w")).alias("col_span"), (bh / F.col("h")).alias("row_span"),
        (F.col("y0") / F.col("h")).alias("margin_top_frac"), ((F.col("h") - 1 - F.col("y1")) / F.col("h")).alias("margin_bottom_frac"), (F.col("x0") / F.col("w")).alias("margin_left_frac"), ((F.col("w") - 1 - F.col("x1")) / F.col("w")).alias("margin_right_frac"),
        one(F.col("y0") <= 1).alias("touch_top"), one(F.col("y1") >= F.col("h") - 2).alias("touch_bottom"), one(F.col("x0") <= 1).alias("touch_left"), one(F.col("x1") >= F.col("w") - 2).alias("touch_right"), "int_mean", "int_std", "int_p95", (F.col("int_mean") - F.col("bg_mean")).alias("contrast"), "saturated_frac", "bg_mean", one(F.col("n") == 0).alias("empty"),
    )


def axis_orientation(masked: DataFrame) -> DataFrame:
    """axis_deg (0 to 90, from the vertical) and length of the main axis of the mask's covariance."""
    c = masked.where("m").groupBy(FRAME).agg(F.var_samp("x").alias("a"), F.var_samp("y").alias("c"), F.covar_samp("x", "y").alias("b"))
    half = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    lam = (F.col("a") + F.col("c")) / 2 + half
    angle = F.abs(F.degrees(F.atan2(F.col("b"), lam - F.col("a"))))  # eigenvector (b, lam - a)
    return c.select(FRAME, F.when(angle > 90, 180 - angle).otherwise(angle).alias("axis_deg"), (4 * F.sqrt(lam)).alias("length"))


# Fixed value: rows that a third of a column must exceed to have a slope.
THIRD_ROWS = 10


def centre_line(rows: DataFrame, least_rows: int = 40, frames: DataFrame | None = None) -> DataFrame:
    """Tilt, bend and width statistics of the line through the row centres; empty_spine where there are too few rows.

    Only thirds of more than THIRD_ROWS rows have a slope; without any, slopes do not differ. ``frames``: the frame_ids to give a row each, as frames with an empty mask have no rows at all.
    """
    line = rows.groupBy(FRAME).agg(F.regr_slope("cx", "y").alias("slope"), F.regr_intercept("cx", "y").alias("icpt"), F.count("*").alias("n"), F.median(F.col("x_max") - F.col("x_min")).alias("width"), F.stddev_pop(F.col("x_max") - F.col("x_min")).alias("sd"))
    cells = rows.join(line, FRAME).withColumn("res", F.col("cx") - F.col("slope") * F.col("y") - F.col("icpt")).withColumn("third", F.ntile(3).over(Window.partitionBy(FRAME).orderBy("y")))
    thirds = cells.groupBy(FRAME, "third").agg(F.when(F.count("*") > THIRD_ROWS, F.regr_slope("cx", "y")).alias("s")).groupBy(FRAME)
    thirds = thirds.agg(F.coalesce(F.max("s") - F.min("s"), F.lit(0.0)).alias("spread"), F.coalesce(F.max(F.sign("s")) - F.min(F.sign("s")), F.lit(0.0)).alias("signs"))
    bend = cells.groupBy(FRAME).agg(F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rms"), F.max(F.abs("res")).alias("most"))
    out = line.join(bend, FRAME).join(thirds, FRAME)
    out = out if frames is None else frames.select(FRAME).distinct().join(out, FRAME, "left")
    enough = F.col("n") >= least_rows
    return out.select(
        FRAME, F.when(enough, 0.0).otherwise(1.0).alias("empty_spine"), F.when(enough, F.abs(F.degrees(F.atan("slope")))).alias("tilt_deg"), F.when(enough, F.col("rms") / (F.col("width") + 1e-6)).alias("curv_rms_norm"),
        F.when(enough, F.col("most") / (F.col("width") + 1e-6)).alias("curv_max_norm"), F.when(enough, (F.col("signs") > 0).cast("double")).alias("slope_sign_change"), F.when(enough, F.degrees(F.atan("spread"))).alias("slope_spread"), F.when(enough, F.col("sd") / (F.col("width") + 1e-6)).alias("width_cv"),
    )


def curvature(masked: DataFrame, least_rows: int = 20) -> DataFrame:
    """Mean distance of the row centres of the mask from their line, over the frame's width; 0 where there are too few rows."""
    rows = masked.where("m").groupBy(FRAME, "y").agg(F.avg("x").alias("cx"))
    line = rows.groupBy(FRAME).agg(F.regr_slope("cx", "y").alias("k"), F.regr_intercept("cx", "y").alias("c"), F.count("*").alias("n")).where(F.col("n") >= least_rows)
    off = rows.join(line, FRAME).groupBy(FRAME).agg(F.avg(F.abs(F.col("cx") - F.col("k") * F.col("y") - F.col("c"))).alias("off"))
    width = masked.groupBy(FRAME).agg((F.max("x") + 1).alias("w"))
    return width.join(off, FRAME, "left").select(FRAME, F.coalesce(F.col("off") / F.col("w"), F.lit(0.0)).alias("curvature"))


def spine_column(bone: DataFrame, share: float = 0.12, least_rows: int = 40) -> DataFrame:
    """Tilt, bend, widths and place of the column, from the brightness-weighted centres of its rows; ``bone`` has filled rows.

    A pixel weighs its value above the row's least one. The tilt is that between the mean centres of the first and last rows
    (share of all, 3 at least), the kink the difference of the angles of both halves. Every frame has a row.
    """
    size = bone.groupBy(FRAME).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    inside = bone.where("m").withColumn("weight", F.col("z") - F.min("z").over(Window.partitionBy(FRAME, "y")) + 1e-6)
    rows = inside.groupBy(FRAME, "y").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("cx"), (F.max("x") - F.min("x")).alias("width"), F.count("*").alias("n"))
    w = Window.partitionBy(FRAME)
    numbered = rows.withColumn("r", F.row_number().over(w.orderBy("y"))).withColumn("rows", F.count("*").over(w)).where(F.col("rows") >= least_rows).withColumn("k", F.greatest(F.lit(3), F.floor(F.col("rows") * share))).withColumn("half", F.floor(F.col("rows") / 2))
    head, tail, upper = F.col("r") <= F.col("k"), F.col("r") > F.col("rows") - F.col("k"), F.col("r") <= F.col("half")
    got = numbered.groupBy(FRAME).agg(
        *(F.avg(F.when(c, F.col(v))).alias(f"{v}_{n}") for v in ("cx", "y") for c, n in ((head, "a"), (tail, "b"))), *(F.regr_slope(F.when(c, F.col("cx")), F.when(c, F.col("y"))).alias(n) for c, n in ((upper, "s1"), (~upper, "s2"))),
        F.regr_slope("cx", "y").alias("s"), F.regr_intercept("cx", "y").alias("c"), F.median("width").alias("width"), F.stddev_pop("width").alias("sd"), F.sum("n").alias("area"), F.min("y").alias("top"), F.max("y").alias("bottom"),
    )
    bend = numbered.join(got.select(FRAME, "s", "c"), FRAME).groupBy(FRAME).agg(F.sqrt(F.avg(F.pow(F.col("cx") - F.col("s") * F.col("y") - F.col("c"), 2))).alias("rms"))
    out = size.join(got.join(bend, FRAME), FRAME, "left")
    return out.select(
        FRAME, F.col("s").isNull().cast("double").alias("empty_column"), F.abs(F.degrees(F.atan((F.col("cx_b") - F.col("cx_a")) / F.greatest(F.col("y_b") - F.col("y_a"), F.lit(1e-6))))).alias("col_tilt_deg"), (F.col("rms") / (F.col("width") + 1e-6)).alias("col_curv_norm"),
        F.abs(F.degrees(F.atan("s1")) - F.degrees(F.atan("s2"))).alias("col_kink_deg"), (F.col("width") / F.col("w")).alias("col_width_med"), (F.col("sd") / (F.col("width") + 1e-6)).alias("col_width_cv"), ((F.col("bottom") - F.col("top")) / F.col("h")).alias("col_height_frac"),
        (F.col("area") / (F.col("h") * F.col("w"))).alias("col_area_frac"), (F.col("top") / F.col("h")).alias("col_top_margin"), ((F.col("h") - F.col("bottom")) / F.col("h")).alias("col_bottom_margin"),
    )


def visibility(masked: DataFrame) -> DataFrame:
    """Share of mask pixels in the side bands of the lowest and highest 15 percent of rows."""
    size = masked.groupBy(FRAME).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    side = (F.col("x") < F.floor(0.28 * F.col("w"))) | (F.col("x") >= F.floor(0.72 * F.col("w")))
    m = F.col("m").cast("double")
    return masked.join(size, FRAME).groupBy(FRAME).agg(F.avg(F.when(side & (F.col("y") >= F.floor(0.85 * F.col("h"))), m)).alias("iliac_bottom_frac"), F.avg(F.when(side & (F.col("y") < F.floor(0.15 * F.col("h"))), m)).alias("ribs_top_frac"))


def field_of_view(normal: DataFrame, dark: float = 0.002, share: float = 0.98) -> DataFrame:
    """Dark share, shares of rows and columns that are dark nearly throughout, and the extent from the first to the last other one.

    A frame without any other row or column counts as open.
    """
    d = (F.col("z") <= dark).cast("double")
    lines = lambda c: normal.groupBy(FRAME, c).agg(F.avg(d).alias("d")).groupBy(FRAME).agg(F.count_if(F.col("d") > share).alias(f"masked_{c}"), F.count("*").alias(f"n_{c}"), (F.max(F.when(F.col("d") <= share, F.col(c))) - F.min(F.when(F.col("d") <= share, F.col(c))) + 1).alias(f"open_{c}"))
    got = normal.groupBy(FRAME).agg(F.avg(d).alias("masked_frac")).join(lines("x"), FRAME).join(lines("y"), FRAME)
    seen = F.col("open_x").isNotNull() & F.col("open_y").isNotNull()
    pick = lambda value, none: F.when(seen, value).otherwise(F.lit(none))
    return got.select(
        FRAME, "masked_frac", pick(F.col("masked_x") / F.col("n_x"), 0.0).alias("masked_cols"), pick(F.col("masked_y") / F.col("n_y"), 0.0).alias("masked_rows"),
        pick(F.col("open_x") / F.col("n_x"), 1.0).alias("fov_w_frac"), pick(F.col("open_y") / F.col("n_y"), 1.0).alias("fov_h_frac"),
    )


def period(rows: DataFrame) -> DataFrame:
    """period (lag of the greatest autocorrelation of the row profile, first wins) and its strength; a frame's profile is one array."""
    profile = rows.groupBy(FRAME).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "zsum"))), lambda s: s.zsum).alias("p"))  # as long as the image is high
    centred = profile.withColumn("p", F.expr("transform(p, v -> v - aggregate(p, 0D, (a, u) -> a + u) / size(p))"))
    product = "aggregate(sequence(0, size(p) - 1 - k), 0D, (a, i) -> a + p[i] * p[i + k])"
    lags = centred.withColumn("lo", F.expr("greatest(3, int(floor(0.08 * size(p))))")).withColumn("hi", F.expr("greatest(5, int(floor(0.45 * size(p))))")).where("lo < hi AND hi <= size(p)")
    scored = lags.withColumn("ac", F.expr(f"transform(sequence(lo, hi - 1), k -> named_struct('r', -round({product} / (aggregate(p, 0D, (a, u) -> a + u * u) + 1e-9D), 9), 'k', k))"))
    return scored.select(FRAME, F.expr("array_min(ac).k").alias("period"), F.expr("-array_min(ac).r").alias("strength"))


def brightness_rows(masked: DataFrame) -> DataFrame:
    """frame_id, y, zsum of every row of the frame: the mask's brightness in it, 0 without mask pixels."""
    return masked.groupBy(FRAME, "y").agg(F.sum(F.when(F.col("m"), F.col("z")).otherwise(0.0)).alias("zsum"))


def vertebra_count(masked: DataFrame, mm_y: float | None = None) -> DataFrame:
    """n_vertebrae (rows of the mask over the period), period_px, period_strength and vertebra_mm; all 0 for an even profile or a short frame."""
    rows = brightness_rows(masked)
    even = rows.groupBy(FRAME).agg((F.stddev_pop("zsum") < 1e-6).alias("even"))
    span = masked.where("m").groupBy(FRAME).agg((F.max("y") - F.min("y") + 1).alias("span"))
    got = even.join(period(rows), FRAME, "left").join(span, FRAME, "left")
    found = ~F.col("even") & F.col("period").isNotNull()
    pick = lambda value: F.when(found, F.coalesce(value, F.lit(0.0))).otherwise(0.0)
    return got.select(FRAME, pick(F.col("span") / F.col("period")).alias("n_vertebrae"), pick(F.col("period").cast("double")).alias("period_px"), pick(F.col("strength")).alias("period_strength"), pick(F.col("period") * F.lit(float(mm_y or 0))).alias("vertebra_mm"))


def peaks(rows: DataFrame, value: str = "zsum") -> DataFrame:
    """frame_id, y of the local peaks: not below the row before and above the row after."""
    w = Window.partitionBy(FRAME).orderBy("y")
    v = F.col(value)
    return rows.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w)).where((v >= F.col("_p")) & (v > F.col("_n"))).select(FRAME, "y", v.alias("value"))


def spaced_peaks(rows: DataFrame, value: str = "zsum", least: float = 0.3, gap: int = 8) -> DataFrame:
    """frame_id, y of the local peaks above ``least`` that keep ``gap`` rows between them: of nearer ones, in order, the higher stays.

    One fold over a frame's peaks, an array as long as the image is high at most.
    """
    found = peaks(rows, value).where(F.col("value") > least).groupBy(FRAME).agg(F.array_sort(F.collect_list(F.struct("y", "value"))).alias("p"))
    kept = f"""aggregate(p, CAST(array() AS array<struct<y: int, value: double>>), (a, x) -> CASE WHEN size(a) = 0 OR x.y - element_at(a, -1).y >= {gap} THEN concat(a, array(x))
      WHEN x.value > element_at(a, -1).value THEN concat(slice(a, 1, size(a) - 1), array(x)) ELSE a END)"""
    return found.select(FRAME, F.explode(F.expr(kept)).alias("k")).select(FRAME, "k.y", "k.value")


def template_response(rows: DataFrame, widths: list[int], value: str = "zsum") -> DataFrame:
    """Per frame the width of the light-dark-light template with the greatest response, and where (first wins)."""
    w = Window.partitionBy(FRAME).orderBy("y")
    out = None
    for width in widths:
        mean = lambda a, b: F.avg(value).over(w.rowsBetween(a, b))
        got = rows.select(FRAME, "y", F.lit(width).alias("width"), (0.5 * mean(-2 * width, -width - 1) - mean(-width, -1) + 0.5 * mean(0, width - 1)).alias("r"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(FRAME)).alias("n"))
        got = got.where((F.col("i") > 2 * width) & (F.col("i") + width - 1 <= F.col("n")))
        out = got if out is None else out.unionByName(got)
    best = out.groupBy(FRAME).agg(F.min(F.struct((-F.round("r", 9)).alias("r"), "width", "y")).alias("b"))
    return best.select(FRAME, F.col("b.width").alias("width"), F.col("b.y").alias("y"), (-F.col("b.r")).alias("response"))


def side_margins(masked: DataFrame, mm: float = 0.6, least: float = 20.0) -> DataFrame:
    """Distances in mm from the mask to the left and right border, and whether the smaller one suffices."""
    got = masked.groupBy(FRAME).agg((F.min(F.when(F.col("m"), F.col("x"))) * mm).alias("left"), ((F.max("x") - F.max(F.when(F.col("m"), F.col("x")))) * mm).alias("right"))
    low = F.least("left", "right")
    return got.select(FRAME, F.col("left").alias("roi_margin_left_mm"), F.col("right").alias("roi_margin_right_mm"), low.alias("roi_margin_min_mm"), (low >= least).cast("double").alias("roi_margin_ok"), F.greatest(F.lit(0.0), least - low).alias("roi_margin_deficit_mm"))


def side(masked: DataFrame) -> DataFrame:
    """right if the mask's upper rows lie right of its lower ones, else left."""
    cut = masked.where("m").groupBy(FRAME).agg(F.percentile("y", F.array(F.lit(0.3), F.lit(0.7))).alias("p"))
    got = masked.where("m").join(cut, FRAME).groupBy(FRAME).agg(F.avg(F.when(F.col("y") < F.col("p")[0], F.col("x"))).alias("top_x"), F.avg(F.when(F.col("y") > F.col("p")[1], F.col("x"))).alias("bottom_x"))
    return got.select(FRAME, "top_x", "bottom_x", F.when(F.col("top_x").isNull() | F.col("bottom_x").isNull(), "unknown").when(F.col("top_x") > F.col("bottom_x"), "right").otherwise("left").alias("side"))


def route(masked: DataFrame) -> DataFrame:
    """The region by aspect and periodicity: score, confidence and class; hips by side, unknown below 0.6, without side or 50 mask pixels.

    A hip's confidence is rounded to two digits; it is 0 without a side or 50 mask pixels.
    """
    shape = silhouette(masked).select(FRAME, "bbox_aspect")
    n = masked.groupBy(FRAME).agg(F.count_if("m").alias("n"))
    p = period(brightness_rows(masked)).select(FRAME, "strength")
    both = n.join(shape, FRAME, "left").join(p, FRAME, "left").fillna(0.0, ["bbox_aspect", "strength"]).join(side(masked).select(FRAME, "side"), FRAME, "left")
    score = 0.6 * F.least(F.col("strength") / 0.35, F.lit(1.0)) + 0.4 * F.least(F.col("bbox_aspect") / 1.6, F.lit(1.0))
    spine = F.col("score") > 0.62
    conf = F.when(spine, F.least(F.col("score"), F.lit(1.0))).otherwise(F.least(1 - F.col("score"), F.lit(1.0)))
    hip = F.when(F.col("side") == "right", "hip_right").when(F.col("side") == "left", "hip_left").otherwise("unknown")
    found = F.when((F.col("n") < 50) | (F.col("confidence") < 0.6), "unknown").when(F.col("score") > 0.62, "spine").otherwise(hip)
    sure = F.when(F.col("n") < 50, 0.0).when((F.col("confidence") < 0.6) | spine, F.col("confidence")).when(hip == "unknown", 0.0).otherwise(F.bround("confidence", 2))
    return both.withColumn("score", score).withColumn("confidence", conf).select(FRAME, "score", sure.alias("confidence"), found.alias("region"))


def outline_features(masked: DataFrame, network: DataFrame | None = None) -> DataFrame:
    """The ten values of a silhouette by which regions were told before; all 0 for a frame without mask pixels.

    ``network`` (frame_id, y, x of mask pixels) is a network's mask; without one its area and whether it fills the frame are 0.
    """
    size = masked.groupBy(FRAME).agg((F.max("y") + 1).alias("h"), F.count("*").alias("px"))
    top = masked.where("m").join(size, FRAME).groupBy(FRAME, "h", "px").agg((F.count_if(F.col("y") < F.expr("h div 3")) / F.count("*")).alias("top_heavy"))
    shape = silhouette(masked).select(FRAME, "area_frac", "bbox_aspect", "col_span")
    rows = brightness_rows(masked)
    found = period(rows).join(rows.groupBy(FRAME).agg((F.stddev_pop("zsum") < 1e-6).alias("even")), FRAME).where("NOT even")
    both = top.join(shape, FRAME).join(column_shape(masked), FRAME, "left").join(found, FRAME, "left")
    both = both.withColumn("period_strength", F.col("strength")).withColumn("period_lag", F.col("period") / F.col("h"))
    seen = network.groupBy(FRAME).agg(F.count("*").alias("seen")) if network is not None else masked.select(FRAME).distinct().withColumn("seen", F.lit(0))
    both = masked.select(FRAME).distinct().join(both, FRAME, "left").join(seen, FRAME, "left").withColumn("sam_area_frac", F.col("seen") / F.col("px")).withColumn("sam_full_frame", (F.col("sam_area_frac") > 0.85).cast("double"))
    names = ("area_frac", "bbox_aspect", "col_span", "profile_dip", "lr_symmetry", "period_strength", "period_lag", "top_heavy", "sam_area_frac", "sam_full_frame")
    return both.select(FRAME, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


def region_features(masked: DataFrame) -> DataFrame:
    """What a region classifier without an embedding reads: aspect, span, fill, area, period, top_heavy, bot_heavy and row_var; zeros below 20 mask pixels."""
    h = masked.groupBy(FRAME).agg((F.max("y") + 1).alias("h"))
    third = masked.where("m").join(h, FRAME).groupBy(FRAME).agg(F.count("*").alias("n"), F.avg((F.col("y") < F.expr("h div 3")).cast("double")).alias("top_heavy"), F.avg((F.col("y") >= F.expr("2 * h div 3")).cast("double")).alias("bot_heavy"))
    rows = masked.groupBy(FRAME, "y").agg(F.count_if("m").alias("n")).groupBy(FRAME).agg((F.stddev_pop("n") / (F.avg("n") + 1e-9)).alias("row_var"))
    shape = silhouette(masked).select(FRAME, F.col("bbox_aspect").alias("aspect"), F.col("col_span").alias("span"), "fill", F.col("area_frac").alias("area"))
    both = shape.join(third, FRAME, "left").join(rows, FRAME).join(period(brightness_rows(masked)).select(FRAME, F.col("strength").alias("period")), FRAME, "left")
    return both.select(FRAME, *(F.when(F.col("n") >= 20, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in ("aspect", "span", "fill", "area", "period", "top_heavy", "bot_heavy", "row_var")))


def column_shape(masked: DataFrame) -> DataFrame:
    """profile_dip and lr_symmetry of the number of mask pixels by column, smoothed by 11 Gaussian weights (sigma 2, mirrored ends).

    The dip is one minus the least over the greatest of the middle half; the symmetry is the smaller half's sum over the larger's.
    """
    per = masked.groupBy(FRAME, "x").agg(F.count_if("m").cast("double").alias("n")).groupBy(FRAME).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "n"))), lambda s: s.n).alias("p"))  # as long as the image is wide
    total = sum(math.exp(-k * k / 8) for k in range(-5, 6))
    # a place beyond an end is mirrored at it, the end itself not repeated
    at = lambda k: f"p[CASE WHEN i + ({k}) < 0 THEN -(i + ({k})) WHEN i + ({k}) >= size(p) THEN 2 * size(p) - 2 - (i + ({k})) ELSE i + ({k}) END]"
    smooth = " + ".join(f"{math.exp(-k * k / 8) / total}D * {at(k)}" for k in range(-5, 6))
    c = per.where("size(p) > 5").select(FRAME, F.expr(f"transform(sequence(0, size(p) - 1), i -> {smooth})").alias("c")).selectExpr(FRAME, "c", "int(floor(0.25 * size(c))) AS a", "int(floor(0.75 * size(c))) AS b", "size(c) div 2 AS half")
    inner = c.selectExpr(FRAME, "slice(c, a + 1, b - a) AS inner", "aggregate(slice(c, 1, int(half)), 0D, (s, v) -> s + v) AS l", "aggregate(slice(c, int(half) + 1, size(c)), 0D, (s, v) -> s + v) AS r")
    return inner.selectExpr(FRAME, "CASE WHEN array_max(inner) > 0 THEN 1 - array_min(inner) / array_max(inner) ELSE 0D END AS profile_dip", "CASE WHEN greatest(l, r) > 0 THEN least(l, r) / greatest(l, r) ELSE 0D END AS lr_symmetry")


def mask_union(masks: DataFrame, least: int = 60) -> DataFrame:
    """frame_id, y, x, m: the union of those masks (frame_id, mask, y, x of their pixels) that have at least so many pixels."""
    sized = masks.withColumn("_n", F.count("*").over(Window.partitionBy(FRAME, "mask")))
    return sized.where(F.col("_n") >= least).select(FRAME, "y", "x").distinct().withColumn("m", F.lit(True))


def first_exceedance(rows: DataFrame, value: str, share: float = 0.15, least: float = 2.0, needed: float = 3.0) -> DataFrame:
    """frame_id, y of the first row whose value reaches max(least, share of the greatest one); none if the greatest is below ``needed``."""
    top = rows.groupBy(FRAME).agg(F.max(value).alias("_top")).where(F.col("_top") >= needed)
    return rows.join(top, FRAME).where(F.col(value) >= F.greatest(F.lit(least), share * F.col("_top"))).groupBy(FRAME).agg(F.min("y").alias("y"))


def mirror(pixels: DataFrame) -> DataFrame:
    """Pixels with x counted from the other side."""
    w = pixels.groupBy(FRAME).agg(F.max("x").alias("last"))
    return pixels.join(w, FRAME).withColumn("x", F.col("last") - F.col("x")).drop("last")


def _slid(pixels: DataFrame, f, along: str, across: str, r: int, value: str) -> DataFrame:
    return pixels.withColumn(value, f(value).over(Window.partitionBy(FRAME, across).orderBy(along).rowsBetween(-r, r)))


def erode(pixels: DataFrame, r: int, value: str = "z") -> DataFrame:
    """Minimum over a (2r + 1)-square; separable, so two windows of one line each."""
    return _slid(_slid(pixels, F.min, "x", "y", r, value), F.min, "y", "x", r, value)


def dilate(pixels: DataFrame, r: int, value: str = "z") -> DataFrame:
    return _slid(_slid(pixels, F.max, "x", "y", r, value), F.max, "y", "x", r, value)


def top_hat(pixels: DataFrame, r: int) -> DataFrame:
    """z minus its opening: what is bright and narrower than the square."""
    opened = dilate(erode(pixels.withColumn("o", F.col("z")), r, "o"), r, "o")
    return opened.withColumn("hat", F.col("z") - F.col("o")).drop("o")


def chain_positions(points: DataFrame, rows: DataFrame) -> DataFrame:
    """x of the polyline through ``points`` (frame_id, y, px) at each of ``rows`` (frame_id, y); end segments go on beyond."""
    w = Window.partitionBy(FRAME).orderBy("y")
    seg = points.select(FRAME, F.col("y").alias("y0"), F.col("px").alias("x0"), F.lead("y").over(w).alias("y1"), F.lead("px").over(w).alias("x1"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(FRAME)).alias("n")).where("y1 IS NOT NULL")
    held = ((F.col("y") >= F.col("y0")) | (F.col("i") == 1)) & ((F.col("y") < F.col("y1")) | (F.col("i") == F.col("n") - 1))
    return rows.join(seg, FRAME).where(held).select(FRAME, "y", (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0"))).alias("x"))


def masked_pool(cells: DataFrame, least: int = 4) -> DataFrame:
    """frame_id, v: the mean vector of a map's cells (frame_id, m, v) in the mask, or of all if it has fewer than ``least``, divided by its length."""
    at = cells.select(FRAME, "m", F.posexplode("v").alias("i", "x"))
    mean = at.groupBy(FRAME, "i").agg(F.avg("x").alias("all"), F.avg(F.when(F.col("m"), F.col("x"))).alias("some"), F.count_if("m").alias("n"))
    mean = mean.select(FRAME, "i", F.when(F.col("n") >= least, F.col("some")).otherwise(F.col("all")).alias("x"))
    whole = mean.groupBy(FRAME).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))  # as long as a vector
    return whole.select(FRAME, F.expr("transform(v, x -> x / (sqrt(aggregate(v, 0D, (a, u) -> a + u * u)) + 1e-6D))").alias("v"))
