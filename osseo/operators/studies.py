"""From per-frame features to a verdict per study and region, and back to every frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from osseo.config import Rules
from osseo.functions.columns import NO_REGION, region_name, scaled_round, share_below, violation_text
from osseo.operators import measures as Q
from osseo.operators.models import Head, fires, probability, with_probabilities

KEY = ["study", "region"]
# Features whose worst case is the smallest or the largest value.
WORST_LOW = ("contrast", "iliac_bottom_frac", "ribs_top_frac", "n_vertebrae")
WORST_HIGH = ("axis_deg", "curvature", "saturated_frac", "n_components", "outside_bright")


def aggregate_features(long: DataFrame) -> DataFrame:
    """study, region, feature, value: mean over frames that have the feature, and its worst case; n_frames as a feature.

    ``long`` has study, region, frame_id, feature, value. -1 counts as a value; NaN makes a mean NaN.
    """
    g = long.groupBy(*KEY, "feature").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    name = F.col("feature")
    low = name.startswith("margin_") | name.isin(*WORST_LOW)
    high = name.startswith("touch_") | name.startswith("thin_") | name.isin(*WORST_HIGH)
    pair = lambda suffix, value: F.struct(F.concat(name, F.lit(suffix)).alias("feature"), F.col(value).alias("value"))
    rows = F.filter(F.array(pair("_mean", "mean"), F.when(low, pair("_min", "low")), F.when(high, pair("_max", "high"))), lambda s: s.isNotNull())
    wide = g.select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.feature", "r.value")
    frames = long.groupBy(*KEY).agg(F.count_distinct("frame_id").cast("double").alias("value")).select(*KEY, F.lit("n_frames").alias("feature"), "value")
    return wide.unionByName(frames)


def region_aggregate(frames: DataFrame) -> DataFrame:
    """One row per study and region: n_frames, means of the angles, the artifact share and the coverage, and the largest mask axis.

    Means that lie on a limit are decided by their last digits, so values are added in the order of event_id, however the
    table is stored and dealt. The frames of a study's region are sorted in one task, which spills them where they are many.
    """
    values = ("axis_deg", "vb_axis_deg", "col_tilt_deg", "kp_art_frac", "coverage")
    ordered = Window.partitionBy(*KEY).orderBy("event_id", *values).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = frames.where("region <> 'error'").select(*KEY, "axis_deg", *(F.avg(c).over(ordered).alias(f"{c}_mean") for c in values))
    return rows.groupBy(*KEY).agg(F.count("*").alias("n_frames"), F.max("axis_deg").alias("axis_deg_max"), *(F.first(f"{c}_mean").alias(f"{c}_mean") for c in values))


def pair_asymmetry(regions: DataFrame, features: list[str]) -> DataFrame:
    """Adds has_pair, and _diff and _asym of each feature against the opposite hip (0 where either is missing)."""
    other = F.when(F.col("region") == "hip_right", "hip_left").when(F.col("region") == "hip_left", "hip_right")
    mates = regions.select("study", other.alias("region"), *(F.col(f).alias(f"_{f}") for f in features), F.lit(1.0).alias("has_pair")).where("region IS NOT NULL")
    out = regions.join(mates, KEY, "left").withColumn("has_pair", F.coalesce("has_pair", F.lit(0.0)))
    for f in features:
        d = F.coalesce(F.col(f) - F.col(f"_{f}"), F.lit(0.0))
        out = out.withColumn(f"{f}_diff", d).withColumn(f"{f}_asym", F.abs(d)).drop(f"_{f}")
    return out


def spine_tilt(*candidates: Column) -> Column:
    """The first candidate that is a finite number from 0 on, else -1."""
    return F.coalesce(*(F.when((c >= 0) & ~F.isnan(c) & (c < float("inf")), c) for c in candidates), F.lit(-1.0))


# The heads whose firing is a violation, in the order of a report.
SPINE_HEADS = {"spine_coverage": "spine_coverage"}
HIP_HEADS = {"hip_positioning": "hip_positioning", "hip_roi_coverage": "hip_roi"}


def violations(regions: DataFrame, rules: Rules, heads: dict[str, Head] | None = None) -> DataFrame:
    """Adds tilt, tilt_limit, the two spine rules and the list of violation codes; the rules fire strictly above their limits.

    The tilt is that of the vertebral bodies, else of the bright column, else of the mask; only the first has a limit of its own.
    Without an artifact feature in the rules the head spine_artifact decides. With ``heads``, rows need their probabilities.
    """
    spine = F.col("region") == "spine"
    vb = spine_tilt(F.col("vb_axis_deg_mean"))
    tilt = spine_tilt(F.col("vb_axis_deg_mean"), F.col("col_tilt_deg_mean"), F.col("axis_deg_max"))
    limit = F.when(vb >= 0, rules.vb_axis_limit_deg).otherwise(rules.max_spine_tilt_deg)
    axis = F.coalesce(spine & (tilt > limit), F.lit(False))
    measured = ~F.isnan("kp_art_frac_mean") & (F.col("kp_art_frac_mean") > rules.artifact_threshold)
    art = F.coalesce(spine & (measured if rules.artifact_feature else fires(heads, "spine_artifact")), F.lit(False))
    by_heads = [F.when(where & fires(heads, h), code) for where, table in ((spine, SPINE_HEADS), (~spine, HIP_HEADS)) for code, h in table.items()] if heads else []
    codes = F.filter(F.array(F.when(axis, "spine_axis"), F.when(art, "spine_artifact"), *by_heads), lambda c: c.isNotNull())
    return regions.withColumn("tilt", F.when(spine, tilt).otherwise(-1.0)).withColumn("tilt_limit", limit).withColumn("fires_axis", axis).withColumn("fires_artifact", art).withColumn("codes", codes)


def quality_score(regions: DataFrame, references: DataFrame, rules: Rules, coverage: Column, spine_head: Column, hip_head: Column) -> DataFrame:
    """Adds score: for spines 0.7 of the rank of the worst ratio to its limit and 0.3 of the head's rank, for hips the head's rank.

    The ratios are those of tilt, artifacts (absent: 0) and the probability of poor coverage. ``references`` is one row with the
    sorted arrays spine_agg, spine_head, hip_head (a few hundred values each).
    """
    artifacts = F.when(F.col("kp_art_frac_mean") >= 0, F.col("kp_art_frac_mean")).otherwise(0.0)
    worst = F.greatest(F.greatest(F.col("tilt"), F.lit(0.0)) / rules.max_spine_tilt_deg, artifacts / rules.artifact_threshold, coverage / rules.coverage_threshold)
    both = regions.crossJoin(F.broadcast(references))  # one row: a constant, not a product
    spine = (1 - Q.SPINE_HEAD_SHARE) * share_below(worst, F.col("spine_agg")) + Q.SPINE_HEAD_SHARE * share_below(spine_head, F.col("spine_head"))
    return both.withColumn("score", F.when(F.col("region") == "spine", spine).otherwise(share_below(hip_head, F.col("hip_head")))).drop("spine_agg", "spine_head", "hip_head")


def decide(regions: DataFrame, rules: Rules, heads: dict[str, Head] | None, references: DataFrame | None = None) -> DataFrame:
    """Adds quality_class, codes, violation_text, details, score and the probabilities ``heads`` to each region of a study.

    A spine is poor with any violation, a hip if its own head says so; a hip's types then follow its class. A head that is missing
    does not fire; in a spine's score it counts 0.5 (a hip's 0). Without references the older scale scores spines, and the
    head's probability hips. Without any model (None) all are good, without text, with score 0.
    """
    rated = violations(with_probabilities(regions, heads), rules, heads)
    spine = F.col("region") == "spine"
    hip = [(code, probability(h) / max(heads[h].threshold, 1e-6) if heads and h in heads else F.lit(-1.0)) for code, h in HIP_HEADS.items()]
    quality = F.when(spine, (F.size("codes") > 0).cast("int")).otherwise(fires(heads, "hip_quality").cast("int"))
    out = rated.withColumn("quality_class", quality)
    out = out.withColumn("codes", F.when(spine, F.col("codes")).otherwise(reconcile(F.col("quality_class"), F.col("codes"), *hip)))
    coverage, spine_head, hip_head = probability("spine_coverage", 0.5), probability("spine_quality", 0.5), probability("hip_quality")
    if references is None:
        older = Q.legacy_score(F.col("tilt"), F.col("kp_art_frac_mean"), coverage, rules, spine_head if heads and "spine_quality" in heads else None)
        out = out.withColumn("score", F.when(spine, older).otherwise(hip_head))
    else:
        out = quality_score(out, references, rules, coverage, spine_head, hip_head)
    if heads is None:
        out = out.withColumns({"quality_class": F.lit(0), "codes": F.array().cast("array<string>"), "score": F.lit(0.0)})
    return details(out.withColumn("violation_text", violation_text(F.col("codes"))), rules)


def reconcile(quality: Column, types: Column, first: tuple[str, Column], second: tuple[str, Column]) -> Column:
    """Hip types after the verdict: none if good; as found if bad; else the type whose ratio is larger (the first on a tie)."""
    best = F.when(first[1] >= second[1], F.lit(first[0])).otherwise(F.lit(second[0]))
    return F.when(quality == 0, F.array().cast("array<string>")).when(F.size(types) > 0, types).otherwise(F.array(best))


# The columns of a report, in order.
REPORT = ["path_to_study", "study_uid", "image_uid", "anatomical_region", "quality_class", "violation_type", "processing_status", "time_of_processing", "quality_prob", "details"]


def report(frames: DataFrame, verdicts: DataFrame) -> DataFrame:
    """REPORT: the verdict of its study and region on every frame.

    ``frames`` has path_to_study, image_uid, study, region (null, unknown or error: failed), seconds and reason; a failed frame has no
    class, type or score, and its reason as details. ``verdicts`` is what ``decide`` gives.
    """
    v = verdicts.select(*KEY, F.col("quality_class").alias("_q"), F.col("violation_text").alias("_text"), F.col("score").alias("_score"), F.col("details").alias("_details"))
    failed = F.col("region").isNull() | F.col("region").isin("unknown", "error")
    told = lambda value, none: F.when(failed, F.lit(none)).otherwise(F.coalesce(value, F.lit(none)))
    out = frames.join(v, KEY, "left").select(
        "path_to_study", F.col("study").cast("string").alias("study_uid"), "image_uid", F.when(failed, "").otherwise(region_name(F.col("region"))).alias("anatomical_region"), F.when(~failed, F.coalesce("_q", F.lit(0))).alias("quality_class"),
        told(F.col("_text"), "").alias("violation_type"), F.when(failed, "Failure").otherwise("Success").alias("processing_status"), F.round("seconds", 3).alias("time_of_processing"),
        F.round(told(F.col("_score"), 0.0), 5).alias("quality_prob"), F.when(failed, F.coalesce("reason", F.lit(NO_REGION))).otherwise(F.coalesce("_details", F.lit(""))).alias("details"),
    )
    return out.select(REPORT)


# The criterion that texts name, limits of the hints, and the names of levels from the top.
CRITERION_DEG = 5
SCOLIOSIS_CURVATURE = 0.128
SIDES_DIFFER_DEG = 4
SATURATED = 0.02
LEVELS = {5: "L5/S1", 4: "L4/L5", 3: "L3/L4", 2: "L2/L3", 1: "L1/L2", 0: "Th12/L1"}


def details(regions: DataFrame, rules: Rules) -> DataFrame:
    """Adds the sentences that explain a verdict, joined by semicolons; what a region's columns do not hold is not mentioned.

    Optional columns: top_vertebra_mean, kp_wing_absent_mean, crest_in_frame_mean and curv_rms_norm_mean of spines,
    shaft_angle_deg_mean, has_pair, shaft_angle_deg_mean_asym and saturated_frac_mean of hips.
    """
    c = lambda name: F.col(name) if name in regions.columns else F.lit(None).cast("double")
    degrees = lambda v: F.format_string("%.1f°", F.bround(v, 1))
    norm = F.when(F.col("tilt") <= rules.max_spine_tilt_deg, f" (в пределах нормы, критерий {CRITERION_DEG}°)").otherwise(f" — превышает норму (критерий {CRITERION_DEG}°)")
    top = F.bround(c("top_vertebra_mean"), 0).cast("int")
    level = F.coalesce(*(F.when(top == k, F.lit(name)) for k, name in LEVELS.items()), F.concat(F.lit("уровень "), top.cast("string")))
    crest = F.when(c("crest_in_frame_mean") > 0.5, "гребни в кадре").when(c("crest_in_frame_mean").isNotNull(), "гребни не видны")
    spine = [
        F.when(F.col("tilt") >= 0, F.concat(F.lit("наклон оси "), degrees(F.col("tilt")), norm)),
        F.when(c("top_vertebra_mean") > -9, F.concat(F.lit("сверху виден "), level)),
        F.when(c("kp_wing_absent_mean") > 0.5, "крыльев таза в кадре нет").otherwise(crest),
        F.when(c("kp_art_frac_mean") >= rules.artifact_threshold, "посторонние тонкие структуры вне позвоночника"),
        F.when(c("curv_rms_norm_mean") >= SCOLIOSIS_CURVATURE, "признаки сколиоза (нарушением укладки не считается)"),
    ]
    hip = [
        F.when(c("shaft_angle_deg_mean") >= 0, F.concat(F.lit("наклон диафиза "), degrees(c("shaft_angle_deg_mean")))),
        F.when((c("has_pair") > 0.5) & (c("shaft_angle_deg_mean_asym") > SIDES_DIFFER_DEG), F.concat(F.lit("стороны различаются на "), degrees(c("shaft_angle_deg_mean_asym")))),
        F.when(c("saturated_frac_mean") > SATURATED, "яркие включения, возможен эндопротез"),
    ]
    return regions.withColumn("details", F.when(F.col("region") == "spine", F.concat_ws("; ", *spine)).otherwise(F.concat_ws("; ", *hip)))


# The tasks that a report's checks name, by rule or head.
TASKS = {"spine_axis": "ось позвоночника", "spine_artifact": "посторонние предметы", "spine_coverage": "укладка позвоночника", "hip_positioning": "укладка бедра", "hip_roi": "область интереса бедра"}


def checks(regions: DataFrame, rules: Rules, heads: dict[str, Head] | None = None) -> DataFrame:
    """Adds the array of checks: task, kind (rule or head), value, threshold, fired. Rules fire above their limits, heads from them on.

    Spines have the two rules and the coverage head, hips two heads; a missing head has no check. Rows have tilt, and with
    ``heads`` their probabilities.
    """
    spine, digits = F.col("region") == "spine", {"spine_axis": 2, "spine_artifact": 5, "spine_coverage": 3, "hip_positioning": 3, "hip_roi": 3}
    one = lambda where, task, kind, value, limit, fired: F.when(where, F.struct(F.lit(TASKS[task]).alias("task"), F.lit(kind).alias("kind"), scaled_round(value, digits[task]).alias("value"), F.lit(limit).alias("threshold"), fired.alias("fired")))
    rule = lambda task, value, limit: one(spine, task, "rule", value, limit, F.coalesce(value > limit, F.lit(False)))
    found = [rule("spine_axis", F.col("tilt"), rules.vb_axis_limit_deg)]
    if rules.artifact_feature:
        found.append(rule("spine_artifact", F.col("kp_art_frac_mean"), rules.artifact_threshold))
    for where, names in ((spine, SPINE_HEADS), (~spine, HIP_HEADS)):
        for h in names.values():
            if heads and h in heads:
                found.append(one(where, h, "head", probability(h), heads[h].threshold, fires(heads, h)))
    return regions.withColumn("checks", F.filter(F.array(*found), lambda c: c.isNotNull()))


# The violation of each head's task, and the notes of checks that the report overrules.
TASK_VIOLATION = {"укладка позвоночника": "Некорректная укладка", "укладка бедра": "Некорректная укладка", "область интереса бедра": "Некорректная область интереса"}
CHOSEN_BELOW = "тип выбран по общей модели годности бедра: ближе всех к своему порогу"
DROPPED_ABOVE = "выше порога, но общая модель годности бедра считает снимок годным"


def agree(regions: DataFrame, names: dict[str, str] = TASK_VIOLATION) -> DataFrame:
    """Adds a note to each of the checks, and lets those of heads fire as violation_type says; other checks stay as they are."""
    told = F.split(F.coalesce("violation_type", F.lit("")), ";")
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def one(c: Column) -> Column:
        name = known[c["task"]]
        held = (c["kind"] == "head") & name.isNotNull()
        fires = F.coalesce(F.array_contains(told, name), F.lit(False))
        note = F.when(held & fires & ~c["fired"], CHOSEN_BELOW).when(held & ~fires & c["fired"], DROPPED_ABOVE)
        return F.struct(c["task"].alias("task"), c["kind"].alias("kind"), c["value"].alias("value"), c["threshold"].alias("threshold"), F.when(held, fires).otherwise(c["fired"]).alias("fired"), note.alias("note"))

    return regions.withColumn("checks", F.transform("checks", one))


def run_summary(report_rows: DataFrame) -> DataFrame:
    """Rows, violations, mean time and mean score by status and region, most rows first when ordered by n."""
    return report_rows.groupBy("processing_status", "anatomical_region").agg(F.count("*").alias("n"), F.count_if(F.col("quality_class") == 1).alias("violations"), F.avg("time_of_processing").alias("mean_time"), F.avg("quality_prob").alias("mean_prob"))
