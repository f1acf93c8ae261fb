"""Every registered query with SQL against DuckDB, and analytic images with known answers."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from osseo.functions.columns import VIOLATIONS, number, positions, resolved, violation_text
from osseo.operators import evaluation, hips as H, manifests, measures as Q, neighbourhood as N, pixels as P, studies as S
from osseo.plans import oracle, queries, registry
from osseo.sources.surrogates import pixels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(rows) -> list:
    def value(v):
        if v is None or isinstance(v, (bool, str)):
            return v
        return None if math.isnan(v) else round(float(v), 6) + 0.0

    return sorted((tuple(value(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(oracle.SQL[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.select(quoted).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_runs_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def image(spark, array: np.ndarray, frame: int = 0):
    y, x = np.indices(array.shape)
    rows = list(zip([frame] * array.size, y.ravel().tolist(), x.ravel().tolist(), array.ravel().astype(float).tolist()))
    return spark.createDataFrame(rows, "frame_id long, y int, x int, v double")


def test_tilted_bar(spark):
    bar = np.zeros((60, 60))
    for y in range(60):
        bar[y, int(round(20 + y * 0.2)) : int(round(20 + y * 0.2)) + 8] = 1
    masked = image(spark, bar).select("frame_id", "y", "x", F.col("v").alias("z"), (F.col("v") > 0).alias("m"))
    row = P.centre_line(P.row_profile(masked)).first()
    assert abs(row.tilt_deg - math.degrees(math.atan(0.2))) < 0.5 and row.empty_spine == 0
    flipped = P.mirror(masked.withColumnRenamed("z", "v")).withColumnRenamed("v", "z")
    assert abs(P.centre_line(P.row_profile(flipped)).first().tilt_deg - row.tilt_deg) < 1e-9


def test_constant_image_is_zero(spark):
    assert P.normalise(image(spark, np.full((20, 20), 7.0))).agg(F.max("z")).first()[0] == 0


def test_period_of_stripes(spark):
    stripes = np.tile((np.arange(60) % 10 < 5).astype(float)[:, None], (1, 30)) + 0.5
    masked = image(spark, stripes).select("frame_id", "y", "x", F.col("v").alias("z"), F.lit(True).alias("m"))
    assert P.period(P.row_profile(masked)).first().period == 10


def test_two_blobs(spark):
    m = np.zeros((20, 20))
    m[2:5, 2:5], m[5, 5], m[12:18, 10:14] = 1, 1, 1
    masked = image(spark, m).withColumn("m", F.col("v") > 0)
    assert sorted(r.n for r in N.components(masked).groupBy("component").agg(F.count("*").alias("n")).collect()) == [10, 24]
    assert len({r.component for r in N.components(masked, eight=False).collect()}) == 3


def test_neighbourhood_pieces():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert N.filled(ring)[4, 4] and N.filled(ring).sum() == 25
    d = N.distance(np.pad(np.ones((5, 5), bool), 1))
    assert d.max() == 3 and d[1, 1] == 1
    assert N.best_chain(np.array([0, 5, 10, 11, 20.0]), np.array([1, 1, 1, 3, 1.0]), 10) == [0, 3, 4]
    assert N.monotone_levels(np.array([[1, 0], [0, 3], [2, 0], [0, 1.0]])).tolist() == [0, 1, 1, 1]


def test_sentinels_and_texts(spark):
    row = spark.range(1).select(
        number(F.lit("x")).alias("a"), number(F.lit(float("nan"))).alias("b"), number(F.lit("2.5")).alias("c"),
        violation_text(F.array(F.lit("spine_axis"), F.lit("?"), F.lit("spine_axis"), F.lit("hip_positioning"), F.lit("hip_rotation"), F.lit("spine_coverage"), F.lit("hip_roi_coverage"))).alias("t"),
        resolved(F.create_map(F.lit("x_mean"), F.lit(float("nan")), F.lit("x_max"), F.lit(3.0)), "x").alias("first"),
    ).first()
    assert (row.a, row.b, row.c, row.first) == (-1, -1, 2.5, -1)
    assert row.t == "Не выровнена ось позвоночника;Некорректная укладка;Некорректная область интереса"
    assert set(VIOLATIONS) == {"spine_coverage", "spine_axis", "spine_artifact", "hip_positioning", "hip_rotation", "hip_roi_coverage"}


def test_pairs_are_antisymmetric(spark):
    got = {(r.study, r.region): r for r in queries.pair_asymmetry(spark, SF).collect()}
    for (study, region), r in got.items():
        assert r.axis_deg_mean_asym >= 0
        if region == "hip_right" and (study, "hip_left") in got:
            assert abs(r.axis_deg_mean_diff + got[study, "hip_left"].axis_deg_mean_diff) < 1e-6


def test_positions_are_global(spark):
    got = positions(spark.range(1000).withColumn("k", F.xxhash64("id")), ["k"], "p").orderBy("p").collect()
    assert [r.p for r in got] == list(range(1000)) and all(a.k < b.k for a, b in zip(got, got[1:]))


def test_registry(spark):
    with pytest.raises(ValueError):
        registry.register(registry.FeatureSet("bad", lambda d: None, needs=("nothing",)))
    names = [s.name for s in registry.for_region("hip_left")]
    assert "femur_medial" in names and "spine_axis" not in names and "hip_side_margins" not in names
    assert registry.describe(spark).count() == 24


def test_dealt_rows_are_not_shuffled_again(spark):
    from osseo.functions.columns import dealt

    df = dealt(spark.range(200).select((F.col("id") % 7).alias("frame_id"), "id"), "frame_id")
    plan = df.groupBy("frame_id").agg(F.sum("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and df.count() == 200 and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_features_of_frames_with_providers(spark):
    """Every enabled set gives its features; frames without what a provider finds get what the set says."""
    from osseo.sources import surrogates as V

    masked = P.bright_mask(V.pixels(spark, SF).where("frame_id < 3"))
    points = P.row_profile(masked).where("frame_id = 1 AND y % 10 = 8").select("frame_id", "y", F.col("wx").alias("px"))
    bodies = spark.createDataFrame([(2, 3.5, 4.0)], "frame_id long, vb_axis_deg double, vb_n double")
    levels = masked.where("frame_id = 0").select("frame_id", "y", "x", F.when(F.col("m"), F.expr("1 + y div 16")).otherwise(0).cast("int").alias("level"))
    got = {(r.frame_id, r.feature): r.value for r in registry.features_long(masked, "spine", {"points": points, "bodies": bodies, "levels": levels}).collect()}
    assert [got[k, "vb_axis_deg"] for k in range(3)] == [-1, -1, 3.5] and got[2, "vb_n"] == 4
    assert [got[k, "kp_wing_vis"] for k in (0, 2)] == [1, 1] and got[0, "vl_body_h_px"] > 0 and got[1, "vl_body_h_px"] == got[2, "vl_aspect_med"] == -1
    names = {f for _, f in got}
    assert {"arc_max_len", "n_vertebrae", "no_levels", "empty_spine", "kp_art_frac", "thin_n", "cx_rel", "empty_column"} <= names and "lmk_empty" not in names
    hip = {(r.frame_id, r.feature): r.value for r in registry.features_long(masked.where("frame_id = 0"), "hip_left").collect()}
    assert hip[0, "lmk_empty"] == 1 and (0, "empty_lm") in hip and (0, "empty_femur") in hip


def test_duplicates_are_marked_once(spark):
    m = spark.createDataFrame([("a", 2, "x"), ("a", 1, "x"), ("b", 3, "y")], "study_dir string, rel_path long, pixel_md5 string")
    got = {r.rel_path: (r.dup_group, r.dup_count, r.is_canonical) for r in manifests.mark_duplicates(m).collect()}
    assert got == {1: (0, 2, True), 2: (0, 2, False), 3: (1, 1, True)}


def test_evaluation_corner_cases(spark):
    one = spark.createDataFrame([(0, 0.1, "a")], "y int, p double, grp string")
    assert evaluation.threshold_by_rate(one).first()[0] == 0.5
    assert evaluation.report(one, 0.5).first().sensitivity == 0


def test_reconcile(spark):
    empty, some = F.array().cast("array<string>"), F.array(F.lit("t"))
    pick = lambda q, types, a, b: S.reconcile(F.lit(q), types, ("x", F.lit(a)), ("y", F.lit(b)))
    row = spark.range(1).select(pick(0, some, 1.0, 2.0), pick(1, some, 1.0, 2.0), pick(1, empty, 2.0, 2.0), pick(1, empty, 1.0, 2.0)).first()
    assert list(row) == [[], ["t"], ["x"], ["y"]]


def test_heads_have_the_reference_sizes(spark):
    from osseo.operators.heads import heads

    boosted, linear, forest = (p.getStages()[-1] for p in heads("y", 200.0))
    assert boosted.getMaxIter() == 150 and forest.getNumTrees() == 300 and forest.getFeatureSubsetStrategy() == "0.5"
    assert abs(linear.getRegParam() - 1 / 60) < 1e-12


def test_frames_without_three_levels_stay(spark):
    two = np.zeros((64, 64))
    two[20:44, 20:44] = 1
    ramp = np.add.outer(np.arange(64), np.arange(64)).astype(float)
    frames = image(spark, np.full((64, 64), 7.0), 1).union(image(spark, two, 2)).union(image(spark, ramp, 3))
    assert {(r.frame_id, r.t1, r.t2) for r in P.multi_otsu(frames).collect() if r.frame_id < 3} == {(1, 0, 0), (2, 0, 0)}
    n = {r.frame_id: r.n for r in queries.bone_mask_stats(frames).collect()}
    assert n[1] == 0 and abs(n[2] - 24 * 24) < 30 and n[3] > 0
    masked = P.bright_mask(frames)
    shape = {r.frame_id: (r.empty, r.area_frac) for r in P.silhouette(masked).collect()}
    assert shape[1] == (1, 0) and shape[2][0] == shape[3][0] == 0
    assert {r.frame_id: r.empty_spine for r in P.centre_line(P.row_profile(masked), 20, masked).collect()} == {1: 1, 2: 0, 3: 0}


def slanted(bump: int = 0) -> np.ndarray:
    """A bar of width 12 that leans 0.2 columns a row, with a bump on its right edge in the middle, and an island that is no part of it."""
    bar = np.zeros((100, 80))
    for y in range(5, 95):
        x = int(round(20 + 0.2 * y))
        bar[y, x : x + 12 + (bump if 42 <= y < 54 else 0)] = 1
    bar[5:8, 70:75] = 1
    return bar


def test_hip_measurements_in_the_frame_of_the_shaft(spark):
    frames = image(spark, slanted(), 1).union(image(spark, slanted(8), 2)).union(image(spark, np.zeros((100, 80)), 3)).withColumnRenamed("v", "z").withColumn("m", F.col("z") > 0)
    bone = H.row_filled(N.largest(frames)).cache()
    shaft = {r.frame_id: r for r in H.shaft(bone).collect()}
    assert len(shaft) == 3 and all(abs(shaft[k].angle_deg - math.degrees(math.atan(0.2))) < 0.5 for k in (1, 2))
    shape = {r.frame_id: r for r in H.femur_shape(bone).collect()}
    assert shape[3].empty_femur == 1 and shape[3].lt_index is None and shape[1].empty_femur == 0
    assert shape[1].lt_protrusion_px < 2 and 6 < shape[2].lt_protrusion_px < 10 and abs(shape[1].shaft_width_px - 11) <= 1
    assert shape[2].lt_index == pytest.approx(shape[2].lt_protrusion_px / shape[2].shaft_width_px)
    contrast = {r.frame_id: list(r)[1:] for r in H.medial_contrast(bone).collect()}
    assert contrast[3] == [-1, -1, 0] and contrast[1][2] == 1
    density = {r.frame_id: r for r in H.trochanter_density(bone).collect()}
    assert density[3].lt_dens_empty == 1 and density[1].lt_dens_peak == 1 and density[1].lt_dens_pos_std >= 0
    widths = N.shaft_widths(bone)
    assert {r.frame_id: r.shaft_w for r in widths.collect()}[3] == 4
    wide = {r.frame_id: r for r in H.grid_features(bone, widths).collect()}
    assert wide[3].empty_grid == 1 and wide[1].empty_grid == 0 and wide[1].g01_fill > 0.5 and len(wide[1]) == 26
    bone.unpersist()


def test_turned_frames_have_no_holes(spark):
    full = image(spark, np.ones((41, 41))).withColumnRenamed("v", "z").withColumn("m", F.lit(True))
    one = full.select("frame_id").distinct()
    turned = Q.rotated(full, one.withColumn("angle_deg", F.lit(30.0)))
    assert turned.count() == 41 * 41 and turned.where("m AND pow(x - 20, 2) + pow(y - 20, 2) < 300").count() == turned.where("pow(x - 20, 2) + pow(y - 20, 2) < 300").count()
    quarter = Q.rotated(image(spark, np.eye(40)[:, ::1] * 1.0).withColumnRenamed("v", "z").withColumn("m", F.col("z") > 0), one.withColumn("angle_deg", F.lit(0.0)))
    assert {(r.y, r.x) for r in quarter.where("m").collect()} == {(k, k) for k in range(40)}


def test_routing_gives_the_side(spark):
    wide = np.zeros((60, 90))
    wide[:30, 50:85], wide[30:, 20:55] = 1, 1
    frames = image(spark, wide, 1).union(image(spark, wide[:, ::-1].copy(), 2)).withColumnRenamed("v", "z").withColumn("m", F.col("z") > 0)
    assert {r.frame_id: r.region for r in P.route(frames).collect()} == {1: "hip_right", 2: "hip_left"}


def test_masks_columns_and_features(spark):
    masks = spark.createDataFrame([(0, k, y, x) for k, n in ((1, 60), (2, 59)) for y, x in ((i // 10 + 20 * k, i % 10) for i in range(n))], "frame_id long, mask int, y int, x int")
    assert P.mask_union(masks).count() == 60
    two = np.zeros((50, 80))
    two[:, 5:30], two[:, 50:75] = 1, 1
    row = P.column_shape(image(spark, two).withColumn("m", F.col("v") > 0)).first()
    assert row.profile_dip == 1 and abs(row.lr_symmetry - 1) < 1e-9
    df = spark.createDataFrame([("s", "spine", 1.0, 1, 2.0, 3.0, 4.0, 1.0, 1.0, "x", 1)], "study string, region string, axis_deg_mean double, fold int, spine_axis_p double, rows_mean double, lmk_a double, y_q double, pos_t_mean double, comment string, flags_or int")
    assert evaluation.feature_columns(df) == ["axis_deg_mean", "lmk_a"] and evaluation.feature_columns(df, "lmk_") == ["axis_deg_mean"]


def test_tilt_falls_back_and_has_two_limits(spark):
    rows = [("spine", 5.0, 9.0, 9.0), ("spine", -1.0, 7.0, 9.0), ("spine", -1.0, float("nan"), 8.0), ("spine", -1.0, -1.0, None), ("hip_left", 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "region string, vb_axis_deg_mean double, col_tilt_deg_mean double, axis_deg_max double").withColumn("kp_art_frac_mean", F.lit(0.0))
    got = S.violations(df, queries.RULES.__class__(max_spine_tilt_deg=7.5, vb_axis_limit_deg=4.0)).collect()
    assert [(r.tilt, r.fires_axis) for r in got] == [(5, True), (7, False), (8, True), (-1, False), (-1, False)]


def test_running_sums_over_many_partitions(spark):
    from osseo.functions.columns import running

    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"))
    assert all(r.s == r.k * (r.k + 1) // 2 for r in running(df, [F.col("k")], {"s": F.col("k")}).collect())
    assert evaluation.quantile(df, "k", 0.25).first()[0] == pytest.approx(np.quantile(np.arange(500), 0.25))


def test_details_name_all_that_is_known(spark):
    spine = spark.createDataFrame([("spine", 7.04, 4.0, 1.0, 1.0, 0.2, 0.001)], "region string, tilt double, top_vertebra_mean double, kp_wing_absent_mean double, crest_in_frame_mean double, curv_rms_norm_mean double, kp_art_frac_mean double")
    assert S.details(spine, queries.RULES.__class__()).first().details == (
        "наклон оси 7.0° — превышает норму (критерий 5°); сверху виден L4/L5; крыльев таза в кадре нет; посторонние тонкие структуры вне позвоночника; признаки сколиоза (нарушением укладки не считается)"
    )
    hip = spark.createDataFrame([("hip_left", -1.0, 7.9, 1.0, 4.5, 0.03)], "region string, tilt double, shaft_angle_deg_mean double, has_pair double, shaft_angle_deg_mean_asym double, saturated_frac_mean double")
    assert S.details(hip, queries.RULES).first().details == "наклон диафиза 7.9°; стороны различаются на 4.5°; яркие включения, возможен эндопротез"


def test_column_of_a_leaning_bar(spark):
    bone = image(spark, slanted(), 1).union(image(spark, np.zeros((100, 80)), 2)).withColumnRenamed("v", "z").withColumn("m", F.col("z") > 0)
    got = {r.frame_id: r for r in P.spine_column(H.row_filled(N.largest(bone))).collect()}
    assert got[2].empty_column == 1 and got[2].col_tilt_deg is None
    assert abs(got[1].col_tilt_deg - math.degrees(math.atan(0.2))) < 0.3 and got[1].col_kink_deg < 0.5 and got[1].col_height_frac == 0.89
    assert {r.frame_id: r.curvature for r in P.curvature(bone).collect()}[2] == 0


def test_islands_and_inclusions(spark):
    """A body with a touching-distance part, a far part and a crumb; a bright bead inside and a wire outside."""
    from osseo.operators import artifacts as A

    z = np.full((64, 64), 0.5)
    m = np.zeros((64, 64), bool)
    m[10:50, 10:30] = True
    m[10:20, 33:45] = True  # near, an eighth of the area
    m[55:63, 45:60] = True  # far
    m[30, 33] = True  # near, too small
    z[20:23, 15:18] = 1.0
    z[50:54, 62] = z[2, 20:40] = 0.9
    y, x = np.mgrid[:64, :64]
    masked = spark.createDataFrame([(0, int(a), int(b), float(c), bool(d)) for a, b, c, d in zip(y.ravel(), x.ravel(), z.ravel(), m.ravel())], "frame_id long, y int, x int, z double, m boolean")
    kept = A.main_body(masked).where("m").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y")).first()
    assert (kept.n, kept.x, kept.y) == (40 * 20 + 10 * 12, 44, 49)
    got = A.inside(masked).first()
    assert (got.in_empty, got.in_hot_n) == (0, 1) and got.in_hot_max_frac == pytest.approx(9 / m.sum()) and got.in_sat_frac == pytest.approx(9 / m.sum())
    got = A.outside(masked).first()
    assert got.thin_n == 1 and got.thin_elong == pytest.approx(42**2 / (4 * np.pi * 20)) and got.thin_area_frac == pytest.approx(20 / 64**2)
    assert A.inside(masked.withColumn("m", F.lit(False))).first().in_empty == 1


def test_checks_follow_the_report(spark):
    from osseo.operators import studies as S

    rows = [("Некорректная укладка", False, "head"), ("", True, "head"), (None, True, "rule")]
    df = spark.createDataFrame([(v, [("укладка бедра", kind, 1.0, 2.0, fired)]) for v, fired, kind in rows], "violation_type string, checks array<struct<task string, kind string, value double, threshold double, fired boolean>>")
    got = [r.checks[0] for r in S.agree(df).collect()]
    assert [c.fired for c in got] == [True, False, True] and [c.note for c in got] == [S.CHOSEN_BELOW, S.DROPPED_ABOVE, None]


@pytest.fixture(scope="module")
def on_limits(tmp_path_factory):
    """Events of 120 studies whose mean artifact share or mean coverage is just a limit, each study's in four files; and the events in order."""
    rng = np.random.default_rng(4)
    rows = []
    for study in range(120):
        ids = np.arange(16) * 121 + study
        k, free = rng.integers(20, 80, 16), np.flatnonzero((ids % 5 > 0) | (study % 2 == 0))
        total = lambda: sum(k) - 800 if study % 2 == 0 else sum(np.where(ids % 5 > 0, k, 25)) - 900  # noqa: B023, E731
        while total():
            k[rng.choice(free)] -= np.sign(total())
        rows += [(int(e), study, "view" if study % 3 else "signup", 10.0, f'{{"k": {n}}}') for e, n in zip(ids, k)]
    folder = tmp_path_factory.mktemp("limits")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", sorted(rows))
    (folder / "events.parquet").mkdir()
    for part in range(4):
        c.execute(f"COPY (SELECT * FROM events WHERE event_id // 121 % 4 = {part}) TO '{folder}/events.parquet/{part}.parquet' (FORMAT parquet)")
    return str(folder), c


@pytest.mark.parametrize("name", ["head_decisions", "report_details", "report_rows", "run_summary", "verdict_artifact", "violation_text", "rule_checks", "agreed_checks"])
def test_means_on_limits_do_not_depend_on_files(spark, on_limits, name):
    folder, c = on_limits
    got = queries.QUERIES[name](spark, folder)
    quoted = ", ".join(f'"{n}"' for n in got.columns)
    assert plain(tuple(r) for r in got.collect()) == plain(c.sql(oracle.SQL[name]).select(quoted).fetchall())


def test_checks_are_rounded_as_sql_does(spark):
    """Angles and shares whose decimal text and whose multiple lie on two sides of a half, and such that have neither."""
    values = [36.995, -36.995, 1.005, 2.675, 12.345, 0.125, 0.00048499999999999997, float("nan"), float("inf"), None]
    heads = F.lit(None).cast("map<string, double>")
    rows = spark.createDataFrame([(i, "spine", v) for i, v in enumerate(values)], "study long, region string, tilt double")
    got = S.checks(rows.withColumn("kp_art_frac_mean", F.col("tilt")).withColumn("heads", heads), queries.RULES).collect()
    con = duckdb.connect()
    want = {i: con.execute("SELECT round(?::DOUBLE, 2), round(?::DOUBLE, 5)", [v, v]).fetchall()[0] for i, v in enumerate(values)}
    assert str({r.study: tuple(c.value for c in r.checks) for r in got}) == str(want)


@pytest.mark.parametrize("last", [16, 32, 48])
def test_vertebra_levels_of_a_short_last_frame(spark, tmp_path, last):
    """A last frame of one, two or three bodies: the query gives it with three only, as its SQL does; the operator always."""
    con.sql(f"SELECT * FROM read_parquet('{SF}/embeddings.parquet') WHERE vec_id < {64 + last}").write_parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    got = queries.QUERIES["vertebra_levels"](spark, str(tmp_path))
    quoted = ", ".join(f'"{n}"' for n in got.columns)
    rows = plain(tuple(r) for r in got.collect())
    assert rows == plain(c.sql(oracle.SQL["vertebra_levels"]).select(quoted).fetchall()) and len(rows) == 1 + (last == 48)
    masked = P.bright_mask(pixels(spark, str(tmp_path)))
    levels = masked.select("frame_id", "y", "x", F.expr("int(IF(m AND y % 16 < 14, 1 + y div 16, 0))").alias("level"))
    found = {r.frame_id: r.vl_tilt_resid for r in Q.vertebra_levels(levels).collect()}
    assert set(found) == {0, 1} and (found[1] == -1) == (last < 48)
