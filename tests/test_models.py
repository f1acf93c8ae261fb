"""Saved heads, providers, and decisions with and without them."""

import math
import warnings

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from osseo.config import Rules
from osseo.operators import models as M, studies as S

HEADS = [
    M.Head("spine_coverage", ("coverage", "axis_deg_dev"), 0.5, (4.0, 0.1), -2.0, centres={"axis_deg": 10.0}),
    M.Head("hip_quality", ("score",), 0.5, (1.0,), 0.0),
    M.Head("hip_positioning", ("a",), 0.8, (1.0,), 0.0),
    M.Head("hip_roi", ("b",), 0.5, (1.0,), 0.0),
]


def regions(spark, rows):
    names = "study string, region string, vb_axis_deg_mean double, col_tilt_deg_mean double, axis_deg_max double, kp_art_frac_mean double, coverage_mean double, axis_deg_mean double, score_mean double, a double, b double"
    return spark.createDataFrame(rows, names)


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def test_heads_go_through_a_folder(spark, tmp_path):
    rows = spark.range(300).select("id", *((F.abs(F.xxhash64("id", F.lit(k))) % 1000 / 1000.0).alias(f"f{k}") for k in range(3)))
    fitted = Pipeline(stages=[GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=1)]).fit(rows.withColumn("x", array_to_vector(F.array("f0", "f1", "f2"))).withColumn("y", (F.col("f0") > F.col("f1")).cast("double")))
    trees = M.Head("trees", ("f0", "f1", "f2_mean"), 0.5, model=fitted)
    folder = str(tmp_path / "heads")
    M.save(spark, [*HEADS, trees], folder)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = M.load(spark, folder)
    assert set(got) == {"spine_coverage", "hip_quality", "hip_positioning", "hip_roi", "trees"} and got["spine_coverage"] == HEADS[0] and got["spine_coverage"].centres == {"axis_deg": 10.0}
    assert M.load(spark, str(tmp_path / "nowhere")) == {}
    scored = M.with_probabilities(rows, {"trees": got["trees"]}).select("id", M.probability("trees").alias("p"), M.fires({"trees": got["trees"]}, "trees").alias("fires"))
    plain = fitted.transform(rows.withColumn("x", array_to_vector(F.array("f0", "f1", "f2")))).select("id", vector_to_array("probability")[1].alias("q"))
    assert all(r.p == pytest.approx(r.q) and r.fires == (r.p >= 0.5) for r in scored.join(plain, "id").collect())


def test_another_engine_gives_a_warning(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M.pyspark, "__version__", "1.0")
    M.save(spark, HEADS[:1], str(tmp_path))
    monkeypatch.undo()
    with pytest.warns(RuntimeWarning, match="fitted with version 1.0"):
        assert set(M.load(spark, str(tmp_path))) == {"spine_coverage"}


def test_missing_heads_and_values(spark):
    df = regions(spark, [("s", "spine", 5.0, -1.0, 5.0, 0.0, None, None, None, None, None)])
    row = M.with_probabilities(df, {h.name: h for h in HEADS}).select(M.probability("spine_coverage").alias("p"), M.probability("none").alias("none"), M.probability("none", 0.5).alias("half"), M.fires(None, "none").alias("f")).first()
    # both features are missing: -1 each
    assert row.p == pytest.approx(sigmoid(4 * -1 + 0.1 * -1 - 2)) and (row.none, row.half, row.f) == (0.0, 0.5, False)


def test_decisions(spark):
    rules, heads = Rules(max_spine_tilt_deg=8.0, vb_axis_limit_deg=4.0, artifact_threshold=0.01, coverage_threshold=0.5), {h.name: h for h in HEADS}
    rows = [
        ("1", "spine", 5.0, 0.0, 0.0, 0.02, 0.1, 10.0, None, None, None),
        ("2", "spine", -1.0, 5.0, 9.0, 0.0, 0.9, 20.0, None, None, None),
        ("3", "hip_left", None, None, None, None, None, None, 1.0, 0.0, -1.0),
        ("4", "hip_left", None, None, None, None, None, None, 1.0, 2.0, 1.0),
        ("5", "hip_left", None, None, None, None, None, None, -1.0, 2.0, 1.0),
        ("6", "hip_right", None, None, None, None, None, None, 1.0, -1.0, -9.0),
    ]
    got = {r.study: r for r in S.decide(regions(spark, rows), rules, heads).collect()}
    assert [(got[k].quality_class, got[k].codes, got[k].violation_text) for k in "123456"] == [
        (1, ["spine_axis", "spine_artifact"], "Не выровнена ось позвоночника;Присутствуют посторонние предметы"),
        (1, ["spine_coverage"], "Некорректная укладка"),
        (1, ["hip_positioning"], "Некорректная укладка"),  # 0.5 / 0.8 is nearer to its threshold than 0.27 / 0.5
        (1, ["hip_positioning", "hip_roi_coverage"], "Некорректная укладка;Некорректная область интереса"),
        (0, [], ""),
        (1, ["hip_positioning"], "Некорректная укладка"),
    ]
    cover = sigmoid(4 * 0.1 - 2)
    assert got["1"].score == pytest.approx(max(cover, 1.0, 5 / 16)) and got["3"].score == pytest.approx(sigmoid(1))
    none = {r.study: r for r in S.decide(regions(spark, rows), rules, None).collect()}
    assert {(r.quality_class, tuple(r.codes), r.violation_text, r.score) for r in none.values()} == {(0, (), "", 0.0)} and none["1"].details.startswith("наклон оси 5.0°")
    # no heads at all: rules still decide spines, and hips are good
    empty = {r.study: r for r in S.decide(regions(spark, rows), rules, {}).collect()}
    assert [empty[k].quality_class for k in "123"] == [1, 0, 0] and empty["2"].score == pytest.approx(max(0.5, 5 / 16))
    # without an artifact feature a head decides
    by_head = S.decide(regions(spark, rows[:1]), Rules(artifact_feature=None), {"spine_artifact": M.Head("spine_artifact", ("kp_art_frac",), 0.5, (1.0,), 3.0)}).first()
    assert "spine_artifact" in by_head.codes


def test_report_and_checks_of_one_study(spark):
    heads = {h.name: h for h in HEADS}
    verdicts = S.decide(regions(spark, [("1", "spine", 5.0, 0.0, 0.0, 0.02, 0.1, 10.0, None, None, None)]), Rules(vb_axis_limit_deg=4.0), heads)
    frames = spark.createDataFrame([("/a", "u1", "1", "spine", 0.12345, None), ("/b", "u2", "1", "unknown", 0.5, None), ("/c", "u3", "1", None, 0.5, "b: ValueError: x"), ("/d", "u4", "2", "hip_left", 0.5, None)], "path_to_study string, image_uid string, study string, region string, seconds double, reason string")
    got = {r.path_to_study: r for r in S.report(frames, verdicts).collect()}
    assert [*got["/a"].asDict()] == S.REPORT
    assert (got["/a"].anatomical_region, got["/a"].quality_class, got["/a"].time_of_processing, got["/a"].processing_status) == ("Поясничный отдел позвоночника", 1, 0.123, "Success")
    assert [(got[p].anatomical_region, got[p].quality_class, got[p].violation_type, got[p].processing_status, got[p].details) for p in ("/b", "/c")] == [("", None, "", "Failure", "анатомическая область не определена"), ("", None, "", "Failure", "b: ValueError: x")]
    assert (got["/d"].quality_class, got["/d"].quality_prob, got["/d"].anatomical_region) == (0, 0.0, "Проксимальный отдел бедра")
    (row,) = S.checks(verdicts, Rules(vb_axis_limit_deg=4.0), heads).collect()
    assert [(c.task, c.kind, c.fired) for c in row.checks] == [("ось позвоночника", "rule", True), ("посторонние предметы", "rule", True), ("укладка позвоночника", "head", False)]


def test_providers_are_made_once_or_absent(spark):
    made = []
    assert M.provided("once", lambda: made.append(1) or "net") == M.provided("once", lambda: made.append(1) or "net") == "net" and made == [1]
    with pytest.warns(RuntimeWarning, match="gone is absent: FileNotFoundError"):
        assert M.provided("gone", lambda: open("/nowhere/weights")) is None
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        assert M.provided("gone", lambda: open("/nowhere/weights")) is None
    df = spark.range(6).withColumnRenamed("id", "frame_id")
    absent = lambda pdf: pdf.assign(v=-1.0)
    found = M.by_provider(df, "factor", lambda: 2.0, lambda net, pdf: pdf.assign(v=pdf.frame_id * net), "frame_id long, v double", absent)
    lost = M.by_provider(df, "lost", lambda: open("/nowhere/weights"), lambda net, pdf: pdf, "frame_id long, v double", absent)
    assert [r.v for r in found.orderBy("frame_id").collect()] == [0, 2, 4, 6, 8, 10] and {r.v for r in lost.collect()} == {-1.0}


def test_health(spark):
    heads = {n: M.Head(n, (), 0.5) for n in ("spine_coverage", "spine_quality", "hip_quality", "hip_positioning", "hip_roi")}
    refs = spark.range(1)
    assert {r.status for r in M.health(spark, heads, refs, {"segmenter": True}).collect()} == {"ok"}
    got = {r.name: (r.ok, r.status) for r in M.health(spark, {}, None, {"segmenter": True}).collect()}
    assert got["segmenter"] == (True, "degraded") and got["references"] == (False, "degraded") and len(got) == 7
