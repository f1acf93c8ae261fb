"""Views over the driver's tables that stand for frames, measurements, manifests and labels.

``pixels``: 64 consecutive embeddings are a 64 x 64 frame; ``measurements``: events are per-frame features of a study.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, y, x, v: the long pixel relation."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {SIDE}").alias("frame_id"), (F.col("vec_id") % SIDE).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("frame_id", "y", "x", F.col("v").cast("double").alias("v"))


def frames(pixels: DataFrame) -> DataFrame:
    """frame_id, study, region, h, w of each frame."""
    region = F.when(F.col("frame_id") % 4 < 2, "spine").when(F.col("frame_id") % 4 == 2, "hip_right").otherwise("hip_left")
    sized = pixels.groupBy("frame_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return sized.select("frame_id", F.expr("frame_id div 4").alias("study"), region.alias("region"), "h", "w")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_to_study, image_uid, study, region, seconds, reason and features of each measured frame (an angle that was not found is -1).

    Region ``error`` marks a failed frame.
    """
    region = F.when(F.col("event_type").isin("view", "signup"), "spine").when(F.col("event_type") == "click", "hip_right").when(F.col("event_type") == "purchase", "hip_left").otherwise("error")
    k, third = F.get_json_object("props", "$.k").cast("double"), F.col("user_id") % 3
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("/data/"), "event_id", F.lit(".dcm")).alias("path_to_study"), F.concat(F.lit("1.2."), "event_id").alias("image_uid"), (k / 1000.0).alias("seconds"), F.when(F.col("event_id") % 2 == 0, "ValueError").alias("reason"), F.col("user_id").alias("study"), region.alias("region"), F.col("value").alias("axis_deg"), (k / 100000.0).alias("kp_art_frac"),
        F.when(third == 0, F.col("value") * 0.75).otherwise(-1.0).alias("vb_axis_deg"), F.when(third == 1, F.col("value") * 0.875).otherwise(-1.0).alias("col_tilt_deg"), F.when(F.col("event_id") % 5 > 0, k / 100.0).otherwise(0.25).alias("coverage"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_dir, rel_path, pixel_md5 and descriptive columns of each file."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("study_dir"), F.col("doc_id").alias("rel_path"), F.md5("text").alias("pixel_md5"), F.col("lang").alias("model"), "n_chars")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (1: violation), p (score), grp (study) of each labelled row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("y"))
    p = F.round((F.col("n_chars") % 997) / 997.0, 6)
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), "y", p.alias("p"), F.col("source").alias("grp"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, low_quality, toxic: nullable flags, null where a study has no label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("spine_artifact"), F.col("toxic").alias("hip_r_roi"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").withColumnRenamed("doc_id", "study")
