"""Streams give what the same batch gives."""

from pyspark.sql import functions as F

from osseo.streaming.incoming import incoming_frames, windowed_measurements

SF = "/root/testdata/sf0.001"


def drained(query):
    query.awaitTermination(120)
    return query


def test_windows_over_a_stream(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = windowed_measurements(stream, "ts", "event_type", "value", "1 day")
    drained(out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count()
    assert got == {(r.w.start, r.event_type): r["count"] for r in batch.collect()}


def test_files_as_a_stream(spark, tmp_path):
    from tests.test_files import dicom
    import numpy as np

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dcm").write_bytes(dicom(np.ones((2, 2))))
    (tmp_path / "in" / "b.dcm").write_bytes(b"broken")
    drained(incoming_frames(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert sorted(r.error is None for r in spark.table("frames").collect()) == [False, True]
