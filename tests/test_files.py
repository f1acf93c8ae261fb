"""File sources: archives, uncompressed frames, broken files, label tables and reports."""

import io
import json
import struct
import zipfile

import numpy as np

from osseo.config import Rules
from osseo.sources import files


def dicom(pixels: np.ndarray, photometric: str = "MONOCHROME2") -> bytes:
    def tag(group: int, element: int, kind: bytes, value: bytes) -> bytes:
        value += b" " * (len(value) % 2)
        size = struct.pack("<HI", 0, len(value)) if kind in (b"OB", b"OW") else struct.pack("<H", len(value))
        return struct.pack("<HH", group, element) + kind + size + value

    us = lambda v: struct.pack("<H", v)
    return (
        b"\0" * 128 + b"DICM" + tag(8, 0x18, b"UI", b"1.2.3") + tag(0x20, 0xD, b"UI", b"9.8") + tag(0x28, 4, b"CS", photometric.encode()) + tag(0x28, 0x10, b"US", us(pixels.shape[0])) + tag(0x28, 0x11, b"US", us(pixels.shape[1]))
        + tag(0x28, 0x30, b"DS", b"0.5\\0.7") + tag(0x28, 0x100, b"US", us(8)) + tag(0x28, 0x101, b"US", us(8)) + tag(0x7FE0, 0x10, b"OB", pixels.astype(np.uint8).tobytes())
    )


def test_frames_from_folders_and_archives(spark, tmp_path):
    image = np.arange(12).reshape(3, 4)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.DCM").write_bytes(dicom(image))
    (tmp_path / "broken").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("снимок.dcm", dicom(image, "MONOCHROME1"))
        z.writestr("readme.md", "x")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"PK broken")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.frames(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"A.DCM", "broken"}
    ok = got["A.DCM"]
    assert (ok.sop_uid, ok.study_uid, ok.rows, ok.cols, ok.mm_x, ok.mm_y, ok.scale_source, ok.error) == ("1.2.3", "9.8", 3, 4, 0.5, 0.7, "pixel_spacing", None)
    assert ok.pixels == list(range(12)) and got["broken"].error and got["broken"].pixels is None
    zipped = files.unzip(spark, str(tmp_path)).withColumnRenamed("member", "path")
    (row,) = files.frames(zipped).collect()
    assert row.path == "снимок.dcm" and row.pixels == [11.0 - i for i in range(12)]
    assert files.pixels(files.frames(files.scan(spark, str(tmp_path)))).count() == 12


def test_tables_and_reports(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("1,s1,0,x\n2,,1,1\n3,s3,,1\n")
    got = files.expert_labels(spark, str(tmp_path / "labels.csv"), ["n", "study", "f1", "f2"], ["f1", "f2"]).collect()
    assert [tuple(r) for r in got] == [("s1", 0.0, None), ("s3", None, 1.0)]
    (tmp_path / "refs.json").write_text(json.dumps({"a": [3, 1, 2], "b": []}))
    assert files.references(spark, str(tmp_path / "refs.json"), ["a", "b"]) is None
    assert files.references(spark, str(tmp_path / "refs.json"), ["a"]).first().a == [1, 2, 3]
    Rules(max_spine_tilt_deg=5.0).save(str(tmp_path / "rules.json"))
    assert Rules.load(str(tmp_path / "rules.json")).max_spine_tilt_deg == 5 and Rules.load("/nowhere") == Rules()
    report = spark.createDataFrame([("a", 1), ("b", None)], "path string, quality_class int")
    files.write_report(report.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.splitlines() == ["path,quality_class", "a,1", "b,"]
