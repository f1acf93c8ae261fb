"""DICOM of all kinds, mask stores, pictures, reports as one file, and frames on other grids."""

import hashlib
import io
import json
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from osseo.operators import resample as R, studies as S
from osseo.sources import files, masks, reports


def element(group, number, kind, value, implicit=False, order="<"):
    value += b" " * (len(value) % 2)
    if implicit:
        return struct.pack("<HHI", group, number, len(value)) + value
    size = struct.pack(f"{order}HI", 0, len(value)) if kind in files.LONG_TYPES else struct.pack(f"{order}H", len(value))
    return struct.pack(f"{order}HH", group, number) + kind + size + value


def dicom(pixels, syntax, nested=b"", data=None, extra=b""):
    implicit, order = syntax == files.IMPLICIT, ">" if syntax == files.BIG else "<"
    e = lambda *a: element(*a, implicit=implicit, order=order)
    us = lambda v: struct.pack(f"{order}H", v)
    width = pixels.dtype.itemsize
    body = e(8, 0x18, b"UI", b"1.2.3") + nested + e(0x20, 0xD, b"UI", b"9.8") + e(0x28, 2, b"US", us(1)) + e(0x28, 4, b"CS", b"MONOCHROME2") + e(0x28, 0x10, b"US", us(pixels.shape[0])) + e(0x28, 0x11, b"US", us(pixels.shape[1]))
    body += e(0x28, 0x100, b"US", us(8 * width)) + e(0x28, 0x101, b"US", us(8 * width)) + extra
    raw = pixels.astype(pixels.dtype.newbyteorder(order)).tobytes()
    return b"\0" * 128 + b"DICM" + element(2, 0x10, b"UI", syntax.encode() + b"\0" * (len(syntax) % 2)) + body + (e(0x7FE0, 0x10, b"OW", raw) if data is None else data)


def run_length(pixels):
    """The planes of an image in literal and repeated runs, one of them an empty step."""
    raw, out = pixels.astype("<u2").tobytes(), []
    for plane in (raw[1::2], raw[0::2]):
        code = b"\x80"
        for k in range(0, len(plane), 7):
            piece = plane[k : k + 7]
            code += bytes([257 - len(piece)]) + piece[:1] if len(set(piece)) == 1 and len(piece) > 1 else bytes([len(piece) - 1]) + piece
        out.append(code + b"\0" * (len(code) % 2))
    head = struct.pack("<16I", 2, 64, 64 + len(out[0]), *[0] * 13)
    frame = head + b"".join(out)
    item = lambda number, body: struct.pack("<HHI", 0xFFFE, number, len(body)) + body
    return struct.pack("<HH", 0x7FE0, 0x10) + b"OB\0\0" + struct.pack("<I", 0xFFFFFFFF) + item(0xE000, b"") + item(0xE000, frame) + item(0xE0DD, b"")


def open_sequence(implicit):
    """A sequence of open length with an open item, in which another open sequence and a tag of interest are nested."""
    mark = lambda number, size=0: struct.pack("<HHI", 0xFFFE, number, size)
    head = lambda group, number: struct.pack("<HHI", group, number, 0xFFFFFFFF) if implicit else struct.pack("<HH", group, number) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF)
    inner = head(8, 0x1150) + mark(0xE000, 0xFFFFFFFF) + element(8, 0x18, b"UI", b"not this", implicit) + mark(0xE00D) + mark(0xE0DD)
    return head(8, 0x1140) + mark(0xE000, 0xFFFFFFFF) + inner + element(0x20, 0xD, b"UI", b"nor this", implicit) + mark(0xE00D) + mark(0xE000, 8) + b"whatever" + mark(0xE0DD)


def test_dicom_of_all_kinds():
    image = np.array([[0, 1, 2, 300], [300] * 4, [7, 7, 7, 65535]], np.uint16)
    us = lambda *v: struct.pack(f"<{len(v)}H", *v)
    told = element(0x40, 0x301, b"US", us(3)) + element(0x40, 0x303, b"US", us(20, 30))
    cases = {
        "explicit": dicom(image, files.EXPLICIT, open_sequence(False), extra=told),
        "implicit": dicom(image, files.IMPLICIT, open_sequence(True)),
        "big": dicom(image, files.BIG),
        "rle": dicom(image, files.RLE, data=run_length(image)),
        "bare": dicom(image, files.IMPLICIT)[132 + 8 + len(files.IMPLICIT) + len(files.IMPLICIT) % 2 * 2 - len(files.IMPLICIT) % 2 :],
    }
    for name, data in cases.items():
        row = files.frame(name, data)
        assert row["error"] is None, (name, row["error"])
        assert (row["sop_uid"], row["study_uid"], row["rows"], row["cols"]) == ("1.2.3", "9.8", 3, 4)
        assert row["pixels"] == image.ravel().tolist() and row["pixel_md5"] == hashlib.md5(image.astype("<u2").tobytes()).hexdigest(), name
        assert (row["exposures"], row["exposed_area"]) == ((3, [20, 30]) if name == "explicit" else (0, None))
    assert files.frame("text", dicom(image, files.EXPLICIT, extra=element(0x40, 0x301, b"IS", b"12 ")))["exposures"] == 12
    jpeg = files.frame("jpeg", dicom(image, "1.2.840.10008.1.2.4.70"))
    cut = files.frame("cut", cases["explicit"][:-5])
    short = files.frame("short", dicom(image, files.RLE, data=run_length(image[:2])))
    assert jpeg["error"].startswith("ValueError: transfer syntax") and cut["error"] and short["error"] and "pixels" not in cut
    signed = files.frame("signed", dicom(image.view(np.int16), files.EXPLICIT, extra=element(0x28, 0x103, b"US", us(1))))
    assert signed["pixels"][-1] == -1


def picture(rows: np.ndarray, depth: int, colour: int, filters) -> bytes:
    """A PNG with the given filter of each row."""
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    h, w = rows.shape[0], rows.shape[1]
    if depth < 8:
        bits = ((rows[..., None].astype(int) >> np.arange(depth)[::-1]) & 1).reshape(h, -1)
        raw = np.packbits(bits.astype(np.uint8), axis=1)
    else:
        raw = rows.astype(">u2" if depth == 16 else np.uint8).reshape(h, -1).view(np.uint8).reshape(h, -1)
    step, above, lines = max(1, samples * depth // 8), np.zeros(raw.shape[1], int), b""
    for y in range(h):
        line, kind = raw[y].astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(step, int), line])[: len(line)]
        corner = np.concatenate([np.zeros(step, int), above])[: len(line)]
        near = left + above - corner
        guess = [min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2] for p, a, b, c in zip(near, left, above, corner)]
        base = [np.zeros(len(line), int), left, above, (left + above) // 2, np.array(guess)][kind]
        lines += bytes([kind]) + ((line - base) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    z = zlib.compress(lines)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", z[:10]) + chunk(b"IDAT", z[10:]) + chunk(b"IEND", b"")


def test_pictures_of_all_kinds():
    r = np.random.default_rng(2)
    grey = r.integers(0, 256, (11, 9))
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (masks.decoded(picture(grey, 8, 0, kinds)) == grey).all()
    for depth in (1, 2, 4):
        few = r.integers(0, 1 << depth, (5, 11))
        assert (masks.decoded(picture(few, depth, 3, [0, 1, 4])) == few).all()
        assert (masks.decoded(picture(few, depth, 0, [2])) == few * (255 // ((1 << depth) - 1))).all()
    deep = r.integers(0, 1 << 16, (4, 5))
    assert (masks.decoded(picture(deep, 16, 0, [4])) == deep >> 8).all()
    colour = r.integers(0, 256, (6, 7, 4))
    assert np.abs(masks.decoded(picture(colour, 8, 6, [1, 3, 4])) - colour[..., :3] @ [0.299, 0.587, 0.114]).max() <= 0.51
    assert (masks.decoded(masks.encoded(grey)) == grey).all()
    with pytest.raises(ValueError):
        masks.decoded(b"GIF89a")


def test_mask_stores_with_a_live_fallback(spark, tmp_path):
    r = np.random.default_rng(3)
    grids = {k: r.random((7, 9)) < 0.4 for k in range(3)}
    store = spark.createDataFrame([(k, 7, 9, masks.packed(m)) for k, m in grids.items()] + [(7, 9, 9, b"\1"), (8, 2, 2, None)], "frame_id long, h int, w int, bits binary")
    got = masks.unpacked(store).toPandas()
    assert {k: sorted(zip(g.y, g.x)) for k, g in got.groupby("frame_id")} == {k: sorted(map(tuple, np.argwhere(m).tolist())) for k, m in grids.items()}
    asked = []

    def live(frames):
        asked.extend(sorted(x.frame_id for x in frames.collect()))
        return frames.select("frame_id", F.lit(0).alias("y"), F.lit(0).alias("x"))

    frames = spark.createDataFrame([(k,) for k in (0, 2, 5)], "frame_id long")
    rows = masks.with_fallback(frames, masks.unpacked(store), live).groupBy("frame_id").count().collect()
    assert {x.frame_id: x["count"] for x in rows} == {0: grids[0].sum(), 2: grids[2].sum(), 5: 1} and asked == [5]
    assert masks.with_fallback(frames, masks.unpacked(store), lambda f: None).select("frame_id").distinct().count() == 2
    assert masks.with_fallback(frames, None, live).count() == 3
    (tmp_path / "1.2.png").write_bytes(masks.encoded(np.arange(6).reshape(2, 3)))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    assert sorted(tuple(x) for x in masks.pictures(spark, str(tmp_path)).collect()) == [("1.2", y, x, 3 * y + x) for y in range(2) for x in range(3)]


def sheet(path):
    with zipfile.ZipFile(path) as z:
        space = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        rows = ET.fromstring(z.read("xl/worksheets/sheet1.xml")).findall(".//s:row", space)
        for name in z.namelist():
            ET.fromstring(z.read(name))
        return [["".join(c.itertext()) for c in r.findall("s:c", space)] for r in rows]


def test_report_is_one_ordered_file(spark, tmp_path):
    rows = [(f"/data/{k:03}.dcm", "s", f"i{k}", "Имя", k % 2 if k % 5 else None, 'a;"b",<c>&\n' if k == 7 else "", "Success", 0.5, 0.25, "x\x01y" if k == 3 else None) for k in range(200)]
    kinds = "path_to_study string, study_uid string, image_uid string, anatomical_region string, quality_class int, violation_type string, processing_status string, time_of_processing double, quality_prob double, details string"
    report = spark.createDataFrame(rows, kinds).repartition(7)
    for name in ("out.csv", "out.xlsx"):
        reports.write_table(report, str(tmp_path / name), ["path_to_study"])
        reports.write_table(report, str(tmp_path / name), ["path_to_study"])  # replaces
    got = pd.read_csv(tmp_path / "out.csv", keep_default_na=False)
    assert [*got.columns] == S.REPORT and [*got.path_to_study] == [r[0] for r in rows] and got.violation_type[7] == rows[7][5] and got.quality_class[0] == ""
    cells = sheet(tmp_path / "out.xlsx")
    assert cells[0] == S.REPORT and len(cells) == 201 and [c[0] for c in cells[1:]] == [r[0] for r in rows]
    assert cells[8][5] == rows[7][5] and cells[1][4] == "" and cells[2][4] == "1" and cells[4][9] == "xy" and cells[2][9] == ""
    for name in ("none.csv", "none.xlsx"):
        reports.write_table(report.where("false"), str(tmp_path / name), ["path_to_study"])
    assert (tmp_path / "none.csv").read_text() == ",".join(S.REPORT) + "\n" and sheet(tmp_path / "none.xlsx") == [S.REPORT]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["none.csv", "none.xlsx", "out.csv", "out.xlsx"]


def test_overlays_and_references(spark, tmp_path):
    z = np.linspace(0, 1, 12).reshape(3, 4)
    y, x = np.indices(z.shape)
    pixels = spark.createDataFrame(pd.DataFrame({"frame_id": 1, "y": y.ravel(), "x": x.ravel(), "z": z.ravel()}), "frame_id long, y int, x int, z double")
    report = spark.createDataFrame([(1, "/d/a.b.dcm", "", "", "Success"), (2, "/d/b", "s", "i", "Failure")], "frame_id long, path_to_study string, study_uid string, image_uid string, processing_status string")
    (row,) = reports.overlays(report, reports.pictures_of(pixels)).collect()
    assert row.path == "study/a.b.png" and (masks.decoded(bytes(row.content)) == np.floor(z * 255)).all()
    names = spark.range(1).select(reports.overlay_name(F.lit("s"), F.lit(None).cast("string"), F.lit("/x/plain")).alias("n"))
    assert names.first().n == "s/plain.png"
    scores = spark.createDataFrame([([0.5, 0.1234567891, None, float("nan")], [2.0])], "a array<double>, b array<double>")
    reports.write_references(scores, str(tmp_path / "refs.json"), ("a", "b"))
    assert json.loads((tmp_path / "refs.json").read_text()) == {"a": [0.123457, 0.5], "b": [2.0]}
    assert files.references(spark, str(tmp_path / "refs.json"), ["a", "b"]).first().a == [0.123457, 0.5]


def relation(spark, *images):
    parts = []
    for k, v in enumerate(images):
        y, x = np.indices(v.shape)
        parts.append(pd.DataFrame({"frame_id": k, "y": y.ravel(), "x": x.ravel(), "v": v.ravel().astype(float)}))
    return spark.createDataFrame(pd.concat(parts), "frame_id long, y int, x int, v double")


def grid(rows, frame=0):
    g = rows.where(f"frame_id = {frame}").toPandas()
    out = np.zeros((g.y.max() + 1, g.x.max() + 1))
    out[g.y, g.x] = g.v
    return out


def plain_resize(v, h2, w2):
    h, w = v.shape
    place = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    py, px = place(h, h2), place(w, w2)
    rows = np.stack([np.interp(px, np.arange(w), line) for line in v])
    return np.stack([np.interp(py, np.arange(h), c) for c in rows.T], 1)


def test_resampling(spark):
    r = np.random.default_rng(6)
    a, b = r.random((20, 35)), r.random((9, 14))
    pixels = relation(spark, a, b)
    targets = spark.createDataFrame([(0, 31, 12), (1, 9, 40)], "frame_id long, h2 int, w2 int")
    for k, (v, h, w) in enumerate([(a, 31, 12), (b, 9, 40)]):
        assert np.allclose(grid(R.resized(pixels, targets), k), plain_resize(v, h, w))
        nearest = v[np.arange(h)[:, None] * v.shape[0] // h, np.arange(w) * v.shape[1] // w]
        assert np.allclose(grid(R.resized(pixels, targets, linear=False), k), nearest)
    assert grid(R.isotropic(pixels)).shape == (20, 20) and np.allclose(grid(R.isotropic(pixels), 1), plain_resize(b, 9, 8))


def blurred(v, sigma=3.0, r=12):
    g = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    g /= g.sum()
    for axis in (0, 1):
        wide = np.pad(v, [(r, r) if a == axis else (0, 0) for a in (0, 1)], "reflect")
        v = sum(k * np.take(wide, range(i, i + v.shape[axis]), axis) for i, k in enumerate(g))
    return v


def test_crop_about_the_column(spark):
    r = np.random.default_rng(7)
    wide, narrow = r.random((60, 90)) * 0.2, r.random((50, 20)) * 0.2
    wide[:, 55:65] += 1
    narrow[:, 5:9] += 1
    pixels = relation(spark, wide, narrow)
    at = {x.frame_id: x.column for x in R.column_place(pixels).collect()}
    for k, v in enumerate((wide, narrow)):
        mean = blurred(v).mean(0)
        n = max(5, len(mean) // 10)
        assert at[k] == np.argmax(np.round(np.convolve(mean, np.ones(n) / n, "same"), 9))
    size = (40, 30)
    got = R.column_crop(pixels, size=size)
    for k, v in enumerate((wide, narrow)):
        z = plain_resize(v, 40, round(v.shape[1] * 40 / v.shape[0]))
        x0 = max(0, min(round(at[k] * 40 / v.shape[0]) - 15, z.shape[1] - 30)) if z.shape[1] >= 30 else 0
        out = np.zeros(size)
        piece = z[:, x0 : x0 + 30]
        out[:, : piece.shape[1]] = piece
        lo, hi = np.percentile(out, [2, 98])
        assert np.allclose(grid(got, k), np.clip((out - lo) / (hi - lo + 1e-9), 0, 1), atol=1e-6)
