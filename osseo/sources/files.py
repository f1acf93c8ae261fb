"""File sources: frames in folders and archives, DICOM (plain and run-length coded), label tables, JSON thresholds; and the report sinks."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SUFFIXES = ("", "dcm", "dicom")
# The pixel size in mm of the device, where a file has none.
DEVICE_MM = (0.6, 1.05)
FRAME_SCHEMA = """path string, sop_uid string, study_uid string, series_uid string, photometric string, manufacturer string, model string, software string, series_description string, rows int, cols int, bits_stored int,
 mm_x double, mm_y double, scale_source string, exposed_area array<int>, exposures int, pixel_md5 string, pixels array<float>, error string"""
# The tags that are read, by group and element.
TAGS = {
    (0x0002, 0x0010): "syntax", (0x0008, 0x0018): "sop_uid", (0x0020, 0x000D): "study_uid", (0x0020, 0x000E): "series_uid", (0x0028, 0x0004): "photometric", (0x0008, 0x0070): "manufacturer", (0x0008, 0x1090): "model",
    (0x0018, 0x1020): "software", (0x0008, 0x103E): "series_description", (0x0028, 0x0002): "samples", (0x0028, 0x0103): "signed", (0x0040, 0x0301): "exposures", (0x0040, 0x0303): "exposed_area",
    (0x0028, 0x0010): "rows", (0x0028, 0x0011): "cols", (0x0028, 0x0101): "bits_stored", (0x0028, 0x0100): "bits_allocated", (0x0028, 0x0030): "pixel_spacing", (0x0018, 0x1164): "imager_spacing", (0x7FE0, 0x0010): "pixel_data",
}
# Transfer syntaxes that are read, and the value types whose length takes four bytes.
IMPLICIT, EXPLICIT, BIG, RLE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.5"
LONG_TYPES = (b"OB", b"OW", b"OF", b"OD", b"OL", b"OV", b"SQ", b"UC", b"UR", b"UT", b"UN", b"SV", b"UV")
_ITEM, _ITEM_END, _SEQUENCE_END, _OPEN = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), 0xFFFFFFFF


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the frame files below root (or of the one file root), by suffix and whatever the letter case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(name.contains("."), F.lower(F.element_at(F.split(name, "[.]"), -1))).otherwise("")
    return files.where(suffix.isin(*SUFFIXES))


def unzip(spark: SparkSession, root: str) -> DataFrame:
    """archive, member, content of the frame files in the archives below root; broken archives give nothing.

    Names without the UTF-8 mark are read as cp866, which is what the archives' makers mean by cp437.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part.path, part.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            name = info.filename if info.flag_bits & 0x800 else info.filename.encode("cp437", "replace").decode("cp866", "replace")
                            suffix = name.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in name.rsplit("/", 1)[-1] else ""
                            if not info.is_dir() and suffix in SUFFIXES:
                                yield pd.DataFrame({"archive": [path], "member": [name], "content": [z.read(info)]})
                except zipfile.BadZipFile:
                    continue

    return archives.mapInPandas(run, "archive string, member string, content binary")


class Reader:
    """Walks the elements of a file: what TAGS names is kept, nested sequences are passed over at any depth."""

    def __init__(self, data: bytes, at: int, implicit: bool, big: bool = False):
        self.data, self.at, self.implicit, self.order = data, at, implicit, ">" if big else "<"

    def unpack(self, kind: str, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def head(self) -> tuple[tuple[int, int], bytes, int]:
        """Tag, value type and length of the next element, which begins at ``at`` then."""
        tag = self.unpack("H", self.at), self.unpack("H", self.at + 2)
        if self.implicit or tag[0] == 0xFFFE:
            size, self.at = self.unpack("I", self.at + 4), self.at + 8
            return tag, b"", size
        kind = self.data[self.at + 4 : self.at + 6]
        if kind in LONG_TYPES:
            size, self.at = self.unpack("I", self.at + 8), self.at + 12
        else:
            size, self.at = self.unpack("H", self.at + 6), self.at + 8
        return tag, kind, size

    def skip(self) -> None:
        """Passes over an open sequence: items of known or open length, and what is nested in them."""
        depth = 1
        while depth:
            tag, _, size = self.head()
            if tag in (_ITEM_END, _SEQUENCE_END):
                depth -= 1
            elif size == _OPEN:
                depth += 1
            else:
                self.at += size

    def fragments(self) -> list[bytes]:
        """The items of compressed pixel data, without the table of offsets."""
        out = []
        while True:
            tag, _, size = self.head()
            if tag == _SEQUENCE_END:
                return out[1:]
            out.append(self.data[self.at : self.at + size])
            self.at += size

    def elements(self, upto: int | None = None, group: int | None = None) -> dict[str, bytes | list[bytes]]:
        found: dict[str, bytes | list[bytes]] = {}
        end = len(self.data) if upto is None else upto
        while self.at + 8 <= end:
            if group is not None and self.unpack("H", self.at) != group:
                break
            tag, kind, size = self.head()
            if size == _OPEN:
                if tag == (0x7FE0, 0x0010):
                    found["pixel_data"] = self.fragments()
                elif kind == b"UN":  # what is nested in an unknown type is implicit
                    inner = Reader(self.data, self.at, True, self.order == ">")
                    inner.skip()
                    self.at = inner.at
                else:
                    self.skip()
                continue
            if self.at + size > len(self.data):
                raise ValueError("the file ends within an element")
            if tag in TAGS:
                found[TAGS[tag]] = self.data[self.at : self.at + size]
            self.at += size
        return found


def elements(data: bytes) -> dict[str, bytes | list[bytes]]:
    """Raw values of the known tags, and ``order``, the byte order; pixel data is a list of fragments where it is compressed.

    Files without a header are read as implicit where that gives a plausible first type, as some devices write them.
    """
    head: dict[str, bytes | list[bytes]] = {}
    at = 0
    if data[128:132] == b"DICM":
        reader = Reader(data, 132, implicit=False)
        head, at = reader.elements(group=2), reader.at
    syntax = head.get("syntax", b"").decode("latin-1").strip("\0 ")
    if not syntax:
        syntax = EXPLICIT if data[at + 4 : at + 6].isalpha() and data[at + 4 : at + 6].isupper() else IMPLICIT
    if syntax not in (IMPLICIT, EXPLICIT, BIG, RLE):
        raise ValueError(f"transfer syntax {syntax} is not supported")
    found = Reader(data, at, syntax == IMPLICIT, syntax == BIG).elements()
    return head | found | {"order": b">" if syntax == BIG else b"<"}


def unpacked(run: bytes) -> bytes:
    """A byte stream from its run-length code: a count below 128 and as many bytes and one more, or one above and a byte to repeat."""
    out, at = bytearray(), 0
    while at < len(run):
        n = run[at]
        if n < 128:
            out += run[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += run[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def planes(fragment: bytes, pixels: int, width: int) -> bytes:
    """Little-endian pixels of ``width`` bytes from a run-length coded frame, whose planes hold one byte each, the highest first."""
    n, *offsets = struct.unpack_from("<16I", fragment)
    if n != width:
        raise ValueError(f"{n} planes of bytes for pixels of {width}")
    ends = [*offsets[1:n], len(fragment)]
    held = [np.frombuffer(unpacked(fragment[a:b])[:pixels], np.uint8) for a, b in zip(offsets, ends)]
    if any(len(p) < pixels for p in held):
        raise ValueError("a plane is too short")
    return np.stack(held[::-1], 1).tobytes()


def scale(tags: dict[str, bytes]) -> tuple[float, float, str]:
    """Pixel size in mm and where it comes from; a tag's first value counts for x."""
    for name in ("pixel_spacing", "imager_spacing"):
        try:
            x, y = (float(v) for v in tags[name].decode().strip("\0 ").split("\\"))
            return x, y, name
        except (KeyError, ValueError):
            continue
    return *DEVICE_MM, "device"


def whole_numbers(raw: bytes | list[bytes] | None, order: str) -> list[int]:
    """Whole numbers of a short binary value or of text; none if it is neither."""
    if not raw or isinstance(raw, list):
        return []
    try:
        return [int(v) for v in raw.decode("ascii").strip("\0 ").split("\\")]
    except (UnicodeDecodeError, ValueError):
        return [int(v) for v in np.frombuffer(raw[: len(raw) // 2 * 2], f"{order}u2")]


def frame(path: str, data: bytes) -> dict:
    """One row of FRAME_SCHEMA; a file that cannot be read gives its path and the error (120 characters).

    exposures is 0 and exposed_area null where a file does not tell. pixel_md5 is that of the decoded pixels.
    """
    try:
        tags = elements(data)
        order = tags["order"].decode()
        text = lambda n: tags.get(n, b"").decode("latin-1").strip("\0 ")
        number = lambda n, *other: struct.unpack(f"{order}H", tags[n][:2])[0] if n in tags or not other else other[0]
        raw, h, w, width = tags["pixel_data"], number("rows"), number("cols"), (number("bits_allocated") + 7) // 8
        if number("samples", 1) != 1 or width not in (1, 2):
            raise ValueError("only grey pixels of one or two bytes are supported")
        if isinstance(raw, list):
            raw, order = planes(raw[0], h * w, width), "<"
        kind = f"{order}{'i' if number('signed', 0) else 'u'}{width}"
        if len(raw) < h * w * width:
            raise ValueError("there are fewer pixels than rows and columns")
        whole = np.frombuffer(raw, kind, h * w)
        v = whole.astype(np.float32)
        x, y, source = scale(tags)
        v = v.max() - v if text("photometric") == "MONOCHROME1" else v
        own = {n: text(n) for n in ("sop_uid", "study_uid", "series_uid", "photometric", "manufacturer", "model", "software", "series_description")}
        taken, area = whole_numbers(tags.get("exposures"), order), whole_numbers(tags.get("exposed_area"), order)
        return {"path": path, **own, "rows": h, "cols": w, "bits_stored": number("bits_stored"), "mm_x": x, "mm_y": y, "scale_source": source, "exposed_area": area or None, "exposures": taken[0] if taken else 0, "pixel_md5": hashlib.md5(whole.astype(kind.replace(">", "<")).tobytes()).hexdigest(), "pixels": v.tolist(), "error": None}
    except Exception as e:  # one bad file must not fail the others
        return {"path": path, "error": f"{type(e).__name__}: {e}"[:120]}


def frames(files: DataFrame) -> DataFrame:
    """FRAME_SCHEMA rows of ``files`` (path, content)."""
    schema = to_arrow_schema(T._parse_datatype_string(FRAME_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist([frame(path.as_py(), content.as_py())], schema=schema)

    return files.select("path", "content").mapInArrow(run, FRAME_SCHEMA)


def pixels(frames_df: DataFrame) -> DataFrame:
    """The long pixel relation (frame_id = path, y, x, v) of readable frames."""
    return frames_df.where("error IS NULL").select(F.col("path").alias("frame_id"), "cols", F.posexplode("pixels").alias("i", "v")).select("frame_id", F.expr("i div cols").cast("int").alias("y"), (F.col("i") % F.col("cols")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def expert_labels(spark: SparkSession, path: str, columns: list[str], flags: list[str]) -> DataFrame:
    """A label table without header: columns by position, flags as numbers where they are, rows without study dropped."""
    raw = spark.read.option("header", "false").csv(path).toDF(*columns)
    return raw.where("study IS NOT NULL").select(F.col("study").cast("string").alias("study"), *(F.col(f).try_cast("double").alias(f) for f in flags))


def references(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    """One row of sorted arrays from a JSON file; None if an array is missing or empty."""
    got = spark.read.option("multiLine", "true").json(path)
    if not set(names) <= {*got.columns} or got.where(" OR ".join(f"size({n}) <= 0" for n in names)).count():
        return None
    return got.select(*(F.array_sort(F.transform(n, lambda v: v.cast("double"))).alias(n) for n in names))


def write_report(report: DataFrame, path: str, as_json: bool = False) -> None:
    """The report as CSV with a header (also when it is empty) or JSON lines; a missing class is written as an empty cell."""
    if as_json:
        report.write.mode("overwrite").json(path)
    else:
        report.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def data_uri(content) -> F.Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(content))
