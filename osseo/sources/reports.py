"""Report sinks: one ordered table file (CSV or XLSX) committed from the parts that tasks wrote, overlays by path, reference scores.

Tasks write the rows of their range; the commit streams the parts, in order, into one file of the same store, so no row passes the
driver's memory and an aborted write leaves no file. Paths may be of any store that Spark writes.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from osseo.operators.neighbourhood import FRAME, _image
from osseo.sources.masks import encoded

_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
}
_HEAD = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_TAIL = "</sheetData></worksheet>"
_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def csv_cell(c: Column) -> Column:
    """Text of a cell; null is empty, and what holds a comma, quote or line end is quoted."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def xml_cell(c: Column, number: bool) -> Column:
    """A cell of a sheet's row; null, NaN and infinite values are empty cells, characters that XML does not allow are left out."""
    if number:
        v = c.cast("double")
        return F.when(c.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "<c/>").otherwise(F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>")))
    text = F.regexp_replace(c.cast("string"), "[^\\t\\n\\r\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return F.when(c.isNull(), "<c/>").otherwise(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>")))


def write_table(report: DataFrame, path: str, order: list[str]) -> None:
    """All rows of ``report``, in the order of some of its columns, as the one file ``path``: XLSX by that suffix, else CSV.

    The header is there without rows too. An existing file is replaced once all rows are written.
    """
    spark, sheet = report.sparkSession, path.lower().endswith(".xlsx")
    if sheet:
        line = F.concat(F.lit("<row>"), *(xml_cell(F.col(f"`{c}`"), kind in _NUMBERS) for c, kind in report.dtypes), F.lit("</row>"))
        head = "<row>" + "".join(f'<c t="inlineStr"><is><t>{_escaped(c)}</t></is></c>' for c in report.columns) + "</row>"
    else:
        line = F.concat_ws(",", *(csv_cell(F.col(f"`{c}`")) for c in report.columns))
        head = ",".join(f'"{c}"' if set(c) & set(',"\n') else c for c in report.columns) + "\n"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    parts = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".parts-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        report.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.text(parts.toString())
        names = sorted(s.getPath().getName() for s in files.listStatus(parts) if s.getPath().getName().startswith("part-"))
        made = jvm.org.apache.hadoop.fs.Path(parts, "whole")
        out = files.create(made, True)
        try:
            (_sheet if sheet else _plain)(jvm, files, out, head, [jvm.org.apache.hadoop.fs.Path(parts, n) for n in names])
        finally:
            out.close()
        files.delete(target, False)
        if not files.rename(made, target):
            raise OSError(f"{path} cannot be written")
    finally:
        files.delete(parts, True)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _copied(jvm, files, out, parts: list) -> None:
    for part in parts:
        source = files.open(part)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        finally:
            source.close()


def _plain(jvm, files, out, head: str, parts: list) -> None:
    out.write(bytearray(head.encode()))
    _copied(jvm, files, out, parts)


def _sheet(jvm, files, out, head: str, parts: list) -> None:
    z = jvm.java.util.zip.ZipOutputStream(out)
    for name, text in _PARTS.items():
        z.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        z.write(bytearray(text.encode()))
        z.closeEntry()
    z.putNextEntry(jvm.java.util.zip.ZipEntry("xl/worksheets/sheet1.xml"))
    z.write(bytearray((_HEAD + head).encode()))
    _copied(jvm, files, z, parts)
    z.write(bytearray(_TAIL.encode()))
    z.closeEntry()
    z.finish()


def overlay_name(study: Column, image: Column, path: Column) -> Column:
    """Where a frame's picture goes: study/image.png, with the word study and the file's stem where these are missing."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    some = lambda c, other: F.when(c.isNull() | (c == ""), other).otherwise(c)
    return F.concat(some(study, F.lit("study")), F.lit("/"), some(image, stem), F.lit(".png"))


def pictures_of(normal: DataFrame, value: str = "z") -> DataFrame:
    """frame_id, content: each frame (values from 0 to 1) as a PNG picture."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grey = np.floor(np.clip(_image(pdf, value, float), 0, 1) * 255).astype(np.uint8)
        return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]], "content": [encoded(grey)]})

    return normal.select(FRAME, "y", "x", value).groupBy(FRAME).applyInPandas(one, f"{FRAME} {dict(normal.dtypes)[FRAME]}, content binary")


def overlays(report: DataFrame, pictures: DataFrame) -> DataFrame:
    """path, content of the picture (frame_id, content) of each frame of ``report`` (with frame_id) that succeeded."""
    done = report.where("processing_status = 'Success'").join(pictures, FRAME)
    return done.select(overlay_name(F.col("study_uid"), F.col("image_uid"), F.col("path_to_study")).alias("path"), "content")


def write_references(scores: DataFrame, path: str, names: tuple[str, ...]) -> None:
    """One row of arrays as a JSON file of sorted numbers with six decimals; null and NaN are left out.

    The arrays are reference distributions of a few hundred values.
    """
    row = scores.select(*(F.array_sort(F.transform(F.filter(n, lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))), lambda v: F.round(v.cast("double"), 6))).alias(n) for n in names)).first()
    write_text(scores.sparkSession, json.dumps({n: row[n] for n in names}), path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
