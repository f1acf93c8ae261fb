"""Helpers the operators share: reading tables, Arrow-batch maps, checkpoints and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Characters that one vectorised step looks at; texts beyond it stand alone.
CHUNK_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share, from the session's ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, path: str) -> str:
    """``path``, an existing folder that is deleted when the application ends."""
    _files(spark, path).deleteOnExit(_path(spark, path))
    return path


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written and nothing reads any more."""
    _files(spark, path).delete(_path(spark, path), True)


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` by way of Parquet in the shared folder: compressed, unlike a checkpoint, so fit for texts."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(passing(df.sparkSession, path))


def row_key() -> F.Column:
    """doc_id and 128 bits of hash of the text: rows that share it are repeated rows."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def packed(docs: DataFrame) -> DataFrame:
    """``row`` with all columns of ``docs``, so that no column of theirs can clash, beside ``rk`` (row_key), doc_id and text."""
    return docs.select(F.struct("*").alias("row"), row_key().alias("rk"), "doc_id", "text")


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``most_rows`` rows, else unchanged (a shuffle join)."""
    return F.broadcast(df) if df.count() <= most_rows else df


def bounded_sample(df: DataFrame, key: str, most_rows: int, seed: int = 17) -> DataFrame:
    """About ``most_rows`` rows of ``df``, chosen by a hash of ``key``; all rows if there are no more than that."""
    n = df.count()
    if n <= most_rows:
        return df
    share = (most_rows << 62) // n
    return df.where(F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), 2) < share)


def map_texts(df: DataFrame, added: dict[str, T.DataType], fn: Callable[[list], dict], text: str = "text", drop_text: bool = True) -> DataFrame:
    """Adds to each row the columns that ``fn`` makes of the whole texts of a group of rows.

    ``fn`` gets a list of texts (null: None) of about CHUNK_CHARS characters at most, or one longer text, and returns lists
    or arrays by column. Other columns pass through as Arrow data, so integers with nulls keep their exact values. ``text`` may
    be a field of a struct column (``row.text``), which then passes through whole and holds the only copy of the text.
    """
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text)]
    schema = T.StructType(kept + [T.StructField(k, v) for k, v in added.items()])
    names = [f.name for f in kept]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, *field = text.split(".")
            values = batch.column(column)
            for lo, hi, texts in chunks((pc.struct_field(values, field) if field else values).to_pylist()):
                got = fn(texts)
                own = [batch.column(n).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays([*own, *(got[k].cast(arrow.field(k).type) if isinstance(got[k], pa.Array) else pa.array(got[k], arrow.field(k).type) for k in added)], names=[*names, *added])

    return df.mapInArrow(run, schema)


def chunks(texts: list) -> Iterator[tuple[int, int, list]]:
    lo, n = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if n and n + size > CHUNK_CHARS:
            yield lo, i, texts[lo:i]
            lo, n = i, 0
        n += size
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


#: A key that holds more than one in so many rows of a join is a hot one; there are fewer than so many of them.
HOT = 2_000


def spread_join(big: DataFrame, by_key: DataFrame, keys: list[str], rows: str = "n") -> DataFrame:
    """The inner join of ``big`` with ``by_key``, one row a key, whose column ``rows`` counts the rows of ``big`` with the key.

    Rows of hot keys stay where they are: their side of ``by_key``, fewer than HOT rows, is broadcast. Others are shuffled.
    Both inputs are read twice, so they should be saved ones.
    """
    total = by_key.agg(F.sum(rows)).first()[0] or 0
    limit = max(total // HOT, 1_000)
    hot, cold = by_key.where(F.col(rows) > limit).drop(rows), by_key.where(F.col(rows) <= limit).drop(rows)
    return big.join(F.broadcast(hot), keys).unionByName(big.join(cold, keys))


_P = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _P) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, 4096), b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all their bits are usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_class(pattern: Callable[[int], bool]) -> np.ndarray:
    return np.array([pattern(b) for b in range(256)], dtype=bool)


def word_spans(texts: list[str], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (joined by a line feed), and start, end and text number of each maximal run of ``inside`` bytes."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends_of = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([0], inside[data].view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return data, starts, ends, np.searchsorted(ends_of, starts, "right")


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _P) -> np.ndarray:
    """A scrambled polynomial hash of values[start:end] for each span."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])
