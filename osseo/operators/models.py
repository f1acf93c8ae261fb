"""Saved heads and providers: what decides, kept as a table of names, features and thresholds; what is absent has a defined result.

A head is linear (its weights stand in the table) or a saved MLlib model beside it. Heads are read once on the driver; MLlib
sends a model to each worker once. A provider makes an object once a worker process (a network, a set of masks) or finds
that it is absent. A missing head has no probability: it never fires, and its probability counts as 0.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyspark
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from osseo.functions.columns import resolved

HEADS = "heads"
_TABLE = "name string, features array<string>, threshold double, weights array<double>, bias double, centres map<string, double>, engine string"


@dataclass(frozen=True)
class Head:
    """``weights`` and ``bias`` of a logistic model over ``features``, or an MLlib ``model`` whose input column is ``x``.

    ``centres`` are the values from which features that end in _dev are distances.
    """

    name: str
    features: tuple[str, ...]
    threshold: float
    weights: tuple[float, ...] = ()
    bias: float = 0.0
    model: Model | None = None
    centres: dict[str, float] = field(default_factory=dict, hash=False)


def save(spark: SparkSession, heads: list[Head], folder: str) -> None:
    rows = [(h.name, list(h.features), h.threshold, list(h.weights), h.bias, h.centres, pyspark.__version__) for h in heads]
    spark.createDataFrame(rows, _TABLE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/table")
    for h in heads:
        if h.model is not None:
            h.model.write().overwrite().save(f"{folder}/{h.name}")


def load(spark: SparkSession, folder: str) -> dict[str, Head]:
    """The heads of a folder by name; none if there is no such folder. Another version of the engine gives a warning."""
    from pyspark.ml import PipelineModel

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/table")):
        return {}
    out = {}
    for r in spark.read.schema(_TABLE).parquet(f"{folder}/table").collect():  # a row a head
        if r.engine != pyspark.__version__:
            warnings.warn(f"{r.name}: fitted with version {r.engine}, here {pyspark.__version__}: predictions may differ", RuntimeWarning, stacklevel=2)
        held = files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.name}"))
        out[r.name] = Head(r.name, tuple(r.features), r.threshold, tuple(r.weights), r.bias, PipelineModel.load(f"{folder}/{r.name}") if held else None, dict(r.centres))
    return out


def features_of(df: DataFrame) -> Column:
    """A map of all numeric columns that are not null, by name."""
    names = [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in names))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def with_probabilities(regions: DataFrame, heads: dict[str, Head] | None) -> DataFrame:
    """Adds the map ``heads``, the probability of each head; features are looked up as ``resolved`` does, absent ones are -1."""
    out = regions.withColumn("_f", features_of(regions))
    entries = []
    for h in (heads or {}).values():
        values = [resolved(F.col("_f"), name, h.centres.get(name.removesuffix("_dev"))) for name in h.features]
        if h.model is None:
            z = sum((w * v for w, v in zip(h.weights, values, strict=True)), F.lit(h.bias))
            entries.append((h.name, 1 / (1 + F.exp(-z))))
            continue
        from pyspark.ml.functions import array_to_vector, vector_to_array

        kept = out.columns
        scored = h.model.transform(out.withColumn("x", array_to_vector(F.array(*values))))
        out = scored.select(*kept, vector_to_array("probability")[1].alias(f"_p_{h.name}"))
        entries.append((h.name, F.col(f"_p_{h.name}")))
    pairs = [x for name, p in entries for x in (F.lit(name), p)]
    probabilities = F.create_map(*pairs) if pairs else F.expr("CAST(map() AS map<string, double>)")
    return out.withColumn(HEADS, probabilities).select(*regions.columns, HEADS)


def probability(name: str, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(F.col(HEADS), F.lit(name)), F.lit(otherwise))


def fires(heads: dict[str, Head] | None, name: str) -> Column:
    """Whether the head's probability reaches its threshold; a missing head does not fire."""
    return F.lit(False) if not heads or name not in heads else probability(name) >= heads[name].threshold


_PROVIDED: dict[str, object] = {}


def provided(key: str, make: Callable[[], object]) -> object | None:
    """What ``make`` gives, made once in this process; None if it gives None or fails, without another attempt."""
    if key not in _PROVIDED:
        try:
            _PROVIDED[key] = make()
        except Exception as e:  # noqa: BLE001 a provider that cannot be loaded is absent
            warnings.warn(f"{key} is absent: {type(e).__name__}: {e}", RuntimeWarning, stacklevel=2)
            _PROVIDED[key] = None
    return _PROVIDED[key]


def by_provider(frames: DataFrame, key: str, make: Callable[[], object], apply: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, absent: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Batches of ``frames`` through the provider ``key``, or through ``absent`` where the worker has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = provided(key, make)
        for batch in batches:
            yield absent(batch) if found is None else apply(found, batch)

    return frames.mapInPandas(run, schema)


def health(spark: SparkSession, heads: dict[str, Head] | None, references: DataFrame | None, providers: dict[str, bool], needed: tuple[str, ...] = ("spine_coverage", "spine_quality", "hip_quality", "hip_positioning", "hip_roi")) -> DataFrame:
    """name, ok of each head that decisions need, the references and the providers, and ``status``, degraded if one is missing."""
    rows = [(n, n in (heads or {})) for n in needed] + [("references", references is not None), *providers.items()]
    status = "ok" if all(ok for _, ok in rows) else "degraded"
    return spark.createDataFrame([(*r, status) for r in rows], "name string, ok boolean, status string")
