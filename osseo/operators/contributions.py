"""What each feature adds to the margin of MLlib's boosted trees, by path-dependent Shapley values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from osseo.functions.columns import shared_folder


@dataclass(frozen=True)
class Leaf:
    """A leaf's value times its tree's weight, the features that lead to it, the open interval (low, high] that each must lie in, and
    the share of training rows that the splits on it pass on.
    """

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaves(nodes: dict[int, tuple], weight: float) -> list[Leaf]:
    """Leaves of a tree of (prediction, rows, left, right, feature, threshold) by node id; a leaf has left -1."""
    out: list[Leaf] = []
    waiting = [(0, {})]
    while waiting:
        at, held = waiting.pop()
        prediction, rows, left, right, feature, threshold = nodes[at]
        if left < 0:
            names = tuple(sorted(held))
            out.append(Leaf(weight * prediction, names, *(tuple(held[f][k] for f in names) for k in range(3))))
            continue
        low, high, share = held.get(feature, (-math.inf, math.inf, 1.0))
        waiting.append((left, held | {feature: (low, min(high, threshold), share * nodes[left][1] / rows)}))
        waiting.append((right, held | {feature: (max(low, threshold), high, share * nodes[right][1] / rows)}))
    return out


def ensemble(spark: SparkSession, model: Model) -> list[Leaf]:
    """The leaves of all trees of a fitted model (GBT), read from its saved form; as many as its depth and rounds allow."""
    import uuid

    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select("treeID", node["id"].alias("id"), node["prediction"].alias("p"), node["rawCount"].alias("n"), node["leftChild"].alias("l"), node["rightChild"].alias("r"), node["split"]["featureIndex"].alias("f"), node["split"]["leftCategoriesOrThreshold"].alias("t"), node["split"]["numCategories"].alias("c")).collect()
    trees: dict[int, dict] = {}
    for r in rows:
        if r.l >= 0 and r.c >= 0:
            raise ValueError("trees with categorical splits are not supported")
        trees.setdefault(r.treeID, {})[r.id] = (r.p, max(r.n, 1), r.l, r.r, r.f, r.t[0] if r.l >= 0 else 0.0)
    return [leaf for k, weight in enumerate(model.treeWeights) for leaf in leaves(trees[k], weight)]


def expected(model: list[Leaf]) -> float:
    """The mean margin over the training rows that the trees were grown with."""
    return sum(leaf.value * math.prod(leaf.share) for leaf in model)


def shapley(x: np.ndarray, model: list[Leaf]) -> np.ndarray:
    """Rows x features: each feature's mean change of the margin over all orders in which a row's values become known.

    A leaf counts in proportion to the training rows that reach it by the splits whose features are not known yet. So for one leaf
    and a set of known features the expected value is a product over its features, and the mean over orders is a sum over
    the sizes of sets, whose products are the coefficients of one polynomial.
    """
    out = np.zeros(x.shape)
    for leaf in model:
        m = len(leaf.features)
        known = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]
        for i, f in enumerate(leaf.features):
            sets = np.zeros((m, len(x)))  # by size: products over the other features, known or not
            sets[0] = 1.0
            for j in range(m):
                if j != i:
                    sets[1:] = sets[1:] * leaf.share[j] + sets[:-1] * known[j]
                    sets[0] *= leaf.share[j]
            weights = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
            out[:, f] += leaf.value * (known[i] - leaf.share[i]) * (np.array(weights) @ sets)
    return out


def tree_contributions(rows: DataFrame, model: Model, key: str, features: str, names: list[str], top: int = 6) -> DataFrame:
    """key, margin, base, and ``contributions``, the ``top`` features of the greatest impact (ties: the first name) with value and impact.

    ``features`` is an array of doubles in the order of ``names``. base and all impacts add up to the margin.
    """
    leaves_of = rows.sparkSession.sparkContext.broadcast(ensemble(rows.sparkSession, model))
    base = expected(leaves_of.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(features).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            phi = shapley(x, leaves_of.value)
            order = np.argsort(-np.abs(np.round(phi, 12)), axis=1, kind="stable")[:, :top]
            told = [[{"feature": names[j], "value": float(x[i, j]), "impact": float(phi[i, j])} for j in order[i]] for i in range(len(x))]
            kind = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64()), ("impact", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(phi.sum(1) + base), pa.array(np.full(len(x), base)), pa.array(told, kind)], names=[key, "margin", "base", "contributions"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, features).mapInArrow(run, f"{key} {kind}, margin double, base double, contributions array<struct<feature: string, value: double, impact: double>>")
