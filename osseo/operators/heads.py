"""Scoring heads: gradient boosting, balanced logistic regression and a forest, averaged; fitted per fold with MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F


def heads(label: str = "y", weight: float = 1.0) -> list[Pipeline]:
    """The three models whose probabilities are averaged (forest: the nearest MLlib has to extremely randomised trees).

    ``weight``: the sum of the training rows' weights, by which C = 0.3, a factor of summed losses, becomes MLlib's penalty of mean ones.
    """
    boosted = GBTClassifier(labelCol=label, featuresCol="x", maxDepth=2, maxIter=150, stepSize=0.06, minInstancesPerNode=8, seed=1)
    scaled = StandardScaler(inputCol="x", outputCol="xs", withMean=True)
    linear = LogisticRegression(labelCol=label, featuresCol="xs", weightCol="w", regParam=1 / (0.3 * weight), standardization=False)
    forest = RandomForestClassifier(labelCol=label, featuresCol="x", numTrees=300, featureSubsetStrategy="0.5", minInstancesPerNode=5, weightCol="w", seed=1)
    return [Pipeline(stages=[boosted]), Pipeline(stages=[scaled, linear]), Pipeline(stages=[forest])]


def out_of_fold(rows: DataFrame, features: str, label: str, fold: str, folds: int) -> DataFrame:
    """``rows`` with p, the mean probability by models that did not see the row's fold; classes weigh the same in each training part."""
    data = rows.withColumn("x", array_to_vector(F.transform(features, lambda v: v.cast("double")))).withColumn("_id", F.xxhash64(*rows.columns))
    out = None
    for k in range(folds):
        train, test = data.where(F.col(fold) != k), data.where(F.col(fold) == k).withColumn("p", F.lit(0.0))
        seen = train.agg(F.avg(label).alias("share"), F.count("*").alias("n")).first()
        share = seen.share if seen.share is not None else 0.5
        train = train.withColumn("w", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
        # with both classes, their weights sum to the number of rows
        for pipeline in heads(label, float(seen.n or 1)):
            scored = pipeline.fit(train).transform(test)
            test = scored.withColumn("p", F.col("p") + vector_to_array("probability")[1] / 3).select(*data.columns, "p")
        out = test if out is None else out.unionByName(test)
    return out.drop("x", "_id")
