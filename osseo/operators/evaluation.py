"""Metrics of scores against labels (y 0 or 1, p a score), thresholds, bootstrap intervals and column pruning.

Sweeps run over the distinct scores, aggregated first, in range-dealt order; only counts cross between partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from osseo.functions.columns import number, positions, running, saved


def tallies(scored: DataFrame) -> DataFrame:
    """p, pos, neg per distinct score, with tp and fp at or above it and the totals."""
    per = scored.groupBy("p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    total = scored.agg(F.sum("y").cast("long").alias("n_pos"), F.sum(1 - F.col("y")).cast("long").alias("n_neg"))
    return running(per, [F.col("p").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}).crossJoin(F.broadcast(total))  # one row


def roc_auc(scored: DataFrame) -> DataFrame:
    """The probability that a positive's score exceeds a negative's, ties counting half."""
    t = tallies(scored)
    above = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return t.agg((above / (F.max("n_pos") * F.max("n_neg"))).alias("roc_auc"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """Average precision."""
    return tallies(scored).agg(F.sum(F.col("pos") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))


def quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the q-quantile of ``value``, linear between neighbours, found by global positions of the distinct values."""
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    placed = running(per, [F.col(value)], {"upto": F.col("n")})
    at = q * (df.where(F.col(value).isNotNull()).count() - 1)
    low, high = (F.min(F.when(F.col("upto") > k, F.col(value))) for k in (math.floor(at), math.ceil(at)))
    return placed.agg(low.alias("low"), high.alias("high")).select((F.col("low") + (F.col("high") - F.col("low")) * (at - math.floor(at))).alias(value))


def threshold_by_rate(scored: DataFrame) -> DataFrame:
    """The score quantile that fires as often as there are positives; 0.5 without enough rows or positives."""
    rate = scored.agg(F.avg("y").alias("r"), F.count("*").alias("n")).first()
    if not rate.n or rate.n < 2 or not rate.r:
        return scored.sparkSession.createDataFrame([(0.5,)], "threshold double")
    return quantile(scored, "p", 1 - float(rate.r)).withColumnRenamed("p", "threshold")


def threshold_by_f1(scored: DataFrame) -> DataFrame:
    """The score with the greatest F1 (the lowest among equals); 0.5 (and no F1) with fewer than two distinct scores or no positive."""
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")), 12)
    best = tallies(scored).select("p", f1.alias("f1"), "n_pos").agg(F.min(F.struct((-F.col("f1")).alias("f"), "p")).alias("b"), F.count("*").alias("scores"), F.max("n_pos").alias("pos"))
    enough = (F.col("scores") >= 2) & (F.col("pos") > 0)
    return best.select(F.when(enough, F.col("b.p")).otherwise(0.5).alias("threshold"), F.when(enough, -F.col("b.f")).alias("f1"))


def report(scored: DataFrame, threshold: float) -> DataFrame:
    """Confusion counts, sensitivity, specificity, F1, balanced accuracy and prevalence; few positives make it exploratory."""
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    c = scored.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select("*", sens.alias("sensitivity"), spec.alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((sens + spec) / 2).alias("balanced_accuracy"), ratio(tp + fn, tp + fp + fn + tn).alias("prevalence"), (tp + fn < 15).alias("exploratory"))


def draws_of(groups: DataFrame, draws: int, seed: int) -> DataFrame:
    """b, g, times: how often draw b holds group number g, when as many groups as there are (numbered from 0) are drawn with replacement."""
    n = groups.count()
    b = groups.sparkSession.range(draws).select(F.col("id").alias("b")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "k")), 1, 8), 16, 10).cast("long") % max(n, 1)
    return b.groupBy("b", pick.alias("g")).agg(F.count("*").alias("times"))


def _interval(values: DataFrame, value: str) -> DataFrame:
    return values.agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("c")).select(F.col("c")[0].alias("low"), F.col("c")[1].alias("high"))


def bootstrap_mean(scored: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """95 percent interval of sensitivity at p >= 0.5 when whole groups are drawn with replacement; draws of one class are skipped.

    Each group's counts are summed first; a draw picks group numbers by a hash, so only group counts are repeated, draws times.
    """
    one = F.col("y") == 1
    per = saved(positions(scored.groupBy("grp").agg(F.count_if(one & (F.col("p") >= 0.5)).alias("tp"), F.count_if(one).alias("pos"), F.count_if(~one).alias("neg")), ["grp"], "g"))
    total = lambda c: F.sum(F.col(c) * F.col("times")).alias(c)
    drawn = draws_of(per, draws, seed).join(per, "g").groupBy("b").agg(total("tp"), total("pos"), total("neg")).where("pos > 0 AND neg > 0")
    return _interval(drawn.withColumn("s", F.col("tp") / F.col("pos")), "s")


def bootstrap_auc(scored: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """95 percent interval of the area under the ROC curve when whole groups are drawn with replacement; draws of one class are skipped."""
    groups = saved(positions(scored.select("grp").distinct(), ["grp"], "g"))
    per = scored.groupBy("grp", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).join(groups, "grp")
    drawn = draws_of(groups, draws, seed).join(per, "g").groupBy("b", "p").agg(F.sum(F.col("pos") * F.col("times")).alias("pos"), F.sum(F.col("neg") * F.col("times")).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("b").orderBy("p")) - F.col("neg") / 2
    each = drawn.withColumn("above", F.col("pos") * below).groupBy("b").agg(F.sum("above").alias("a"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0 AND neg > 0")
    return _interval(each.withColumn("auc", F.col("a") / (F.col("pos") * F.col("neg"))), "auc")


def evaluation_row(scored: DataFrame, threshold: float, task: str, model: str = "", draws: int = 2000, seed: int = 7) -> DataFrame:
    """One row of all that is reported about a task: counts, areas and their interval, F1, sensitivity and its interval, specificity, status.

    The interval of the sensitivity is that of the answers at ``threshold``. Each part is one row, so their product is one.
    """
    answered = scored.withColumn("p", (F.col("p") >= threshold).cast("double"))
    parts = [
        roc_auc(scored).select(F.round("roc_auc", 3).alias("roc_auc")), bootstrap_auc(scored, draws, seed).select(F.format_string("%.2f–%.2f", "low", "high").alias("auc_interval")),
        pr_auc(scored).select(F.round("pr_auc", 3).alias("pr_auc")), bootstrap_mean(answered, draws, seed).select(F.format_string("%.2f–%.2f", "low", "high").alias("sensitivity_interval")),
    ]
    out = report(scored, threshold).select(
        F.lit(task).alias("task"), F.lit(model).alias("model"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), (F.col("tp") + F.col("fn")).alias("positives"), F.round("prevalence", 3).alias("prevalence"), F.round("f1", 3).alias("f1"),
        F.round("sensitivity", 3).alias("sensitivity"), F.round("specificity", 3).alias("specificity"), F.concat_ws("/", "tp", "fp", "fn", "tn").alias("counts"), F.when(F.col("exploratory"), "exploratory").otherwise("").alias("status"),
    )
    for part in parts:
        out = out.crossJoin(part)
    return out


# Columns that come from labels, from the way of recording and from bookkeeping; none of them is a feature.
LABEL_COLUMNS = ["study", "region", "quality_class", "flags_or", "verdict_mismatch", "verdict_itog", "violation_type", "comment", "_t", "_pos", "pos_t", "roi_t", "y_q", "y_p", "spine_coverage", "spine_axis", "spine_artifact", "hip_r_positioning", "hip_r_roi", "hip_l_positioning", "hip_l_roi", "verdict_spine", "verdict_hip_r", "verdict_hip_l"]
MODE_COLUMNS = ["rows", "cols", "mm_per_px", "scale_known", "mm_per_px_anat", "period_px"]
SERVICE_COLUMNS = ["fold", "copy", "n_frames_x", "n_frames_y"]


def feature_columns(df: DataFrame, without_prefix: str = "") -> list[str]:
    """Numeric columns that are neither labels (or made from them), nor modes of recording, nor bookkeeping."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    stem = lambda c: c.rpartition("_")[0]
    ok = lambda c: not ({c, stem(c)} & {*LABEL_COLUMNS, *MODE_COLUMNS} or c in SERVICE_COLUMNS or any(c.startswith(f"{x}_") for x in LABEL_COLUMNS))
    return [c for c, kind in df.dtypes if kind in numeric and ok(c) and not (without_prefix and c.startswith(without_prefix))]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("s")).select("s.*")


def pruned(df: DataFrame, columns: list[str], limit: float = 0.97) -> list[str]:
    """The columns that stay when constants and later ones of highly correlated pairs go, in order; null, NaN and infinite values count as -1."""
    df = df.select(*(number(F.col(c)).alias(c) for c in columns))
    spread = df.agg(*(F.stddev_samp(c).alias(c) for c in columns)).first()
    live = [c for c in columns if spread[c] is not None and spread[c] > 1e-9]
    high = {(r.a, r.b) for r in correlations(df, live).where(F.abs("r") > limit).collect()} if len(live) > 1 else set()
    kept: list[str] = []
    for c in live:
        if not any((k, c) in high for k in kept):
            kept.append(c)
    return kept


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The vector over its length (plus 1e-6)."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.withColumn("norm", norm).withColumn("unit", F.transform(column, lambda x: x.cast("double") / (F.col("norm") + 1e-6)))
