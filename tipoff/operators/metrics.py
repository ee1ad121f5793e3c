"""Exact quantiles and score metrics without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.operators.scale import rank_cut, running
from tipoff.session import staged

# Fixed value: probabilities are kept this far from 0 and 1 in the log loss.
PROBABILITY_FLOOR = 2.220446049250313e-16


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Interpolating quantiles per group, one row per (group, ``q``).

    The two neighbours of each rank are found by counting inside a bracket of a sketch, see
    ``rank_cut``, so cells follow the data however it is spread.
    """
    known = df.where(F.col(value).isNotNull())
    ranks = {}
    for i, p in enumerate(probs):
        ranks[f"{i}a"] = lambda n, p=p: F.floor((n - 1) * p) + 1
        ranks[f"{i}b"] = lambda n, p=p: F.ceil((n - 1) * p) + 1
    found = rank_cut(known, by, {"_value": F.col(value)}, ranks)
    q = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.expr("CAST(left(_label, length(_label) - 1) AS INT)"))
    at = F.col("q") * (F.col("_size") - 1)
    a, b = F.min("_value"), F.max("_value")
    return (
        found.withColumn("q", q)
        .groupBy(*by, "q", "_size")
        .agg(a.alias("_a"), b.alias("_b"))
        .select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias(value))
    )


def median_by(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    out = exact_quantiles(df, by, value, [0.5])
    return out.select(*by, F.col(value).cast("double").alias(name))


def median_line(df: DataFrame, by: Sequence[str], target: str, store: bool = False) -> DataFrame:
    """Line and label from the training median of each group.

    Needs ``split``. A total equal to the line is labelled 0 and settles as a push. ``store`` writes
    the medians, for rows that are read many times.
    """
    lines = median_by(df.where(F.col("split") == "train"), by, target, "line")
    if store:
        lines = staged(lines, "medians")
    return df.join(lines, list(by), "left").withColumn(
        "over_hit", (F.col(target) > F.col("line")).cast("int")
    )


def error_metrics(
    df: DataFrame, by: Sequence[str], actual: str, predicted: str, baseline: str | None = None
) -> DataFrame:
    """MAE and RMSE per group, with the baseline's MAE and the gain over it."""
    err = F.col(actual) - F.col(predicted)
    aggs = [
        F.count("*").alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
    ]
    if baseline:
        aggs.append(F.avg(F.abs(F.col(actual) - F.col(baseline))).alias("baseline_mae"))
    out = df.groupBy(*by).agg(*aggs)
    return out.withColumn("delta", F.col("baseline_mae") - F.col("mae")) if baseline else out


def overall_errors(per_group: DataFrame) -> DataFrame:
    """Row-weighted means of the group metrics; the RMSE is a mean of RMSEs."""
    n = F.sum("n")
    mean = {c: F.sum(F.col(c) * F.col("n")) / n for c in ("mae", "rmse", "baseline_mae")}
    return per_group.agg(n.alias("n"), *[v.alias(c) for c, v in mean.items()]).withColumn(
        "delta", F.col("baseline_mae") - F.col("mae")
    )


def log_loss(label: Column, prob: Column) -> Column:
    p = F.least(F.greatest(prob, F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    return F.avg(-(label * F.ln(p) + (1 - label) * F.ln(1 - p)))


def classification_metrics(df: DataFrame, by: Sequence[str], label: str, prob: str) -> DataFrame:
    """Rows, log loss and ROC-AUC per group; the AUC is NULL when only one class occurs."""
    loss = df.groupBy(*by).agg(
        F.count("*").alias("n"), log_loss(F.col(label), F.col(prob)).alias("log_loss")
    )
    return loss.join(roc_auc(df, by, label, prob), list(by), "left")


def roc_auc(df: DataFrame, by: Sequence[str], label: str, prob: str) -> DataFrame:
    """Exact mid-rank AUC: rows are counted per distinct score, negatives below are a running sum.

    The running sum goes over cells of 1/4096 of the score range, so a group with many
    distinct scores is not sorted in one task.
    """
    counts = df.groupBy(*by, prob).agg(
        F.sum(label).alias("_pos"), (F.count("*") - F.sum(label)).alias("_neg")
    )
    below = running(
        counts,
        by,
        [prob],
        {"_below": ("sum", F.col("_neg"))},
        cell=F.floor(F.col(prob) * 4096),
        inclusive=False,
    )
    pairs = F.sum("_pos") * F.sum("_neg")
    won = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    return below.groupBy(*by).agg((won / F.nullif(pairs, F.lit(0))).alias("roc_auc"))


def class_balance(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Share of positives in percent and number of classes."""
    return df.groupBy(*by).agg(
        (F.avg(F.col(label).cast("double")) * 100).alias("over_rate"),
        F.count_distinct(label).alias("n_classes"),
    )
