"""Metrics and the data behind evaluation charts.

Inputs are scored tables. Every result is an aggregation; curves use running
totals over score buckets instead of one global window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..functions.ordering import running_totals_desc
from ..functions.runtime import checkpointed

# Histogram bins and the number of listed importances.
MIN_BINS, MAX_BINS = 5, 30
TOP_FEATURES = 10

# A matrix is a report: with more labels than this it is refused.
MAX_LABELS = 1_000


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, n) for every pair of labels, zero counts included.

    More than ``MAX_LABELS`` different labels are an error.
    """
    counted = (
        df.groupBy(col(label).alias("actual"), col(prediction).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = counted.select(F.explode(F.array("actual", "predicted")).alias("v")).distinct()
    if found.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"'{label}' and '{prediction}' have more than {MAX_LABELS} labels")
    # One row per label pair: from here on the data is as small as the label set.
    labels = counted.select(
        F.explode(F.array("actual", "predicted")).alias("v")
    ).agg(F.sort_array(F.collect_set("v")).alias("values"))
    grid = labels.select(F.explode("values").alias("actual"), "values").select(
        "actual", F.explode("values").alias("predicted")
    )
    return grid.join(counted, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def _binary_sums(actual: Column, predicted: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    ]


def binary_metrics(
    df: DataFrame, label: str, prediction: str, positive, by: list[str] | None = None
) -> DataFrame:
    """Counts, accuracy, precision, recall and F1; empty denominators give 0."""
    sums = _binary_sums(col(label) == F.lit(positive), col(prediction) == F.lit(positive))
    counted = df.groupBy(*(by or [])).agg(*sums)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        *(by or []), "n", "tn", "fp", "fn", "tp",
        ratio(tp + tn, F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _score_groups(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """(score, pos, neg): rows merged by score, so ties count once.

    Several passes follow, so the merged scores are written once.
    """
    hit = col(label) == F.lit(positive)
    return checkpointed(
        df.filter(col(score).isNotNull() & col(label).isNotNull())
        .groupBy((col(score).cast("double") + F.lit(0.0)).alias("score"))
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )


def roc_auc(df: DataFrame, label: str, score: str, positive, buckets: int | None = None) -> DataFrame:
    """One row ``roc_auc``: chance that a positive outscores a negative, ties half.

    NULL when only one class is present.
    """
    ranked = running_totals_desc(_score_groups(df, label, score, positive), "score", ["pos"], buckets)
    wins = F.sum(
        F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / F.lit(2.0))
    )
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def roc_points(
    df: DataFrame, label: str, score: str, positive, buckets: int | None = None
) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, from the highest down.

    Empty when only one class is present.
    """
    groups = _score_groups(df, label, score, positive)
    total = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = total["p"] or 0, total["n"] or 0
    ranked = running_totals_desc(groups, "score", ["pos", "neg"], buckets)
    if p == 0 or n == 0:
        ranked = ranked.limit(0)
    return ranked.select(
        F.col("score").alias("threshold"),
        ((F.col("neg_before") + F.col("neg")) / F.lit(float(max(n, 1)))).alias("fpr"),
        ((F.col("pos_before") + F.col("pos")) / F.lit(float(max(p, 1)))).alias("tpr"),
    )


def regression_metrics(
    df: DataFrame, label: str, prediction: str, by: list[str] | None = None
) -> DataFrame:
    """RMSE, MAE and R2 in one aggregation; R2 is NULL for a constant label."""
    y, e = col(label).cast("double"), (col(label) - col(prediction)).cast("double")
    sums = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("var"),
    )
    return sums.select(
        *(by or []), "n",
        F.sqrt("mse").alias("rmse"),
        "mae",
        (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("var"))).alias("r2"),
    )


def actual_vs_predicted(df: DataFrame, label: str, prediction: str) -> tuple[DataFrame, DataFrame]:
    """The pairs, and one row with their common range."""
    pairs = df.select(col(label).alias("actual"), col(prediction).alias("predicted"))
    limits = pairs.agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
    )
    return pairs, limits


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    """(bin, low, high, n) over equal bins, the last one closed, empty bins included."""
    s = col(score).cast("double")
    row = df.agg(F.count(s).alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi")).first()
    n, lo, hi = row["n"], row["lo"], row["hi"]
    bins = min(MAX_BINS, max(MIN_BINS, math.isqrt(n)))
    if n and lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    lo, hi = (lo, hi) if n else (0.0, 1.0)
    width = (hi - lo) / bins
    place = F.least(
        F.floor((s - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1)
    )
    counted = (
        df.filter(s.isNotNull()).groupBy(place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def top_importances(importances: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The k greatest (feature, importance) rows, ties by name."""
    return importances.orderBy(F.col("importance").desc(), "feature").limit(k)
