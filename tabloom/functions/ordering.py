"""Global order on distributed tables: running totals and dense indexes.

A window without PARTITION BY moves the whole table to one task. These helpers
cut the value range into buckets first, so that each window works inside one
bucket and only one row per bucket takes part in the global step.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .expressions import col
from .runtime import checkpointed

ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 10_000


def running_totals_desc(
    df: DataFrame, order: str, sums: list[str], buckets: int | None = None
) -> DataFrame:
    """Add ``<s>_before``: the total of ``s`` over rows with a greater ``order``.

    ``order`` is a double without NULLs and distinct per row (group first).
    """
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(1, math.ceil(df.count() / ROWS_PER_BUCKET)))
    splits: list[float] = []
    if buckets > 1:
        probabilities = [i / buckets for i in range(1, buckets)]
        splits = sorted(set(df.approxQuantile(order, probabilities, 1 / (4 * buckets))))
    if splits:
        edges = [-math.inf, *splits, math.inf]
        cut = Bucketizer(splits=edges, inputCol=order, outputCol="__b").transform(df)
    else:
        cut = df.withColumn("__b", F.lit(0.0))
    per_bucket = cut.groupBy("__b").agg(*[F.sum(col(s)).alias(f"__t_{s}") for s in sums])
    # One row per bucket, MAX_BUCKETS at the most: a bounded global window.
    above = Window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "__b",
        *[F.coalesce(F.sum(f"__t_{s}").over(above), F.lit(0)).alias(f"__o_{s}") for s in sums],
    )
    local = (
        Window.partitionBy("__b").orderBy(col(order).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.join(F.broadcast(offsets), "__b")
        .withColumns(
            {
                f"{s}_before": F.col(f"__o_{s}") + F.coalesce(F.sum(col(s)).over(local), F.lit(0))
                for s in sums
            }
        )
        .drop("__b", *[f"__o_{s}" for s in sums])
    )


def dense_index(
    table: DataFrame, group: str, value: str, limit: int = ROWS_PER_BUCKET, rows: int | None = None
) -> DataFrame:
    """Add ``idx``: 0-based position of ``value`` among the rows of its ``group``.

    ``table`` has one row per (group, value), ``rows`` in all if known. Up to ``limit`` rows one window
    per group does it; beyond that the table is range-sorted, written to the
    checkpoint folder, and numbered by partition offsets.
    """
    if rows is None:
        rows = table.limit(limit + 1).count()
    if rows <= limit:
        w = Window.partitionBy(group).orderBy(value)
        return table.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    ordered = checkpointed(
        table.orderBy(group, value).withColumn("__id", F.monotonically_increasing_id())
    ).withColumn("__p", F.shiftright("__id", 33))
    pieces = ordered.groupBy(group, "__p").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first")
    )
    # One row per group and sort partition.
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col(group).alias("__g"), F.col("__p").alias("__q"), "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
    )
    return (
        ordered.join(
            F.broadcast(offsets), (F.col(group) == F.col("__g")) & (F.col("__p") == F.col("__q"))
        )
        .withColumn("idx", F.col("__id") - F.col("__first") + F.col("__off"))
        .drop("__id", "__p", "__g", "__q", "__first", "__off")
    )
