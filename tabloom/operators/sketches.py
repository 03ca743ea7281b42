"""Approximate column statistics from mergeable sketches, kept as a table.

``sketch_columns`` makes one row per part of a table and column: row and NULL counts, a
HyperLogLog sketch of the values and a KLL sketch of the numbers. Such rows can be
written next to the data, one batch per partition that arrives, and merged on demand over any
choice of parts: a profile of a grown table reads new data only, and no value is shuffled,
only sketches of 64 kilobytes at most for distinct values and a few for numbers.

Errors, for the default sizes: distinct counts are within ``DISTINCT_ERROR`` of the truth
(six standard errors of 2^16 registers, so that none of many columns is beyond it by chance), and the rank of a quantile is within
``RANK_ERROR`` of the wanted one (99 % of the cases). Both hold whatever the number of rows and
however many parts were merged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col, counting_key, field_types, is_numeric, nan_to_null
from ..functions.runtime import checkpointed

HLL_BITS = 16
KLL_SIZE = 2_000
#: Six standard errors of merged HyperLogLog sketches, 1.04 / sqrt(registers) each.
DISTINCT_ERROR = 6 * 1.04 / math.sqrt(2**HLL_BITS)
#: Rank error of a KLL sketch of this size, from its published fit for one quantile, doubled for safety.
RANK_ERROR = 2 * 2.296 / KLL_SIZE**0.9021

SCHEMA = (
    "part string, column string, rows long, present long, numeric boolean, "
    "low double, high double, distinct_sketch binary, number_sketch binary"
)


def sketch_columns(
    df: DataFrame, columns: list[str] | None = None, part: Column | None = None
) -> DataFrame:
    """``SCHEMA`` rows for ``columns`` of ``df``, in one pass.

    ``part`` names the part that a row belongs to (a day, a file, a source); parts are
    what can be merged, replaced or left out later. Sketches are combined on the map
    side, so a part that holds a third of all rows is a few rows in the shuffle.
    """
    df = nan_to_null(df)
    types = field_types(df)
    names = columns or df.columns
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        _, key = counting_key(c, types[c])
        number = col(c).cast("double") if is_numeric(types[c]) else F.lit(None).cast("double")
        aggregates += [
            F.count(col(c)).alias(f"n_{i}"),
            F.hll_sketch_agg(F.when(key.isNotNull(), F.xxhash64(key)), F.lit(HLL_BITS)).alias(f"d_{i}"),
            F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias(f"q_{i}"),
            F.min(number).alias(f"l_{i}"), F.max(number).alias(f"h_{i}"),
        ]
    name = F.coalesce((F.lit("") if part is None else part).cast("string"), F.lit(""))
    wide = df.withColumn("__part", name).groupBy("__part").agg(*aggregates)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"n_{i}").alias("present"),
            F.lit(is_numeric(types[c])).alias("numeric"),
            F.col(f"l_{i}").alias("low"), F.col(f"h_{i}").alias("high"),
            F.col(f"d_{i}").alias("distinct_sketch"), F.col(f"q_{i}").alias("number_sketch"),
        )
        for i, c in enumerate(names)
    ])
    return wide.select(F.col("__part").alias("part"), "rows", F.explode(rows).alias("c")).select(
        "part", "c.column", "rows", "c.present", "c.numeric", "c.low", "c.high",
        "c.distinct_sketch", "c.number_sketch",
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row per column over all given parts; the same schema without ``part``."""
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"),
        F.bool_or("numeric").alias("numeric"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("number_sketch").alias("number_sketch"),
    )


def distinct_estimate(merged: DataFrame) -> Column:
    """Distinct non-null values; never more than there are values."""
    return F.least(F.hll_sketch_estimate("distinct_sketch"), F.col("present"))


def quantile_estimate(probability: float) -> Column:
    """Value whose rank is near ``probability``, NULL for a column without numbers."""
    return F.when(
        F.kll_sketch_get_n_double("number_sketch") > 0,
        F.kll_sketch_get_quantile_double("number_sketch", F.lit(probability)),
    )


def share_outside(low: float, high: float) -> Column:
    """Share of numbers below ``low`` or above ``high``, from the ranks of the sketch."""
    # The rank counts values up to its argument; the next smaller double leaves out ``low`` itself.
    before = F.lit(math.nextafter(low, -math.inf))
    return (
        F.kll_sketch_get_rank_double("number_sketch", before)
        + 1.0 - F.kll_sketch_get_rank_double("number_sketch", F.lit(high))
    )


def column_estimates(sketches: DataFrame, iqr_factor: float = 1.5) -> DataFrame:
    """(column, rows, present, n_distinct, distinct_ratio, low, q1, median, q3, high, outlier_ratio).

    One row per column. Ranks are asked for by literals, so the quartiles pass through the
    driver, one row per column as well.
    """
    merged = checkpointed(merge_sketches(sketches))
    measured = merged.select(
        "column", "rows", "present", distinct_estimate(merged).alias("n_distinct"), "low",
        quantile_estimate(0.25).alias("q1"), quantile_estimate(0.5).alias("median"),
        quantile_estimate(0.75).alias("q3"), "high", "number_sketch",
    )
    # Without spread between the quartiles there is no rule for outliers.
    outside = F.when(F.col("q1").isNotNull(), F.lit(0.0))
    for r in measured.filter("q3 > q1").select("column", "q1", "q3").collect():
        margin = iqr_factor * (r["q3"] - r["q1"])
        share = share_outside(r["q1"] - margin, r["q3"] + margin)
        outside = F.when(F.col("column") == r["column"], share).otherwise(outside)
    return measured.select(
        "column", "rows", "present", "n_distinct",
        F.when(F.col("present") > 0, F.col("n_distinct") / F.col("present")).otherwise(F.lit(0.0))
        .alias("distinct_ratio"),
        "low", "q1", "median", "q3", "high", outside.alias("outlier_ratio"),
    )
