"""Synthetic labelled transactions, one per id, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import col

# Share of positives and the value ranges of both classes.
POSITIVE_SHARE = 0.02
NORMAL_AMOUNT, FRAUD_AMOUNT = (0.0, 500.0), (1000.0, 10000.0)
NORMAL_SPAN, FRAUD_SPAN = 2.0, 5.0
DEFAULT_ROWS, DEFAULT_SEED = 500, 42


def uniform(seed: int, name: str, key: Column) -> Column:
    """Number in [0, 1) from the MD5 of seed, name and key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def transactions_for(ids: DataFrame, key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """V1..V4, Amount and Class for every id."""
    k = col(key)
    fraud = uniform(seed, "class", k) < F.lit(POSITIVE_SHARE)
    span = F.when(fraud, F.lit(FRAUD_SPAN)).otherwise(F.lit(NORMAL_SPAN))
    low = F.when(fraud, F.lit(FRAUD_AMOUNT[0])).otherwise(F.lit(NORMAL_AMOUNT[0]))
    high = F.when(fraud, F.lit(FRAUD_AMOUNT[1])).otherwise(F.lit(NORMAL_AMOUNT[1]))
    values = [
        F.round((uniform(seed, f"v{i}", k) * 2.0 - 1.0) * span, 4).alias(f"V{i}")
        for i in range(1, 5)
    ]
    amount = F.round(low + uniform(seed, "amount", k) * (high - low), 2).alias("Amount")
    return ids.select(k, *values, amount, fraud.cast("int").alias("Class"))


def synthetic_transactions(
    spark: SparkSession, rows: int = DEFAULT_ROWS, seed: int = DEFAULT_SEED
) -> DataFrame:
    return transactions_for(spark.range(rows), "id", seed).drop("id")
