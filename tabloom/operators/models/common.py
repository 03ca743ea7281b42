"""Output columns shared by the anomaly models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anomaly_columns(df: DataFrame, threshold: float) -> DataFrame:
    """From ``raw_score`` add ``anomaly_score`` (> 0 is an anomaly) and ``prediction``."""
    score = F.col("raw_score") - F.lit(float(threshold))
    return df.withColumn("anomaly_score", score).withColumn(
        "prediction", F.when(score > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
