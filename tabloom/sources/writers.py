"""Writing tables, quality reports, run history and run summaries."""

from __future__ import annotations

import json
import posixpath
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col
from ..functions.identity import in_source_order
from ..operators.profile import TableProfile
from .files import path_exists
from .readers import CSV_OPTIONS

# Columns of the run history.
HISTORY_COLUMNS = [
    "timestamp", "pipeline_name", "accuracy", "classification_precision",
    "classification_recall", "f1", "roc_auc", "anomaly_auc", "anomaly_precision",
    "anomaly_recall", "anomaly_f1",
]
# Older column names, and the columns they fall back on.
LEGACY_COLUMNS = {
    "auc": ["roc_auc", "anomaly_auc"],
    "precision": ["classification_precision", "anomaly_precision"],
    "recall": ["classification_recall", "anomaly_recall"],
}
TEXT_COLUMNS = ("timestamp", "pipeline_name")


def stamped_name(source: str, what: str, now: datetime | None = None) -> str:
    """``<stem>_<what>_<time>``, the default name of a derived table."""
    stem = posixpath.splitext(posixpath.basename(source.rstrip("/")))[0] or "table"
    return f"{stem}_{what}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "errorifexists",
    order_by: list[str] | None = None,
) -> str:
    """Write from the executors, one file per partition; CSV with a header.

    ``order_by`` restores an order by key columns with a distributed sort.
    """
    if order_by:
        df = df.orderBy(*[col(c) for c in order_by])
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_cleaned(df: DataFrame, folder: str, source: str, fmt: str = "csv") -> str:
    return write_table(df, f"{folder}/{stamped_name(source, 'cleaned')}", fmt)


def write_predictions(
    df: DataFrame,
    folder: str,
    source: str,
    fmt: str = "csv",
    order_by: list[str] | None = None,
    source_order: bool = False,
) -> str:
    """``source_order`` restores the order of the Parquet files that the rows come from."""
    if source_order:
        df = in_source_order(df)
    name = stamped_name(source, "predictions")
    return write_table(df, f"{folder}/{name}", fmt, order_by=order_by)


def write_quality_report(
    spark: SparkSession,
    profile: TableProfile,
    path: str,
    source: str | None = None,
    target: str | None = None,
) -> str:
    """Folder with ``report`` (one JSON row) and ``columns`` (one row per column)."""
    if not isinstance(profile, TableProfile):
        raise ValueError("profile must be a TableProfile")
    payload = {
        "generated_at_utc": datetime.now(timezone.utc).isoformat(),
        "source_csv": source,
        "target_column": target if target is not None else profile.target,
        "summary": profile.summary,
        "warnings": [w.text for w in profile.warnings],
    }
    _write_json_row(spark, payload, f"{path}/report")
    profile.to_df(spark).coalesce(1).write.mode("overwrite").json(f"{path}/columns")
    return path


def _write_json_row(spark: SparkSession, payload: dict, path: str) -> None:
    text = json.dumps(payload, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def history_row(pipeline: str, task: str, metrics: dict, now: datetime | None = None) -> dict:
    """Metrics of one run under the canonical column names."""
    row = dict.fromkeys(HISTORY_COLUMNS)
    row["timestamp"] = (now or datetime.now(timezone.utc)).isoformat()
    row["pipeline_name"] = pipeline
    if task == "anomaly":
        row["anomaly_auc"] = metrics.get("roc_auc")
        for name in ("precision", "recall", "f1"):
            row[f"anomaly_{name}"] = metrics.get(name)
    elif task == "classification":
        row["accuracy"] = metrics.get("accuracy")
        row["classification_precision"] = metrics.get("precision")
        row["classification_recall"] = metrics.get("recall")
        row["f1"] = metrics.get("f1")
        row["roc_auc"] = metrics.get("roc_auc")
    return row


def align_history(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Canonical run rows under another table's columns; unknown columns become NULL."""
    out = []
    for name in columns:
        if name in runs.columns:
            out.append(col(name))
        elif name in LEGACY_COLUMNS:
            out.append(F.coalesce(*[col(c) for c in LEGACY_COLUMNS[name]]).alias(name))
        else:
            out.append(F.lit(None).cast("string").alias(name))
    return runs.select(*out)


def append_history(spark: SparkSession, path: str, row: dict, fmt: str = "csv") -> str:
    """Append one run; an existing history keeps its own columns."""
    schema = T.StructType(
        [
            T.StructField(c, T.StringType() if c in TEXT_COLUMNS else T.DoubleType())
            for c in HISTORY_COLUMNS
        ]
    )
    values = tuple(
        row.get(c) if c in TEXT_COLUMNS or row.get(c) is None else float(row[c])
        for c in HISTORY_COLUMNS
    )
    runs = spark.createDataFrame([values], schema)
    columns = HISTORY_COLUMNS
    if path_exists(spark, path):
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        columns = reader.format(fmt).load(path).columns or HISTORY_COLUMNS
    return write_table(align_history(runs, columns).coalesce(1), path, fmt, mode="append")


def write_run_summary(spark: SparkSession, folder: str, summary: dict) -> str:
    """One JSON row: run id, seed, metrics, features, target and class counts."""
    path = f"{folder}/{summary['run_id']}_{summary['pipeline_name']}"
    _write_json_row(spark, summary, path)
    return path
