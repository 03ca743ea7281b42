"""Model bundles: a fitted pipeline and the metadata needed to score with it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from .files import path_exists

TASKS = ("classification", "regression", "anomaly")


@dataclass
class ModelBundle:
    """``meta`` holds task, model type, target, labels, allowed values, settings, metrics."""

    preprocessor: object
    model: object
    meta: dict = field(default_factory=dict)


def normalize_task(task: str | None) -> str:
    value = (task or "classification").strip().lower()
    value = "classification" if value == "binary_classification" else value
    if value not in TASKS:
        raise ValueError(f"unsupported model task: {value}")
    return value


def save_bundle(spark: SparkSession, bundle: ModelBundle, path: str, overwrite: bool = False) -> str:
    if not overwrite and path_exists(spark, path):
        raise FileExistsError(f"'{path}' already exists")
    PipelineModel([bundle.preprocessor, bundle.model]).write().overwrite().save(f"{path}/pipeline")
    text = json.dumps(bundle.meta, default=str)
    (
        spark.createDataFrame([(text,)], "value string").coalesce(1)
        .write.mode("overwrite").text(f"{path}/meta")
    )
    return path


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    for part in ("meta", "pipeline"):
        if not path_exists(spark, f"{path}/{part}"):
            raise ValueError(f"'{path}' is not a model bundle: no {part}")
    rows = spark.read.text(f"{path}/meta").collect()
    meta = json.loads("\n".join(r["value"] for r in rows))
    meta["task"] = normalize_task(meta.get("task"))
    if not meta.get("feature_columns"):
        raise ValueError("model bundle is missing its feature schema")
    stages = PipelineModel.load(f"{path}/pipeline").stages
    return ModelBundle(stages[0], stages[1], meta)
