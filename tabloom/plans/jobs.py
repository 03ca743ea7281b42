"""Composite jobs: prepare, train and evaluate, tune, score, bulk fix."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import (
    as_double,
    canonical_text,
    col,
    field_types,
    is_categorical,
    nan_to_null,
)
from ..functions.identity import with_row_identity
from ..functions.runtime import cached_for_iteration, ensure_checkpoint_dir
from ..operators.class_weights import add_balanced_weights, check_target
from ..operators.evaluate import binary_metrics, regression_metrics, roc_auc
from ..operators.fixes import FixResult, apply_quick_fixes
from ..operators.importance import model_importances, permutation_importance
from ..operators.models import isolation_forest, linear, lof, moments, one_class_svm, trees
from ..operators.preprocess import TabularPreprocessor, class_labels
from ..operators.profile import TableProfile, profile_table
from ..operators.recommend import Recommendation, recommend_fixes
from ..operators.scoring import allowed_values, output_profile, predict
from ..operators.split import split_rows
from ..operators.tuning import TuneResult, random_search
from ..sources.bundles import ModelBundle, normalize_task
from ..sources.files import path_bytes
from ..sources.readers import read_table
from ..sources.writers import append_history, history_row, write_cleaned, write_run_summary

ROW_KEY = "__row"

# Model types by task, with the settings each one takes.
MODEL_SETTINGS: dict[str, tuple[str, ...]] = {
    "classification_rf": (
        "n_estimators", "max_depth", "min_samples_leaf", "class_weight", "random_state",
    ),
    "classification_logreg": ("C", "max_iter", "class_weight", "random_state"),
    "classification_xgboost": (
        "n_estimators", "max_depth", "learning_rate", "subsample", "random_state",
    ),
    "regression_rf": ("n_estimators", "max_depth", "random_state"),
    "regression_linear": ("fit_intercept",),
    "regression_ridge": ("alpha",),
    "regression_lasso": ("alpha", "max_iter"),
    "regression_elasticnet": ("alpha", "l1_ratio", "max_iter"),
    "anomaly_isolation_forest": ("contamination", "n_estimators", "random_state"),
    "anomaly_lof": ("n_neighbors", "contamination", "search", "bands", "bucket_rows"),
    "anomaly_ocsvm": ("nu", "kernel", "gamma"),
}
MODEL_ALIASES = {"classification": "classification_rf", "regression": "regression_rf"}


def model_name(model_type: str) -> str:
    name = MODEL_ALIASES.get(model_type, model_type)
    if name not in MODEL_SETTINGS:
        raise ValueError(f"unknown model type '{model_type}', known: {sorted(MODEL_SETTINGS)}")
    return name


def task_of(model_type: str) -> str:
    return model_name(model_type).split("_")[0]


def fit_model(train: DataFrame, model_type: str, keys: list[str] | None = None, **params):
    """Fit one model on ``features`` and ``label``; unknown settings are an error."""
    name = model_name(model_type)
    unknown = sorted(set(params) - set(MODEL_SETTINGS[name]))
    if unknown:
        raise ValueError(f"unknown settings for {name}: {unknown}")
    p = {k: v for k, v in params.items() if k != "class_weight"}
    seed = int(p.pop("random_state", 42))
    if params.get("class_weight"):
        train = add_balanced_weights(train, "label")
    if name == "classification_rf":
        return trees.train_forest_classifier(train, seed=seed, **p)
    if name == "classification_logreg":
        return linear.train_logistic(train, **p)
    if name == "classification_xgboost":
        return trees.train_boosted_classifier(train, seed=seed, **p)
    if name == "regression_rf":
        return trees.train_forest_regressor(train, seed=seed, **p)
    if name == "regression_linear":
        return linear.train_linear(train, **p)
    if name == "regression_ridge":
        return linear.train_ridge(train, **p)
    if name == "regression_lasso":
        return linear.train_lasso(train, **p)
    if name == "regression_elasticnet":
        return linear.train_elasticnet(train, **p)
    if name == "anomaly_isolation_forest":
        return isolation_forest.IsolationForest(seed=seed, keys=keys, **p).fit(train)
    if name == "anomaly_lof":
        return lof.LocalOutlierFactor(**p).fit(train)
    return one_class_svm.OneClassSVM(**p).fit(train)


@dataclass
class PreparedData:
    """Split table with features, and what belongs to it."""

    train: DataFrame
    test: DataFrame
    preprocessor: object
    task: str
    target: str
    target_type: T.DataType
    labels: list[str]
    class_counts: dict
    keys: list[str]
    seed: int
    original: DataFrame
    parts: DataFrame

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()
        self.parts.unpersist()


def prepare(
    df: DataFrame,
    target: str,
    task: str,
    keys: list[str] | None = None,
    test_size: float = 0.2,
    validation_strategy: str = "stratified",
    random_state: int = 42,
    fit_on: str = "train",
    require_binary_target: bool | None = None,
    **preprocess,
) -> PreparedData:
    """Check the target, split exactly, fit the preprocessing, build features.

    ``keys`` identify a row and fix the split whatever the partitioning. The
    preprocessing is fitted on the training rows (``fit_on="all"``: on all rows).
    """
    task = normalize_task(task)
    if fit_on not in ("train", "all"):
        raise ValueError(f"fit_on must be 'train' or 'all', got {fit_on!r}")
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found in {df.columns}")
    features = preprocess.pop("features", None) or [c for c in df.columns if c != target]
    binary = task != "regression" if require_binary_target is None else require_binary_target
    counts = check_target(df, target, binary)
    base = nan_to_null(df).filter(col(target).isNotNull())
    if not keys:
        base = with_row_identity(base, ROW_KEY)
        keys = [ROW_KEY]

    dtype = field_types(df)[target]
    labels = class_labels(base, target) if task != "regression" else []
    if task == "regression":
        label = as_double(col(target), dtype)
    else:
        text = canonical_text(target, dtype)
        label = F.lit(None).cast("double")
        for i, value in enumerate(labels):
            label = F.when(text == F.lit(value), F.lit(float(i))).otherwise(label)

    stratify = target if task != "regression" and validation_strategy == "stratified" else None
    # Fitting takes many passes: the split is computed once, for the columns that are used.
    needed = list(dict.fromkeys([*features, target, *keys]))
    parts = split_rows(base.select(*[col(c) for c in needed]), test_size, random_state, keys, stratify)
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    train_rows, test_rows = (parts.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    estimator = TabularPreprocessor(
        target=target, features=features, keys=keys, task=task,
        random_state=random_state, **preprocess,
    )
    if fit_on == "train":
        fitted = estimator.fit(train_rows)
        train = fitted.transform_training(train_rows)
        test = fitted.transform(test_rows)
    else:
        fitted = estimator.fit(parts.drop("split"))
        whole = fitted.transform_training(parts)
        train, test = (whole.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    columns = list(dict.fromkeys(["features", "label", *keys]))
    train = cached_for_iteration(
        train.withColumn("label", label).select(*[col(c) for c in columns])
    )
    # Scored once per model; kept when the first model reads it.
    test = test.withColumn("label", label).persist(StorageLevel.MEMORY_AND_DISK)
    return PreparedData(
        train, test, fitted, task, target, dtype, labels, counts, keys, random_state, df,
        parts,
    )


def evaluate_model(prepared: PreparedData, model) -> tuple[DataFrame, dict]:
    """Scored test rows and their metrics."""
    scored = model.transform(prepared.test)
    if prepared.task == "regression":
        row = regression_metrics(scored, "label", "prediction").first()
        return scored, {k: row[k] for k in ("rmse", "mae", "r2")}
    if prepared.task == "anomaly":
        score = F.col("anomaly_score")
    else:
        score = vector_to_array("probability")[1]
    narrow = scored.select("label", "prediction", score.alias("score"))
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    row = binary_metrics(narrow, "label", "prediction", 1.0).first().asDict()
    row["roc_auc"] = roc_auc(narrow, "label", "score", 1.0).first()["roc_auc"]
    narrow.unpersist()
    row.pop("n")
    return scored, row


@dataclass
class TrainResult:
    bundle: ModelBundle
    metrics: dict
    predictions: DataFrame
    prepared: PreparedData

    def metrics_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, None if v is None else float(v)) for k, v in self.metrics.items()]
        return spark.createDataFrame(rows, "metric string, value double")

    def importances(self, spark: SparkSession) -> DataFrame | None:
        return model_importances(
            spark, self.bundle.model, self.bundle.preprocessor.feature_names
        )

    def permutation_importances(self, repeats: int = 10) -> DataFrame:
        p = self.prepared
        return permutation_importance(
            self.bundle.model, p.test, p.task,
            feature_names=self.bundle.preprocessor.feature_names,
            repeats=repeats, keys=p.keys,
        )


def train_tabular(
    df: DataFrame,
    target: str,
    model_type: str,
    model_params: dict | None = None,
    normal_only: bool = False,
    **prepare_settings,
) -> TrainResult:
    """Split, preprocess, train, evaluate.

    With ``normal_only`` an anomaly model is fitted on the training rows of the first
    label only; all test rows are judged.
    """
    if normal_only and task_of(model_type) != "anomaly":
        raise ValueError("normal_only is for anomaly models")
    prepared = prepare(df, target, task_of(model_type), **prepare_settings)
    try:
        train = prepared.train.filter("label = 0.0") if normal_only else prepared.train
        model = fit_model(train, model_type, prepared.keys, **(model_params or {}))
        # Test rows are read once, from the kept split.
        prepared.train.unpersist()
        prepared.test.unpersist()
        predictions, metrics = evaluate_model(prepared, model)
    finally:
        prepared.release()
    return TrainResult(
        make_bundle(prepared, model, model_type, metrics), metrics, predictions, prepared
    )


def make_bundle(prepared: PreparedData, model, model_type: str, metrics: dict) -> ModelBundle:
    pre = prepared.preprocessor
    schema = pre.raw_schema
    listed = [f.name for f in schema.fields if is_categorical(f.dataType)]
    allowed: dict[str, list[str]] = {}
    if listed:
        rows = allowed_values(prepared.original, listed).orderBy("column", "rank").collect()
        for r in rows:
            allowed.setdefault(r["column"], []).append(r["value"])
    labels = prepared.labels
    meta = {
        "task": prepared.task,
        "model_type": model_name(model_type),
        "target": prepared.target,
        "target_type": prepared.target_type.simpleString(),
        "feature_columns": schema.fieldNames(),
        "feature_dtypes": {f.name: f.dataType.simpleString() for f in schema.fields},
        "feature_allowed_values": allowed,
        "class_labels": labels,
        "positive_label": labels[1] if len(labels) == 2 else None,
        "preprocess": pre.state["config"],
        "metrics": metrics,
        "random_seed": prepared.seed,
        "class_counts": {str(k): v for k, v in prepared.class_counts.items()},
        "date": datetime.now(timezone.utc).isoformat(),
    }
    return ModelBundle(pre, model, meta)


def score(
    bundle: ModelBundle, df: DataFrame, profile: str = "detailed", on_null: str = "error"
) -> DataFrame:
    """Score a table; same rows as the input, none dropped."""
    meta = bundle.meta
    scored = predict(
        df,
        bundle.preprocessor,
        bundle.model,
        normalize_task(meta.get("task")),
        labels=meta.get("class_labels"),
        label_type=T._parse_datatype_string(meta["target_type"]) if meta.get("target_type") else None,
        positive_label=meta.get("positive_label"),
        on_null=on_null,
    )
    return output_profile(scored, normalize_task(meta.get("task")), profile)


@dataclass
class Preparation:
    profile: TableProfile
    recommendation: Recommendation
    fixed: FixResult
    preprocess: dict = field(default_factory=dict)


def auto_prepare(
    df: DataFrame,
    target: str | None = None,
    date_extract: bool = True,
    text_extract: bool = True,
    rare_grouping: bool = True,
) -> Preparation:
    """Profile, recommend, fix; each recommended feature step can be turned off."""
    profile = profile_table(df, target)
    rec = recommend_fixes(profile)
    fixed = apply_quick_fixes(
        df, target, rec.drop_constant_columns, rec.drop_duplicate_rows, rec.missing_strategy,
        profile.suspects,
    )
    wanted = dict(rec.preprocess_params)
    if not date_extract:
        wanted.pop("date_extract", None)
    if not text_extract:
        for name in ("text_extract", "text_feature_columns", "text_drop_original"):
            wanted.pop(name, None)
    if not rare_grouping:
        wanted.pop("rare_category_min_freq", None)
    return Preparation(profile, rec, fixed, wanted)


def tune(
    df: DataFrame,
    target: str,
    model_type: str,
    n_trials: int = 10,
    max_minutes: float = 0,
    random_state: int = 42,
    parallelism: int = 1,
    model_params: dict | None = None,
    shared_moments: bool = True,
    **prepare_settings,
) -> tuple[TrainResult, TuneResult]:
    """Random search on one prepared table; returns the best model and the search.

    Least-squares models of up to ``moments.MAX_FEATURES`` features are searched on moments
    that one pass computes, and only the baseline and the best settings are fitted and
    evaluated by jobs of their own. ``shared_moments=False`` fits every trial.
    """
    spark = df.sparkSession
    name = model_name(model_type)
    prepared = prepare(
        df, target, task_of(model_type), random_state=random_state, **prepare_settings
    )
    fixed = dict(model_params or {})

    def fit(params: dict):
        model = fit_model(prepared.train, model_type, prepared.keys, **{**fixed, **params})
        return model, evaluate_model(prepared, model)[1]

    shared = shared_moments and name in moments.SOLVABLE and (
        len(prepared.preprocessor.feature_names) <= moments.MAX_FEATURES
    )
    try:
        if shared:
            known = moments.moments(
                prepared.train.select("features", "label", F.lit("train").alias("part")).unionByName(
                    prepared.test.select("features", "label", F.lit("test").alias("part"))
                ),
                F.col("part"),
            )

            def solved(params: dict):
                found = moments.solve(name, known["train"], {**fixed, **params})
                return None, moments.fit_metrics(known["test"], *found)

            search = solved
        else:
            search = fit
        found = random_search(
            search, name, prepared.task, n_trials, max_minutes, random_state, parallelism,
            lambda model: model_bytes(spark, model),
        )
        if shared:
            found.refit(fit, lambda model: model_bytes(spark, model))
        predictions, metrics = evaluate_model(prepared, found.best.model)
    finally:
        prepared.release()
    bundle = make_bundle(prepared, found.best.model, model_type, metrics)
    return TrainResult(bundle, metrics, predictions, prepared), found


def model_bytes(spark: SparkSession, model) -> int | None:
    """Size of the saved model."""
    if model is None:
        return None
    path = f"{ensure_checkpoint_dir(spark)}/model-size/{model.uid}"
    model.write().overwrite().save(path)
    return path_bytes(spark, path)


def record_run(
    spark: SparkSession, result: TrainResult, pipeline: str, folder: str, run_id: str | None = None
) -> str:
    """Append the run to the history and write its summary."""
    meta = result.bundle.meta
    now = datetime.now(timezone.utc)
    append_history(
        spark, f"{folder}/history", history_row(pipeline, meta["task"], result.metrics, now)
    )
    return write_run_summary(
        spark,
        f"{folder}/summaries",
        {
            "run_id": run_id or now.strftime("%Y%m%dT%H%M%S%fZ"),
            "timestamp": now.isoformat(),
            "pipeline_name": pipeline,
            "random_seed": meta["random_seed"],
            "metrics": {} if meta["task"] == "anomaly" else result.metrics,
            "anomaly_metrics": result.metrics if meta["task"] == "anomaly" else {},
            "feature_columns": meta["feature_columns"],
            "target_column": meta["target"],
            "target_class_counts": meta["class_counts"],
        },
    )


def bulk_fix(
    spark: SparkSession, sources: dict[str, str], out_folder: str, fmt: str = "csv"
) -> DataFrame:
    """Profile, fix and write every table; a failing source is reported, not raised.

    Returns one row per source: (name, cleaned, actions as JSON, error).
    """
    rows = []
    for name, source in sources.items():
        try:
            df = read_table(spark, source, fmt)
            done = auto_prepare(df)
            path = write_cleaned(done.fixed.df, out_folder, f"{name}_{source}", fmt)
            rows.append((name, path, json.dumps(done.fixed.actions), None))
        except Exception as exc:
            rows.append((name, None, None, str(exc).splitlines()[0]))
    report = spark.createDataFrame(
        rows, "name string, cleaned string, actions string, error string"
    )
    report.coalesce(1).write.mode("overwrite").json(f"{out_folder}/report")
    return report
