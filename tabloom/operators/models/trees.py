"""Tree ensembles on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame

FEATURES, LABEL, WEIGHT = "features", "label", "weight"
# Spark's deepest tree; stands for "no depth limit".
DEEPEST = 30


def _depth(max_depth: int | None) -> int:
    if max_depth is not None and int(max_depth) > DEEPEST:
        raise ValueError(f"max_depth is {max_depth}, trees here have at most {DEEPEST} levels")
    return DEEPEST if max_depth is None else int(max_depth)


def train_forest_classifier(
    train: DataFrame,
    n_estimators: int = 100,
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    seed: int = 42,
):
    estimator = RandomForestClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL,
        numTrees=n_estimators,
        maxDepth=_depth(max_depth),
        minInstancesPerNode=min_samples_leaf,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=512,
    )
    if WEIGHT in train.columns:
        estimator.setWeightCol(WEIGHT)
    return estimator.fit(train)


def train_forest_regressor(
    train: DataFrame, n_estimators: int = 100, max_depth: int | None = None, seed: int = 42
):
    return RandomForestRegressor(
        featuresCol=FEATURES,
        labelCol=LABEL,
        numTrees=n_estimators,
        maxDepth=_depth(max_depth),
        featureSubsetStrategy="all",
        seed=seed,
        maxMemoryInMB=512,
    ).fit(train)


def train_boosted_classifier(
    train: DataFrame,
    n_estimators: int = 100,
    max_depth: int = 6,
    learning_rate: float = 0.1,
    subsample: float = 1.0,
    seed: int = 42,
):
    return GBTClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL,
        maxIter=n_estimators,
        maxDepth=_depth(max_depth),
        stepSize=learning_rate,
        subsamplingRate=subsample,
        seed=seed,
        maxMemoryInMB=512,
    ).fit(train)
