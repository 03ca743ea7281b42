"""Linear models with the penalty scales of the usual single-machine library.

Spark divides its objective by the number of rows (or by the sum of weights)
and, for least squares, works on a label scaled by its standard deviation. The
formulas below translate ``C``, ``alpha`` and ``l1_ratio`` exactly.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, LABEL, WEIGHT = "features", "label", "weight"
# Beyond this many features Spark's normal-equation solver is not available.
NORMAL_SOLVER_FEATURES = 4096


def train_logistic(
    train: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-9
):
    """L2-penalised logistic regression; uses the ``weight`` column when present."""
    weighted = WEIGHT in train.columns
    total = train.agg(F.sum(F.col(WEIGHT)) if weighted else F.count(F.lit(1))).first()[0]
    estimator = LogisticRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        regParam=1.0 / (C * float(total)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
        family="binomial",
    )
    if weighted:
        estimator.setWeightCol(WEIGHT)
    return estimator.fit(train)


def train_linear(train: DataFrame, fit_intercept: bool = True):
    return _least_squares(train, 0.0, 0.0, fit_intercept=fit_intercept)


def train_ridge(train: DataFrame, alpha: float = 1.0):
    n, spread, normal = _label_scale(train)
    return _least_squares(train, alpha * spread / n, 0.0, normal=normal)


def train_lasso(train: DataFrame, alpha: float = 1.0, max_iter: int = 10_000):
    return _least_squares(train, alpha, 1.0, max_iter=max_iter)


def train_elasticnet(
    train: DataFrame, alpha: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 10_000
):
    _, spread, normal = _label_scale(train)
    reg = alpha * (l1_ratio + (1.0 - l1_ratio) * spread)
    mix = alpha * l1_ratio / reg if reg else 0.0
    return _least_squares(train, reg, mix, max_iter=max_iter, normal=normal)


def _label_scale(train: DataFrame) -> tuple[int, float, bool]:
    """Rows, the label spread Spark's solver will divide by, and which solver that is."""
    width = len(train.select(FEATURES).first()[0])
    normal = width <= NORMAL_SOLVER_FEATURES
    deviation = F.stddev_pop(LABEL) if normal else F.stddev_samp(LABEL)
    row = train.agg(F.count(F.lit(1)).alias("n"), deviation.alias("s")).first()
    return row["n"], float(row["s"] or 0.0), normal


def _least_squares(
    train: DataFrame,
    reg: float,
    mix: float,
    max_iter: int = 10_000,
    fit_intercept: bool = True,
    normal: bool | None = None,
):
    solver = "auto" if normal is None else ("normal" if normal else "l-bfgs")
    return LinearRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        regParam=reg,
        elasticNetParam=mix,
        standardization=False,
        fitIntercept=fit_intercept,
        maxIter=max_iter,
        tol=1e-10,
        solver=solver,
    ).fit(train)
