"""Least-squares models from shared moments: one pass over the data, any number of solves.

A pass gives, per group of rows (training, test, folds), the row count, the means and the
centred cross-products of features and label. They are merged pairwise without cancellation
(Chan, Golub & LeVeque 1983). Ridge, lasso, elastic-net and plain least-squares fits, and their
RMSE and R2 on any group, then are small dense problems: a search over settings costs one pass
however many trials it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features up to which moments are used: a matrix of 8 MB a task.
MAX_FEATURES = 1_000
#: Partial moments merged by one task, and rows of partial moments that may go to the driver.
MERGED_AT_ONCE = 32

SCHEMA = "grp string, n long, mean array<double>, cross array<double>"


@dataclass
class Moments:
    """Rows, means and centred cross-products of (features, label)."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, z: np.ndarray) -> Moments:
        mean = z.mean(axis=0)
        centred = z - mean
        return cls(len(z), mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n, self.mean + gap * (other.n / n),
            self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n),
        )

    @property
    def width(self) -> int:
        return len(self.mean) - 1


def _merged(rows: pd.DataFrame) -> Moments:
    total = None
    for n, mean, cross in zip(rows["n"], rows["mean"], rows["cross"], strict=True):
        size = len(mean)
        part = Moments(int(n), np.asarray(mean, float), np.asarray(cross, float).reshape(size, size))
        total = part if total is None else total.merge(part)
    return total


def _row(group: str, m: Moments) -> pd.DataFrame:
    return pd.DataFrame(
        {"grp": [group], "n": [m.n], "mean": [m.mean.tolist()], "cross": [m.cross.ravel().tolist()]}
    )


def moments(
    df: DataFrame, group: Column | None = None, features: str = "features", label: str = "label"
) -> dict[str, Moments]:
    """Moments per group (a few: training, test, folds), from one pass over ``df``."""
    rows = df.select(
        F.coalesce((F.lit("") if group is None else group).cast("string"), F.lit("")).alias("grp"),
        vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"),
    ).filter("y IS NOT NULL")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Moments] = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = np.column_stack([np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float)])
            names = pdf["grp"].to_numpy()
            for name in pd.unique(names):
                part = Moments.of(z[names == name])
                found[name] = part if name not in found else found[name].merge(part)
        for name in sorted(found):
            yield _row(name, found[name])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _row(rows["grp"].iloc[0], _merged(rows.sort_values("task")))

    parts = rows.mapInPandas(partial, SCHEMA)
    tasks = rows.rdd.getNumPartitions()
    while tasks > MERGED_AT_ONCE:
        task = F.spark_partition_id()
        parts = (
            parts.withColumn("task", task)
            .groupBy(F.floor(F.col("task") / MERGED_AT_ONCE).alias("bundle"), "grp").applyInPandas(merge, SCHEMA)
        )
        tasks = -(-tasks // MERGED_AT_ONCE)
    # At most MERGED_AT_ONCE partial results a group, or the shuffle's partitions.
    pdf = parts.toPandas()
    return {str(name): _merged(part) for name, part in pdf.groupby("grp", sort=True)}


def _parts(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    return m.cross[:-1, :-1], m.cross[:-1, -1]


def solve_ridge(m: Moments, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise squared errors plus ``alpha`` |w|^2."""
    gram, target = _parts(m)
    w = _solve(gram + alpha * np.eye(m.width), target)
    return w, float(m.mean[-1] - w @ m.mean[:-1])


def solve_linear(m: Moments, fit_intercept: bool = True) -> tuple[np.ndarray, float]:
    gram, target = _parts(m)
    if not fit_intercept:
        mean = m.mean[:-1]
        w = _solve(gram + m.n * np.outer(mean, mean), target + m.n * mean * m.mean[-1])
        return w, 0.0
    w = _solve(gram, target)
    return w, float(m.mean[-1] - w @ m.mean[:-1])


def _solve(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(gram, target)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(gram, target, rcond=None)[0]


def solve_elasticnet(
    m: Moments, alpha: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 10_000, tol: float = 1e-12
) -> tuple[np.ndarray, float]:
    """Coordinate descent on half the mean squared error plus ``alpha`` times the mixed penalty."""
    gram, target = _parts(m)
    gram, target = gram / m.n, target / m.n
    bound, ridge = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    w = np.zeros(m.width)
    left = target.copy()  # target - gram @ w
    for _ in range(max_iter):
        moved = 0.0
        for j in np.flatnonzero(gram.diagonal() > 0):
            pull = left[j] + gram[j, j] * w[j]
            new = np.sign(pull) * max(0.0, abs(pull) - bound) / (gram[j, j] + ridge)
            if new != w[j]:
                left -= gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * np.sqrt(gram[j, j]))
                w[j] = new
        if moved <= tol * max(1e-300, np.sqrt(m.cross[-1, -1] / m.n)):
            break
    return w, float(m.mean[-1] - w @ m.mean[:-1])


def solve(model_type: str, m: Moments, params: dict) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a named model with the settings of the trainers."""
    if model_type == "regression_ridge":
        return solve_ridge(m, **params)
    if model_type == "regression_linear":
        return solve_linear(m, **params)
    if model_type == "regression_lasso":
        return solve_elasticnet(m, l1_ratio=1.0, **params)
    if model_type == "regression_elasticnet":
        return solve_elasticnet(m, **params)
    raise ValueError(f"{model_type} can't be solved from moments")


SOLVABLE = ("regression_ridge", "regression_linear", "regression_lasso", "regression_elasticnet")


def fit_metrics(m: Moments, w: np.ndarray, intercept: float) -> dict[str, float | None]:
    """RMSE and R2 of a linear model on the rows behind ``m``; R2 is None for a constant label."""
    gram, target = _parts(m)
    bias = m.mean[-1] - w @ m.mean[:-1] - intercept
    errors = max(0.0, m.n * bias**2 + m.cross[-1, -1] - 2.0 * (w @ target) + w @ gram @ w)
    spread = m.cross[-1, -1]
    return {"rmse": float(np.sqrt(errors / m.n)), "r2": float(1.0 - errors / spread) if spread > 0 else None}
