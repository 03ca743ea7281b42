"""One-class SVM in the primal, on random features.

The exact kernel solution needs all pairs of rows. Here the kernel is the inner
product of ``n_components`` random features, the same way at every table size:
Fourier features for rbf (Rahimi and Recht 2007), Maclaurin features for poly (Kar
and Karnick 2012), the columns themselves for linear. The sigmoid kernel is not
positive definite and has no such features; it is taken on ``n_components`` rows
drawn by a hash of their values (Nystroem, Williams and Seeger 2001). The weights solve

    min  |w|^2 / 2 - rho + sum_i max(0, rho - f(x_i)) / (nu * n)

over all rows with L-BFGS, on a hinge smoothed by a tenth and then a hundredth of the
scale, to a relative gradient of 1e-3 or ``max_iter`` steps each. An evaluation is one
pass that returns a summed vector. At the end ``rho`` is the exact nu-quantile of the
training scores, so a share ``nu`` of them is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.quantiles import exact_quantiles
from ...functions.runtime import cached_for_iteration
from ..persistence import FittedStage
from .common import anomaly_columns

# Degree of the polynomial kernel; its offset and that of the
# sigmoid kernel are 0.
POLY_DEGREE = 3
KERNELS = ("rbf", "linear", "poly", "sigmoid")
COMPONENTS = 1_000
SMOOTHING = (0.1, 0.01)
HISTORY = 20
#: Step lengths of a line search, all evaluated in one pass.
STEPS = (1.0, 0.5, 0.25, 0.125, 1 / 16, 1 / 64, 1 / 512, 1e-4, 1e-6)
SUM_GROUPS = 64
#: Rows whose random features are held at once, whatever the size of an Arrow batch.
CHUNK_ROWS = 512
# Eigenvalues below this share of the greatest one carry no information.
RANK_TOLERANCE = 1e-10


def directions(kernel: str, gamma: float, width: int, count: int, seed: int) -> list[np.ndarray]:
    """What the random features of a kernel are made of."""
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    if kernel == "rbf":
        turns = rng.normal(scale=np.sqrt(2.0 * gamma), size=(width, count))
        return [turns, rng.uniform(0.0, 2.0 * np.pi, count)]
    if kernel == "poly":
        return [rng.choice([-1.0, 1.0], size=(width, count)) for _ in range(POLY_DEGREE)]
    return []


def feature_values(x: np.ndarray, parts: list[np.ndarray], kernel: str, gamma: float):
    """Random features of rows; for sigmoid the kernel of rows and landmarks."""
    if kernel == "rbf":
        return np.sqrt(2.0 / parts[0].shape[1]) * np.cos(x @ parts[0] + parts[1])
    if kernel == "poly":
        scale = gamma ** (POLY_DEGREE / 2.0) / np.sqrt(parts[0].shape[1])
        return scale * np.prod([x @ p for p in parts], axis=0)
    if kernel == "sigmoid":
        return np.tanh(gamma * (x @ parts[0].T))
    return x


def whitening(marks: np.ndarray, gamma: float) -> np.ndarray:
    """K^(-1/2) of the landmarks: turns kernel values into orthonormal features."""
    k = feature_values(marks, [marks], "sigmoid", gamma)
    values, vectors = np.linalg.eigh((k + k.T) / 2.0)
    kept = values > RANK_TOLERANCE * values.max()
    return vectors[:, kept] / np.sqrt(values[kept])


class OneClassSVM(Estimator):
    """``gamma`` is a number, "auto" (1/#features) or "scale" (1/(#features * variance))."""

    def __init__(
        self,
        nu: float = 0.05,
        kernel: str = "rbf",
        gamma: float | str = "auto",
        n_components: int = COMPONENTS,
        max_iter: int = 40,
        seed: int = 42,
    ):
        super().__init__()
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}, got {kernel!r}")
        if not 0.0 < nu <= 1.0:
            raise ValueError(f"nu must be in (0, 1], got {nu}")
        self.nu, self.kernel, self.gamma = nu, kernel, gamma
        self.n_components, self.max_iter, self.seed = n_components, max_iter, seed

    def _fit(self, dataset: DataFrame) -> "OneClassSVMModel":
        rows = cached_for_iteration(dataset.select(vector_to_array("features").alias("x")))
        try:
            n = rows.count()
            if n == 0:
                raise ValueError("one-class SVM needs at least 1 row")
            width = len(rows.first()["x"])
            gamma = self._gamma(rows, n, width)
            parts, basis = directions(self.kernel, gamma, width, self.n_components, self.seed), None
            marks = None
            if self.kernel == "sigmoid":
                marks = self._landmarks(rows)
                parts, basis = [marks], whitening(marks, gamma)
            size = len(feature_values(np.zeros((1, width)), parts, self.kernel, gamma)[0])
            weights = _solve(rows, n, self.nu, self.kernel, gamma, parts, basis, size, self.max_iter)
            spark = dataset.sparkSession
            tables = {}
            if marks is not None:
                tables["landmarks"] = spark.createDataFrame(
                    [(i, v.tolist()) for i, v in enumerate(marks)], "i int, x array<double>"
                )
            model = OneClassSVMModel(
                {"kernel": self.kernel, "gamma": gamma, "rho": 0.0, "width": width,
                 "n_components": self.n_components, "seed": self.seed,
                 "weights": [float(v) for v in weights]},
                tables,
            )
            scored = rows.select(model.margin(rows, F.col("x")).alias("m"))
            scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
            cut = exact_quantiles(scored, ["m"], [self.nu], counts={"m": n})["m"][0]
            model.state["rho"] = cut
            scored.unpersist()
            return model
        finally:
            rows.unpersist()

    def _landmarks(self, rows: DataFrame) -> np.ndarray:
        """Rows with the smallest hashes of their values, on any partitioning the same."""
        draw = F.xxhash64(F.lit(self.seed), "x")
        drawn = rows.distinct().withColumn("u", draw).orderBy("u").limit(self.n_components).collect()
        return np.array([r["x"] for r in drawn], dtype=float)

    def _gamma(self, rows: DataFrame, n: int, width: int) -> float:
        if self.gamma == "auto":
            return 1.0 / width
        if self.gamma == "scale":
            flat = rows.select(
                F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"),
                F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("q"),
            ).agg(F.sum("s").alias("s"), F.sum("q").alias("q")).first()
            cells = n * width
            variance = flat["q"] / cells - (flat["s"] / cells) ** 2
            return 1.0 / (width * variance) if variance > 0 else 1.0
        return float(self.gamma)


class OneClassSVMModel(FittedStage):
    def margin(self, dataset: DataFrame, x):
        s = self.state
        kernel, gamma = s["kernel"], s["gamma"]
        parts = directions(kernel, gamma, s["width"], s["n_components"], s["seed"])
        if "landmarks" in self.tables:
            stored = self.tables["landmarks"].orderBy("i").collect()
            parts = [np.array([r["x"] for r in stored], dtype=float)]
        shared = dataset.sparkSession.sparkContext.broadcast((parts, np.array(s["weights"])))

        @F.pandas_udf("double")
        def value(v: pd.Series) -> pd.Series:
            if len(v) == 0:
                return pd.Series([], dtype=float)
            parts, weights = shared.value
            found = [feature_values(x, parts, kernel, gamma) @ weights for x in _chunks(v)]
            return pd.Series(np.concatenate(found))

        return value(x)

    def score(self, dataset: DataFrame) -> DataFrame:
        """Add ``raw_score``: the negative decision value, greater for outliers."""
        return dataset.withColumn("raw_score", -self.margin(dataset, vector_to_array("features")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return anomaly_columns(self.score(dataset), -self.state["rho"])


def _chunks(vectors: pd.Series) -> Iterator[np.ndarray]:
    """Rows of a batch as matrices of at most ``CHUNK_ROWS`` rows."""
    for at in range(0, len(vectors), CHUNK_ROWS):
        yield np.stack(vectors.iloc[at:at + CHUNK_ROWS].to_numpy()).astype(float)


def _summed(rows: DataFrame, size: int, function) -> np.ndarray:
    """Sum of ``function(x)`` over a few rows at a time, added up inside Spark."""

    def partial(batches):
        total = np.zeros(size)
        for pdf in batches:
            for x in _chunks(pdf["x"]):
                total += function(x)
        yield pd.DataFrame({"v": [total]})

    parts = rows.mapInPandas(partial, "v array<double>")
    # Two levels, so that no task adds up one vector per partition of a big table.
    half = parts.groupBy((F.spark_partition_id() % SUM_GROUPS).alias("g")).agg(
        Summarizer.sum(array_to_vector("v")).alias("v")
    )
    row = half.select(Summarizer.sum(F.col("v")).alias("t")).first()
    return row["t"].toArray()


def _solve(rows, n, nu, kernel, gamma, parts, basis, size, max_iter) -> np.ndarray:
    """Weights of the feature values.

    The search runs in the whitened space, where |w| is the plain norm; tasks
    only see kernel values, so a row costs one kernel row and two products.
    """
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def outward(w: np.ndarray) -> np.ndarray:
        return w if basis is None else basis @ w

    def inward(g: np.ndarray) -> np.ndarray:
        return g if basis is None else g @ basis

    def evaluate(thetas: list[np.ndarray], delta: float) -> list[tuple[float, np.ndarray]]:
        """Values and gradients at several points: one pass, one kernel row per row of data."""
        weights = np.column_stack([outward(t[:-1]) for t in thetas])
        rhos = np.array([t[-1] for t in thetas])

        def batch(x: np.ndarray) -> np.ndarray:
            k = feature_values(x, shared.value, kernel, gamma)
            t = rhos - k @ weights
            slope = np.clip(t / delta, 0.0, 1.0)
            loss = np.where(t >= delta, t - delta / 2.0, slope * np.maximum(t, 0.0) / 2.0)
            return np.column_stack([loss.sum(axis=0), slope.sum(axis=0), slope.T @ k]).ravel()

        totals = _summed(rows, (size + 2) * len(thetas), batch).reshape(len(thetas), -1) / (nu * n)
        return [
            (
                0.5 * t[:-1] @ t[:-1] - t[-1] + total[0],
                np.concatenate([t[:-1] - inward(total[2:]), [total[1] - 1.0]]),
            )
            for t, total in zip(thetas, totals, strict=True)
        ]

    mean = _summed(
        rows, size, lambda x: feature_values(x, shared.value, kernel, gamma).sum(axis=0)
    ) / n
    w = inward(mean)
    scale = max(float(w @ w), 1e-6)
    theta = np.concatenate([w, [scale]])
    for smoothing in SMOOTHING:
        theta = _lbfgs(lambda several: evaluate(several, smoothing * scale), theta, max_iter)
    return outward(theta[:-1])


def _lbfgs(evaluate, theta: np.ndarray, max_iter: int, tol: float = 1e-3) -> np.ndarray:
    """Limited-memory BFGS for a few hundred variables; ``evaluate`` takes a list of points.

    All step lengths of a line search are evaluated at once, so an iteration is one pass
    over the data. The longest step that gains enough is taken.
    """
    value, gradient = evaluate([theta])[0]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= tol * max(1.0, np.linalg.norm(theta)):
            break
        direction = -_two_loop(gradient, pairs)
        slope = float(direction @ gradient)
        if slope >= 0:
            direction, slope, pairs = -gradient, -float(gradient @ gradient), []
        candidates = [theta + step * direction for step in STEPS]
        found = evaluate(candidates)
        chosen = next(
            (i for i, step in enumerate(STEPS) if found[i][0] <= value + 1e-4 * step * slope), len(STEPS) - 1
        )
        candidate, (new_value, new_gradient) = candidates[chosen], found[chosen]
        if new_value >= value:
            break
        s, y = candidate - theta, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = (pairs + [(s, y)])[-HISTORY:]
        done = value - new_value <= 1e-6 * max(1.0, abs(value))
        theta, value, gradient = candidate, new_value, new_gradient
        if done:
            break
    return theta


def _two_loop(gradient: np.ndarray, pairs) -> np.ndarray:
    q = gradient.copy()
    scales = []
    for s, y in reversed(pairs):
        a = (s @ q) / (y @ s)
        q -= a * y
        scales.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(scales)):
        q += s * (a - (y @ q) / (y @ s))
    return q
