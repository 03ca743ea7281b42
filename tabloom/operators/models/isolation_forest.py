"""Isolation forest (Liu, Ting, Zhou 2008).

A tree needs 256 rows whatever the size of the table. One pass deals every row to
the trees by hashes, with the same chance for each row and tree, and the trees are
grown in parallel, one task per tree. Scoring walks all trees over
Arrow batches. The decision offset is an exact quantile of the training scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.expressions import col
from ...functions.quantiles import exact_quantiles
from ...functions.runtime import by_group, cached_for_iteration, staged
from ..persistence import FittedStage
from .common import anomaly_columns

SAMPLE_ROWS = 256
WALK_ROWS = 256
TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, depth array<double>"
)


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def depth_limit(n: int) -> int:
    return math.ceil(math.log2(max(n, 2)))


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """Random cuts until a row is alone, all rows are equal, or the depth limit."""
    nodes = {"feature": [], "threshold": [], "left": [], "right": [], "depth": []}

    def add(rows: np.ndarray, depth: int) -> int:
        index = len(nodes["feature"])
        for key, empty in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1)):
            nodes[key].append(empty)
        nodes["depth"].append(0.0)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= limit or len(varying) == 0:
            nodes["depth"][index] = depth + average_path(len(rows))
            return index
        f = int(rng.choice(varying))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = x[rows, f] <= cut
        if goes_left.all():  # the cut fell on the maximum
            cut = float(np.nextafter(high[f], low[f]))
            goes_left = x[rows, f] <= cut
        nodes["feature"][index], nodes["threshold"][index] = f, cut
        nodes["left"][index] = add(rows[goes_left], depth + 1)
        nodes["right"][index] = add(rows[~goes_left], depth + 1)
        return index

    add(np.arange(len(x)), 0)
    return nodes


def flatten_trees(trees: list, steps: int) -> dict[str, list[np.ndarray]]:
    """All trees, level by level, as full binary trees of ``steps`` levels.

    Place ``j`` of a level has its children at ``2 j`` and ``2 j + 1`` of the next one. Below
    a leaf all places are its own, so every walk takes the same number of steps.
    """
    feature, threshold = [], []
    node = np.zeros((len(trees), 1), dtype=np.intp)
    parts = [{k: np.array(t[k]) for k in ("feature", "threshold", "left", "right", "depth")} for t in trees]
    for _ in range(steps):
        f = np.stack([p["feature"][at] for p, at in zip(parts, node)])
        leaf = f < 0
        feature.append(np.where(leaf, 0, f).astype(np.intp).ravel())
        threshold.append(np.stack([p["threshold"][at] for p, at in zip(parts, node)]).ravel())
        below = [
            np.where(leaf, node, np.stack([p[side][at] for p, at in zip(parts, node)]))
            for side in ("left", "right")
        ]
        node = np.stack(below, axis=2).reshape(len(trees), -1)
    depth = np.stack([p["depth"][at] for p, at in zip(parts, node)]).ravel()
    return {"feature": feature, "threshold": threshold, "depth": [depth]}


def path_lengths(x: np.ndarray, forest: dict[str, list[np.ndarray]]) -> np.ndarray:
    """Mean depth over all trees, one value per row."""
    out = np.empty(len(x))
    trees = len(forest["feature"][0])
    roots = np.arange(trees)[None, :]
    for start in range(0, len(x), WALK_ROWS):
        part = np.ascontiguousarray(x[start:start + WALK_ROWS])
        flat = part.ravel()
        base = (np.arange(len(part)) * part.shape[1])[:, None]
        # Tree t starts at place t of the first level, so places are those of all trees.
        right = part.take(forest["feature"][0], axis=1) > forest["threshold"][0]
        place = 2 * roots + right
        cell, cut = np.empty_like(place), np.empty(place.shape)
        value = np.empty(place.shape)
        # Indexes are in range; "clip" lets numpy write to the buffers as it goes.
        for feature, threshold in zip(forest["feature"][1:], forest["threshold"][1:]):
            feature.take(place, out=cell, mode="clip")
            cell += base
            flat.take(cell, out=value, mode="clip")
            threshold.take(place, out=cut, mode="clip")
            np.greater(value, cut, out=right)
            place += place
            place += right
        out[start:start + WALK_ROWS] = forest["depth"][0].take(place, out=value, mode="clip").mean(axis=1)
    return out


class IsolationForest(Estimator):
    """``keys`` make the drawn rows independent of how the table is partitioned."""

    def __init__(
        self,
        contamination: float | str = 0.01,
        n_estimators: int = 100,
        seed: int = 42,
        keys: list[str] | None = None,
    ):
        super().__init__()
        self.contamination = contamination
        self.n_estimators = n_estimators
        self.seed = seed
        self.keys = keys

    def _fit(self, dataset: DataFrame) -> "IsolationForestModel":
        columns = ["features", *(self.keys or [])]
        rows = cached_for_iteration(dataset.select(*columns))
        try:
            return self._fit_cached(rows)
        finally:
            rows.unpersist()

    def fit_scored(self, dataset: DataFrame, keep: list[str]) -> tuple["IsolationForestModel", DataFrame]:
        """The model, and the columns ``keep`` of ``dataset`` with the columns of ``transform``.

        The threshold needs the score of every row; here each is computed once and
        written, with ``keep``, to the checkpoint folder. ``dataset`` is read three times (to
        count, draw and score); only one with fewer partitions than cores is kept and spread.
        """
        columns = list(dict.fromkeys(["features", *(self.keys or []), *keep]))
        rows = dataset.select(*[col(c) for c in columns])
        if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
            rows = cached_for_iteration(rows)
        try:
            model, n = self._grown(rows)
            scored = staged(model.score(rows).select(*[col(c) for c in keep], "raw_score"))
            if self.contamination != "auto":
                model.set_share(scored, float(self.contamination), n)
        finally:
            rows.unpersist()
        return model, anomaly_columns(scored, -model.state["offset"])

    def _fit_cached(self, dataset: DataFrame) -> "IsolationForestModel":
        model, n = self._grown(dataset)
        if self.contamination != "auto":
            scores = model.score(dataset).select("raw_score").persist(StorageLevel.MEMORY_AND_DISK)
            model.set_share(scores, float(self.contamination), n)
            scores.unpersist()
        return model

    def _grown(self, dataset: DataFrame) -> tuple["IsolationForestModel", int]:
        """A model with its trees and no threshold yet, and the number of rows."""
        n = dataset.count()
        if n < 2:
            raise ValueError("an isolation forest needs at least 2 rows")
        psi = min(SAMPLE_ROWS, n)
        trees = self._grow(dataset, n, psi).collect()
        state = {
            "psi": psi,
            "offset": -0.5,
            "trees": len(trees),
        }
        table = dataset.sparkSession.createDataFrame(trees, TREE_SCHEMA)
        return IsolationForestModel(state, {"trees": table}), n

    def _grow(self, dataset: DataFrame, n: int, psi: int) -> DataFrame:
        seed, limit = self.seed, depth_limit(psi)
        identity = F.struct(*self.keys) if self.keys else F.monotonically_increasing_id()
        rows = dataset.select(
            F.xxhash64(F.lit(seed), identity).alias("id"),
            vector_to_array("features").alias("x"),
        )
        # Twice the sample on average, so that a tree practically never falls short.
        chance = min(1.0, (2.0 * psi + 64.0) / n)
        trees = self.n_estimators
        # The trees fall into as many ranges as a row enters trees on average, one at
        # least; in each range a row enters one tree or none. A big table has one range.
        ranges = max(1, min(trees, math.ceil(chance * trees)))
        place = F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))
        first = F.floor(F.col("range") * trees / ranges)
        size = F.floor((F.col("range") + 1) * trees / ranges) - first
        drawn = (
            rows.withColumn("range", place)
            .withColumn("u", _uniform(F.xxhash64(F.lit(seed + 2), "range", "id")))
            .filter(F.col("u") < chance * size)
            .withColumn(
                "tree", (first + F.pmod(F.xxhash64(F.lit(seed + 3), "range", "id"), size)).cast("int")
            )
        )

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            chosen = pdf.sort_values(["u", "id"]).head(psi)
            x = np.array(chosen["x"].tolist(), dtype=float)
            rng = np.random.default_rng([seed & 0x7FFFFFFF, int(key[0])])
            tree = grow_tree(x, rng, limit)
            return pd.DataFrame([{"tree": int(key[0]), **tree}])

        placed = by_group(drawn, self.n_estimators, "tree")
        return placed.groupBy("tree").applyInPandas(build, TREE_SCHEMA)


class IsolationForestModel(FittedStage):
    def set_share(self, scores: DataFrame, share: float, n: int) -> None:
        """Let ``share`` of the ``n`` rows with these ``raw_score`` be anomalies."""
        cut = exact_quantiles(scores.select("raw_score"), ["raw_score"], [1.0 - share], counts={"raw_score": n})
        self.state["offset"] = -cut["raw_score"][0]

    def score(self, dataset: DataFrame) -> DataFrame:
        """Add ``raw_score`` in (0, 1): the greater, the easier a row is isolated."""
        spark = dataset.sparkSession
        trees = self.tables["trees"].orderBy("tree").collect()
        forest = spark.sparkContext.broadcast(flatten_trees(trees, depth_limit(self.state["psi"])))
        scale = average_path(self.state["psi"])

        @F.arrow_udf("double")
        def isolation(x: pa.Array) -> pa.Array:
            if len(x) == 0:
                return pa.array([], pa.float64())
            width = pc.min_max(pc.list_value_length(x)).as_py()
            if x.null_count or width["min"] != width["max"]:
                raise ValueError("features must be vectors of one length")
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width["min"])
            return pa.array(np.exp2(-path_lengths(rows, forest.value) / scale))

        return dataset.withColumn("raw_score", isolation(vector_to_array("features")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return anomaly_columns(self.score(dataset), -self.state["offset"])


def _uniform(hashed):
    """Hash spread evenly over [0, 1)."""
    return F.pmod(hashed, F.lit(1 << 40)) / F.lit(float(1 << 40))
