"""Approximate k-nearest-neighbour join by trees of random projections.

Every band is a tree: a node splits its points at the median of their projection on a random
direction, one direction a level, so leaves hold about ``bucket_rows`` points whatever the
data look like (Dasgupta & Freund 2008). Points that share a leaf of some band are measured
exactly. Work grows with rows x bands x bucket_rows instead of the square of the rows; what
may be missed is a neighbour that no band brings together, so more bands mean more recall.

The upper levels of the trees are fitted on a sample of at most ``SAMPLE_ROWS`` points; deeper
levels are medians per leaf, computed in one aggregation a level over the leaves that are still
too large. Every point is dealt to a leaf. A query that meets fewer than k points is searched
exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.runtime import by_group, checkpointed
from .neighbors import POINT_BLOCK, QUERY_BLOCK, _block_neighbors, _stack, nearest_neighbors

BANDS = 16
BUCKET_ROWS = 512
#: Points that the upper levels are fitted on, and sampled points a leaf of them keeps.
SAMPLE_ROWS = 20_000
SAMPLE_LEAF = 64
#: Levels beyond those that even halving needs, for points that crowd on one side.
SPARE_LEVELS = 6


@dataclass
class ProjectionForest:
    """Random projection trees of one table of points (``id``, ``x``)."""

    bands: int
    bucket_rows: int
    directions: np.ndarray  # bands x levels x components
    upper: np.ndarray  # bands x nodes: thresholds by heap index
    levels: int  # of ``upper``
    splits: list[DataFrame] = field(default_factory=list)  # (band, leaf, threshold) a lower level

    @classmethod
    def fit(
        cls, points: DataFrame, n: int, bands: int = BANDS, bucket_rows: int = BUCKET_ROWS, seed: int = 42
    ) -> tuple[ProjectionForest, DataFrame]:
        """The trees, and the points' leaves (band, id, leaf)."""
        sample = _stack(
            points.orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE_ROWS).select("x").toPandas()["x"]
        )
        depth = max(0, math.ceil(math.log2(max(1, n / bucket_rows))))
        levels = min(depth, max(0, int(math.log2(max(1, len(sample) / SAMPLE_LEAF)))))
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(bands, depth + SPARE_LEVELS, sample.shape[1]))
        directions /= np.sqrt((directions**2).sum(axis=2, keepdims=True))
        upper = np.zeros((bands, 1 << levels))
        for band in range(bands):
            z = sample @ directions[band].T
            node = np.ones(len(sample), np.int64)
            for level in range(levels):
                for own in range(1 << level, 2 << level):
                    inside = z[node == own, level]
                    upper[band, own] = np.median(inside) if len(inside) else 0.0
                node = 2 * node + (z[:, level] > upper[band, node])
        forest = cls(bands, bucket_rows, directions, upper, levels)
        return forest, forest._grow(points)

    def _start(self, rows: DataFrame) -> DataFrame:
        """(band, id, leaf, z): leaves of the upper levels, and projections of the lower ones."""
        shared = rows.sparkSession.sparkContext.broadcast((self.directions, self.upper))
        levels = self.levels

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            directions, upper = shared.value
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                x = _stack(pdf["x"])
                for band in range(len(directions)):
                    z = x @ directions[band].T
                    node = np.ones(len(x), np.int64)
                    for level in range(levels):
                        node = 2 * node + (z[:, level] > upper[band, node])
                    yield pd.DataFrame(
                        {"band": np.int32(band), "id": pdf["id"], "leaf": node, "z": list(z[:, levels:])}
                    )

        return rows.select("id", "x").mapInPandas(
            place, "band int, id string, leaf long, z array<double>"
        )

    def _grow(self, points: DataFrame) -> DataFrame:
        """Split leaves that are too large, a level at a time; keeps the splits."""
        rows = checkpointed(self._start(points))
        done: list[DataFrame] = []
        for level in range(self.directions.shape[1] - self.levels):
            sizes = rows.groupBy("band", "leaf").agg(F.count(F.lit(1)).alias("n"))
            large = sizes.filter(F.col("n") > self.bucket_rows).select("band", "leaf")
            z = F.element_at("z", level + 1)
            cut = checkpointed(
                rows.join(large, ["band", "leaf"]).groupBy("band", "leaf")
                .agg(F.percentile_approx(z, 0.5).alias("threshold"), F.max(z).alias("top"))
                # A leaf whose projections are all equal can't be split in this direction.
                .filter("threshold < top").drop("top")
            )
            if cut.limit(1).count() == 0:
                break
            self.splits.append(cut.withColumn("level", F.lit(level)))
            done.append(rows.join(cut, ["band", "leaf"], "left_anti"))
            rows = checkpointed(_split(rows.join(cut, ["band", "leaf"]), level))
        for part in done:
            rows = rows.unionByName(part)
        return rows.select("band", "id", "leaf")

    def leaves(self, queries: DataFrame) -> DataFrame:
        """(band, id, leaf) of other rows in the same trees."""
        rows = self._start(queries)
        for level, cut in enumerate(self.splits):
            joined = rows.join(cut.drop("level"), ["band", "leaf"], "left")
            rows = _split(joined, level)
        return rows.select("band", "id", "leaf")


def _split(rows: DataFrame, level: int) -> DataFrame:
    """One level down for rows with a threshold; others stay. Heap indexes grow, so leaves stay apart."""
    right = (F.element_at("z", level + 1) > F.col("threshold")).cast("long")
    deeper = F.when(F.col("threshold").isNotNull(), 2 * F.col("leaf") + right)
    return rows.withColumn("leaf", F.coalesce(deeper, F.col("leaf"))).drop("threshold")


def leaf_sizes(leaves: DataFrame) -> DataFrame:
    """(band, leaf, n): the pairs measured are the sum of n squared."""
    return leaves.groupBy("band", "leaf").agg(F.count(F.lit(1)).alias("n"))


def approximate_neighbors(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    same: bool = False,
    bands: int = BANDS,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 42,
    forest: tuple[ProjectionForest, DataFrame] | None = None,
) -> DataFrame:
    """(qid, pid, dist): the k nearest points found for every query, ties by pid.

    ``queries`` and ``points`` have ``id`` (unique text) and ``x`` (array of doubles). With
    ``same`` they are one table, and a query is not its own neighbour. ``forest`` is a fitted
    forest of the points with their leaves, to be used again.
    """
    n = points.count()
    trees, own = forest or ProjectionForest.fit(points, n, bands, bucket_rows, seed)
    placed = own.join(points, "id")
    largest = leaf_sizes(own).agg(F.max("n")).first()[0] or 0
    groups = math.ceil(trees.bands * max(1, n / trees.bucket_rows))
    schema = "qid string, pid string, dist double"

    if same and largest <= POINT_BLOCK:
        def measure(rows: pd.DataFrame) -> pd.DataFrame:
            return _block_neighbors(rows, rows, k, True)

        found = by_group(placed, groups, "band", "leaf").groupBy("band", "leaf").applyInPandas(measure, schema)
    else:
        # Leaves that hold many queries, or points that can't be split, are cut into blocks.
        asked = placed if same else trees.leaves(queries).join(queries, "id")
        q_blocks = leaf_sizes(asked).select(
            "band", "leaf", F.ceil(F.col("n") / QUERY_BLOCK).alias("a_blocks")
        )
        p_blocks = leaf_sizes(own).select("band", "leaf", F.ceil(F.col("n") / POINT_BLOCK).alias("b_blocks"))
        blocks = checkpointed(q_blocks.join(p_blocks, ["band", "leaf"]))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

        def dealt(rows: DataFrame, side: str, other: str) -> DataFrame:
            return (
                rows.join(blocks, ["band", "leaf"])
                .withColumn(side, F.pmod(F.xxhash64("id"), F.col(f"{side}_blocks")))
                .withColumn("blocks", F.col(f"{other}_blocks")).withColumn(other, every)
                .select("band", "leaf", "a", "b", "id", "x")
            )

        def measure_two(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _block_neighbors(left, right, k, same)

        keys = ("band", "leaf", "a", "b")
        found = (
            by_group(dealt(asked, "a", "b"), groups, *keys).groupBy(*keys)
            .cogroup(by_group(dealt(placed, "b", "a"), groups, *keys).groupBy(*keys))
            .applyInPandas(measure_two, schema)
        )
    # At most bands x k rows a query.
    best = checkpointed(
        found.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("dist", "pid"))).alias("near"))
        .select("qid", F.slice("near", 1, k).alias("near"))
    )
    wanted = min(k, n - int(same))
    short = best.filter(F.size("near") < wanted).select(F.col("qid").alias("id"))
    missing = queries.join(best.select(F.col("qid").alias("id")), "id", "left_anti").select("id")
    rest = checkpointed(queries.join(short.unionByName(missing), "id", "left_semi"))
    rows = best.filter(F.size("near") >= wanted).select("qid", F.explode("near").alias("e")).select(
        "qid", F.col("e.pid").alias("pid"), F.col("e.dist").alias("dist")
    )
    if rest.limit(1).count():
        rows = rows.unionByName(nearest_neighbors(rest, points, k, same=same).select("qid", "pid", "dist"))
    return rows
