"""Clustering around integer centroids, assigned by a tournament of bisectors.

Components become integers ``floor(scale * x)``. For each pair of centroids (i, j) the
bisector is kept as an integer normal ``2 (cj - ci)`` and the threshold ``|cj|^2 - |ci|^2``:
a vector is nearer to j if its product with the normal exceeds the threshold. A vector
starts with centroid 0 and meets 1, 2, ... in turn: k - 1 sign tests, each of which
eliminates one centroid; zero keeps the smaller number. Only the winner's distance is
computed. All arithmetic is exact: 64-bit up to ``SAFE``, beyond it on unbounded integers.

Defined results: vectors that are NULL, of another length, or that hold a NULL or
non-finite component take no part; fewer kept vectors than ``k`` make fewer centroids; an
empty table gives no rows; repeated rows get a row each; equal hashes of ids are ordered by
the vectors' components; rows of NULL id are clustered but start no centroid while there are
others; a distance beyond 64 bits is NULL, and sums of 38 digits and more are an error;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage

# Fixed by the contract of the query.
CENTROIDS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
#: Largest absolute component for 64-bit arithmetic: products with a normal stay below 2^62 at 64 components.
SAFE = 1 << 27
LONG = (1 << 63) - 1
#: Vectors tested at once.
ROWS_AT_ONCE = 4_096


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``: 64-bit integers, or Python's if one is too large."""
    if not x.size or np.abs(x).max() <= SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array(
        [[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()], dtype=object
    )


@dataclass
class Tournament:
    """Bisectors of all pairs of ``centers`` (one list of integers each)."""

    centers: list[list[int]]

    def __post_init__(self) -> None:
        c = np.array(self.centers, dtype=object)
        square = (c * c).sum(axis=1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = square[None, :] - square[:, None]
        self.exact = c
        self.small = all(abs(v) <= SAFE for center in self.centers for v in center) and c.shape[1] <= 64
        if self.small:
            self.normals64 = self.normals.astype(np.int64)
            self.thresholds64 = self.thresholds.astype(np.int64)
            self.centers64 = c.astype(np.int64)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and its squared distance."""
        if self.small and x.dtype == np.int64:
            normals, thresholds, centers = self.normals64, self.thresholds64, self.centers64
        else:
            normals, thresholds, centers = self.normals, self.thresholds, self.exact
            x = x.astype(object)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centers)):
            side = (x * normals[best, j]).sum(axis=1) - thresholds[best, j]
            best = np.where(side > 0, j, best)
        gap = x - centers[best]
        return best, (gap * gap).sum(axis=1)


def usable(rows: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """(key, v) of the rows that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    fits = F.col(vector).isNotNull() & (F.size(vector) == dimensions) & finite
    return rows.filter(fits).select(F.col(key).alias("key"), v.alias("v"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    cells = batch.column(column)
    return cells.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def first_centers(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest digest of seed and id."""
    drawn = (
        kept.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256))
        .orderBy(F.col("__h").asc_nulls_last(), "v").limit(k).select("v").collect()
    )
    return [integers(np.array([r["v"]]), scale)[0].tolist() for r in drawn]


def _sums(kept: DataFrame, centers: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and component sums of each cluster: one row per task and cluster, then per cluster."""
    width = len(centers[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centers)
        counts, totals = [0] * len(centers), [[0] * width for _ in centers]
        for whole in batches:
            for batch in slices(whole, ROWS_AT_ONCE):
                x = integers(_matrix(batch, 0), scale)
                best, _ = tournament.assign(x)
                for c in np.unique(best).tolist():
                    own = x[best == c]
                    counts[c] += len(own)
                    totals[c] = [a + int(b) for a, b in zip(totals[c], own.sum(axis=0).tolist(), strict=True)]
        found = [c for c in range(len(centers)) if counts[c]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.int32()), pa.array([counts[c] for c in found], pa.int64()),
                pa.array(
                    [[Decimal(t) for t in totals[c]] for c in found], pa.list_(pa.decimal128(38, 0))
                ),
            ],
            ["cluster", "n", "totals"],
        )

    parts = kept.select("v").mapInArrow(run, "cluster int, n long, totals array<decimal(38,0)>")
    rows = (
        parts.select("cluster", "n", F.posexplode("totals").alias("at", "total"))
        .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    ).collect()  # centroids x components rows
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        found.setdefault(r["cluster"], (r["n"], [0] * width))[1][r["at"]] = int(r["total"])
    return found


def moved(centers: list[list[int]], sums: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    """Means rounded down; a centroid without vectors stays."""
    return [
        [t // sums[c][0] for t in sums[c][1]] if c in sums else center for c, center in enumerate(centers)
    ]


def fit(
    kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE
) -> list[list[int]]:
    """Centroids after ``rounds`` of the staged rows (key, v)."""
    centers = first_centers(kept, k, seed, scale)
    for _ in range(rounds if centers else 0):
        new = moved(centers, _sums(kept, centers, scale))
        if new == centers:  # nothing moves any more
            break
        centers = new
    return centers


def assign(kept: DataFrame, centers: list[list[int]], scale: int = SCALE) -> DataFrame:
    """(key, cluster, distance) of every row (key, v)."""
    kind = kept.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centers)
        for whole in batches:
            for batch in slices(whole, ROWS_AT_ONCE):
                best, distance = tournament.assign(integers(_matrix(batch, 1), scale))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(best.tolist(), pa.int32()),
                        pa.array([d if d <= LONG else None for d in distance.tolist()], pa.int64()),
                    ],
                    ["key", "cluster", "distance"],
                )

    return kept.select("key", "v").mapInArrow(run, f"key {kind}, cluster int, distance long")


def center_digest(center: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, center)).encode("ascii")).hexdigest()


def cluster(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS,
    rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, scale: int = SCALE,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row that takes part."""
    spark: SparkSession = rows.sparkSession
    kept = stage(usable(rows, key, vector, dimensions), "bisector-vectors")
    centers = fit(kept, k, rounds, seed, scale)
    if not centers:
        centers = [[0] * dimensions]  # no row will meet it
    assigned = stage(assign(kept, centers, scale), "bisector-assigned")
    sums = {
        r["cluster"]: r["total"]
        for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }
    whole = sum(int(v or 0) for v in sums.values())

    def long(value: int) -> int | None:
        return value if value <= LONG else None

    table = spark.createDataFrame(
        [
            (c, long(int(sums.get(c) or 0)), long(whole), center_digest(center))
            for c, center in enumerate(centers)
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # One row per centroid.
    return assigned.join(F.broadcast(table), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
