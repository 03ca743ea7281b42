"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, padded to ``CODE_BITS`` and turned by a random rotation; the code
is the sign of each coordinate. With o the unit residual of a vector, x its code as a
unit vector and q that of a query, <x, q> / <x, o> estimates <o, q>, and the error is
at most EPSILON * sqrt((1 - <x,o>^2) / <x,o>^2 / (bits - 1)) with high probability. A
code is packed bits with two correction scalars: the residual's length and <x, o>.

Slices of vectors of one length meet blocks of queries of that length. A slice is centred
and encoded in its task. For each query the codes give lower and upper distance bounds; the
vectors whose lower bound isn't above the k-th smallest upper bound are reranked by exact
distances on the spot, and only the k best of a slice leave it.

Defined results: vectors that are NULL, zero or hold NULL or non-finite components
take no part; a query meets vectors of its own length only; rows with the same id are
vectors of their own, but a query meets no row of its own id; NULL ids take no part; fewer
candidates than k give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_or_not, stage

CODE_BITS = 256
EPSILON = 2.4
SEED = 20
#: Vectors per slice of codes and per block of queries.
SLICE = 16_384
QUERY_BLOCK = 16_384
#: Queries of a block that are compared at once.
AT_ONCE = 64


def rotation(size: int, bits: int = CODE_BITS, seed: int = SEED) -> np.ndarray:
    """``size`` orthonormal rows of a random rotation of ``bits`` dimensions."""
    gauss = np.random.default_rng(seed).standard_normal((bits, bits))
    q, r = np.linalg.qr(gauss)
    return (q * np.sign(np.diag(r)))[:size]


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Packed codes, residual lengths and <x, o>."""
    residual = vectors - centre
    length = np.sqrt((residual**2).sum(1))
    turned = residual @ turn
    bits = turned >= 0
    scale = math.sqrt(turn.shape[1])
    with np.errstate(invalid="ignore", divide="ignore"):
        inner = np.abs(turned).sum(1) / (scale * length)
    return np.packbits(bits, axis=1), length, np.where(length > 0, inner, 1.0)


def bounds(codes, length, inner, queries, query_length):
    """Lower and upper distance bounds, one row per query."""
    bits = codes.shape[1] * 8
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = np.where(query_length[:, None] > 0, queries / query_length[:, None], 0.0)
    estimate = (unit.astype(np.float32) @ signs.T) / (math.sqrt(bits) * inner)
    error = EPSILON * np.sqrt(np.maximum(0.0, 1 - inner**2) / inner**2 / (bits - 1))
    base = length**2 + query_length[:, None] ** 2
    cross = 2 * length * query_length[:, None]
    low = base - cross * np.minimum(1.0, estimate + error)
    high = base - cross * np.maximum(-1.0, estimate - error)
    return low, high


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, size) with finite, nonzero vectors."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.select(
        F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")
    ).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    return good.filter(~bad & F.exists(v, lambda x: x != 0)).withColumn("size", F.size("v"))


def search(vectors, ids, queries, query_ids, k: int):
    """(query number, vector number, distance) of the k best of one slice for each query."""
    bits = max(CODE_BITS, -(-vectors.shape[1] // 8) * 8)
    turn = rotation(vectors.shape[1], bits)
    centre = vectors.mean(axis=0)
    codes, length, inner = encode(vectors, centre, turn)
    residual = queries - centre
    norms, turned = np.sqrt((residual**2).sum(1)), residual @ turn
    out = []
    for at in range(0, len(queries), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        low, high = bounds(codes, length, inner, turned[part], norms[part])
        own = ids[None, :] == query_ids[part, None]
        low[own] = high[own] = np.inf
        limit = (
            np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k
            else np.full(len(high), np.inf)
        )
        which, found = np.nonzero((low <= limit[:, None]) & ~own)
        gap = vectors[found] - queries[part][which]
        distance = np.sqrt((gap * gap).sum(1))
        order = np.lexsort((ids[found], distance, which))
        which, found, distance = which[order], found[order], distance[order]
        starts = np.searchsorted(which, np.arange(len(high)))
        best = np.arange(len(which)) - starts[which] < k
        out.append((which[best] + at, found[best], distance[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found, by Euclidean distance.

    ``queries`` has rows of ``rows``.
    """
    base = stage(usable(rows, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = stage(
        base.join(queries.select(F.col(key).alias("q")).distinct(), F.col("id") == F.col("q"), "left_semi"),
        "queries",
    )
    # One row per length of vectors.
    plan = stage(
        asked.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
        .join(base.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices")), "size"),
        "lengths",
    )
    lengths = small_or_not(plan)
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    # A slice of vectors is sent to each block of queries, and a block to each slice.
    placed = (
        base.join(lengths, "size").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")))
        .withColumn("block", each("blocks")).select("size", "slice", "block", "row", "id", "v")
    )
    sent = (
        asked.join(lengths, "size").withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")))
        .withColumn("slice", each("slices")).select("size", "slice", "block", "row", "id", "v")
    )

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_row", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, float if c == "score" else np.int64) for c in columns})
        # By row, so that a result doesn't hang on the order in which rows arrive.
        left = left.sort_values("row")
        x, y = (np.stack(side["v"].to_numpy()).astype(np.float64) for side in (left, right))
        ids, query_ids = left["id"].to_numpy(), right["id"].to_numpy()
        which, found, distance = search(x, ids, y, query_ids, k)
        values = (right["row"].to_numpy()[which], query_ids[which], ids[found], distance)
        return pd.DataFrame(dict(zip(columns, values, strict=True)))

    groups = ("size", "slice", "block")
    found = placed.groupBy(*groups).cogroup(sent.groupBy(*groups)).applyInPandas(
        scan, "query_row long, query_id long, vec_id long, score double"
    )
    # k rows per query and slice, reduced before the shuffle.
    best = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
