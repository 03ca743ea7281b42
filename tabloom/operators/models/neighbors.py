"""Exact k-nearest-neighbour join on partitioned blocks.

Points are assigned to cells around a bounded set of pivots. The triangle
inequality gives, from one summary row set per cell, a radius beyond which no
point can be a neighbour of any query in a cell; each point is sent only to the
cells it can matter for (Lu et al. 2012). Inside a cell queries and points are
cut into blocks of bounded size, each pair of blocks is one task-sized matrix
product, and only the k best of a block leave the task. A row travels once for each
block of the other side, so blocks are as large as memory and the number of cores allow.
On large tables a few blocks of queries are searched at a time, so that the copies under way
stay bounded; each query is searched once, against all points that can matter.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.runtime import by_group, checkpointed, shuffles_dropped, staged

QUERY_BLOCK = 1_024
POINT_BLOCK = 8_192
#: Rows, numbers and pairs for a core of the blocks that all queries and points are cut into.
LARGEST_BLOCK = 32_768
BLOCK_NUMBERS = 1 << 22
PAIRS_PER_CORE = 4
#: Numbers of the copied rows that are on their way at once, unless one block of queries takes more.
NUMBERS_AT_ONCE = 1 << 29
#: Copied rows that leave a task together.
COPIES_AT_ONCE = 8_192
#: Distances of a pair of blocks, and candidates, that are held at once.
CHUNK_DISTANCES = 1 << 20
CANDIDATES = 1 << 17
#: Distances of a row whose minimum counts for all of them in the bound of its neighbours.
GROUP = 64
POINTS_PER_CELL = 20_000
MAX_CELLS = 1_024
# Widens pruning bounds by more than the rounding of a distance.
SLACK = 1e-9


def nearest_neighbors(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    same: bool = False,
    points_per_cell: int = POINTS_PER_CELL,
    query_block: int | None = None,
    point_block: int | None = None,
) -> DataFrame:
    """(qid, pid, dist): the k nearest points of every query, ties by pid.

    ``queries`` and ``points`` have the columns ``id`` (unique text) and ``x``
    (array of doubles). With ``same`` a query is not its own neighbour.
    """
    n = points.count()
    largest = _largest_block(queries, points, n)
    query_block, point_block = query_block or largest, point_block or largest
    cells = int(min(MAX_CELLS, max(1, n // points_per_cell)))
    if cells > 1:
        routed_q, route = _route(queries, points, k + int(same), n, cells)
        counted = route(None, count=True)
    else:
        routed_q = queries.select(F.lit(0).alias("cell"), "id", "x")
        counted = points.select(F.lit(0).alias("cell"))

    q_blocks = _block_counts(routed_q, query_block)
    p_blocks = _block_counts(counted, point_block)
    order = Window.partitionBy("qid").orderBy("dist", "pid")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _block_neighbors(left, right, k, same)

    def search(asked: dict[int, tuple[int, int]]) -> DataFrame:
        """Neighbours of some blocks of queries: first and last one by cell."""
        if cells > 1:
            routed_p = route(sorted(asked))
        else:
            routed_p = points.select(F.lit(0).alias("cell"), "id", "x")
        p_all = {cell: (0, max(1, p_blocks.get(cell, 0)) - 1) for cell in asked}
        q = _to_blocks(routed_q, "a", q_blocks, asked, "b", p_all)
        p = _to_blocks(routed_p, "b", p_blocks, p_all, "a", asked)
        pair = ("cell", "a", "b")
        pairs = sum((last - first + 1) * p_blocks.get(cell, 0) for cell, (first, last) in asked.items())
        candidates = (
            by_group(q, pairs, *pair).groupBy(*pair)
            .cogroup(by_group(p, pairs, *pair).groupBy(*pair))
            .applyInPandas(best, "qid string, pid string, dist double")
        )
        return (
            candidates.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .drop("rank")
        )

    rounds = _rounds(q_blocks, p_blocks, (query_block + point_block) * _width(points))
    if len(rounds) == 1:
        return search(rounds[0])
    with shuffles_dropped(points.sparkSession):
        found = [checkpointed(search(asked)) for asked in rounds]
    return reduce(DataFrame.unionAll, found)


def _rounds(q_blocks: dict[int, int], p_blocks: dict[int, int], numbers: int) -> list[dict[int, tuple[int, int]]]:
    """Blocks of queries that are searched together, as first and last one by cell.

    A block of queries meets all blocks of points of its cell; a pair of blocks moves ``numbers``.
    """
    rounds: list[dict] = [{}]
    room = NUMBERS_AT_ONCE
    for cell in sorted(q_blocks):
        cost = max(1, p_blocks.get(cell, 0)) * numbers
        for block in range(q_blocks[cell]):
            if cost > room and rounds[-1]:
                rounds.append({})
                room = NUMBERS_AT_ONCE
            first = rounds[-1].get(cell, (block,))[0]
            rounds[-1][cell] = (first, block)
            room -= cost
    return rounds


def _width(points: DataFrame) -> int:
    first = points.select(F.size("x").alias("width")).first()
    return max(1, first["width"]) if first else 1


def _largest_block(queries: DataFrame, points: DataFrame, n: int) -> int:
    """Rows of a block: few blocks, but some pairs of them for every core."""
    width = _width(points)
    cores = points.sparkSession.sparkContext.defaultParallelism
    spread = math.isqrt(queries.count() * n // (PAIRS_PER_CORE * cores))
    return max(QUERY_BLOCK, min(LARGEST_BLOCK, BLOCK_NUMBERS // width, spread))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float)


def _block_neighbors(
    left: pd.DataFrame, right: pd.DataFrame, k: int, same: bool
) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"qid": [], "pid": [], "dist": []})
    a, b = _stack(left["x"]), _stack(right["x"])
    qid, pid = left["id"].to_numpy(), right["id"].to_numpy()
    norm_a, norm_b = (a * a).sum(1), (b * b).sum(1)
    wanted = min(k + int(same), len(b))
    step = max(1, CHUNK_DISTANCES // len(b))
    found, near, held = [], [], 0
    for at in range(0, len(a), step):
        rows, cols = _candidates(a[at:at + step], b, norm_a[at:at + step], norm_b, wanted)
        near.append((rows + at, cols))
        held += len(rows)
        if held >= CANDIDATES or at + step >= len(a):
            rows, cols = (np.concatenate(part) for part in zip(*near, strict=True))
            found.append(_measured(a, b, rows, cols, qid, pid, k, same))
            near, held = [], 0
    return pd.concat(found, ignore_index=True)


def _candidates(a, b, norm_a, norm_b, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the nearest: the points within a bound of ``wanted`` of them."""
    rough = a @ b.T
    rough *= -2.0
    rough += norm_b[None, :]
    rough += norm_a[:, None]
    # The matrix product proposes; everything within its rounding error of the
    # bound is measured again from the differences.
    error = 8.0 * (a.shape[1] + 8) * np.finfo(float).eps * (norm_a + norm_b.max())
    values, groups = rough, rough.shape[1] // GROUP
    if groups >= 4 * wanted:
        # The smallest minima of groups belong to as many points, so none of the nearest lies beyond.
        values = rough[:, : groups * GROUP].reshape(len(rough), GROUP, groups).min(axis=1)
    bound = np.partition(values, wanted - 1, axis=1)[:, wanted - 1]
    return np.nonzero(rough <= (bound + 2.0 * error)[:, None])


def _measured(a, b, rows, cols, qid, pid, k: int, same: bool) -> pd.DataFrame:
    """The k nearest of the candidates of each query, by exact distances."""
    if same:
        other = qid[rows] != pid[cols]
        rows, cols = rows[other], cols[other]
    if len(rows) == 0:
        return pd.DataFrame({"qid": [], "pid": [], "dist": []})
    dist = np.empty(len(rows))
    for start in range(0, len(rows), 20_000):
        part = slice(start, start + 20_000)
        dist[part] = np.sqrt(((a[rows[part]] - b[cols[part]]) ** 2).sum(1))
    out = pd.DataFrame({"row": rows, "qid": qid[rows], "pid": pid[cols], "dist": dist})
    out = out.sort_values(["row", "dist", "pid"])
    return out[out.groupby("row").cumcount() < k][["qid", "pid", "dist"]]


def _block_counts(routed: DataFrame, size: int) -> dict[int, int]:
    """Blocks per cell of rows, or of counted rows; at most MAX_CELLS rows reach the driver."""
    n = F.sum("n") if "n" in routed.columns else F.count(F.lit(1))
    rows = routed.groupBy("cell").agg(n.alias("n")).collect()
    return {r["cell"]: -(-r["n"] // size) for r in rows}


def _to_blocks(
    routed: DataFrame, own: str, own_blocks: dict[int, int], kept: dict[int, tuple[int, int]],
    other: str, other_kept: dict[int, tuple[int, int]],
) -> DataFrame:
    """Give each row of the kept cells and blocks its block, and one copy per kept block of the other side."""

    def lookup(values: dict[int, int]):
        pairs = [F.lit(v) for cell in kept for v in (cell, values.get(cell, 1))]
        return F.element_at(F.create_map(*pairs), F.col("cell")) if pairs else F.lit(1)

    def ends(blocks: dict[int, tuple[int, int]]):
        return [lookup({cell: pair[i] for cell, pair in blocks.items()}).cast("int") for i in (0, 1)]

    return (
        routed.filter(F.col("cell").isin(*kept))
        .withColumn(own, F.pmod(F.xxhash64("id"), lookup(own_blocks).cast("long")).cast("int"))
        .filter(F.col(own).between(*ends(kept)))
        .withColumn(other, F.explode(F.sequence(*ends(other_kept))))
        .select("cell", "a", "b", "id", "x")
    )


def _route(queries: DataFrame, points: DataFrame, k: int, n: int, cells: int):
    """Queries with their cells, and a function that sends every point to all cells it can matter for.

    The function takes the cells that are asked for, all by default, and may only count the points.
    """
    spark = points.sparkSession
    sample = (
        points.orderBy(F.xxhash64("id")).limit(cells).select("x").collect()
    )
    pivots = np.array([r["x"] for r in sample], dtype=float)
    shared = spark.sparkContext.broadcast(pivots)

    def assigned(*columns: str):
        def assign(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                d = distances(_stack(pdf["x"]), shared.value)
                own = d.argmin(axis=1)
                pdf["cell"] = own.astype("int32")
                pdf["reach"] = d[np.arange(len(pdf)), own]
                yield pdf[["cell", "reach", *columns]]

        return assign

    schema = "cell int, reach double"
    routed_q = staged(queries.select("id", "x").mapInPandas(assigned("id", "x"), f"{schema}, id string, x array<double>"))
    own_p = points.select("x").mapInPandas(assigned(), schema)

    radius = np.full(cells, -1.0)
    for r in routed_q.groupBy("cell").agg(F.max("reach").alias("u")).collect():
        radius[r["cell"]] = r["u"]
    # The k points closest to each pivot bound every neighbour distance from above.
    nearest = Window.partitionBy("cell").orderBy("reach")
    close: list[list[float]] = [[] for _ in range(cells)]
    for r in (
        own_p.withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k).select("cell", "reach").collect()
    ):
        close[r["cell"]].append(r["reach"])
    between = distances(pivots, pivots)
    bound = np.full(cells, np.inf)
    for i in range(cells):
        if radius[i] < 0:
            continue
        upper = np.concatenate([between[i, j] + np.array(close[j]) for j in range(cells)])
        if len(upper) >= k:
            bound[i] = radius[i] + np.partition(upper, k - 1)[k - 1]
    limit = np.where(radius < 0, -1.0, (radius + bound) * (1.0 + SLACK) + SLACK)
    limits = spark.sparkContext.broadcast(limit)

    def route(asked: list[int] | None, count: bool = False) -> DataFrame:
        wanted = np.arange(cells) if asked is None else np.array(asked)

        def replicate(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                d = distances(_stack(pdf["x"]), shared.value[wanted])
                rows, cols = np.nonzero(d <= limits.value[None, wanted])
                # A point can go to all cells: its copies leave a few at a time.
                for at in range(0, len(rows), COPIES_AT_ONCE):
                    out = pdf[["id", "x"]].iloc[rows[at:at + COPIES_AT_ONCE]].copy()
                    out.insert(0, "cell", wanted[cols[at:at + COPIES_AT_ONCE]].astype("int32"))
                    yield out

        def tally(batches):
            n = np.zeros(cells, np.int64)
            for pdf in batches:
                if len(pdf):
                    n += (distances(_stack(pdf["x"]), shared.value) <= limits.value[None, :]).sum(axis=0)
            yield pd.DataFrame({"cell": np.flatnonzero(n).astype("int32"), "n": n[n > 0]})

        if count:
            return points.select("x").mapInPandas(tally, "cell int, n long")
        return points.select("id", "x").mapInPandas(replicate, "cell int, id string, x array<double>")

    return routed_q.select("cell", "id", "x"), route
