"""Exact quantiles with linear interpolation, for tables of any size.

Small inputs use the built-in ``percentile``. That aggregate keeps every
distinct value of a column in one task, so columns of more than
``direct_cells`` values have their order statistics are found by narrowing brackets instead: a KLL sketch proposes two
pivots around the wanted rank, one counting pass finds on which side the rank
lies, and the bracket shrinks to about a five-hundredth. The sketch only
proposes; every decision rests on exact counts, so the result is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import as_double, col, field_types

DIRECT_CELLS = 5_000_000
COLLECT_ROWS = 100_000
SKETCH_K = 20_000
SKETCH_MARGIN = 0.001
SKETCH_GROUPS = 64


@dataclass
class _Bracket:
    """Open interval of values known to hold the order statistic ``rank``."""

    column: str
    rank: int
    rows: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self, x: Column) -> Column:
        cond = x.isNotNull()
        if self.low is not None:
            cond = cond & (x > F.lit(self.low))
        if self.high is not None:
            cond = cond & (x < F.lit(self.high))
        return cond


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    counts: dict[str, int] | None = None,
    direct_cells: int = DIRECT_CELLS,
    collect_rows: int = COLLECT_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles per column over its non-null values; ``None`` for empty columns.

    ``counts`` are the non-null counts when the caller already has them.
    """
    if not columns:
        return {}
    types = field_types(df)
    values = df.select(*[as_double(col(c), types[c]).alias(c) for c in columns])
    if counts is None:
        row = values.agg(*[F.count(col(c)).alias(c) for c in columns]).first()
        counts = row.asDict()
    result: dict[str, list[float | None]] = {}
    for group in _direct_groups([c for c in columns if counts[c] <= direct_cells], counts, direct_cells):
        row = values.agg(
            *[F.percentile(col(c), F.lit(probabilities)).alias(c) for c in group]
        ).first()
        for c in group:
            result[c] = (
                [None] * len(probabilities) if row[c] is None else [float(v) for v in row[c]]
            )
    columns = [c for c in columns if c not in result]
    if not columns:
        return result

    wanted = {
        (c, p): _rank_pair(counts[c], p)
        for c in columns
        for p in probabilities
    }
    brackets = {
        (c, r): _Bracket(c, r, counts[c])
        for (c, _), (lo, hi, _) in wanted.items()
        for r in {lo, hi}
    }
    _resolve(values, list(brackets.values()), collect_rows)

    for c in columns:
        out: list[float | None] = []
        for p in probabilities:
            lo, hi, frac = wanted[(c, p)]
            a, b = brackets[(c, lo)].value, brackets[(c, hi)].value
            out.append(a if frac == 0.0 else a * (1.0 - frac) + b * frac)
        result[c] = out
    return result


def medians(df: DataFrame, columns: list[str], **kwargs) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5], **kwargs).items()}


def _direct_groups(
    columns: list[str], counts: dict[str, int], cells: int
) -> list[list[str]]:
    """Columns in groups whose values together stay within ``cells``."""
    groups: list[list[str]] = []
    room = -1
    for c in columns:
        if counts[c] > room:
            groups.append([])
            room = cells
        groups[-1].append(c)
        room -= counts[c]
    return groups


def _rank_pair(n: int, p: float) -> tuple[int, int, float]:
    position = (n - 1) * p
    low = math.floor(position)
    return low, math.ceil(position), position - low


def _resolve(values: DataFrame, brackets: list[_Bracket], collect_rows: int) -> None:
    while True:
        wide = [b for b in brackets if b.value is None and b.rows > collect_rows]
        if not wide:
            break
        _narrow(values, wide)
    # What is left fits in a bounded, sorted array per interval.
    rest = _by_interval([b for b in brackets if b.value is None])
    for start in range(0, len(rest), 32):
        part = rest[start:start + 32]
        arrays = values.agg(
            *[
                F.sort_array(F.collect_list(F.when(same[0].inside(col(same[0].column)), col(same[0].column)))).alias(f"s{i}")
                for i, same in enumerate(part)
            ]
        )
        row = arrays.select(
            *[
                F.element_at(F.col(f"s{i}"), F.lit(b.rank - b.below + 1)).alias(f"v{i}_{j}")
                for i, same in enumerate(part) for j, b in enumerate(same)
            ]
        ).first()
        for i, same in enumerate(part):
            for j, b in enumerate(same):
                b.value = float(row[f"v{i}_{j}"])


def _by_interval(brackets: list[_Bracket]) -> list[list[_Bracket]]:
    """Brackets that are the same interval of the same column, together."""
    found: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        found.setdefault((b.column, b.low, b.high), []).append(b)
    return list(found.values())


def _narrow(values: DataFrame, brackets: list[_Bracket]) -> None:
    intervals = _by_interval(brackets)
    sketches = [
        F.kll_sketch_agg_double(
            F.when(same[0].inside(col(same[0].column)), col(same[0].column)), F.lit(SKETCH_K)
        ).alias(f"s{i}")
        for i, same in enumerate(intervals)
    ]
    # Two levels, so that the last task merges a few dozen sketches and not one
    # for every input partition.
    partial = (
        values.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
        .agg(*sketches)
    )
    merged = partial.agg(
        *[F.kll_merge_agg_double(F.col(f"s{i}")).alias(f"s{i}") for i in range(len(intervals))]
    )
    pivots = []
    for i, same in enumerate(intervals):
        for j, b in enumerate(same):
            p = (b.rank - b.below + 0.5) / b.rows
            for side, q in (("a", p - SKETCH_MARGIN), ("b", p + SKETCH_MARGIN)):
                pivots.append(
                    F.kll_sketch_get_quantile_double(
                        F.col(f"s{i}"), F.lit(min(1.0, max(0.0, q)))
                    ).alias(f"{side}{i}_{j}")
                )
    row = merged.select(*pivots).first()
    ends = {
        id(b): (float(row[f"a{i}_{j}"]) + 0.0, float(row[f"b{i}_{j}"]) + 0.0)
        for i, same in enumerate(intervals) for j, b in enumerate(same)
    }
    wanted: dict[str, set[float]] = {}
    for b in brackets:
        wanted.setdefault(b.column, set()).update(ends[id(b)])
    counts = _counts_around(values, wanted)

    for b in brackets:
        a, z = ends[id(b)]
        (lower, at), (upper, at_end) = counts[b.column, a], counts[b.column, z]
        steps = [("range", lower - b.below, b.low, a), ("point", at, a, a)]
        if z > a:
            steps += [("range", upper - lower - at, a, z), ("point", at_end, z, z)]
        above = b.rows - sum(s[1] for s in steps)
        steps.append(("range", above, z, b.high))
        seen = b.below
        for kind, size, low, high in steps:
            if b.rank < seen + size:
                if kind == "point":
                    b.value = low
                else:
                    b.low, b.high, b.below, b.rows = low, high, seen, size
                break
            seen += size


def _counts_around(
    values: DataFrame, pivots: dict[str, set[float]]
) -> dict[tuple[str, float], tuple[int, int]]:
    """(values below, values equal) for every pivot of every column, in one pass.

    Values are put into buckets between neighbouring pivots and counted by column and
    bucket: the code of the pass doesn't grow with pivots, as one count for each would.
    """
    columns = list(pivots)
    splits = []
    for c in columns:
        finite = {0.0, *(p for p in pivots[c] if p != math.inf)}
        # A pivot has a bucket of its own, up to the next greater number.
        edges = finite | {math.nextafter(p, math.inf) for p in finite} | {-math.inf, math.inf}
        splits.append(sorted(edges))
    names = [f"x{i}" for i in range(len(columns))]
    places = [f"p{i}" for i in range(len(columns))]
    # Adding zero turns -0.0 into 0.0.
    plain = values.select(*[(col(c) + F.lit(0.0)).alias(x) for c, x in zip(columns, names)])
    placed = Bucketizer(
        splitsArray=splits, inputCols=names, outputCols=places, handleInvalid="keep"
    ).transform(plain)
    stacked = placed.select(
        *[F.when(F.col(x) == math.inf, F.lit(-1.0)).otherwise(F.col(p)).alias(p) for x, p in zip(names, places)]
    ).unpivot([], places, "column", "place")
    rows = (
        stacked.filter(F.col("place").isNotNull())
        .groupBy("column", "place").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    # One row per column and bucket; infinity is -1, and NaN lies behind the last bucket.
    found = {(r["column"], int(r["place"])): r["n"] for r in rows}
    counts = {}
    for c, place, edges in zip(columns, places, splits):
        sizes = [found.get((place, i), 0) for i in range(len(edges) - 1)]
        for p in pivots[c]:
            if p == math.inf:
                counts[c, p] = (sum(sizes), found.get((place, -1), 0))
            else:
                i = edges.index(p)
                counts[c, p] = (sum(sizes[:i]), sizes[i])
    return counts
