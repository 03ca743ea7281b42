"""One-bit codes: bounds, recall against brute force, and awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, query_ids, k):
    out = {}
    for q in query_ids:
        for at in np.flatnonzero(ids == q):
            d = np.sqrt(((vectors - vectors[at]) ** 2).sum(1))
            d[ids == q] = np.inf
            order = [i for i in np.lexsort((ids, d)) if np.isfinite(d[i])][:k]
            out[int(q), int(at)] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def check(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for (q, _), near in want.items():
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        assert len(mine) == len(near)
        true = dict(near)
        for _, v, s in mine:
            if v in true:
                assert s == pytest.approx(true[v], abs=1e-9)
        hits += len({m[1] for m in mine} & set(true))
        total += len(near)
    assert hits >= least * total


@pytest.mark.parametrize("kind", ["unit", "clusters", "shifted"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 700)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 48))
    if kind == "unit":
        x /= np.sqrt((x**2).sum(1, keepdims=True))
    elif kind == "clusters":
        x = x * 0.1 + rng.normal(size=(10, 48))[rng.integers(0, 10, 2500)] * 5
    else:
        x += 100.0
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = ann.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    check(got, brute(np.arange(2500), x, range(0, 2500, 100), 10), 0.97)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(3000, 40)), rng.normal(size=(20, 40))
    turn = ann.rotation(40)
    codes, length, inner = ann.encode(x, np.zeros(40), turn)
    low, high = ann.bounds(codes, length, inner, q @ turn, np.sqrt((q**2).sum(1)))
    true = ((q[:, None] - x[None]) ** 2).sum(-1)
    assert ((low <= true + 1e-6) & (true <= high + 1e-6)).mean() > 0.98


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.1, 0.0], 1), (2, None, 1), (3, [0.0, 0.0, 0.0], 1),
        (4, [1.0, nan, 0.0], 1), (5, [inf, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [], 1),
        (8, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1),
        (100, [1.0, 0.0, 0.0], 1), (200, [0.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("row", F.lit("y"))
    got = ann.nearest(df, df.filter("vec_id % 100 = 0"), k=3).collect()
    assert {r["query_id"] for r in got} == {0, 100}
    first = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert first == [(1, 9, 0.0), (2, 10, 0.0), (3, 100, 0.0)]
    few = df.filter("vec_id in (0, 1)")
    assert [(r["vec_id"], r["rank"]) for r in ann.nearest(few, few.filter("vec_id = 0")).collect()] == [(1, 1)]
    same = ann.nearest(df.unionAll(df), df.filter("vec_id = 0"), k=2).collect()
    assert {r["vec_id"] for r in same} == {9}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_vectors_meet_those_of_their_length(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(1, 30)] + [(100 + i, [float(i), 1.0, 2.0], 0) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(df, df.filter("vec_id in (5, 100)"), k=10).collect()
    near = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (5, 100)}
    assert near[100] == [101, 102, 103] and near[5][:2] == [4, 6] and len(near[5]) == 10


def test_recall_of_many_vectors(spark, folder):
    """50,000 vectors in four slices, 500 queries."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    x = rng.normal(size=(50_000, 64)).astype(np.float32)
    x[::3] = x[rng.integers(0, 300, len(x[::3]))] + 0.05 * rng.normal(size=(len(x[::3]), 64))
    lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, dtype=np.int32), x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": lists}), f"{folder}/v.parquet")
    df = spark.read.parquet(f"{folder}/v.parquet")
    got = ann.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    check(got, brute(np.arange(50_000), x.astype(np.float64), range(0, 50_000, 100), 10), 0.95)
