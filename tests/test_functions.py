"""Building blocks: quantiles, lookups, order, splits."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions.expressions import parse_date, row_digest, word_count
from tabloom.functions.frequencies import LONG_TEXT, key_counts, modes, short_key, value_counts, with_texts
from tabloom.functions.lookup import lookup_join
from tabloom.functions.ordering import dense_index, running_totals_desc
from tabloom.functions.quantiles import exact_quantiles
from tabloom.operators.split import split_rows, test_quotas as quotas_of

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def frames():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(size=20_000),
        "heavy_tail": np.exp(rng.normal(size=20_000) * 8),
        "third_equal": np.where(rng.random(20_000) < 0.34, 7.0, rng.random(20_000) * 14),
        "two_values": rng.integers(0, 2, 20_000).astype(float),
        "constant": np.full(20_000, 3.5),
    }


@pytest.mark.parametrize("name", list(frames()))
def test_narrowed_quantiles_equal_numpy(spark, name):
    x = frames()[name]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    found = exact_quantiles(df, ["x"], PROBABILITIES, direct_cells=10, collect_rows=200)["x"]
    np.testing.assert_allclose(found, np.quantile(x, PROBABILITIES), rtol=1e-12)


def test_quantiles_of_several_columns_and_empty_ones(spark):
    df = spark.range(1001).select(
        F.col("id").cast("double").alias("a"), F.lit(None).cast("double").alias("b"), "id"
    )
    direct = exact_quantiles(df, ["a", "b", "id"], [0.5])
    narrowed = exact_quantiles(df, ["a", "b", "id"], [0.5], direct_cells=5, collect_rows=50)
    assert direct == narrowed == {"a": [500.0], "b": [None], "id": [500.0]}


def test_values_are_counted_around_many_pivots_in_one_aggregation(spark):
    """Infinities, both zeros, gaps and any names; the pass has one count, however many pivots."""
    from tabloom.functions.quantiles import _counts_around

    rng = random.Random(9)
    odd = [0.0, -0.0, float("inf"), float("-inf"), 1.7976931348623157e308, 5e-324, None, 2.0, 2.0]
    rows = [tuple(rng.choice(odd + [rng.gauss(0, 3)]) for _ in range(3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "`a.b` double, `c d` double, e double")
    pivots = {
        c: {0.0, 2.0, 5e-324, float("inf"), float("-inf"), 1.7976931348623157e308, *(
            r[i] for r in rows[:20] if r[i] is not None and abs(r[i]) < 100 and r[i] != 0.0
        )}
        for i, c in enumerate(df.columns)
    }
    for (c, p), got in _counts_around(df, pivots).items():
        x = [r[df.columns.index(c)] for r in rows if r[df.columns.index(c)] is not None]
        assert got == (sum(v < p for v in x), sum(v == p for v in x)), (c, p)
    values = [v for v in (r[0] for r in rows) if v is not None and abs(v) < 1e300]
    ends = values + [float("-inf")] * 3 + [float("inf")] * 400
    tails = spark.createDataFrame([(v,) for v in ends], "x double")
    found = exact_quantiles(tails, ["x"], [0.0, 0.2, 0.9, 1.0], direct_cells=5, collect_rows=3)["x"]
    order = sorted(ends)
    assert found[0] == float("-inf") and found[2:] == [float("inf")] * 2
    place = (len(order) - 1) * 0.2
    low = int(place)
    assert found[1] == pytest.approx(order[low] + (place - low) * (order[low + 1] - order[low]))


def test_value_counts_and_modes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", None)], "s string, n long")
    rows = {(r["column"], r["value"]): r["n"] for r in value_counts(df, ["s", "n"]).collect()}
    assert rows == {("s", "a"): 1, ("s", "b"): 2, ("n", "1"): 2, ("n", None): 1}
    assert modes(df, ["s", "n"]) == {"s": "b", "n": "1"}


def test_lookup_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 700}") for i in range(6000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(8)
    table = df.filter("k is not null").groupBy("k").agg(
        F.count(F.lit(1)).alias("w"), F.max("id").alias("top")
    )
    small = lookup_join(df, table, "k", "k", weight="w")
    large = lookup_join(df, table, "k", "k", weight="w", broadcast_rows=10)
    assert small.count() == large.count() == 6001
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    assert large.filter("id = -1").first()["top"] is None


def test_large_lookup_spreads_the_rows_of_a_hot_key(spark):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    df = spark.range(20_000, numPartitions=16).select(hot.alias("k"))
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(df, table, "k", "k", weight="w", broadcast_rows=10)
        sizes = joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000
    assert max(sizes) < 20_000 / 4


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 9)), min_size=1, max_size=60))
def test_running_totals(spark, pairs):
    unique = dict(pairs)
    df = spark.createDataFrame([(float(k), v) for k, v in unique.items()], "k double, v long")
    for buckets in (1, 7):
        rows = running_totals_desc(df, "k", ["v"], buckets).collect()
        for r in rows:
            assert r["v_before"] == sum(v for k, v in unique.items() if k > r["k"])


def test_dense_index_both_ways(spark):
    df = spark.range(900).select(
        F.concat(F.lit("g"), F.col("id") % 3).alias("g"), F.lpad("id", 4, "0").alias("v")
    )
    small = {tuple(r) for r in dense_index(df, "g", "v").collect()}
    large = {tuple(r) for r in dense_index(df, "g", "v", limit=10).collect()}
    assert small == large and len(small) == 900


def test_words_and_digests(spark):
    df = spark.createDataFrame(
        [("a b",), (" a b\tc ",), ("",), ("　",), ("one",)], "t string"
    )
    texts = [r["t"] for r in df.collect()]
    counts = [r["w"] for r in df.select(word_count(F.col("t")).alias("w")).collect()]
    assert counts == [len(t.split()) for t in texts]
    pairs = spark.createDataFrame([("a|1:b", "c"), ("a", "1:b|c"), (None, "-"), ("-", None)], "x string, y string")
    assert pairs.select(row_digest(pairs)).distinct().count() == 4
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert zeros.select(row_digest(zeros)).distinct().count() == 1


def test_dates_that_do_not_exist_are_null(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("text",)], "t string")
    got = [r[0] for r in df.select(parse_date(F.col("t"), 0).cast("string")).collect()]
    assert got == [None, "2024-02-29 00:00:00", None]


@settings(max_examples=100, deadline=None)
@given(
    st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 500), min_size=1),
    st.floats(0.01, 0.99),
)
def test_quotas_add_up(sizes, share):
    quotas = quotas_of(sizes, share)
    n = sum(sizes.values())
    assert sum(quotas.values()) == int(np.ceil(share * n - 1e-9))
    assert all(0 <= quotas[g] <= sizes[g] for g in sizes)
    assert all(abs(quotas[g] - sizes[g] * sum(quotas.values()) / n) < 1 for g in sizes)


def test_split_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(5003).withColumn("y", F.col("id") % 7 == 0)
    one = split_rows(df.coalesce(1), 0.3, keys=["id"], stratify="y")
    many = split_rows(df.repartition(13), 0.3, keys=["id"], stratify="y")
    a = {r["id"] for r in one.filter("split = 'test'").collect()}
    b = {r["id"] for r in many.filter("split = 'test'").collect()}
    assert a == b and len(a) == 1501
    assert one.filter("split = 'test' and y").count() in (214, 215)
    other = split_rows(df, 0.3, seed=7, keys=["id"])
    assert {r["id"] for r in other.filter("split = 'test'").collect()} != a


def test_split_without_keys_deals_out_copies(spark):
    copies = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id")).alias("v")
    )
    parts = split_rows(copies, 0.25)
    assert parts.filter("split = 'test'").count() == 750
    tested = parts.filter("split = 'test' and v = 0").count()
    assert 180 < tested < 320


def test_split_with_tied_keys_keeps_the_exact_size(spark):
    df = spark.range(1000).select((F.col("id") < 400).cast("int").alias("k"))
    for share in (0.1, 0.5, 0.7):
        parts = split_rows(df, share, keys=["k"])
        assert parts.filter("split = 'test'").count() == round(share * 1000)


@pytest.mark.parametrize("bad", [0.0, 1.0, -1, 2])
def test_split_size_is_checked(spark, bad):
    with pytest.raises(ValueError, match="test_size"):
        split_rows(spark.range(10), bad, keys=["id"])


def test_quotas_of_a_table_of_classes(spark):
    """The table form gives the quotas of the plain one, equal remainders included."""
    from tabloom.operators.split import class_quotas

    rng = random.Random(5)
    for sizes in (
        {f"c{i}": rng.randint(1, 40) for i in range(300)}, {f"c{i}": 3 for i in range(50)},
        {"a": 10**12, "b": 1, "c": 1}, {"only": 7},
    ):
        table = spark.createDataFrame(list(sizes.items()), "g string, rows long")
        for share in (0.1, 0.25, 0.5):
            got = {r["g"]: r["take"] for r in class_quotas(table, share).collect()}
            assert got == split_quotas(sizes, share)


def split_quotas(sizes, share):
    from fractions import Fraction
    from math import ceil, floor

    n = sum(sizes.values())
    total = ceil(share * n - 1e-9)
    exact = {g: Fraction(total * s, n) for g, s in sizes.items()}
    quotas = {g: floor(v) for g, v in exact.items()}
    for g in sorted(sizes, key=lambda g: (quotas[g] - exact[g], g))[: total - sum(quotas.values())]:
        quotas[g] += 1
    return quotas


def test_ten_thousand_classes_split_exactly(spark):
    """Classes of 1 to 5 rows and one of a third of all rows; the same on any partitioning."""
    rng = random.Random(6)
    rows = [(c, f"class {c}") for c in range(10_000) for _ in range(rng.randint(1, 5))]
    rows += [(0, "hot")] * 15_000
    rows += [(0, None)] * 40
    df = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "id long, y string")
    one = split_rows(df.coalesce(2), 0.3, keys=["id"], stratify="y")
    sizes = Counter(y if y is not None else "\0null" for _, y in rows)
    got = Counter(
        r["y"] if r["y"] is not None else "\0null" for r in one.filter("split = 'test'").collect()
    )
    assert got == {g: q for g, q in split_quotas(sizes, 0.3).items() if q}
    assert one.columns == ["id", "y", "split"] and one.count() == len(rows)
    many = split_rows(df.repartition(13), 0.3, keys=["id"], stratify="y")
    assert {r["id"] for r in many.filter("split = 'test'").collect()} == {
        r["id"] for r in one.filter("split = 'test'").collect()
    }


def test_many_classes_with_equal_keys(spark):
    """Rows of equal keys at a threshold are dealt out by position, class by class."""
    rows = [(c % 3, f"c{c % 1500}") for c in range(9_000)]
    df = spark.createDataFrame(rows, "id long, y string")
    got = split_rows(df, 0.5, keys=["id"], stratify="y").filter("split = 'test'").groupBy("y").count().collect()
    assert len(got) == 1500 and {r["count"] for r in got} == {3}


def test_long_texts_are_counted_by_digest(spark):
    """Texts of equal heads, one that looks like a key, short ones, NULLs: counts and modes are those of the texts."""
    head = "h" * LONG_TEXT
    texts = [head + "b"] * 4 + [head + "a"] * 4 + [head] * 3 + ["short"] * 2 + [None] * 9 + [head + "\x01" + "0" * 64]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "t string, k long").repartition(4)
    counted = key_counts(df, ["t", "k"])
    assert max(len(r["key"]) for r in counted.collect()) <= 2 * LONG_TEXT + 1
    got = Counter({(r["column"], r["value"]): r["n"] for r in with_texts(df, counted).collect()})
    want = Counter(("t", t) for t in texts if t is not None) + Counter(("k", str(i % 2)) for i in range(len(texts)))
    assert got == want
    assert got == Counter({(r["column"], r["value"]): r["n"] for r in with_texts(df, counted, broadcast_rows=0).collect()})
    assert modes(df, ["t", "k"]) == {"t": head + "a", "k": "0" if len(texts) % 2 else "0"}
    assert spark.range(1).select(short_key(F.lit("x" * 500))).first()[0].startswith("x" * LONG_TEXT + "\x01")


def test_no_exchange_carries_long_texts(spark):
    df = spark.range(50).select(F.concat(F.lit("x" * 3000), F.col("id").cast("string")).alias("t"))
    plan = key_counts(df, ["t"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    exchanged = physical[physical.index("Exchange"):].splitlines()[0]
    assert "key" in exchanged and "sha2" in physical
    from tabloom.operators.features import fit_categories
    from tabloom.operators.scoring import allowed_values

    fitted = fit_categories(df, ["t"], rare_min_freq=0.5)
    assert fitted.sizes == {"t": 0} and fitted.other == {"t": 50} and fitted.table.count() == 0
    listed = allowed_values(df, ["t"], 3).orderBy("rank").collect()
    assert [r["value"][3000:] for r in listed] == ["0", "1", "10"]


@pytest.mark.parametrize("stratify", [None, "y"])
def test_threshold_is_found_in_one_pass(spark, monkeypatch, stratify):
    from tabloom.operators import split

    df = spark.range(20_000).select("id", (F.col("id") % 3).cast("string").alias("y"))
    whole = split_rows(df, 0.3, keys=["id"], stratify=stratify).collect()
    monkeypatch.setattr(split, "ROUNDS", ())
    assert sorted(split_rows(df, 0.3, keys=["id"], stratify=stratify).collect()) == sorted(whole)
    assert sum(r["split"] == "test" for r in whole) == 6_000


def test_rows_of_many_classes_are_shuffled_once(spark, monkeypatch):
    """Small classes by ranks, large ones by thresholds: the same split as by thresholds only."""
    from tabloom.operators import split

    df = spark.range(12_000).select("id", (F.col("id") * 7 % 3_001).alias("y"), F.lit("x").alias("note"))
    df = df.unionAll(spark.range(20_000, 25_000).select("id", F.lit(5_000).alias("y"), F.lit("x")))

    def rows():
        parts = split_rows(df, 0.3, keys=["id"], stratify="y")
        return parts, sorted(parts.collect())

    by_ranks, found = rows()
    assert by_ranks._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    monkeypatch.setattr(split, "CLASS_ROWS", 1_000)
    assert rows()[1] == found
    monkeypatch.setattr(split, "CLASS_ROWS", 0)
    assert rows()[1] == found
