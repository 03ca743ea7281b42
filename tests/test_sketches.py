"""Sketches of columns: errors, merging, and profiles made of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile as profiles
from tabloom.operators.profile import profile_table
from tabloom.operators.sketches import (
    DISTINCT_ERROR,
    RANK_ERROR,
    column_estimates,
    merge_sketches,
    sketch_columns,
)


def columns():
    rng = np.random.default_rng(8)
    n = 30_000
    return {
        "normal": rng.normal(size=n),
        "heavy": np.exp(rng.normal(size=n) * 6),
        "third": np.where(rng.random(n) < 0.34, 7.0, rng.random(n) * 14),
        "few": rng.integers(0, 5, n).astype(float),
        "signed_zero": np.where(rng.random(n) < 0.5, 0.0, -0.0),
    }


@pytest.fixture(scope="module")
def table(spark):
    made = columns()
    rows = list(zip(range(30_000), *[v.tolist() for v in made.values()]))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in made))
    return df.withColumns({
        "text": F.concat(F.lit("t"), (F.col("id") % 9000).cast("string")),
        "gaps": F.when(F.col("id") % 3 == 0, F.col("normal")).when(F.col("id") % 3 == 1, F.lit(float("nan"))),
        "empty": F.lit(None).cast("double"), "no text": F.lit(None).cast("string"),
    }).cache()


def test_errors_of_merged_parts(table):
    made = {r["column"]: r for r in column_estimates(sketch_columns(table, part=F.col("id") % 37)).collect()}
    assert set(made) == set(table.columns) and all(r["rows"] == 30_000 for r in made.values())
    for name, values in columns().items():
        exact = len(np.unique(values))
        assert abs(made[name]["n_distinct"] - exact) <= DISTINCT_ERROR * exact
        assert (made[name]["low"], made[name]["high"]) == (values.min(), values.max())
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            v = made[name][q]
            assert (values < v).mean() <= p + RANK_ERROR and (values <= v).mean() >= p - RANK_ERROR
        q1, q3 = made[name]["q1"], made[name]["q3"]
        margin = 1.5 * (q3 - q1)
        outside = ((values < q1 - margin) | (values > q3 + margin)).mean() if q3 > q1 else 0.0
        assert made[name]["outlier_ratio"] == pytest.approx(outside, abs=2 * RANK_ERROR)
    assert made["gaps"]["present"] == 10_000
    assert abs(made["text"]["n_distinct"] - 9000) <= DISTINCT_ERROR * 9000 and made["text"]["q1"] is None
    assert made["empty"]["n_distinct"] == 0 and made["empty"]["q1"] is None and made["empty"]["outlier_ratio"] is None


def test_kept_sketches_grow_by_parts(spark, table, folder):
    """A part that arrives later is the only data that is read for the new profile."""
    path = f"{folder}/sketches"
    for day in range(3):
        rows = table.filter(F.col("id") % 3 == day)
        sketch_columns(rows, ["id", "heavy"], part=F.lit(f"day{day}")).write.mode("append").parquet(path)
    kept = spark.read.parquet(path)
    assert kept.count() == 6 and kept.select("part").distinct().count() == 3
    all_days = {r["column"]: r for r in column_estimates(kept).collect()}
    assert all_days["id"]["rows"] == 30_000 and abs(all_days["id"]["n_distinct"] - 30_000) <= DISTINCT_ERROR * 30_000
    two = {r["column"]: r for r in column_estimates(kept.filter("part <> 'day1'")).collect()}
    assert two["id"]["rows"] == 20_000 and abs(two["id"]["n_distinct"] - 20_000) <= DISTINCT_ERROR * 20_000


def test_sketches_of_no_rows(table):
    none = table.limit(0)
    assert sketch_columns(none).count() == 0 and merge_sketches(sketch_columns(none)).count() == 0
    assert profile_table(none, duplicates=False, approximate=True)["heavy"].n_distinct == 0


def test_only_sketches_are_shuffled(table):
    plan = sketch_columns(table, ["id", "text"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange") == 1 and "partial_hll_sketch_agg" in physical


def test_approximate_profile_follows_the_exact_rules(table, monkeypatch):
    monkeypatch.setattr(profiles, "EXACT_VALUES", 1_000)
    near = profile_table(table, duplicates=False, approximate=True)
    exact = profile_table(table, duplicates=False)
    flags = ("is_constant", "is_high_cardinality", "is_potential_id", "has_heavy_outliers", "is_rare_heavy", "is_text_like")
    for c in exact.columns:
        other = near[c.column]
        assert [getattr(other, f) for f in flags] == [getattr(c, f) for f in flags], c.column
        assert other.n_null == c.n_null
        assert abs(other.n_distinct - c.n_distinct) <= DISTINCT_ERROR * c.n_distinct
    kept = sketch_columns(table, part=F.col("id") % 5)
    again = profile_table(table, duplicates=False, sketches=kept)
    assert [c.is_potential_id for c in again.columns] == [c.is_potential_id for c in exact.columns]


def test_bound_of_distinct_counts_is_far_from_chance(spark):
    """Merged sketches of 48 columns: their errors' spread is less than a ninth of the bound."""
    from tabloom.operators.sketches import distinct_estimate

    n = 80_000
    df = spark.range(n).select(*[(F.col("id") * 48 + i).alias(f"c{i}") for i in range(48)])
    merged = merge_sketches(sketch_columns(df, part=F.spark_partition_id()))
    errors = [r["d"] / n - 1 for r in merged.select(distinct_estimate(merged).alias("d")).collect()]
    assert len(errors) == 48 and np.sqrt(np.mean(np.square(errors))) <= DISTINCT_ERROR / 9
