"""Least squares from shared moments against fits of Spark and numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators.models import moments
from tabloom.operators.models.linear import train_elasticnet, train_lasso, train_linear, train_ridge
from tabloom.plans.jobs import tune


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4)) * [1, 10, 0.1, 1] + [0, 1e6, 5, -3]
    y = x @ [2.0, 0.5, -30.0, 0.0] + rng.normal(size=900) * 3 + 7
    rows = [(i, x[i].tolist(), float(y[i]), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, fold int")
    return x, y, df.withColumn("features", array_to_vector("x")).drop("x").repartition(40).cache()


def test_moments_of_groups(data):
    x, y, df = data
    found = moments.moments(df, F.col("fold"))
    assert set(found) == {"0", "1", "2"}
    whole = moments.moments(df)[""]
    for name, rows in [(str(k), np.arange(900) % 3 == k) for k in range(3)] + [("", np.ones(900, bool))]:
        m = whole if name == "" else found[name]
        z = np.column_stack([x[rows], y[rows]])
        centred = z - z.mean(0)
        assert m.n == rows.sum() and np.allclose(m.mean, z.mean(0), rtol=1e-12)
        # The second feature is 10 around a million: no cancellation.
        assert np.allclose(m.cross, centred.T @ centred, rtol=1e-8, atol=1e-6)


def test_solutions_are_those_of_the_trainers(data):
    _, _, df = data
    m = moments.moments(df)[""]
    for train, solved in (
        (train_ridge(df, alpha=50.0), moments.solve_ridge(m, 50.0)),
        (train_linear(df), moments.solve_linear(m)),
        (train_linear(df, fit_intercept=False), moments.solve_linear(m, fit_intercept=False)),
        (train_lasso(df, alpha=0.2), moments.solve_elasticnet(m, 0.2, 1.0)),
        (train_elasticnet(df, alpha=0.3, l1_ratio=0.4), moments.solve_elasticnet(m, 0.3, 0.4)),
    ):
        w, b = solved
        pred = np.array([w @ np.array(r["features"]) + b for r in df.select("features").take(50)])
        want = np.array([r["prediction"] for r in train.transform(df).select("prediction").take(50)])
        assert np.abs(pred - want).max() < 0.02


def test_metrics_from_moments(data):
    x, y, df = data
    found = moments.moments(df, F.col("fold") == 0)
    w, b = moments.solve_ridge(found["false"], 1.0)
    rows = np.arange(900) % 3 == 0
    error = y[rows] - x[rows] @ w - b
    got = moments.fit_metrics(found["true"], w, b)
    assert got["rmse"] == pytest.approx(np.sqrt((error**2).mean()), rel=1e-6)
    assert got["r2"] == pytest.approx(1 - (error**2).sum() / ((y[rows] - y[rows].mean()) ** 2).sum(), rel=1e-6)
    flat = moments.Moments.of(np.column_stack([x[:5], np.ones(5)]))
    assert moments.fit_metrics(flat, w, b)["r2"] is None


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, [2.0, 2.0]), (None, [5.0, 5.0]), (3.0, [4.0, 4.0])], "label double, x array<double>")
    df = df.withColumn("features", array_to_vector("x"))
    m = moments.moments(df)[""]
    assert m.n == 2
    w, b = moments.solve_linear(m)  # two equal columns: any of the best fits
    assert w @ [2.0, 2.0] + b == pytest.approx(1.0) and w @ [4.0, 4.0] + b == pytest.approx(3.0)
    assert moments.moments(df.limit(0)) == {}
    with pytest.raises(ValueError, match="moments"):
        moments.solve("regression_rf", m, {})


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), out


def test_search_on_moments_costs_one_pass(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), float(a - 2 * b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    made = {}
    for n in (2, 20):
        made[n], (result, search) = jobs_of(
            spark, f"tune{n}", lambda n=n: tune(df, "y", "regression_ridge", n_trials=n, keys=["id"])
        )
    assert made[2] == made[20]
    fitted, _ = jobs_of(
        spark, "fits", lambda: tune(df, "y", "regression_ridge", n_trials=2, keys=["id"], shared_moments=False)
    )
    _, plain = tune(df, "y", "regression_ridge", n_trials=20, keys=["id"], shared_moments=False)
    assert [t.params for t in plain.trials] == [t.params for t in search.trials]
    assert [t.score for t in plain.trials] == pytest.approx([t.score for t in search.trials], abs=1e-6)
    report = search.report(spark).first()
    assert report["baseline_metrics"].keys() == {"rmse", "mae", "r2"} == report["best_metrics"].keys()
    assert report["best_metrics"]["rmse"] == pytest.approx(-search.best.score, abs=1e-6)
    assert report["best_bytes"] > 0 and result.metrics["rmse"] == pytest.approx(-search.best.score, abs=1e-6)
