"""Metrics and chart data against numpy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.operators.evaluate import (
    actual_vs_predicted,
    binary_metrics,
    confusion_matrix,
    regression_metrics,
    roc_auc,
    roc_points,
    score_histogram,
    top_importances,
)
from tabloom.operators.tuning import (
    KEEP,
    RECOMMEND,
    REVIEW,
    SEARCH_SPACES,
    comparison_report,
    patience_of,
    random_search,
    score_of,
    search_candidates,
    trial_history,
)


def pair_auc(y, s):
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean()


@pytest.mark.parametrize("buckets", [1, 9])
def test_auc_with_ties(spark, buckets):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 700)
    s = np.round(rng.normal(size=700) + y, 1)
    s[:250] = 0.5
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y long, s double")
    got = roc_auc(df, "y", "s", 1, buckets).first()["roc_auc"]
    assert got == pytest.approx(pair_auc(y, s))
    points = sorted(tuple(r) for r in roc_points(df, "y", "s", 1, buckets).collect())[::-1]
    for threshold, fpr, tpr in points:
        assert fpr == pytest.approx((s[y == 0] >= threshold).mean())
        assert tpr == pytest.approx((s[y == 1] >= threshold).mean())
    assert points[-1][1:] == (1.0, 1.0)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y long, s double")
    assert roc_auc(df, "y", "s", 1).first()["roc_auc"] is None
    assert roc_points(df, "y", "s", 1).count() == 0


def test_binary_metrics_without_positives(spark):
    df = spark.createDataFrame([("n", "n"), ("n", "n")], "y string, p string")
    row = binary_metrics(df, "y", "p", "p").first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_confusion_matrix_has_all_pairs(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a")], "y string, p string")
    rows = {(r["actual"], r["predicted"]): r["n"] for r in confusion_matrix(df, "y", "p").collect()}
    assert len(rows) == 9 and rows[("a", "b")] == 2 and rows[("c", "a")] == 1
    assert sum(rows.values()) == 3


def test_regression_metrics_and_pairs(spark):
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    row = regression_metrics(df, "y", "p").first()
    assert row["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row["mae"] == pytest.approx(0.5)
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    pairs, limits = actual_vs_predicted(df, "y", "p")
    assert pairs.count() == 3 and tuple(limits.first()) == (1.0, 4.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3).map(lambda v: round(v, 1)), min_size=1, max_size=200))
def test_histogram(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s double")
    rows = sorted(score_histogram(df, "s").collect())
    bins = min(30, max(5, int(np.sqrt(len(values)))))
    assert len(rows) == bins
    assert sum(r["n"] for r in rows) == len(values)
    assert rows[0]["low"] <= min(values) and rows[-1]["high"] >= max(values) - 1e-9
    for r in rows:
        inside = [v for v in values if r["low"] + 1e-6 < v < r["high"] - 1e-6]
        assert len(inside) <= r["n"]


def test_top_importances(spark):
    df = spark.createDataFrame([(f"f{i:02d}", float(i % 7)) for i in range(30)], "feature string, importance double")
    rows = [tuple(r) for r in top_importances(df).collect()]
    assert len(rows) == 10 and rows[0] == ("f06", 6.0) and rows[3] == ("f27", 6.0)


def test_score_choice():
    assert score_of({"rmse": 2.0}, "regression") == -2.0
    assert score_of({"f1": None, "roc_auc": 0.4, "accuracy": 0.9}, "classification") == 0.4
    assert score_of({"accuracy": 0.9}, "anomaly") == 0.9
    assert score_of({}, "classification") == 0.0


def test_candidates_are_seeded_draws():
    a = search_candidates("classification_rf", 50, 7)
    assert a == search_candidates("classification_rf", 50, 7) and len(a) == 50
    space = SEARCH_SPACES["classification_rf"]
    assert all(set(c) == set(space) and all(c[k] in space[k] for k in c) for c in a)
    assert search_candidates("anomaly_lof", 2) == [{}, {}]


def run_search(scores, n_trials, parallelism=1, baseline=0.5):
    calls = []

    def fit(params):
        if not params and not calls:
            calls.append("base")
            return "base", {"f1": baseline}
        i = len(calls) - 1
        calls.append(i)
        if scores[i] is None:
            raise RuntimeError("no fit")
        return f"m{i}", {"f1": scores[i]}

    return random_search(fit, "unknown", "classification", n_trials, parallelism=parallelism)


def test_search_stops_early_and_keeps_the_best(spark):
    found = run_search([0.6, None, 0.6, 0.9, 0.9], 10)
    assert patience_of(10) == 2
    assert len(found.trials) == 3 and found.best.model == "m0" and len(found.errors) == 1
    replay = sorted(found.history(spark).collect())
    assert [r["ran"] for r in replay] == [True] * 3
    assert [r["improved"] for r in replay] == [True, False, False]


def test_history_replays_a_full_log(spark):
    log = spark.createDataFrame(
        [(0, 0.4), (1, 0.6), (2, None), (3, 0.6), (4, 0.9)], "trial int, score double"
    )
    rows = sorted(trial_history(log, 0.5, 5).collect())
    assert [r["ran"] for r in rows] == [True, True, True, True, False]
    assert [r["best_before"] for r in rows] == [0.5, 0.5, 0.6, 0.6, 0.6]


def test_failing_baseline_is_an_error():
    def fit(params):
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError, match="broken"):
        random_search(fit, "classification_rf", "classification")


def test_recommendations(spark):
    rows = [
        (0.5, 0.5, 10, 10, 1.0, KEEP),
        (0.5, 0.6, 10, 12, 1.0, RECOMMEND),
        (0.5, 0.6, 10, 13, 1.0, REVIEW),
        (0.5, 0.6, None, 13, 1.0, RECOMMEND),
        (0.5, 0.6, 10, 10, 601.0, REVIEW),
        (0.5, 0.52, 10, 10, 1.0, REVIEW),
        (-2.0, -1.0, 10, 10, 1.0, RECOMMEND),
        (0.0, 0.4, 10, 10, 1.0, REVIEW),
    ]
    df = spark.createDataFrame(
        rows,
        "baseline_score double, best_score double, baseline_bytes long, best_bytes long, "
        "elapsed_seconds double, want string",
    )
    report = comparison_report(df)
    assert report.filter(F.col("recommendation") != F.col("want")).count() == 0
