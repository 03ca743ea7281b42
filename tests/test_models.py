"""Models against closed forms, brute force and planted outliers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators.class_weights import add_balanced_weights, balanced_weights, check_target
from tabloom.operators.importance import model_importances, permutation_importance
from tabloom.operators.models.isolation_forest import IsolationForest, average_path
from tabloom.operators.models.linear import (
    train_elasticnet,
    train_lasso,
    train_linear,
    train_logistic,
    train_ridge,
)
from tabloom.operators.models.lof import LocalOutlierFactor
from tabloom.operators.models.neighbors import nearest_neighbors
from tabloom.operators.models.one_class_svm import OneClassSVM
from tabloom.operators.models.trees import train_forest_classifier, train_forest_regressor


def frame(spark, x, y=None, **extra):
    columns = ["id", "features"] + (["label"] if y is not None else [])
    rows = [
        (i, Vectors.dense(v)) + ((float(y[i]),) if y is not None else ())
        for i, v in enumerate(x)
    ]
    return spark.createDataFrame(rows, columns).repartition(4, "id")


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) * [1.0, 3.0, 0.5, 2.0] + [0, 1, 5, 2]
    y = x @ [2.0, -1.0, 0.0, 0.3] + 4.0 + rng.normal(size=300)
    return x, y, frame(spark, x, y)


def descend(x, y, l1, l2, rounds=3000):
    """Coordinate descent for (1/2n)|y-Xw|^2 + l1|w|_1 + l2/2|w|^2 on centred data."""
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(w)):
            rest = yc - xc @ w + xc[:, j] * w[j]
            c = xc[:, j] @ rest / n
            w[j] = np.sign(c) * max(abs(c) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2)
    return w


def test_linear_and_ridge(regression):
    x, y, df = regression
    xc, yc = x - x.mean(0), y - y.mean()
    ols = np.linalg.lstsq(xc, yc, rcond=None)[0]
    np.testing.assert_allclose(train_linear(df).coefficients.toArray(), ols, atol=1e-8)
    for alpha in (1.0, 50.0):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
        np.testing.assert_allclose(train_ridge(df, alpha).coefficients.toArray(), want, atol=1e-8)


def test_lasso_and_elasticnet(regression):
    x, y, df = regression
    np.testing.assert_allclose(
        train_lasso(df, 0.2).coefficients.toArray(), descend(x, y, 0.2, 0.0), atol=1e-5
    )
    np.testing.assert_allclose(
        train_elasticnet(df, 0.5, 0.3).coefficients.toArray(),
        descend(x, y, 0.15, 0.35), atol=1e-5,
    )


def newton(x, y, weight, c):
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0 / c] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (weight * (p - y)) + penalty @ w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty
        w -= np.linalg.solve(h, g)
    return w


def test_logistic_plain_and_weighted(spark, regression):
    x, raw, _ = regression
    y = (raw > np.quantile(raw, 0.8)).astype(float)
    df = frame(spark, x, y)
    model = train_logistic(df, C=0.7)
    got = np.append(model.coefficients.toArray(), model.intercept)
    np.testing.assert_allclose(got, newton(x, y, np.ones(300), 0.7), atol=1e-4)
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    model = train_logistic(add_balanced_weights(df, "label"), C=0.7)
    got = np.append(model.coefficients.toArray(), model.intercept)
    np.testing.assert_allclose(got, newton(x, y, weight, 0.7), atol=1e-4)


def test_forests_learn(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    df = frame(spark, x, y)
    model = train_forest_classifier(df, n_estimators=30)
    assert model.transform(df).filter("prediction = label").count() > 380
    assert model.transform(df).count() == 400
    importances = model_importances(spark, model, ["a", "b", "c"]).collect()
    top = {r["feature"]: r["importance"] for r in importances}
    assert top["c"] < top["a"] and top["c"] < top["b"]
    target = x[:, 0] * 10
    model = train_forest_regressor(frame(spark, x, target), n_estimators=20, max_depth=8)
    scored = model.transform(frame(spark, x, target))
    assert scored.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 0.5


def test_class_weights_and_target_checks(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)], "y string")
    got = {r["value"]: r["weight"] for r in balanced_weights(df, "y").collect()}
    assert got == {"a": pytest.approx(8 / 12), "b": pytest.approx(2.0)}
    assert check_target(df, "y") == {"a": 6, "b": 2}
    with pytest.raises(ValueError, match="exactly 2 classes"):
        check_target(spark.createDataFrame([(i % 3,) for i in range(9)], "y long"), "y")
    with pytest.raises(ValueError, match="at least 2 rows"):
        check_target(spark.createDataFrame([(0,), (0,), (1,)], "y long"), "y")
    with pytest.raises(ValueError, match="empty"):
        check_target(spark.createDataFrame([(None,)], "y long"), "y", binary=False)


def planted(seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=(500, 3)), rng.normal(size=(5, 3)) + 9])


def test_average_path():
    assert (average_path(1), average_path(2)) == (0.0, 1.0)
    # Exact value for n rows: 2 H(n-1) - 2 (n-1)/n.
    n = 256
    exact = 2 * sum(1 / i for i in range(1, n)) - 2 * (n - 1) / n
    assert average_path(n) == pytest.approx(exact, abs=0.01)


@pytest.mark.parametrize(
    "estimator",
    [
        lambda: IsolationForest(contamination=0.02, keys=["id"]),
        lambda: LocalOutlierFactor(),
        lambda: LocalOutlierFactor(contamination=0.02),
        lambda: OneClassSVM(nu=0.05),
        lambda: OneClassSVM(nu=0.05, gamma="scale"),
    ],
)
def test_planted_outliers_are_found(spark, folder, estimator):
    df = frame(spark, planted())
    # The exact one-class SVM puts outliers it was trained on just at its margin.
    svm = isinstance(estimator(), OneClassSVM)
    model = estimator().fit(df.filter("id < 500") if svm else df)
    scored = model.transform(df)
    assert scored.count() == 505
    assert scored.filter("id >= 500 and prediction = 1").count() == 5
    assert scored.filter("id < 500 and prediction = 1").count() < 40
    assert scored.filter("(anomaly_score > 0) <> (prediction = 1)").count() == 0
    PipelineModel([model]).write().overwrite().save(f"{folder}/m")
    again = PipelineModel.load(f"{folder}/m").transform(df)
    a = {r["id"]: r["anomaly_score"] for r in scored.collect()}
    b = {r["id"]: r["anomaly_score"] for r in again.collect()}
    assert a == pytest.approx(b)


def test_isolation_forest_flags_its_share_and_ignores_partitioning(spark):
    df = frame(spark, planted(3))
    a = IsolationForest(contamination=0.1, keys=["id"]).fit(df)
    b = IsolationForest(contamination=0.1, keys=["id"]).fit(df.coalesce(1))
    sa = {r["id"]: r["raw_score"] for r in a.transform(df).collect()}
    sb = {r["id"]: r["raw_score"] for r in b.transform(df).collect()}
    assert sa == sb
    assert a.transform(df).filter("prediction = 1").count() == 51


def test_isolation_forest_deals_rows_to_few_trees(spark):
    """Rows outnumber the draws, so most rows enter one tree of a few, or none."""
    rng = np.random.default_rng(4)
    df = frame(spark, np.vstack([rng.normal(size=(3000, 2)), rng.normal(size=(30, 2)) + 30.0]))
    model = IsolationForest(contamination=0.01, n_estimators=4, keys=["id"]).fit(df)
    top = model.transform(df).orderBy(F.col("raw_score").desc()).limit(25).collect()
    assert all(r["id"] >= 3000 for r in top)


def test_isolation_forest_scores_a_table_once(spark):
    """Model and scores in one go: the rows of fit and transform, each scored once."""
    walked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        walked.add(1)
        return x

    df = frame(spark, planted(3)).withColumn("note", counted(F.col("id").cast("double")))
    forest = IsolationForest(contamination=0.1, keys=["id"])
    model, scored = forest.fit_scored(df, ["id", "note"])
    assert scored.columns == ["id", "note", "raw_score", "anomaly_score", "prediction"]
    found = {r["id"]: r for r in scored.collect()}
    scored.count(), scored.agg(F.sum("note")).collect()
    assert walked.value == df.count()
    again = forest.fit(df).transform(df).collect()
    assert len(found) == len(again)
    for r in again:
        assert tuple(found[r["id"]]) == tuple(r[c] for c in scored.columns)


def test_walk_over_full_trees_equals_the_walk_node_by_node():
    from tabloom.operators.models.isolation_forest import flatten_trees, grow_tree, path_lengths

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(700, 3)), 1)
    trees = [grow_tree(x[rng.choice(700, 64)], np.random.default_rng(i), 6) for i in range(9)]

    def depth(row, t):
        at = 0
        while t["feature"][at] >= 0:
            at = t["right" if row[t["feature"][at]] > t["threshold"][at] else "left"][at]
        return t["depth"][at]

    expected = np.array([[depth(row, t) for t in trees] for row in x]).mean(axis=1)
    assert (path_lengths(x, flatten_trees(trees, 6)) == expected).all()


def brute_neighbors(q, p, k, same):
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
    if same:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("cells", [10_000, 40])
@pytest.mark.parametrize("same", [True, False])
def test_nearest_neighbors_equal_brute_force(spark, cells, same):
    rng = np.random.default_rng(6)
    # Clusters of very different density, and far from the origin.
    p = np.vstack([rng.normal(size=(200, 3)), rng.normal(size=(100, 3)) * 0.01 + 1000])
    q = p if same else rng.normal(size=(50, 3)) * 3

    def table(x):
        return spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, x array<double>")

    found = nearest_neighbors(
        table(q), table(p), 7, same, points_per_cell=cells, query_block=33, point_block=57
    ).toPandas()
    assert len(found) == 7 * len(q)
    got = np.array([sorted(g) for _, g in found.groupby("qid")["dist"]])
    np.testing.assert_allclose(got, brute_neighbors(q, p, 7, same), rtol=1e-9)


def brute_lof(train, test, k):
    d = np.sqrt(((train[:, None] - train[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    kdist = dist[:, -1]
    lrd = 1 / (np.maximum(dist, kdist[near]).mean(1) + 1e-10)
    dt = np.sqrt(((test[:, None] - train[None]) ** 2).sum(-1))
    near_t = np.argsort(dt, axis=1, kind="stable")[:, :k]
    dist_t = np.take_along_axis(dt, near_t, axis=1)
    lrd_t = 1 / (np.maximum(dist_t, kdist[near_t]).mean(1) + 1e-10)
    return lrd[near_t].mean(1) / lrd_t, lrd[near].mean(1) / lrd


@pytest.mark.parametrize("copies", [1, 3, 40])
def test_lof_equals_brute_force_with_copies(spark, copies):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 2))
    train = np.vstack([base, np.repeat(base[:1], copies - 1, axis=0)])
    test = np.vstack([rng.normal(size=(30, 2)), base[:1]])
    k = 5
    want, own = brute_lof(train, test, k)
    model = LocalOutlierFactor(k, contamination=0.05).fit(frame(spark, train))
    rows = model.transform(frame(spark, test)).collect()
    got = np.array([r["raw_score"] for r in sorted(rows, key=lambda r: r["id"])])
    np.testing.assert_allclose(got, want, rtol=1e-6)
    assert model.state["threshold"] == pytest.approx(np.quantile(own, 0.95))


def test_one_class_svm_flags_nu_of_the_training_rows(spark):
    df = frame(spark, np.random.default_rng(8).normal(size=(400, 2)))
    for kernel in ("linear", "poly"):
        model = OneClassSVM(nu=0.1, kernel=kernel).fit(df)
        assert model.transform(df).filter("prediction = 1").count() == 40
    with pytest.raises(ValueError, match="kernel"):
        OneClassSVM(kernel="precomputed")


def exact_one_class_scores(x, nu, gamma):
    """f - rho of the kernel solution, by projected gradient on the dual."""
    n, cap = len(x), 1 / (nu * len(x))
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))

    def project(v):
        low, high = v.min() - 1, v.max()
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
        return np.clip(v - low, 0, cap)

    a, step = np.full(n, 1 / n), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(5000):
        a = project(a - step * (kernel @ a))
    f = kernel @ a
    return f - np.median(f[(a > 1e-6) & (a < cap - 1e-6)])


def test_one_class_svm_is_near_the_kernel_solution(spark):
    x = np.random.default_rng(11).normal(size=(300, 2))
    exact = exact_one_class_scores(x, 0.1, 0.5)
    model = OneClassSVM(nu=0.1, n_components=1500).fit(frame(spark, x))
    rows = sorted(model.transform(frame(spark, x)).collect(), key=lambda r: r["id"])
    score = np.array([-r["anomaly_score"] for r in rows])
    assert np.corrcoef(score, exact)[0, 1] > 0.95
    clear = np.abs(exact) > 0.05
    assert ((score < 0) == (exact < 0))[clear].mean() > 0.95


def test_one_class_svm_is_the_same_on_a_doubled_table(spark):
    x = np.random.default_rng(12).normal(size=(300, 2))
    for kernel in ("rbf", "sigmoid"):
        settings = dict(nu=0.1, kernel=kernel, n_components=100, max_iter=4)
        once = OneClassSVM(**settings).fit(frame(spark, x))
        twice = OneClassSVM(**settings).fit(
            frame(spark, np.concatenate([x, x])).repartition(16)
        )
        a, b = (
            [r["raw_score"] for r in sorted(m.transform(frame(spark, x)).collect(), key=lambda r: r["id"])]
            for m in (once, twice)
        )
        assert np.corrcoef(a, b)[0, 1] > 0.99


def test_isolation_forest_does_not_hang_on_partitions(spark):
    x = np.random.default_rng(13).normal(size=(2000, 3))
    fits = [
        IsolationForest(contamination=0.02, n_estimators=20, keys=["id"]).fit(frame(spark, x).repartition(p))
        for p in (2, 16)
    ]
    a, b = ([r["raw_score"] for r in sorted(m.transform(frame(spark, x)).collect(), key=lambda r: r["id"])] for m in fits)
    np.testing.assert_allclose(a, b)


def test_depth_beyond_the_deepest_tree_is_an_error():
    from tabloom.operators.models.trees import train_forest_classifier

    class Columns:
        columns = ["features", "label"]

    with pytest.raises(ValueError, match="max_depth"):
        train_forest_classifier(Columns(), max_depth=31)


def test_permutation_importance_of_a_known_model(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 3)) * [1.0, 2.0, 1.0]
    y = 3 * x[:, 0] + x[:, 1]
    df = frame(spark, x, y)
    rows = permutation_importance(
        train_linear(df), df, "regression", feature_names=["a", "b", "c"], keys=["id"],
        repeats=5,
    ).collect()
    got = {r["feature"]: r["importance"] for r in rows}
    # Shuffling adds 2 w^2 var(x) to the squared error.
    assert got["a"] == pytest.approx(18 * x[:, 0].var(), rel=0.1)
    assert got["b"] == pytest.approx(2 * x[:, 1].var(), rel=0.1)
    assert got["c"] == pytest.approx(0.0, abs=1e-6)


def test_permutation_keeps_every_value(spark):
    """A model that returns the feature shows that a shuffle only moves values."""
    from pyspark.ml import Transformer

    class First(Transformer):
        def _transform(self, dataset):
            return dataset.withColumn("prediction", vector_to_array("features")[0])

    df = frame(spark, np.arange(500.0).reshape(-1, 1), np.zeros(500))
    rows = permutation_importance(First(), df, "regression", keys=["id"], repeats=3).collect()
    assert rows[0]["importance"] == pytest.approx(0.0, abs=1e-6)


def test_permutation_follows_the_ranks_of_keyed_hashes(spark, monkeypatch):
    """Every feature and repeat against a sort in plain Python, over many hash buckets."""
    import hashlib

    from pyspark.ml import Transformer

    from tabloom.functions import permute

    class Weighted(Transformer):
        def _transform(self, dataset):
            x = vector_to_array("features")
            return dataset.withColumn("prediction", x[0] + 10 * x[1])

    monkeypatch.setattr(permute, "ROWS_PER_BUCKET", 40)
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(700, 2)), rng.normal(size=700)
    df = frame(spark, x, y)
    ids = [r["id"] for r in df.orderBy("id").collect()]

    def order(prefix):
        return sorted(range(700), key=lambda i: hashlib.md5(f"{prefix}:{ids[i]}".encode()).hexdigest())

    vectors = {r["id"]: (r["v"], r["label"]) for r in df.select("id", vector_to_array("features").alias("v"), "label").collect()}
    x = np.array([vectors[i][0] for i in ids])
    y = np.array([vectors[i][1] for i in ids])
    base = order("7")
    loss = ((y - x[:, 0] - 10 * x[:, 1]) ** 2).mean()
    want = {}
    for f in range(2):
        drops = []
        for r in range(4):
            changed = x[base].copy()
            changed[:, f] = x[order(f"7:{f}:{r}"), f]
            drops.append(((y[base] - changed[:, 0] - 10 * changed[:, 1]) ** 2).mean() - loss)
        want[f"feature_{f}"] = (np.mean(drops), np.std(drops))
    found = permutation_importance(Weighted(), df, "regression", keys=["id"], repeats=4, seed=7)
    for r in found.collect():
        assert (r["importance"], r["importance_std"]) == pytest.approx(want[r["feature"]], rel=1e-9)
    spread = permutation_importance(Weighted(), df.repartition(13), "regression", keys=["id"], repeats=4, seed=7)
    assert {r["feature"]: round(r["importance"], 9) for r in spread.collect()} == {
        k: round(v[0], 9) for k, v in want.items()
    }


@pytest.mark.parametrize("copies", [1, 3, 200])
def test_permutation_over_stretches_of_ranks(spark, monkeypatch, copies):
    """Values sent straight to their stretch of ranks, and ranks numbered first where keys repeat."""
    import hashlib

    from tabloom.functions import permute

    monkeypatch.setattr(permute, "ROWS_PER_STRETCH", 37)
    x = np.random.default_rng(13).normal(size=(700, 2)).round(1)
    keys = [f"k{i // copies}" for i in range(700)]
    rows = spark.createDataFrame(
        [(k, v.tolist(), float(v.sum())) for k, v in zip(keys, x)], "key string, x array<double>, label double"
    )

    def order(prefix, own):
        return sorted(range(700), key=lambda i: (hashlib.md5(f"{prefix}:{keys[i]}".encode()).hexdigest(), own(i)))

    base = order("5", lambda i: (*x[i], x[i].sum()))
    want = sorted(
        (f * 2 + r, *x[b], x[v, f]) for f in range(2) for r in range(2)
        for b, v in zip(base, order(f"5:{f}:{r}", lambda i: x[i, f]))
    )
    found = permute.permuted_columns(rows, 700, 2, 2, 5)
    assert sorted((r["series"], *r["x"], r["value"]) for r in found.collect()) == want


def test_permutation_moves_values_once(spark):
    """One exchange of values and one of base rows: no value is sorted or moved by its rank again."""
    from tabloom.functions.permute import permuted_columns

    rows = spark.range(100).selectExpr("string(id) AS key", "array(double(id)) AS x", "double(id) AS label")
    plan = permuted_columns(rows, 100, 1, 2, 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning(stretch") == 2
    assert "Window" not in physical and "Exchange hashpartitioning(rank" not in physical


@pytest.mark.parametrize("copies", [1, 200])
def test_permutation_in_rounds(spark, monkeypatch, folder, copies):
    """Few permutations at a time: the same scores, base rows moved once, and no shuffle files kept."""
    from tabloom.functions import permute

    x = np.random.default_rng(16).normal(size=(600, 3))
    df = frame(spark, x, x[:, 0] + 2 * x[:, 1]).withColumn("key", F.expr(f"floor(monotonically_increasing_id() / {copies})"))
    df.write.parquet(f"{folder}/rows")
    df = spark.read.parquet(f"{folder}/rows")
    monkeypatch.setattr(permute, "ROWS_PER_STRETCH", 47)

    def found():
        rows = permutation_importance(train_linear(df), df, "regression", keys=["key"], repeats=2).collect()
        return {r["feature"]: (r["importance"], r["importance_std"]) for r in rows}

    want = found()
    monkeypatch.setattr(permute, "VALUES_AT_ONCE", 1300)
    made = []
    rounds = permute.permutation_rounds

    def watched(*args):
        for part in rounds(*args):
            made.append(part)
            yield part

    monkeypatch.setattr("tabloom.operators.importance.permutation_rounds", watched)
    got = found()
    assert len(made) == 3 and got.keys() == want.keys()
    assert all(got[f] == pytest.approx(want[f], rel=1e-9, abs=1e-9) for f in want)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    if copies == 1:
        for part in made:
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(stretch") == 1


def test_permutation_ships_numbers_and_stays_in_the_jvm(spark):
    """No vector travels per feature and repeat: the exchanges of swaps carry three narrow columns."""
    from pyspark.ml import Transformer

    class First(Transformer):
        def _transform(self, dataset):
            return dataset.withColumn("prediction", vector_to_array("features")[0])

    df = frame(spark, np.arange(40.0).reshape(-1, 4), np.zeros(10))
    plan = permutation_importance(First(), df, "regression", keys=["id"], repeats=2)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "Python" not in physical and "Arrow" not in physical and "Pandas" not in physical


def test_permutation_without_keys_and_without_rows(spark):
    df = frame(spark, np.arange(60.0).reshape(-1, 2), np.zeros(30))
    model = train_linear(df)
    assert permutation_importance(model, df.drop("id"), "regression", repeats=2).count() == 2
    with pytest.raises(ValueError, match="at least 1 row"):
        permutation_importance(model, df.limit(0), "regression", keys=["id"])


# --- memory and shuffles of large tables -----------------------------------

def test_blocks_of_neighbours_grow_with_the_table(spark, monkeypatch):
    """Copies of a row: one for each block of the other side, of which there are few."""
    from tabloom.operators.models import neighbors

    rng = np.random.default_rng(14)
    x = rng.normal(size=(9000, 6))
    points = spark.createDataFrame([(f"{i:05}", v.tolist()) for i, v in enumerate(x)], "id string, x array<double>")
    made = []
    blocks = neighbors._block_counts
    monkeypatch.setattr(neighbors, "_block_counts", lambda *a: made.append(blocks(*a)) or made[-1])
    monkeypatch.setattr(neighbors, "CHUNK_DISTANCES", 100_000)
    found = neighbors.nearest_neighbors(points.limit(2000), points, 3, same=True).collect()
    assert sum(made[0].values()) <= 2 and sum(made[1].values()) <= 9000 / neighbors.QUERY_BLOCK + 1
    large = neighbors._largest_block(spark.range(600_000), points, 600_000)
    assert large == neighbors.LARGEST_BLOCK and neighbors._largest_block(points, points, 9000) < large
    assert len(found) == 3 * 2000
    for r in found[::97]:
        q = int(r["qid"])
        near = np.argsort(np.where(np.arange(9000) == q, np.inf, ((x - x[q]) ** 2).sum(1)))[:3]
        assert int(r["pid"]) in near


@pytest.mark.parametrize("cells", [10_000, 60])
def test_neighbours_in_rounds(spark, monkeypatch, cells):
    """Few copies at a time: every query is searched once, and no task gives many copies together."""
    from tabloom.operators.models import neighbors

    rng = np.random.default_rng(17)
    p, q = rng.normal(size=(400, 24)), rng.normal(size=(150, 24))
    monkeypatch.setattr(neighbors, "NUMBERS_AT_ONCE", 10_000)
    monkeypatch.setattr(neighbors, "COPIES_AT_ONCE", 50)
    rounds = neighbors._rounds
    made = []
    monkeypatch.setattr(neighbors, "_rounds", lambda *a: made.append(rounds(*a)) or made[-1])
    sizes = spark.sparkContext.accumulator(0)
    measure = neighbors._block_neighbors

    def watched(left, right, *rest):
        sizes.add(len(left) + len(right))
        return measure(left, right, *rest)

    monkeypatch.setattr(neighbors, "_block_neighbors", watched)
    found = neighbors.nearest_neighbors(
        points_of(spark, q, "q"), points_of(spark, p), 5, points_per_cell=cells, query_block=40, point_block=100
    ).toPandas()
    assert len(made[0]) > 1 and sizes.value > 0
    blocks = [(cell, b) for asked in made[0] for cell, (first, last) in asked.items() for b in range(first, last + 1)]
    assert len(blocks) == len(set(blocks))
    want = brute_neighbors(q, p, 5, False)
    for i, near in found.groupby("qid")["dist"]:
        assert sorted(near) == pytest.approx(want[int(i[1:])], rel=1e-9)
    assert len(found) == 750 and found["qid"].nunique() == 150


def test_bounds_of_many_points(spark, monkeypatch):
    """Minima of groups give the same neighbours as a sort, with ties and equal points."""
    from tabloom.operators.models import neighbors

    rng = np.random.default_rng(18)
    x = np.round(rng.normal(size=(2500, 2)), 1)
    rows = pd.DataFrame({"id": [f"{i:04}" for i in range(2500)], "x": list(x)})
    monkeypatch.setattr(neighbors, "GROUP", 16)
    monkeypatch.setattr(neighbors, "CANDIDATES", 300)
    found = neighbors._block_neighbors(rows, rows, 4, True)
    for i, near in found.groupby("qid"):
        d = np.sqrt(((x - x[int(i)]) ** 2).sum(1))
        d[int(i)] = np.inf
        assert near["pid"].astype(int).tolist() == np.lexsort((np.arange(2500), d))[:4].tolist()


def test_one_class_svm_holds_features_of_a_few_rows(spark, monkeypatch):
    """No matrix of random features has more rows than a chunk; sums and scores don't depend on it."""
    from tabloom.operators.models import one_class_svm

    x = np.random.default_rng(15).normal(size=(1300, 4))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").coalesce(1)

    def total(part):
        assert len(part) <= 512
        return part.sum(axis=0)

    assert one_class_svm._summed(rows, 4, total) == pytest.approx(x.sum(axis=0))
    model = one_class_svm.OneClassSVMModel(
        {"kernel": "linear", "gamma": 1.0, "rho": 0.0, "width": 4, "n_components": 4, "seed": 1,
         "weights": [1.0, 2.0, 3.0, 4.0]}, {},
    )
    got = [r["m"] for r in rows.select(model.margin(rows, F.col("x")).alias("m")).collect()]
    assert got == pytest.approx(x @ [1.0, 2.0, 3.0, 4.0])


# --- neighbours by projections ---------------------------------------------


def points_of(spark, x, prefix=""):
    rows = [(f"{prefix}{i}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id string, x array<double>")


def near_sets(rows):
    out = {}
    for r in rows:
        out.setdefault(r["qid"], {})[r["pid"]] = r["dist"]
    return out


def test_projections_find_nine_in_ten_neighbours(spark):
    """All embeddings; distances are exact, and the pairs measured grow with the rows."""
    from tabloom.operators.models.neighbors import nearest_neighbors
    from tabloom.operators.models.projections import ProjectionForest, approximate_neighbors, leaf_sizes

    pairs = {}
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        points = df.selectExpr("cast(vec_id AS string) AS id", "cast(embedding AS array<double>) AS x").cache()
        n = points.count()
        forest = ProjectionForest.fit(points, n, 24, 128)
        sizes = [r["n"] for r in leaf_sizes(forest[1]).collect()]
        assert sum(sizes) == 24 * n
        pairs[n] = sum(s * s for s in sizes)
        want = near_sets(nearest_neighbors(points, points, 20, same=True).collect())
        got = near_sets(approximate_neighbors(points, points, 20, same=True, forest=forest).collect())
        assert {q: len(p) for q, p in got.items()} == {q: 20 for q in want}
        hits = sum(len(got[q].keys() & want[q].keys()) for q in want)
        assert hits >= 0.9 * 20 * n
        assert all(got[q][p] == pytest.approx(want[q][p]) for q in want for p in got[q].keys() & want[q].keys())
    (small, few), (large, many) = sorted(pairs.items())
    assert many / few <= 1.5 * large / small


def test_projections_split_crowded_and_flat_data(spark, monkeypatch):
    """Points on one line, points that crowd in one corner, and points that no direction splits."""
    from tabloom.operators.models import projections

    monkeypatch.setattr(projections, "SAMPLE_ROWS", 200)
    rng = np.random.default_rng(3)
    line = np.outer(np.arange(600.0), np.ones(4))
    crowd = np.vstack([rng.normal(size=(570, 4)) * 1e-3, rng.normal(size=(30, 4)) * 100])
    for x in (line, crowd):
        points = points_of(spark, x)
        _, leaves = projections.ProjectionForest.fit(points, len(x), 4, 50)
        assert max(r["n"] for r in projections.leaf_sizes(leaves).collect()) <= 60
        assert leaves.groupBy("band").count().filter(f"count <> {len(x)}").count() == 0
    same = points_of(spark, np.ones((300, 4)))
    got = near_sets(projections.approximate_neighbors(same, same, 3, same=True, bands=2, bucket_rows=50).collect())
    assert len(got) == 300 and all(len(p) == 3 for p in got.values())


def test_projections_of_other_queries_and_blocks(spark, monkeypatch):
    from tabloom.operators.models import projections
    from tabloom.operators.models.neighbors import nearest_neighbors

    monkeypatch.setattr(projections, "POINT_BLOCK", 40)
    monkeypatch.setattr(projections, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8)) * 20
    points = points_of(spark, centers[rng.integers(0, 6, 500)] + rng.normal(size=(500, 8)))
    queries = points_of(spark, np.vstack([centers + rng.normal(size=(6, 8)), [[1e4] * 8]]), "q")
    want = near_sets(nearest_neighbors(queries, points, 5).collect())
    got = near_sets(projections.approximate_neighbors(queries, points, 5, bands=12, bucket_rows=64).collect())
    assert got.keys() == want.keys() and all(len(p) == 5 for p in got.values())
    assert sum(len(got[q].keys() & want[q].keys()) for q in want) >= 0.9 * 35
    # Fewer points than neighbours asked for: all of them, found exactly.
    few = points.limit(3).cache()
    got = near_sets(projections.approximate_neighbors(queries, few, 5).collect())
    assert all(len(p) == 3 for p in got.values()) and len(got) == 7


def test_local_outlier_factor_by_projections(spark, folder):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(400, 6)), rng.normal(size=(400, 6)) + 12, rng.uniform(-40, 40, size=(12, 6))])
    df = frame(spark, x)
    exact = LocalOutlierFactor(15).fit(df)
    near = LocalOutlierFactor(15, search="projections", bands=20, bucket_rows=100).fit(df)
    near.write().overwrite().save(f"{folder}/lof")
    from tabloom.operators.models.lof import LocalOutlierFactorModel

    loaded = LocalOutlierFactorModel.read().load(f"{folder}/lof")
    scores = {}
    for name, model in (("exact", exact), ("near", loaded)):
        scores[name] = {r["id"]: r["raw_score"] for r in model.transform(df).collect()}
    planted = range(800, 812)
    ids = sorted(scores["exact"])
    rank = {name: sorted(ids, key=lambda i: -s[i])[:12] for name, s in scores.items()}
    assert len(set(rank["near"]) & set(rank["exact"])) >= 11
    assert np.mean([abs(scores["near"][i] / scores["exact"][i] - 1) for i in ids]) < 0.05
    with pytest.raises(ValueError, match="search"):
        LocalOutlierFactor(search="guess")


def test_line_search_evaluates_all_steps_at_once():
    """One call an iteration, and the minimum of a badly scaled quadratic."""
    from tabloom.operators.models.one_class_svm import STEPS, _lbfgs

    scales = np.array([1.0, 30.0, 0.02, 5.0])
    target = np.array([3.0, -1.0, 10.0, 0.5])
    calls = []

    def evaluate(points):
        calls.append(len(points))
        return [(0.5 * float(scales @ (p - target) ** 2), scales * (p - target)) for p in points]

    found = _lbfgs(evaluate, np.zeros(4), 60, tol=1e-6)
    assert np.abs(found - target).max() < 0.05
    assert calls[0] == 1 and set(calls[1:]) == {len(STEPS)} and len(calls) <= 61
