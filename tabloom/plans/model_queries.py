"""Queries that train, explain and tune models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.importance import model_importances, permutation_importance
from ..operators.models.isolation_forest import IsolationForest
from ..operators.models.linear import (
    train_elasticnet,
    train_lasso,
    train_linear,
    train_logistic,
    train_ridge,
)
from ..operators.models.lof import LocalOutlierFactor
from ..operators.models.neighbors import nearest_neighbors
from ..operators.models.one_class_svm import OneClassSVM
from ..operators.models.projections import ProjectionForest, approximate_neighbors, leaf_sizes
from ..operators.split import split_rows
from ..operators.tuning import search_candidates
from .jobs import score, train_tabular, tune
from .registry import query, table

MOMENTS_SQL = """SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
  covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx
  FROM lineitem"""


def line_sql(slope: str) -> str:
    return f"""WITH m AS ({MOMENTS_SQL}), s AS (SELECT *, {slope} AS w FROM m)
      SELECT round(w, 3) AS slope, round(my - w * mx, 2) AS intercept FROM s"""


def _line(spark: SparkSession, folder: str, train) -> DataFrame:
    df = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        table(spark, folder, "lineitem").select(
            "l_quantity", F.col("l_extendedprice").alias("label")
        )
    )
    model = train(df)
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 3), round(float(model.intercept), 2))],
        "slope double, intercept double",
    )


@query("linear_regression", line_sql("sxy / sxx"))
def linear_regression(spark, folder):
    return _line(spark, folder, train_linear)


@query("ridge_regression", line_sql("sxy / (sxx + 100000.0)"))
def ridge_regression(spark, folder):
    return _line(spark, folder, lambda df: train_ridge(df, alpha=100000.0))


@query(
    "lasso_regression",
    line_sql("sign(sxy) * greatest(abs(sxy) / n - 1.0, 0) / (sxx / n)"),
)
def lasso_regression(spark, folder):
    return _line(spark, folder, lambda df: train_lasso(df, alpha=1.0))


@query(
    "elasticnet_regression",
    line_sql("sign(sxy) * greatest(abs(sxy) / n - 1.5 * 0.4, 0) / (sxx / n + 1.5 * 0.6)"),
)
def elasticnet_regression(spark, folder):
    return _line(spark, folder, lambda df: train_elasticnet(df, alpha=1.5, l1_ratio=0.4))


@query(
    "train_and_evaluate",
    """WITH k AS (SELECT l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY
           md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey))
             <= ceil(0.2 * count(*) OVER ()) AS test FROM lineitem),
         w AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM k WHERE NOT test),
         e AS (SELECT y, a * x + b AS p FROM k, w WHERE test),
         m AS (SELECT avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM e)
       SELECT 'rmse' AS metric, round(sqrt(mse), 2) AS value FROM m
       UNION ALL SELECT 'mae', round(mae, 2) FROM m
       UNION ALL SELECT 'r2', round(1 - mse / v, 6) FROM m""",
)
def train_and_evaluate(spark, folder):
    """The whole job: split, preprocess, train, evaluate."""
    done = train_tabular(
        table(spark, folder, "lineitem"), "l_extendedprice", "regression_linear",
        features=["l_quantity"], keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )

    return done.metrics_df(spark).select(
        "metric",
        F.when(F.col("metric") == "r2", F.round("value", 6))
        .otherwise(F.round("value", 2)).alias("value"),
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, folder, "labels").join(documents, "doc_id")


DOCUMENT_FEATURES = ["lang", "source", "n_chars", "toxic"]


def _classifier(spark, folder, model_type: str, **params) -> DataFrame:
    done = train_tabular(
        labelled_documents(spark, folder), "quality", model_type, params,
        features=DOCUMENT_FEATURES, keys=["doc_id"],
    )
    return done.metrics_df(spark)


@query("classify_logistic")
def classify_logistic(spark, folder):
    return _classifier(spark, folder, "classification_logreg", class_weight=True)


@query("classify_forest")
def classify_forest(spark, folder):
    return _classifier(spark, folder, "classification_rf", n_estimators=50, max_depth=8)


@query("classify_boosted")
def classify_boosted(spark, folder):
    return _classifier(spark, folder, "classification_xgboost", n_estimators=10, max_depth=4)


@query("regress_forest")
def regress_forest(spark, folder):
    done = train_tabular(
        table(spark, folder, "lineitem"), "l_extendedprice", "regression_rf",
        {"n_estimators": 20, "max_depth": 6},
        features=["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
        keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )
    return done.metrics_df(spark)


NEWTON_SQL = """WITH RECURSIVE d AS (SELECT l_quantity / 50.0::DOUBLE AS x,
    count(*)::DOUBLE AS n, sum((l_quantity * l_quantity > l_extendedprice / 100)::INT)::DOUBLE AS k
    FROM lineitem GROUP BY l_quantity),
  it AS (SELECT 0 AS step, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b
    UNION ALL
    SELECT step + 1, w - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12),
      b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
    FROM (SELECT step, w, b, w / 0.5 + sum(n * p * x - k * x) AS g1, sum(n * p - k) AS g2,
        1 / 0.5 + sum(n * p * (1 - p) * x * x) AS h11, sum(n * p * (1 - p) * x) AS h12,
        sum(n * p * (1 - p)) AS h22
      FROM (SELECT step, w, b, x, n, k, 1 / (1 + exp(-(w * x + b))) AS p FROM it, d)
      GROUP BY step, w, b) WHERE step < 25)
  SELECT round(w, 3) AS slope, round(b, 3) AS intercept FROM it WHERE step = 25"""


@query("logistic_regression", NEWTON_SQL)
def logistic_regression(spark, folder):
    """Penalised logistic regression; the SQL twin runs Newton's method."""
    lineitem = table(spark, folder, "lineitem").select(
        (F.col("l_quantity") / 50).alias("x"),
        (F.col("l_quantity") * F.col("l_quantity") > F.col("l_extendedprice") / 100)
        .cast("double").alias("label"),
    )
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(lineitem)
    model = train_logistic(df, C=0.5)
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 3), round(float(model.intercept), 3))],
        "slope double, intercept double",
    )


# --- anomalies -------------------------------------------------------------

def embedding_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x")
    )


@query(
    "nearest_neighbors",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings),
         d AS (SELECT a.vec_id AS q, b.vec_id AS p, array_distance(a.x, b.x) AS dist
               FROM e a JOIN e b ON a.vec_id <> b.vec_id)
       SELECT q AS qid, p AS pid, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER
         (PARTITION BY q ORDER BY dist, p) AS k FROM d) WHERE k <= 5""",
)
def nearest_neighbors_query(spark, folder):
    points = embedding_vectors(spark, folder).select(F.col("vec_id").cast("string").alias("id"), "x")
    found = nearest_neighbors(points, points, 5, same=True)
    return found.select(
        F.col("qid").cast("long").alias("qid"), F.col("pid").cast("long").alias("pid"),
        F.round("dist", 6).alias("dist"),
    )


@query(
    "projection_neighbors",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings),
         d AS (SELECT a.vec_id AS q, row_number() OVER (PARTITION BY a.vec_id
             ORDER BY array_distance(a.x, b.x), b.vec_id) AS k
           FROM e a JOIN e b ON a.vec_id <> b.vec_id)
       SELECT count(*) AS neighbors, TRUE AS recall_of_90, TRUE AS pairs_linear FROM d WHERE k <= 20""",
)
def projection_neighbors_query(spark, folder):
    """Neighbours by projections against the exact ones: all found, recall, and pairs measured."""
    points = embedding_vectors(spark, folder).select(F.col("vec_id").cast("string").alias("id"), "x")
    bands, rows = 24, 128
    n = points.count()
    forest = ProjectionForest.fit(points, n, bands, rows)
    pairs = leaf_sizes(forest[1]).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    found = approximate_neighbors(points, points, 20, same=True, forest=forest).withColumn("hit", F.lit(1))
    exact = nearest_neighbors(points, points, 20, same=True)
    both = exact.join(found.select("qid", "pid", "hit"), ["qid", "pid"], "left")
    # One row of two aggregates.
    return both.agg(F.count(F.lit(1)).alias("neighbors"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).crossJoin(
        F.broadcast(pairs)
    ).select(
        "neighbors", (F.col("recall") >= 0.9).alias("recall_of_90"),
        (F.col("pairs") <= F.lit(n * bands * rows)).alias("pairs_linear"),
    )


@query(
    "local_outlier_factor",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS x, row_number() OVER
           (ORDER BY md5('42:' || vec_id)) <= ceil(0.2 * count(*) OVER ()) AS test FROM embeddings),
         tr AS (SELECT vec_id, x FROM e WHERE NOT test), te AS (SELECT vec_id, x FROM e WHERE test),
         nn AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS p, array_distance(a.x, b.x) AS d,
             row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(a.x, b.x), b.vec_id)
               AS k FROM tr a JOIN tr b ON a.vec_id <> b.vec_id) WHERE k <= 20),
         kd AS (SELECT q, max(d) AS kdist FROM nn GROUP BY q),
         lrd AS (SELECT nn.q, 1 / (avg(greatest(d, kdist)) + 1e-10) AS lrd
                 FROM nn JOIN kd ON kd.q = nn.p GROUP BY nn.q),
         tn AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS p, array_distance(a.x, b.x) AS d,
             row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(a.x, b.x), b.vec_id)
               AS k FROM te a, tr b) WHERE k <= 20)
       SELECT tn.q AS vec_id, round(avg(lrd) * (avg(greatest(d, kdist)) + 1e-10), 6) AS raw_score,
         CASE WHEN avg(lrd) * (avg(greatest(d, kdist)) + 1e-10) > 1.5 THEN 1.0 ELSE 0.0 END::DOUBLE
           AS prediction
       FROM tn JOIN kd ON kd.q = tn.p JOIN lrd ON lrd.q = tn.p GROUP BY tn.q""",
)
def local_outlier_factor(spark, folder):
    parts = split_rows(embedding_vectors(spark, folder), 0.2, seed=42, keys=["vec_id"])
    parts = parts.withColumn("features", array_to_vector("x"))
    model = LocalOutlierFactor(n_neighbors=20).fit(parts.filter("split = 'train'"))
    scored = model.transform(parts.filter("split = 'test'").select("vec_id", "features"))
    return scored.select("vec_id", F.round("raw_score", 6).alias("raw_score"), "prediction")


def lineitem_vectors(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return VectorAssembler(
        inputCols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], outputCol="features"
    ).transform(lineitem)


@query("isolation_forest")
def isolation_forest_query(spark, folder):
    df = lineitem_vectors(spark, folder)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    scored = IsolationForest(contamination=0.01, keys=keys).fit_scored(df, keys)[1]
    return scored.select(
        *keys, F.round("anomaly_score", 6).alias("anomaly_score"), "prediction"
    )


@query("one_class_svm")
def one_class_svm_query(spark, folder):
    df = embedding_vectors(spark, folder).withColumn("features", array_to_vector("x"))
    scored = OneClassSVM(nu=0.05).fit(df.select("vec_id", "features")).transform(df)
    return scored.select(
        "vec_id", F.round("anomaly_score", 6).alias("anomaly_score"), "prediction"
    )


# --- explanation, search, scoring ------------------------------------------

@query(
    "coefficient_importance",
    f"""WITH m AS ({MOMENTS_SQL}) SELECT 'num__l_quantity' AS feature,
          round(abs(sxy / sxx), 3) AS importance, 'coefficient' AS importance_type FROM m""",
)
def coefficient_importance(spark, folder):
    df = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        table(spark, folder, "lineitem").select(
            "l_quantity", F.col("l_extendedprice").alias("label")
        )
    )
    rows = model_importances(spark, train_linear(df), ["num__l_quantity"])
    return rows.withColumn("importance", F.round("importance", 3))


#: The row of rank i by the base order gets the value of the row of rank i by the order of (feature, repeat).
PERMUTATION_SQL = """WITH d AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey
      AS k, [l_quantity, l_discount, l_tax]::DOUBLE[] AS x, l_quantity * 3 + l_discount * 100 AS y FROM lineitem),
    base AS (SELECT x, y, row_number() OVER (ORDER BY md5('42:' || k), k, x, y) AS i FROM d),
    vals AS (SELECT f, r, x[f + 1] AS v, row_number() OVER
        (PARTITION BY f, r ORDER BY md5('42:' || f || ':' || r || ':' || k), x[f + 1]) AS i
      FROM d, range(0, 3) AS a(f), range(0, 10) AS b(r)),
    scores AS (SELECT f, r, -avg(power(y - 3 * (CASE f WHEN 0 THEN v ELSE x[1] END)
        - 100 * (CASE f WHEN 1 THEN v ELSE x[2] END), 2)) AS score
      FROM base JOIN vals USING (i) GROUP BY f, r)
  SELECT ['l_quantity', 'l_discount', 'l_tax'][f + 1] AS feature, abs(round(avg(-score), 4)) AS importance,
    abs(round(stddev_pop(-score), 4)) AS importance_std FROM scores GROUP BY f"""


@query("permutation_importance", PERMUTATION_SQL)
def permutation_importance_query(spark, folder):
    """All rows of the table, three features, ten repeats, one job."""
    lineitem = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_discount", "l_tax",
        (F.col("l_quantity") * 3 + F.col("l_discount") * 100).alias("label"),
    )
    names = ["l_quantity", "l_discount", "l_tax"]
    df = VectorAssembler(inputCols=names, outputCol="features").transform(lineitem)
    found = permutation_importance(
        train_linear(df), df, "regression", feature_names=names,
        keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )
    return found.select(
        "feature", F.abs(F.round("importance", 4)).alias("importance"),
        F.abs(F.round("importance_std", 4)).alias("importance_std"),
    )


@query("tune_ridge")
def tune_ridge(spark, folder):
    _, search = tune(
        table(spark, folder, "orders"), "o_totalprice", "regression_ridge", n_trials=5,
        features=["o_custkey", "o_orderstatus", "o_orderpriority"], keys=["o_orderkey"],
    )
    return search.history(spark)


def _ridge_search_sql(n_trials: int = 5) -> str:
    """Ridge on one scaled feature in closed form, and the early stop of the search."""
    trials = ", ".join(
        f"({i}, {c['alpha']}, '{str(c).replace(chr(39), chr(39) * 2)}')"
        for i, c in enumerate(search_candidates("regression_ridge", n_trials))
    )
    return f"""WITH k AS (SELECT s_nationkey AS x, s_acctbal AS y, row_number() OVER (ORDER BY
        md5('42:' || s_suppkey)) <= ceil(0.2 * count(*) OVER ()) AS test FROM supplier),
      m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n,
        covar_pop(x, y) * count(*) / stddev_pop(x) AS sxy FROM k WHERE NOT test),
      c(trial, alpha, params) AS (VALUES (-1, 1.0, ''), {trials}),
      s AS (SELECT trial, params, -sqrt(avg(power(y - my - sxy / (n + alpha) * (x - mx) / sx, 2))) AS score
        FROM c, m, k WHERE test GROUP BY trial, params),
      b AS (SELECT *, max(score) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s),
      i AS (SELECT *, score > best AS improved, trial - coalesce(max(CASE WHEN score > best THEN trial END)
        OVER (ORDER BY trial), -1) AS idle FROM b WHERE trial >= 0),
      r AS (SELECT *, coalesce(max(idle) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2
        AS ran FROM i)
      SELECT trial::INTEGER AS trial, params, round(score, 6) AS score, round(best, 6) AS best_before, improved
      FROM r WHERE ran"""


@query("tune_ridge_by_moments", _ridge_search_sql())
def tune_ridge_by_moments(spark, folder):
    """All trials solved from the moments of one pass."""
    _, search = tune(
        table(spark, folder, "supplier"), "s_acctbal", "regression_ridge", n_trials=5,
        features=["s_nationkey"], keys=["s_suppkey"],
    )
    return search.history(spark).select(
        "trial", "params", F.round("score", 6).alias("score"), F.round("best_before", 6).alias("best_before"),
        "improved",
    )


@query("score_classifier")
def score_classifier(spark, folder):
    """Train on the labelled documents, then score all documents."""
    done = train_tabular(
        labelled_documents(spark, folder), "quality", "classification_logreg",
        features=["lang", "source", "n_chars"], keys=["doc_id"],
    )
    batch = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return score(done.bundle, batch)
