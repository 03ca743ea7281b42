"""Queries that run whole jobs, through files and saved models, on whole tables.

Models without a closed form are checked by what must hold on every row: counts, ranges,
agreement of columns, planted cases, and being better than the trivial model.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import ensure_checkpoint_dir
from ..operators.models.isolation_forest import IsolationForest
from ..operators.models.one_class_svm import OneClassSVM
from ..operators.persistence import FittedStage
from ..operators.preprocess import TabularPreprocessor
from ..operators.profile import profile_table
from ..sources.bundles import load_bundle, save_bundle
from ..sources.readers import load_batch, load_labelled, read_table
from ..sources.writers import (
    append_history,
    history_row,
    write_predictions,
    write_quality_report,
    write_table,
)
from .jobs import bulk_fix, score, train_tabular
from .model_queries import DOCUMENT_FEATURES, labelled_documents
from .registry import query, table

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

#: Fit on four fifths of lineitem, as ``train_and_evaluate`` does.
LINE_FIT_SQL = """k AS (SELECT l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY
    md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey))
      <= ceil(0.2 * count(*) OVER ()) AS test FROM lineitem),
  w AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM k WHERE NOT test)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of one run, in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def price_model(spark: SparkSession, folder: str):
    return train_tabular(
        table(spark, folder, "lineitem"), "l_extendedprice", "regression_linear",
        features=["l_quantity"], keys=LINE_KEYS,
    )


@query(
    "bundle_round_trip",
    f"""WITH {LINE_FIT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          round(a * l_quantity + b, 2) AS prediction FROM lineitem, w""",
)
def bundle_round_trip(spark, folder):
    """Train, save, load and score: all rows of the table."""
    path = save_bundle(spark, price_model(spark, folder).bundle, scratch(spark, "bundle"))
    scored = score(load_bundle(spark, path), table(spark, folder, "lineitem"))
    return scored.select(*LINE_KEYS, F.round("prediction", 2).alias("prediction"))


@query(
    "prediction_file",
    f"""WITH {LINE_FIT_SQL} SELECT l_partkey, count(*) AS n, round(sum(a * l_quantity + b), 1) AS predicted
        FROM lineitem, w GROUP BY l_partkey""",
)
def prediction_file(spark, folder):
    """A batch from a CSV file, scored, written as CSV and read back."""
    batch = write_table(table(spark, folder, "lineitem").select("l_partkey", "l_quantity"), scratch(spark, "batch"))
    scored = score(price_model(spark, folder).bundle, load_batch(spark, batch))
    path = write_predictions(scored, scratch(spark, "predictions"), "lineitem.csv")
    return read_table(spark, path).groupBy(F.col("l_partkey").cast("long").alias("l_partkey")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("prediction").cast("double")), 1).alias("predicted")
    )


@query(
    "labelled_file",
    """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus""",
)
def labelled_file(spark, folder):
    """A labelled CSV source with inferred types."""
    path = write_table(
        table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), scratch(spark, "orders")
    )
    return load_labelled(spark, path, "o_orderstatus").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


REPORTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


@query(
    "quality_report_file",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null,
          count(DISTINCT {c}) AS n_distinct FROM orders""" for c in REPORTED
    ),
)
def quality_report_file(spark, folder):
    """The report of a whole table, written and read back."""
    profile = profile_table(table(spark, folder, "orders").select(*REPORTED))
    path = write_quality_report(spark, profile, scratch(spark, "report"), "orders")
    return spark.read.json(f"{path}/columns").select("column", "n_rows", "n_null", "n_distinct")


@query(
    "history_of_two_runs",
    """WITH m AS (SELECT avg((quality = toxic)::INT) AS a, avg(quality) AS p FROM labels)
       SELECT 'first' AS pipeline_name, round(a, 6) AS accuracy, round(p, 6) AS "precision", NULL::DOUBLE AS auc FROM m
       UNION ALL SELECT 'second', NULL, round(p, 6), round(a, 6) FROM m""",
)
def history_of_two_runs(spark, folder):
    """A classification and an anomaly run appended under an older header."""
    row = table(spark, folder, "labels").agg(
        F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("a"), F.avg("quality").alias("p")
    ).first()
    path = scratch(spark, "history")
    older = "pipeline_name string, accuracy double, precision double, auc double"
    spark.createDataFrame([], older).coalesce(1).write.option("header", True).csv(path)
    append_history(
        spark, path, history_row("first", "classification", {"accuracy": row["a"], "precision": row["p"]})
    )
    append_history(spark, path, history_row("second", "anomaly", {"roc_auc": row["a"], "precision": row["p"]}))
    kept = spark.read.option("header", True).csv(path)
    return kept.select("pipeline_name", *[
        F.round(F.col(c).cast("double"), 6).alias(c) for c in ("accuracy", "precision", "auc")
    ])


@query(
    "bulk_fix_files",
    """WITH p AS (SELECT p_size, p_brand FROM part), c AS (SELECT c_nationkey, c_mktsegment FROM customer)
       SELECT 'part' AS name, FALSE AS failed, (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS n_rows
       UNION ALL SELECT 'customer', FALSE, (SELECT count(*) FROM (SELECT DISTINCT * FROM c))
       UNION ALL SELECT 'missing', TRUE, NULL""",
)
def bulk_fix_files(spark, folder):
    """Profile, fix and write several files; one of them isn't there."""
    base = scratch(spark, "bulk")
    sources = {"missing": f"{base}/missing"}
    for name, columns in (("part", ["p_size", "p_brand"]), ("customer", ["c_nationkey", "c_mktsegment"])):
        sources[name] = write_table(table(spark, folder, name).select(*columns), f"{base}/{name}")
    rows = bulk_fix(spark, sources, f"{base}/out").collect()  # one row a source
    counted = [
        (r["name"], r["error"] is not None, None if r["cleaned"] is None else read_table(spark, r["cleaned"]).count())
        for r in rows
    ]
    return spark.createDataFrame(counted, "name string, failed boolean, n_rows long")


@query(
    "preprocess_numbers_only",
    """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS price,
         round((o_custkey - avg(o_custkey) OVER ()) / stddev_pop(o_custkey) OVER (), 6) AS customer, 2 AS width
       FROM orders WHERE o_orderkey % 3 <> 0""",
)
def preprocess_numbers_only(spark, folder):
    """All columns but the target are features, texts are left out, rows without a target go."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_orderkey") % 3 != 0, F.lit(1.0)).alias("y"),
    )
    fitted = TabularPreprocessor(
        target="y", task="regression", features=["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"],
        keys=["o_orderkey"], encode_categoricals=False,
    ).fit(orders)
    x = vector_to_array("features")
    return fitted.transform_training(orders).filter("o_orderkey % 3 <> 0").select(
        "o_orderkey", F.round(x[0], 6).alias("price"), F.round(x[1], 6).alias("customer"), F.size(x).alias("width")
    )


class PriceBand(FittedStage):
    """A user's own step: the price in bands as wide as a learned mean."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        width = self.state["width"]
        return dataset.withColumn("band", F.floor(F.col("p_retailprice") / F.lit(width)))


@query(
    "user_stage",
    """SELECT p_partkey, floor(p_retailprice / (SELECT avg(p_retailprice) / 4 FROM part))::BIGINT AS band FROM part""",
)
def user_stage(spark, folder):
    """A user-defined step, saved, loaded and applied."""
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    mean = part.agg(F.avg("p_retailprice")).first()[0]
    path = scratch(spark, "stage")
    PriceBand({"width": mean / 4}).write().overwrite().save(path)
    return PriceBand.read().load(path).transform(part).select("p_partkey", "band")


# --- models without a closed form --------------------------------------------

TEST_ROWS_SQL = """SELECT '{name}' AS model, ceil(0.2 * count(*))::BIGINT AS test_rows, TRUE AS holds FROM {table}"""


@query(
    "classifiers_beat_the_majority",
    " UNION ALL ".join(
        TEST_ROWS_SQL.format(name=n, table="labels JOIN documents USING (doc_id)")
        for n in ("classification_rf", "classification_xgboost", "classification_logreg")
    ),
)
def classifiers_beat_the_majority(spark, folder):
    """Test rows of a stratified split; accuracy no worse than that of the commonest class,
    but for the chance of a test set of n rows: 1 / sqrt(n)."""
    rows = []
    settings = {"classification_rf": {"n_estimators": 30, "max_depth": 6},
                "classification_xgboost": {"n_estimators": 10, "max_depth": 4}, "classification_logreg": {}}
    for name, params in settings.items():
        done = train_tabular(
            labelled_documents(spark, folder), "toxic", name, params,
            features=["lang", "source", "n_chars"], keys=["doc_id"],
        )
        counted = done.predictions.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # two classes
        total, most = sum(r["n"] for r in counted), max(r["n"] for r in counted)
        rows.append((name, total, done.metrics["accuracy"] >= most / total - total**-0.5))
    return spark.createDataFrame(rows, "model string, test_rows long, holds boolean")


@query("forest_explains_charges", TEST_ROWS_SQL.format(name="regression_rf", table="lineitem"))
def forest_explains_charges(spark, folder):
    """A forest finds the charged quantity: most of its variance, and importances that sum to 1."""
    charged = F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    done = train_tabular(
        table(spark, folder, "lineitem").withColumn("charged", charged), "charged", "regression_rf",
        {"n_estimators": 10, "max_depth": 6},
        features=["l_quantity", "l_discount", "l_tax"], keys=LINE_KEYS,
    )
    total = done.importances(spark).agg(F.sum("importance")).first()[0]
    spread = done.predictions.agg(F.stddev_pop("label")).first()[0]
    holds = done.metrics["rmse"] < 0.3 * spread and abs(total - 1.0) < 1e-6
    n = done.predictions.count()
    return spark.createDataFrame([("regression_rf", n, holds)], "model string, test_rows long, holds boolean")


@query(
    "scores_of_a_classifier",
    """SELECT lang, count(*) AS n, TRUE AS sums_to_one, TRUE AS likelier_class, TRUE AS positive_score
       FROM documents GROUP BY lang""",
)
def scores_of_a_classifier(spark, folder):
    """Every document scored: probabilities, class and score agree on each row."""
    done = train_tabular(
        labelled_documents(spark, folder), "quality", "classification_logreg",
        features=["lang", "source", "n_chars"], keys=["doc_id"],
    )
    batch = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    scored = score(done.bundle, batch)
    likelier = F.when(F.col("proba_1") > F.col("proba_0"), F.lit("1")).otherwise(F.lit("0"))
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.abs(F.col("proba_0") + F.col("proba_1") - 1.0) < 1e-9).alias("sums_to_one"),
        F.bool_and(F.col("prediction").cast("string") == likelier).alias("likelier_class"),
        F.bool_and(F.col("prediction_score") == F.col("proba_1")).alias("positive_score"),
    )


@query(
    "anomaly_scores",
    """SELECT lang, count(*) AS n, TRUE AS named_by_score FROM documents GROUP BY lang""",
)
def anomaly_scores(spark, folder):
    """An anomaly model applied to every document: the name follows the sign of the score."""
    done = train_tabular(
        labelled_documents(spark, folder), "toxic", "anomaly_isolation_forest", {"n_estimators": 20},
        features=DOCUMENT_FEATURES[:3], keys=["doc_id"],
    )
    scored = score(done.bundle, table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars"))
    name = F.when(F.col("anomaly_score") > 0, F.lit("Anomaly")).otherwise(F.lit("Normal"))
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction") == name).alias("named_by_score")
    )


@query(
    "one_class_svm_share",
    """SELECT count(*) AS n_rows, ceil(0.05 * (count(*) - 1))::BIGINT AS flagged FROM embeddings""",
)
def one_class_svm_share(spark, folder):
    """The boundary is the quantile of nu: so many rows lie outside, of all embeddings."""
    df = table(spark, folder, "embeddings").select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    scored = OneClassSVM(nu=0.05).fit(df).transform(df)
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction") == 1.0).alias("flagged")
    )


@query(
    "isolation_forest_planted",
    """SELECT count(*) AS n_rows, count(*) FILTER (l_orderkey % 997 = 0) AS planted_found, TRUE AS share_kept FROM lineitem""",
)
def isolation_forest_planted(spark, folder):
    """Rows moved far away are flagged, all of them; others up to the contamination."""
    planted = F.col("l_orderkey") % 997 == 0
    far = [F.when(planted, F.col(c) * 50 + 1000).otherwise(F.col(c)).alias(c) for c in ("l_quantity", "l_discount", "l_tax")]
    df = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(
        table(spark, folder, "lineitem").select(*LINE_KEYS, planted.alias("planted"), *far)
    )
    scored = IsolationForest(contamination=0.05, keys=LINE_KEYS).fit_scored(df, ["planted"])[1]
    flagged = F.col("prediction") == 1.0
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(flagged & F.col("planted")).alias("planted_found"),
        (F.count_if(flagged) <= 0.05 * F.count(F.lit(1)) + 1).alias("share_kept"),
    )
