"""Queries for metrics, chart data, tuning reports, run history and batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evaluate import (
    actual_vs_predicted,
    binary_metrics,
    confusion_matrix,
    regression_metrics,
    roc_auc,
    roc_points,
    score_histogram,
    top_importances,
)
from ..operators.models.linear import train_linear
from ..operators.preprocess import TabularPreprocessor
from ..operators.scoring import coerce_to_schema, coercion_problems, output_profile, predict
from ..operators.tuning import comparison_report, score_column, trial_history
from ..sources.writers import align_history
from .registry import query, table

SCORED_SQL = """SELECT l.doc_id, source, quality AS y, n_chars::DOUBLE AS s,
  CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d
  ON l.doc_id = d.doc_id"""


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "labels")
        .join(table(spark, folder, "documents").select("doc_id", "source", "n_chars"), "doc_id")
        .select(
            "doc_id", "source", F.col("quality").alias("y"),
            F.col("n_chars").cast("double").alias("s"),
            F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("p"),
        )
    )


BINARY_SQL = """count(*) AS n, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn,
  count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn,
  count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, round(avg((y = p)::INT), 6) AS accuracy,
  round(coalesce(count(*) FILTER (WHERE y = 1 AND p = 1) /
    nullif(count(*) FILTER (WHERE p = 1), 0), 0), 6) AS "precision",
  round(coalesce(count(*) FILTER (WHERE y = 1 AND p = 1) /
    nullif(count(*) FILTER (WHERE y = 1), 0), 0), 6) AS recall,
  round(coalesce(2 * count(*) FILTER (WHERE y = 1 AND p = 1) /
    nullif(count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE p = 1), 0), 0), 6) AS f1"""
RATIOS = ("accuracy", "precision", "recall", "f1")


@query("binary_metrics", f"WITH t AS ({SCORED_SQL}) SELECT {BINARY_SQL} FROM t")
def binary_metrics_query(spark, folder):
    return binary_metrics(scored_documents(spark, folder), "y", "p", 1).withColumns(
        {c: F.round(c, 6) for c in RATIOS}
    )


@query(
    "binary_metrics_by_source",
    f"WITH t AS ({SCORED_SQL}) SELECT source, {BINARY_SQL} FROM t GROUP BY source",
)
def binary_metrics_by_source(spark, folder):
    return binary_metrics(scored_documents(spark, folder), "y", "p", 1, ["source"]).withColumns(
        {c: F.round(c, 6) for c in RATIOS}
    )


@query(
    "roc_auc",
    f"""WITH t AS ({SCORED_SQL}), r AS (SELECT y, rank() OVER (ORDER BY s)
          + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM t),
        a AS (SELECT sum(k) FILTER (WHERE y = 1) AS ranks, count(*) FILTER (WHERE y = 1) AS p,
          count(*) FILTER (WHERE y <> 1) AS n FROM r)
        SELECT round(((ranks - p * (p + 1) / 2.0) / (p * n))::DOUBLE, 6) AS roc_auc FROM a""",
)
def roc_auc_query(spark, folder):
    return roc_auc(scored_documents(spark, folder), "y", "s", 1).select(
        F.round("roc_auc", 6).alias("roc_auc")
    )


@query(
    "confusion_matrix",
    f"""WITH t AS ({SCORED_SQL}), v AS (SELECT y AS v FROM t UNION SELECT p FROM t)
        SELECT a.v AS actual, b.v AS predicted, (SELECT count(*) FROM t WHERE y = a.v AND p = b.v)
          AS n FROM v a, v b""",
)
def confusion_matrix_query(spark, folder):
    return confusion_matrix(scored_documents(spark, folder), "y", "p")


ROC_SQL = """SELECT s AS threshold,
  round(sum(sum((y <> 1)::INT)) OVER (ORDER BY s DESC) / (SELECT count(*) FROM t WHERE y <> 1), 6)
    AS fpr,
  round(sum(sum((y = 1)::INT)) OVER (ORDER BY s DESC) / (SELECT count(*) FROM t WHERE y = 1), 6)
    AS tpr FROM t GROUP BY s"""


@query("roc_points", f"WITH t AS ({SCORED_SQL}) {ROC_SQL}")
def roc_points_query(spark, folder):
    return roc_points(scored_documents(spark, folder), "y", "s", 1).withColumns(
        {c: F.round(c, 6) for c in ("fpr", "tpr")}
    )


@query(
    "roc_points_bucketed",
    f"""WITH t AS (SELECT l_extendedprice AS s, (l_returnflag = 'R')::INT AS y FROM lineitem)
        {ROC_SQL}""",
)
def roc_points_bucketed(spark, folder):
    """The running totals of a big table: cut into score buckets."""
    df = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    return roc_points(df, "y", "s", 1, buckets=40).withColumns(
        {c: F.round(c, 6) for c in ("fpr", "tpr")}
    )


PRICED_SQL = """SELECT l_returnflag, l_extendedprice AS y,
  2000 * l_quantity + 5000 * l_discount AS p FROM lineitem"""


def priced_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("y"),
        (2000 * F.col("l_quantity") + 5000 * F.col("l_discount")).alias("p"),
    )


@query(
    "regression_metrics",
    f"""WITH t AS ({PRICED_SQL}) SELECT l_returnflag, count(*) AS n,
          round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
          round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM t GROUP BY l_returnflag""",
)
def regression_metrics_query(spark, folder):
    df = regression_metrics(priced_lineitem(spark, folder), "y", "p", ["l_returnflag"])
    return df.withColumns(
        {"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "r2": F.round("r2", 6)}
    )


@query(
    "actual_vs_predicted",
    f"""WITH t AS ({PRICED_SQL}) SELECT round(y, 4) AS actual, round(p, 4) AS predicted,
          round((SELECT least(min(y), min(p)) FROM t), 4) AS low,
          round((SELECT greatest(max(y), max(p)) FROM t), 4) AS high FROM t""",
)
def actual_vs_predicted_query(spark, folder):
    pairs, limits = actual_vs_predicted(priced_lineitem(spark, folder), "y", "p")
    row = limits.first()
    return pairs.select(
        F.round("actual", 4).alias("actual"), F.round("predicted", 4).alias("predicted"),
        F.lit(round(row["low"], 4)).alias("low"), F.lit(round(row["high"], 4)).alias("high"),
    )


@query(
    "score_histogram",
    """WITH t AS (SELECT value AS s FROM events),
         m AS (SELECT min(s) AS lo, max(s) AS hi,
                 least(30, greatest(5, floor(sqrt(count(*)))))::INT AS bins FROM t),
         c AS (SELECT least(floor((s - lo) / (hi - lo) * bins), bins - 1)::INT AS bin,
                 count(*) AS n FROM t, m GROUP BY 1)
       SELECT b.bin::INT AS bin, round(lo + b.bin * ((hi - lo) / bins), 6) AS low,
         round(lo + (b.bin + 1) * ((hi - lo) / bins), 6) AS high, coalesce(n, 0) AS n
       FROM m, range((SELECT bins FROM m)) AS b(bin) LEFT JOIN c ON c.bin = b.bin""",
)
def score_histogram_query(spark, folder):
    return score_histogram(table(spark, folder, "events"), "value").withColumns(
        {c: F.round(c, 6) for c in ("low", "high")}
    )


@query(
    "top_importances",
    """SELECT p_name AS feature, round(avg(p_retailprice), 4) AS importance FROM part
       GROUP BY p_name ORDER BY round(avg(p_retailprice), 4) DESC, p_name LIMIT 10""",
)
def top_importances_query(spark, folder):
    df = table(spark, folder, "part").groupBy(F.col("p_name").alias("feature")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("importance")
    )
    return top_importances(df)


# --- tuning reports over trial logs made from the tables -------------------

@query(
    "tuning_score",
    f"""WITH t AS ({SCORED_SQL}), m AS (SELECT source, {BINARY_SQL} FROM t GROUP BY source)
        SELECT source, coalesce(CASE WHEN tp > 0 THEN f1 END, accuracy) AS classification,
          accuracy AS anomaly FROM m""",
)
def tuning_score(spark, folder):
    """F1 where there is one, else accuracy; anomaly models have no F1 here."""
    metrics = binary_metrics(scored_documents(spark, folder), "y", "p", 1, ["source"])
    metrics = metrics.withColumn("f1", F.when(F.col("tp") > 0, F.col("f1")))
    return metrics.select(
        "source",
        F.round(score_column(metrics, "classification"), 6).alias("classification"),
        F.round(score_column(metrics, "anomaly"), 6).alias("anomaly"),
    )


TRIALS_SQL = """SELECT c_nationkey AS trial, CASE WHEN c_nationkey = 2 THEN NULL
  ELSE round(avg(c_acctbal), 4) END AS score FROM customer GROUP BY c_nationkey"""


@query(
    "trial_history",
    f"""WITH t AS ({TRIALS_SQL}), b AS (SELECT trial, score, greatest(4000.0, coalesce(max(score)
          OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4000.0))
            AS best_before FROM t),
        i AS (SELECT *, coalesce(score > best_before, FALSE) AS improved FROM b),
        g AS (SELECT *, trial - coalesce(max(CASE WHEN improved THEN trial END)
          OVER (ORDER BY trial), (SELECT min(trial) - 1 FROM t)) AS idle FROM i),
        s AS (SELECT *, coalesce(lag(idle) OVER (ORDER BY trial), 0) >= 5 AS stop FROM g)
        SELECT trial, score, best_before::DOUBLE AS best_before, improved, idle,
          NOT bool_or(stop) OVER (ORDER BY trial) AS ran FROM s""",
)
def trial_history_query(spark, folder):
    trials = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("trial")).agg(
        F.round(F.avg("c_acctbal"), 4).alias("score")
    ).withColumn("score", F.when(F.col("trial") != 2, F.col("score")))
    return trial_history(trials, 4000.0, 25)


OUTCOMES_SQL = """SELECT s_nationkey, round(min(s_acctbal), 2) AS baseline_score,
  round(CASE WHEN s_nationkey < 3 THEN min(s_acctbal) ELSE avg(s_acctbal) END, 2) AS best_score,
  count(*) * 100 AS baseline_bytes,
  CASE WHEN s_nationkey = 5 THEN NULL ELSE max(s_suppkey) * 3 END AS best_bytes,
  round(max(s_acctbal) / 12, 2) AS elapsed_seconds FROM supplier GROUP BY s_nationkey"""


@query(
    "tuning_report",
    f"""WITH o AS ({OUTCOMES_SQL}), r AS (SELECT *, CASE WHEN baseline_score <> 0 THEN
            (best_score - baseline_score) / abs(baseline_score) * 100 ELSE 0 END AS gain,
          best_bytes - baseline_bytes AS size_delta_bytes,
          (best_bytes - baseline_bytes) / nullif(baseline_bytes, 0) * 100 AS size_pct FROM o)
        SELECT s_nationkey, round(gain, 4) AS improvement_pct, size_delta_bytes,
          round(size_pct, 4) AS size_change_pct,
          CASE WHEN best_score <= baseline_score THEN
            'keep baseline: no better score'
          WHEN gain >= 5 AND (size_pct IS NULL OR size_pct <= 25) AND elapsed_seconds <= 600 THEN
            'take tuned model: gain, size and time within limits'
          ELSE 'decide by hand: better score, but a limit is missed'
          END AS recommendation FROM r""",
)
def tuning_report(spark, folder):
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    outcomes = table(spark, folder, "supplier").groupBy("s_nationkey").agg(
        F.round(F.min(balance), 2).alias("baseline_score"),
        F.round(F.when(nation < 3, F.min(balance)).otherwise(F.avg(balance)), 2).alias("best_score"),
        (F.count(F.lit(1)) * 100).alias("baseline_bytes"),
        F.when(nation != 5, F.max("s_suppkey") * 3).alias("best_bytes"),
        F.round(F.max(balance) / 12, 2).alias("elapsed_seconds"),
    )
    return comparison_report(outcomes).select(
        "s_nationkey", F.round("improvement_pct", 4).alias("improvement_pct"),
        "size_delta_bytes", F.round("size_change_pct", 4).alias("size_change_pct"),
        "recommendation",
    )


@query(
    "run_history_aligned",
    f"""WITH t AS ({SCORED_SQL}), m AS (SELECT source, {BINARY_SQL} FROM t GROUP BY source)
        SELECT source AS pipeline_name, accuracy, f1,
          CAST(NULL AS DOUBLE) AS auc, CASE WHEN tp > 0 THEN "precision" ELSE 0.5 END AS "precision",
          recall, CAST(0.25 AS DOUBLE) AS anomaly_f1, CAST(NULL AS VARCHAR) AS owner FROM m""",
)
def run_history_aligned(spark, folder):
    """Runs under the columns of an older history: fall-backs, and one unknown column."""
    m = binary_metrics(scored_documents(spark, folder), "y", "p", 1, ["source"]).withColumns(
        {c: F.round(c, 6) for c in RATIOS}
    )
    nothing = F.lit(None).cast("double")
    runs = m.select(
        F.col("source").alias("pipeline_name"), "accuracy", "f1",
        F.when(F.col("tp") > 0, F.col("precision")).alias("classification_precision"),
        F.col("recall").alias("classification_recall"),
        nothing.alias("roc_auc"), nothing.alias("anomaly_auc"),
        F.lit(0.5).alias("anomaly_precision"), nothing.alias("anomaly_recall"),
        F.lit(0.25).alias("anomaly_f1"),
    )
    return align_history(
        runs,
        ["pipeline_name", "accuracy", "f1", "auc", "precision", "recall", "anomaly_f1", "owner"],
    )


# --- batch scoring ---------------------------------------------------------

ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_flag", T.BooleanType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)


def orders_as_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(
            F.col("o_custkey").cast("string"),
            F.when(F.col("o_orderstatus") == "O", ".0").otherwise(""),
        ).alias("o_custkey"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderstatus") == "F", " Yes ").otherwise("n").alias("o_flag"),
        "o_orderpriority", "o_orderstatus",
    )


@query(
    "coerce_to_schema",
    """SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice,
         o_orderstatus = 'F' AS o_flag, o_orderpriority, o_orderstatus FROM orders""",
)
def coerce_to_schema_query(spark, folder):
    return coerce_to_schema(orders_as_text(spark, folder), ORDER_SCHEMA)


@query(
    "coercion_problems",
    """SELECT 'o_custkey' AS "column", 'integer expected' AS problem,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM orders
       UNION ALL SELECT 'o_custkey', 'fraction in an integer',
         count(*) FILTER (WHERE o_orderpriority = '2-HIGH') FROM orders
       UNION ALL SELECT 'o_totalprice', 'number expected',
         count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
       UNION ALL SELECT 'o_flag', 'boolean expected',
         count(*) FILTER (WHERE o_orderpriority = '5-LOW') FROM orders""",
)
def coercion_problems_query(spark, folder):
    priority = F.col("o_orderpriority")
    broken = orders_as_text(spark, folder).withColumns(
        {
            "o_custkey": F.when(priority == "1-URGENT", "twelve")
            .when(priority == "2-HIGH", "12.5").otherwise(F.col("o_custkey")),
            "o_totalprice": F.when(F.col("o_orderstatus") == "P", "")
            .otherwise(F.col("o_totalprice")),
            "o_flag": F.when(priority == "5-LOW", "maybe").otherwise(F.col("o_flag")),
        }
    )
    return coercion_problems(broken, ORDER_SCHEMA)


LINE_SQL = """SELECT regr_slope(l_extendedprice, l_quantity) AS a,
  regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem"""


def priced_by_model(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    prepared = TabularPreprocessor(
        target="l_extendedprice", task="regression", features=["l_quantity"],
        scale_strategy="none",
    ).fit(lineitem)
    train = prepared.transform(lineitem).withColumnRenamed("l_extendedprice", "label")
    model = train_linear(train)
    batch = lineitem.withColumn("l_quantity", F.col("l_quantity").cast("string"))
    return predict(batch.drop("l_extendedprice"), prepared, model, "regression")


@query(
    "score_detailed",
    f"""SELECT l_orderkey, l_linenumber, l_quantity::VARCHAR AS l_quantity,
          round(a * l_quantity + b, 4) AS prediction FROM lineitem, ({LINE_SQL})""",
)
def score_detailed(spark, folder):
    scored = output_profile(priced_by_model(spark, folder), "regression", "detailed")
    return scored.withColumn("prediction", F.round("prediction", 4))


@query(
    "score_simple",
    f"SELECT round(a * l_quantity + b, 4) AS prediction FROM lineitem, ({LINE_SQL})",
)
def score_simple(spark, folder):
    scored = output_profile(priced_by_model(spark, folder), "regression", "simple")
    return scored.withColumn("prediction", F.round("prediction", 4))
