"""Queries for derived features, imputation, scaling, encoding and splits.

The SQL adds 0.0 to rounded values of either sign: Spark rounds to 0.0 where SQL
keeps a negative zero.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import ensure_checkpoint_dir
from ..operators.features import (
    apply_numeric,
    column_roles,
    date_features,
    encode_ordinal,
    find_date_columns,
    find_text_columns,
    fit_numeric,
    group_rare,
    impute_mode,
    text_features,
)
from ..operators.preprocess import TabularPreprocessor
from ..operators.split import split_rows
from ..sources.readers import load_labelled, read_table
from ..sources.synthetic import transactions_for
from ..sources.writers import stamped_name, write_table
from .quality_queries import (
    DATES_SQL,
    GAPS_SQL,
    MODE_SQL,
    lineitem_with_gaps,
    orders_with_text_dates,
    words_sql,
)
from .registry import query, table


@query(
    "date_features",
    f"""WITH t AS ({DATES_SQL}), p AS (SELECT o_orderkey,
          strptime(iso, '%Y-%m-%d') AS a, strptime(slashed, '%m/%d/%Y') AS b FROM t)
        SELECT o_orderkey, """
    + ", ".join(
        f"CAST({part} AS INTEGER) AS {name}__{label}"
        for name, v in (("iso", "a"), ("slashed", "b"))
        for label, part in (
            ("year", f"year({v})"), ("month", f"month({v})"), ("day", f"day({v})"),
            ("hour", f"hour({v})"), ("weekday", f"isodow({v}) - 1"),
        )
    )
    + " FROM p",
)
def date_features_query(spark, folder):
    df = orders_with_text_dates(spark, folder).select("o_orderkey", "iso", "slashed")
    return date_features(df, find_date_columns(df, ["iso", "slashed"]))


@query(
    "date_features_of_timestamps",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS ts__year, CAST(month(ts) AS INTEGER) AS ts__month,
         CAST(day(ts) AS INTEGER) AS ts__day, CAST(hour(ts) AS INTEGER) AS ts__hour,
         CAST(isodow(ts) - 1 AS INTEGER) AS ts__weekday FROM events""",
)
def date_features_of_timestamps(spark, folder):
    df = table(spark, folder, "events").select("event_id", "ts")
    return date_features(df, find_date_columns(df, ["ts"]))


@query(
    "text_features",
    f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS text__char_len,
          CAST({words_sql('text')} AS INTEGER) AS text__word_count FROM documents""",
)
def text_features_query(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text")
    return text_features(df, find_text_columns(df), drop_original=True)


@query(
    "column_roles",
    f"""WITH t AS ({DATES_SQL}), c AS (
          SELECT 'iso' AS "column", iso AS v FROM t UNION ALL SELECT 'slashed', slashed FROM t
          UNION ALL SELECT 'mixed', mixed FROM t
          UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM t)
        SELECT "column", CASE WHEN avg(regexp_matches(v, '\\d')::INT) >= 0.6
            AND avg(regexp_matches(v, '[-/:T]')::INT) >= 0.6
            AND avg((coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'))
                     IS NOT NULL)::INT) >= 0.5
          THEN 'dropped' ELSE 'categorical' END AS role FROM c GROUP BY "column"
        UNION ALL SELECT 'o_orderkey', CASE WHEN count(o_orderkey) >= 0 THEN 'numeric' END FROM t""",
)
def column_roles_query(spark, folder):
    df = orders_with_text_dates(spark, folder)
    roles = column_roles(df, df.columns)
    rows = [
        (c, role)
        for role in ("numeric", "categorical", "dropped")
        for c in getattr(roles, role)
    ]
    return spark.createDataFrame(rows, "column string, role string")


@query(
    "group_rare_categories",
    """SELECT doc_id, CASE WHEN share < 0.12 THEN '__OTHER__' ELSE lang END AS lang
       FROM documents JOIN (SELECT lang AS l, count(*) / sum(count(*)) OVER () AS share
                            FROM documents GROUP BY lang) ON l = lang""",
)
def group_rare_categories(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "lang")
    return group_rare(df, ["lang"], 0.12)


@query(
    "impute_median",
    f"""WITH t AS ({GAPS_SQL}) SELECT l_orderkey, l_linenumber, l_suppkey,
          round(coalesce(l_quantity, (SELECT median(l_quantity) FROM t)), 6) AS l_quantity,
          round(coalesce(l_discount, (SELECT median(l_discount) FROM t)), 6) AS l_discount
        FROM t""",
)
def impute_median(spark, folder):
    df = lineitem_with_gaps(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount"
    )
    filled = apply_numeric(df, fit_numeric(df, ["l_quantity", "l_discount"], True, "none"))
    return filled.withColumns(
        {c: F.round(c, 6) for c in ("l_quantity", "l_discount")}
    )


@query(
    "impute_mode",
    f"""WITH t AS ({GAPS_SQL}) SELECT l_orderkey, l_linenumber, l_suppkey,
          coalesce(l_returnflag, {MODE_SQL.format(c='l_returnflag')}) AS l_returnflag,
          coalesce(l_linestatus, {MODE_SQL.format(c='l_linestatus')}) AS l_linestatus FROM t""",
)
def impute_mode_query(spark, folder):
    df = lineitem_with_gaps(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus"
    )
    return impute_mode(df, ["l_returnflag", "l_linestatus"])


def _filled(column: str) -> str:
    return f"coalesce({column}, (SELECT median({column}) FROM t))"


@query(
    "scale_standard",
    f"""WITH t AS ({GAPS_SQL}), f AS (SELECT l_orderkey, l_linenumber, l_suppkey,
          {_filled('l_quantity')} AS l_quantity, l_extendedprice FROM t)
        SELECT l_orderkey, l_linenumber, l_suppkey,
          round((l_quantity - (SELECT avg(l_quantity) FROM f)) /
            (SELECT stddev_pop(l_quantity) FROM f), 6) + 0.0 AS l_quantity,
          round((l_extendedprice - (SELECT avg(l_extendedprice) FROM f)) /
            (SELECT stddev_pop(l_extendedprice) FROM f), 6) + 0.0 AS l_extendedprice FROM f""",
)
def scale_standard(spark, folder):
    return _scaled(spark, folder, "standard")


@query(
    "scale_minmax",
    f"""WITH t AS ({GAPS_SQL}), f AS (SELECT l_orderkey, l_linenumber, l_suppkey,
          {_filled('l_quantity')} AS l_quantity, l_extendedprice FROM t)
        SELECT l_orderkey, l_linenumber, l_suppkey,
          round((l_quantity - (SELECT min(l_quantity) FROM f)) /
            (SELECT max(l_quantity) - min(l_quantity) FROM f), 6) AS l_quantity,
          round((l_extendedprice - (SELECT min(l_extendedprice) FROM f)) /
            (SELECT max(l_extendedprice) - min(l_extendedprice) FROM f), 6) AS l_extendedprice
        FROM f""",
)
def scale_minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


def _scaled(spark: SparkSession, folder: str, method: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice"]
    df = lineitem_with_gaps(spark, folder).select("l_orderkey", "l_linenumber", "l_suppkey", *names)
    scaled = apply_numeric(df, fit_numeric(df, names, True, method))
    return scaled.withColumns({c: F.round(c, 6) for c in names})


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "encode_onehot",
    "SELECT c_custkey, "
    + ", ".join(f"(c_mktsegment = '{s}')::DOUBLE AS is_{s.lower()}" for s in SEGMENTS)
    + " FROM customer",
)
def encode_onehot(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    model = TabularPreprocessor(
        target="c_acctbal", task="regression", features=["c_mktsegment"]
    ).fit(df)
    slots = {n.removeprefix("cat__c_mktsegment_"): i for i, n in enumerate(model.feature_names)}
    x = vector_to_array("features")
    return model.transform(df).select(
        "c_custkey", *[x[slots[s]].alias(f"is_{s.lower()}") for s in SEGMENTS]
    )


@query(
    "encode_ordinal",
    """SELECT p_partkey, coalesce(b.idx, -1) AS p_brand, coalesce(t.idx, -1) AS p_type
       FROM part LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx
           FROM (SELECT DISTINCT p_brand AS v FROM part WHERE p_size <= 3)) b ON p_brand = b.v
         LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx
           FROM (SELECT DISTINCT p_type AS v FROM part WHERE p_size <= 3)) t ON p_type = t.v""",
)
def encode_ordinal_query(spark, folder):
    """Fitted on small parts only, so that other brands can be unseen."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    fit_on = parts.filter("p_size <= 3")
    return encode_ordinal(parts.drop("p_size"), ["p_brand", "p_type"], fit_on)


def encoding_sql(stats: str, overall: str) -> str:
    """Shrunken category mean from a statistics row and the overall mean and variance."""
    return (
        f"CASE WHEN {stats}.n > 0 AND {stats}.v + {stats}.n * {overall}.v > 0 THEN "
        f"({stats}.n * {overall}.v * {stats}.m + {stats}.v * {overall}.m) / "
        f"({stats}.v + {stats}.n * {overall}.v) ELSE {overall}.m END"
    )


@query(
    "encode_ordinal_whole",
    """SELECT p_partkey, b.idx AS p_brand, t.idx AS p_type
       FROM part JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx
           FROM (SELECT DISTINCT p_brand AS v FROM part)) b ON p_brand = b.v
         JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx
           FROM (SELECT DISTINCT p_type AS v FROM part)) t ON p_type = t.v""",
)
def encode_ordinal_whole(spark, folder):
    """Fitted on the whole table."""
    return encode_ordinal(table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


@query(
    "encode_target",
    f"""WITH s AS (SELECT o_orderpriority AS c, count(*) AS n, avg(o_totalprice) AS m,
              var_pop(o_totalprice) AS v FROM orders GROUP BY o_orderpriority),
          a AS (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders)
        SELECT o_orderkey, round({encoding_sql('s', 'a')}, 4) AS encoded
        FROM orders JOIN s ON c = o_orderpriority, a""",
)
def encode_target(spark, folder):
    df = table(spark, folder, "orders")
    model = _target_encoder(df)
    return model.transform(df).select(
        "o_orderkey", F.round(vector_to_array("features")[0], 4).alias("encoded")
    )


@query(
    "encode_target_crossfit",
    f"""WITH k AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER
              (ORDER BY md5('43:' || o_orderkey)) <= ceil(count(*) OVER () * 0.5) AS first
            FROM orders),
          s AS (SELECT first, o_orderpriority AS c, count(*) AS n, avg(o_totalprice) AS m,
              var_pop(o_totalprice) AS v FROM k GROUP BY first, o_orderpriority),
          a AS (SELECT first, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v
                FROM k GROUP BY first)
        SELECT o_orderkey, round({encoding_sql('s', 'a')}, 4) AS encoded
        FROM k JOIN s ON s.c = k.o_orderpriority AND s.first <> k.first
               JOIN a ON a.first <> k.first""",
)
def encode_target_crossfit(spark, folder):
    df = table(spark, folder, "orders")
    return _target_encoder(df).transform_training(df).select(
        "o_orderkey", F.round(vector_to_array("features")[0], 4).alias("encoded")
    )


def _target_encoder(df: DataFrame):
    return TabularPreprocessor(
        target="o_totalprice", task="regression", features=["o_orderpriority"],
        keys=["o_orderkey"], encoding_strategy="target",
    ).fit(df)


@query(
    "assembled_features",
    f"""WITH t AS ({GAPS_SQL}), f AS (SELECT l_orderkey, l_linenumber, l_suppkey,
          {_filled('l_quantity')} AS q, {_filled('l_discount')} AS d,
          coalesce(l_linestatus, {MODE_SQL.format(c='l_linestatus')}) AS s FROM t)
        SELECT l_orderkey, l_linenumber, l_suppkey,
          round((q - (SELECT avg(q) FROM f)) / (SELECT stddev_pop(q) FROM f), 6) + 0.0 AS num__l_quantity,
          round((d - (SELECT avg(d) FROM f)) / (SELECT stddev_pop(d) FROM f), 6) + 0.0 AS num__l_discount,
          (s = 'F')::DOUBLE AS cat__l_linestatus_F, (s = 'O')::DOUBLE AS cat__l_linestatus_O
        FROM f""",
)
def assembled_features(spark, folder):
    df = lineitem_with_gaps(spark, folder)
    model = TabularPreprocessor(
        target="l_extendedprice", task="regression",
        features=["l_quantity", "l_discount", "l_linestatus"],
    ).fit(df)
    x = vector_to_array("features")
    return model.transform(df).select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        *[F.round(x[i], 6).alias(n) for i, n in enumerate(model.feature_names)],
    )


@query(
    "split_random",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42:' || o_orderkey))
         <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def split_random(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey")
    return split_rows(df, 0.2, seed=42, keys=["o_orderkey"])


@query(
    "split_stratified",
    """WITH c AS (SELECT quality AS q, count(*) AS n FROM labels GROUP BY quality),
         s AS (SELECT q, ceil(0.25 * sum(n) OVER ()) AS total,
                 ceil(0.25 * sum(n) OVER ()) * n / sum(n) OVER () AS share FROM c),
         f AS (SELECT q, floor(share) + CASE WHEN row_number() OVER
                 (ORDER BY share - floor(share) DESC, q) <= total - sum(floor(share)) OVER ()
                 THEN 1 ELSE 0 END AS quota FROM s)
       SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality
         ORDER BY md5('42:' || doc_id)) <= quota THEN 'test' ELSE 'train' END AS split
       FROM labels JOIN f ON q = quality""",
)
def split_stratified(spark, folder):
    df = table(spark, folder, "labels").select("doc_id", "quality")
    return split_rows(df, 0.25, seed=42, keys=["doc_id"], stratify="quality")


@query(
    "split_many_classes",
    """WITH c AS (SELECT l_partkey AS q, count(*)::HUGEINT AS n FROM lineitem GROUP BY l_partkey),
         t AS (SELECT sum(n)::HUGEINT AS n, ceil(sum(n) / 4)::HUGEINT AS total FROM c),
         s AS (SELECT q, total * c.n // t.n AS base, total * c.n % t.n AS rest, total FROM c, t),
         f AS (SELECT q, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, q::VARCHAR)
                 <= total - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM s)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN row_number() OVER
         (PARTITION BY l_partkey ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':'
            || l_partkey || ':' || l_suppkey)) <= quota THEN 'test' ELSE 'train' END AS split
       FROM lineitem JOIN f ON q = l_partkey""",
)
def split_many_classes(spark, folder):
    """As many classes as parts: thresholds are a joined table."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return split_rows(
        table(spark, folder, "lineitem").select(*keys), 0.25, seed=42, keys=keys, stratify="l_partkey"
    )


def _uniform_sql(name: str) -> str:
    return (
        f"(('0x' || substr(md5('42:{name}:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    )


@query(
    "synthetic_transactions",
    f"""WITH u AS (SELECT o_orderkey, {_uniform_sql('class')} < 0.02 AS fraud,
          {_uniform_sql('amount')} AS a, """
    + ", ".join(f"{_uniform_sql(f'v{i}')} AS u{i}" for i in range(1, 5))
    + """ FROM orders)
        SELECT o_orderkey, """
    + ", ".join(
        f"round((u{i} * 2 - 1) * CASE WHEN fraud THEN 5 ELSE 2 END, 4) + 0.0 AS V{i}"
        for i in range(1, 5)
    )
    + """, round(CASE WHEN fraud THEN 1000 + a * 9000 ELSE a * 500 END, 2) AS Amount,
          fraud::INT AS Class FROM u""",
)
def synthetic_transactions_query(spark, folder):
    """The synthetic labelled source, one row per order."""
    return transactions_for(table(spark, folder, "orders"), "o_orderkey")


@query(
    "csv_round_trip",
    f"""WITH t AS ({GAPS_SQL}) SELECT l_returnflag, count(*) AS n, count(l_quantity) AS quantities,
          round(sum(l_extendedprice), 2) AS price, sum(l_orderkey)::BIGINT AS orders,
          min(strftime(l_shipdate, '%Y-%m-%d')) AS first_day FROM t GROUP BY l_returnflag""",
)
def csv_round_trip(spark, folder):
    """Write a table as CSV, read it back with inferred types, check the target."""
    df = lineitem_with_gaps(spark, folder).withColumn(
        "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")
    )
    out = f"{ensure_checkpoint_dir(spark)}/csv/{stamped_name('lineitem.csv', 'cleaned')}"
    write_table(df, out, "csv", mode="overwrite")
    back = load_labelled(spark, out, "l_extendedprice")
    return back.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("l_quantity").alias("quantities"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.sum("l_orderkey").alias("orders"),
        F.min("l_shipdate").alias("first_day"),
    )


@query(
    "csv_text_round_trip",
    """SELECT 'documents' AS origin, doc_id AS id, 0::BIGINT AS turn, length(text) AS n, md5(text) AS digest,
          lang AS mark FROM documents
        UNION ALL SELECT 'conversations', conv_id, turn, length(text), md5(text), role FROM conversations""",
)
def csv_text_round_trip(spark, folder):
    """Whole texts through CSV files: quotes, delimiters, line breaks and blanks survive."""
    parts = []
    for name, key, turn, mark in (
        ("documents", "doc_id", F.lit(0), "lang"), ("conversations", "conv_id", F.col("turn"), "role")
    ):
        out = f"{ensure_checkpoint_dir(spark)}/csv/{uuid.uuid4().hex}/{name}"
        write_table(table(spark, folder, name), out, "csv")
        back = read_table(spark, out)
        parts.append(
            back.select(
                F.lit(name).alias("origin"), F.col(key).alias("id"), turn.cast("long").alias("turn"),
                F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"),
                F.col(mark).alias("mark"),
            )
        )
    return parts[0].unionAll(parts[1])
