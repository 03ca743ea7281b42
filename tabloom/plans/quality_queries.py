"""Queries for profiling, recommendations and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import as_double, col, field_types, is_numeric
from ..functions.frequencies import multiplicities
from ..functions.quantiles import exact_quantiles
from ..operators.class_weights import balanced_weights, check_target, class_counts
from ..operators.fixes import (
    apply_quick_fixes,
    constant_columns,
    table_difference,
    tables_equal,
)
from ..operators.profile import (
    TableProfile,
    drop_duplicates,
    duplicate_count,
    leakage_by_name,
    profile_table,
)
from ..operators.recommend import recommend_fixes
from ..operators.scoring import allowed_values, unseen_values
from ..operators.sketches import (
    DISTINCT_ERROR,
    RANK_ERROR,
    column_estimates,
    sketch_columns,
)
from .jobs import auto_prepare
from .registry import query, table

WORDS_SQL = (
    r"len(regexp_extract_all({c}, '[^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}"
    r"\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'))"
)


def words_sql(column: str) -> str:
    return WORDS_SQL.format(c=column)


def profile_sql(source: str, columns: dict[str, str]) -> str:
    """One SELECT per column; ``columns`` maps a name to num, text or other."""
    parts = []
    for name, kind in columns.items():
        outliers = "CAST(NULL AS DOUBLE)"
        if kind == "num":
            outliers = f"""(SELECT round(CASE WHEN q.q3 > q.q1 THEN
                count(*) FILTER (WHERE {name} < q.q1 - 1.5 * (q.q3 - q.q1)
                                    OR {name} > q.q3 + 1.5 * (q.q3 - q.q1)) / count({name})
                ELSE 0 END, 6)
              FROM t, (SELECT quantile_cont({name}, 0.25) AS q1, quantile_cont({name}, 0.75) AS q3
                       FROM t) q GROUP BY q.q1, q.q3)"""
        ratio = f"count(DISTINCT {name}) / nullif(count({name}), 0)"
        wide = f"(count({name}) >= 20 AND {ratio} >= 0.8)" if kind == "text" else "FALSE"
        parts.append(
            f"""SELECT '{name}' AS "column", count(*) AS n_rows,
              count(*) - count({name}) AS n_null,
              count(DISTINCT {name}) AS n_distinct,
              round(coalesce({ratio}, 0), 6) AS distinct_ratio,
              count(DISTINCT {name}) + max(CASE WHEN {name} IS NULL THEN 1 ELSE 0 END) <= 1
                AS is_constant,
              {wide} AS is_high_cardinality,
              (count({name}) >= 20 AND {ratio} >= 0.98) AS is_potential_id,
              {outliers} AS outlier_ratio
            FROM t"""
        )
    return f"WITH t AS ({source}) " + " UNION ALL ".join(parts)


def column_table(spark: SparkSession, profile: TableProfile) -> DataFrame:
    return profile.to_df(spark).select(
        "column", "n_rows", "n_null", "n_distinct",
        F.round("distinct_ratio", 6).alias("distinct_ratio"),
        "is_constant", "is_high_cardinality", "is_potential_id",
        F.round("outlier_ratio", 6).alias("outlier_ratio"),
    )


@query(
    "profile_orders",
    profile_sql(
        "SELECT * FROM orders",
        {
            "o_orderkey": "num", "o_custkey": "num", "o_orderstatus": "text",
            "o_totalprice": "num", "o_orderdate": "other", "o_orderpriority": "text",
        },
    ),
)
def profile_orders(spark, folder):
    return column_table(spark, profile_table(table(spark, folder, "orders")))


LINEITEM_KINDS = {
    "l_orderkey": "num", "l_partkey": "num", "l_suppkey": "num", "l_linenumber": "num",
    "l_quantity": "num", "l_extendedprice": "num", "l_discount": "num", "l_tax": "num",
    "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "other",
}
# The tables hold no missing values: these predicates make some.
GAPS_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN l_linenumber IN (1, 2, 5) THEN NULL ELSE l_discount END AS l_discount,
  l_tax,
  CASE WHEN l_tax > 0.07 THEN NULL ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_suppkey = 7 THEN NULL ELSE l_linestatus END AS l_linestatus,
  l_shipdate FROM lineitem"""


def lineitem_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("l_linenumber")
    return table(spark, folder, "lineitem").withColumns(
        {
            "l_quantity": F.when(number != 3, F.col("l_quantity")),
            "l_discount": F.when(~number.isin(1, 2, 5), F.col("l_discount")),
            "l_returnflag": F.when(F.col("l_tax") <= 0.07, F.col("l_returnflag")),
            "l_linestatus": F.when(F.col("l_suppkey") != 7, F.col("l_linestatus")),
        }
    )


@query("profile_lineitem_with_gaps", profile_sql(GAPS_SQL, LINEITEM_KINDS))
def profile_lineitem_with_gaps(spark, folder):
    return column_table(spark, profile_table(lineitem_with_gaps(spark, folder)))


@query(
    "profile_events",
    profile_sql(
        "SELECT event_id, ts, user_id, event_type, value * value * value AS value, props "
        "FROM events",
        {
            "event_id": "num", "ts": "other", "user_id": "num", "event_type": "text",
            "value": "num", "props": "text",
        },
    ),
)
def profile_events(spark, folder):
    events = table(spark, folder, "events")
    v = F.col("value")
    return column_table(spark, profile_table(events.withColumn("value", v * v * v)))


@query(
    "quartiles_by_narrowing",
    """SELECT 'l_extendedprice' AS "column", round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
         round(quantile_cont(l_extendedprice, 0.5), 6) AS q2,
         round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem
       UNION ALL
       SELECT 'l_quantity', round(quantile_cont(l_quantity, 0.25), 6),
         round(quantile_cont(l_quantity, 0.5), 6), round(quantile_cont(l_quantity, 0.75), 6)
       FROM lineitem""",
)
def quartiles_by_narrowing(spark, folder):
    """The path for big tables, forced by limits far below the size of the table."""
    lineitem = table(spark, folder, "lineitem")
    found = exact_quantiles(
        lineitem, ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.75],
        direct_cells=1_000, collect_rows=500,
    )
    rows = [(c, *[round(v, 6) for v in q]) for c, q in found.items()]
    return spark.createDataFrame(rows, "column string, q1 double, q2 double, q3 double")


SKETCHED = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    "sketched_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count({c}) AS present,
          count(DISTINCT {c}) AS n_distinct, TRUE AS distinct_within, TRUE AS quantiles_within FROM lineitem"""
        for c in SKETCHED
    ),
)
def sketched_columns(spark, folder):
    """Sketches by ship month, merged, against exact counts and ranks of all rows."""
    df = table(spark, folder, "lineitem").select(*SKETCHED)
    parts = sketch_columns(df, part=F.date_format("l_shipdate", "yyyy-MM"))
    found = {r["column"]: r for r in column_estimates(parts).collect()}
    types = field_types(df)
    checks = []
    for c in SKETCHED:
        if not is_numeric(types[c]):
            continue
        x, n = as_double(col(c), types[c]), F.count(col(c))
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            value = F.lit(found[c][name])
            checks.append(F.struct(
                F.lit(c).alias("column"),
                ((F.count_if(x < value) <= (p + RANK_ERROR) * n) & (F.count_if(x <= value) >= (p - RANK_ERROR) * n))
                .alias("ok"),
            ))
    ranks = df.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).groupBy("c.column").agg(
        F.bool_and("c.ok").alias("quantiles_within")
    )
    exact = multiplicities(df, SKETCHED).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    estimates = spark.createDataFrame(
        [(c, r["rows"], r["present"], r["n_distinct"]) for c, r in found.items()],
        "column string, rows long, present long, estimate long",
    )
    return (
        exact.join(F.broadcast(estimates), "column").join(ranks, "column", "left")
        .select(
            "column", "rows", "present", "n_distinct",
            (F.abs(F.col("estimate") - F.col("n_distinct")) <= DISTINCT_ERROR * F.col("n_distinct"))
            .alias("distinct_within"),
            F.coalesce("quantiles_within", F.lit(True)).alias("quantiles_within"),
        )
    )


@query(
    "profile_approximate",
    """SELECT c AS "column", d >= 0.8 AND t AS is_high_cardinality, d >= 0.98 AS is_potential_id, n <= 1 AS is_constant
       FROM (SELECT 'o_orderkey' AS c, FALSE AS t, count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) / count(*) AS d FROM orders
         UNION ALL SELECT 'o_custkey', FALSE, count(DISTINCT o_custkey), count(DISTINCT o_custkey) / count(*) FROM orders
         UNION ALL SELECT 'o_orderstatus', TRUE, count(DISTINCT o_orderstatus), count(DISTINCT o_orderstatus) / count(*) FROM orders
         UNION ALL SELECT 'o_orderpriority', TRUE, count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority) / count(*) FROM orders
         UNION ALL SELECT 'o_totalprice', FALSE, count(DISTINCT o_totalprice), count(DISTINCT o_totalprice) / count(*) FROM orders)""",
)
def profile_approximate(spark, folder):
    """The rules on cardinality, decided by sketches."""
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    profile = profile_table(df, duplicates=False, approximate=True)
    return profile.to_df(spark).select("column", "is_high_cardinality", "is_potential_id", "is_constant")


@query(
    "duplicate_rows",
    """SELECT 'documents' AS name, count(*) AS n_rows,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents))
           AS duplicate_rows FROM documents
       UNION ALL
       SELECT 'lineitem', count(*), count(*) - (SELECT count(*) FROM
         (SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem)) FROM lineitem
       UNION ALL
       SELECT 'orders', count(*), count(*) - (SELECT count(*) FROM
         (SELECT DISTINCT * FROM orders)) FROM orders""",
)
def duplicate_rows(spark, folder):
    tables = {
        "documents": table(spark, folder, "documents").select("text", "lang"),
        "lineitem": table(spark, folder, "lineitem").select(
            "l_returnflag", "l_linestatus", "l_discount"
        ),
        "orders": table(spark, folder, "orders"),
    }
    rows = [(name, df.count(), duplicate_count(df)) for name, df in tables.items()]
    return spark.createDataFrame(rows, "name string, n_rows long, duplicate_rows long")


@query(
    "drop_duplicate_rows",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem",
)
def drop_duplicate_rows(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    return apply_quick_fixes(df, drop_duplicate_rows=True).df


@query(
    "drop_duplicate_documents",
    """SELECT text, lang, count(*) OVER () AS n_rows FROM (SELECT DISTINCT text, lang FROM documents)""",
)
def drop_duplicate_documents(spark, folder):
    """Whole texts; only rows of repeated hashes are shuffled."""
    df = drop_duplicates(table(spark, folder, "documents").select("text", "lang"))
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_rows"))))


@query(
    "missing_ratio",
    "WITH t AS (" + GAPS_SQL + ") " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6)
              AS missing_ratio,
              avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) >= 0.3 AS high_missing FROM t"""
        for c in LINEITEM_KINDS
    ),
)
def missing_ratio(spark, folder):
    profile = profile_table(lineitem_with_gaps(spark, folder), duplicates=False)
    return profile.to_df(spark).select(
        "column",
        F.round("missing_ratio", 6).alias("missing_ratio"),
        (F.col("missing_ratio") >= 0.3).alias("high_missing"),
    )


FIX_SUMMARY_SQL = """SELECT l_linenumber, count(*) AS n, round(sum(l_quantity), 4) AS quantity,
  round(sum(l_discount), 4) AS discount, count(DISTINCT l_returnflag) AS flags,
  min(l_returnflag) AS first_flag, count(l_linestatus) AS statuses FROM f GROUP BY l_linenumber"""


def fix_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 4).alias("quantity"),
        F.round(F.sum("l_discount"), 4).alias("discount"),
        F.count_distinct("l_returnflag").alias("flags"),
        F.min("l_returnflag").alias("first_flag"),
        F.count("l_linestatus").alias("statuses"),
    )


@query(
    "fix_drop_rows",
    f"""WITH t AS ({GAPS_SQL}), f AS (SELECT * FROM t WHERE l_quantity IS NOT NULL
        AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL)
        {FIX_SUMMARY_SQL}""",
)
def fix_drop_rows(spark, folder):
    return fix_summary(
        apply_quick_fixes(lineitem_with_gaps(spark, folder), missing_strategy="drop_rows").df
    )


@query(
    "fix_missing_target",
    f"""WITH t AS ({GAPS_SQL}), f AS (SELECT * FROM t WHERE l_returnflag IS NOT NULL)
        {FIX_SUMMARY_SQL}""",
)
def fix_missing_target(spark, folder):
    return fix_summary(
        apply_quick_fixes(lineitem_with_gaps(spark, folder), target="l_returnflag").df
    )


MODE_SQL = (
    "(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
)


@query(
    "fix_fill_simple",
    f"""WITH t AS ({GAPS_SQL}), f AS (SELECT l_linenumber,
          coalesce(l_quantity, (SELECT median(l_quantity) FROM t)) AS l_quantity,
          coalesce(l_discount, (SELECT median(l_discount) FROM t)) AS l_discount,
          coalesce(l_returnflag, {MODE_SQL.format(c='l_returnflag')}) AS l_returnflag,
          coalesce(l_linestatus, {MODE_SQL.format(c='l_linestatus')}) AS l_linestatus FROM t)
        {FIX_SUMMARY_SQL}""",
)
def fix_fill_simple(spark, folder):
    return fix_summary(
        apply_quick_fixes(lineitem_with_gaps(spark, folder), missing_strategy="fill_simple").df
    )


@query(
    "fix_actions",
    f"""WITH t AS ({GAPS_SQL})
        SELECT CAST(0 AS INTEGER) AS position, 'rows without l_returnflag removed: ' || count(*) AS action
        FROM t WHERE l_returnflag IS NULL
        UNION ALL
        SELECT 1, 'gaps filled: l_quantity ' || count(*) FILTER (WHERE l_quantity IS NULL)
          || ', l_discount ' || count(*) FILTER (WHERE l_discount IS NULL)
          || ', l_linestatus ' || count(*) FILTER (WHERE l_linestatus IS NULL)
        FROM t WHERE l_returnflag IS NOT NULL""",
)
def fix_actions(spark, folder):
    done = apply_quick_fixes(
        lineitem_with_gaps(spark, folder), target="l_returnflag", missing_strategy="fill_simple"
    )
    return done.actions_df(spark)


@query(
    "fix_preview",
    """WITH t AS (SELECT c_nationkey, c_mktsegment FROM customer)
       SELECT count(*) AS rows_before, CAST(3 AS BIGINT) AS columns_before,
         (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS rows_after,
         CAST(2 AS BIGINT) AS columns_after FROM t""",
)
def fix_preview(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_nationkey", "c_mktsegment", F.lit("EU").alias("zone")
    )
    p = apply_quick_fixes(customers, drop_duplicate_rows=True).preview
    return spark.createDataFrame(
        [(p["rows_before"], p["columns_before"], p["rows_after"], p["columns_after"])],
        "rows_before long, columns_before long, rows_after long, columns_after long",
    )


@query(
    "constant_columns",
    """WITH t AS (SELECT r_regionkey, r_name, 'x' AS tag, CAST(NULL AS BIGINT) AS nothing
                  FROM region)
       SELECT * FROM (
         SELECT 'r_regionkey' AS "column", count(DISTINCT r_regionkey) <= 1 AS constant FROM t
         UNION ALL SELECT 'r_name', count(DISTINCT r_name) <= 1 FROM t
         UNION ALL SELECT 'tag', count(DISTINCT tag) <= 1 FROM t
         UNION ALL SELECT 'nothing', count(DISTINCT nothing) <= 1 FROM t)""",
)
def constant_columns_query(spark, folder):
    df = table(spark, folder, "region").select(
        "r_regionkey", "r_name", F.lit("x").alias("tag"),
        F.lit(None).cast("long").alias("nothing"),
    )
    found = set(constant_columns(df))
    return spark.createDataFrame(
        [(c, c in found) for c in df.columns], "column string, constant boolean"
    )


@query("drop_constant_columns", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def drop_constant_columns(spark, folder):
    df = table(spark, folder, "nation").withColumn("planet", F.lit("earth"))
    return apply_quick_fixes(df).df


@query(
    "leakage_by_name",
    """SELECT c AS "column", contains(lower(trim(c)), 'flag') OR contains('flag', lower(trim(c)))
         AS leakage_hint, (SELECT count(*) FROM lineitem) AS n_rows
       FROM (VALUES ('returned_flag'), ('fl'), ('l_quantity'), ('FLAG_2'), ('status')) AS v(c)""",
)
def leakage_query(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_returnflag").alias("returned_flag"),
        F.col("l_linestatus").alias("fl"),
        "l_quantity",
        F.col("l_linestatus").alias("FLAG_2"),
        F.col("l_linestatus").alias("status"),
    )
    hits = set(leakage_by_name(df.columns, "flag"))
    n = df.count()
    return spark.createDataFrame(
        [(c, c in hits, n) for c in df.columns if c != "flag"],
        "column string, leakage_hint boolean, n_rows long",
    )


@query(
    "target_imbalance",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS target, (SELECT count(DISTINCT {t}) FROM {s}) AS n_classes,
              round(max(n) / sum(n), 6) AS top_share,
              (SELECT count(DISTINCT {t}) FROM {s}) <= 10 AND max(n) / sum(n) >= 0.9
                AS imbalanced
            FROM (SELECT {t}, count(*) AS n FROM {s} GROUP BY {t})"""
        for s, t in (("labels", "quality"), ("labels", "toxic"), ("orders", "o_orderpriority"))
    ),
)
def target_imbalance(spark, folder):
    rows = []
    for source, target in (
        ("labels", "quality"), ("labels", "toxic"), ("orders", "o_orderpriority"),
    ):
        profile = profile_table(table(spark, folder, source).select(target), target, False)
        c = profile[target]
        rows.append(
            (target, c.n_distinct, round(c.top_share, 6),
             any(w.rule == "imbalanced_target" for w in profile.warnings))
        )
    return spark.createDataFrame(
        rows, "target string, n_classes long, top_share double, imbalanced boolean"
    )


@query(
    "class_counts",
    "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority",
)
def class_counts_query(spark, folder):
    return class_counts(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "target_check",
    """SELECT toxic AS value, count(*) AS n FROM labels GROUP BY toxic""",
)
def target_check(spark, folder):
    counts = check_target(table(spark, folder, "labels"), "toxic")
    return spark.createDataFrame(list(counts.items()), "value int, n long")


@query(
    "class_weights",
    """SELECT quality AS value, count(*) AS n,
         round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight
       FROM labels GROUP BY quality""",
)
def class_weights(spark, folder):
    weights = balanced_weights(table(spark, folder, "labels"), "quality")
    return weights.select("value", "n", F.round("weight", 6).alias("weight"))


DATES_SQL = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso,
  strftime(o_orderdate, '%m/%d/%Y') AS slashed,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
       ELSE o_orderpriority END AS mixed, o_orderpriority FROM orders"""


def orders_with_text_dates(spark: SparkSession, folder: str) -> DataFrame:
    when = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format(when, "yyyy-MM-dd").alias("iso"),
        F.date_format(when, "MM/dd/yyyy").alias("slashed"),
        F.when(F.col("o_orderstatus") == "F", F.date_format(when, "yyyy-MM-dd"))
        .otherwise(F.col("o_orderpriority")).alias("mixed"),
        "o_orderpriority",
    )


@query(
    "date_like_columns",
    f"WITH t AS ({DATES_SQL}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column",
              avg(CASE WHEN regexp_matches({c}, '\\d') THEN 1.0 ELSE 0.0 END) >= 0.6
              AND avg(CASE WHEN regexp_matches({c}, '[-/:T]') THEN 1.0 ELSE 0.0 END) >= 0.6
              AND avg(CASE WHEN coalesce(try_strptime({c}, '%Y-%m-%d'),
                try_strptime({c}, '%m/%d/%Y')) IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.6
              AS is_date_like FROM t"""
        for c in ("iso", "slashed", "mixed", "o_orderpriority")
    ),
)
def date_like_columns(spark, folder):
    profile = profile_table(orders_with_text_dates(spark, folder), duplicates=False)
    return profile.to_df(spark).filter("column <> 'o_orderkey'").select("column", "is_date_like")


@query(
    "text_like_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({words_sql(c)}), 6) AS avg_words,
              round(avg(length({c})), 6) AS avg_chars,
              avg({words_sql(c)}) >= 2 OR avg(length({c})) >= 20 AS is_text_like
            FROM {s}"""
        for s, c in (
            ("documents", "text"), ("documents", "lang"), ("documents", "source"),
            ("part", "p_name"), ("part", "p_type"),
        )
    ),
)
def text_like_columns(spark, folder):
    documents = table(spark, folder, "documents").select("text", "lang", "source")
    parts = table(spark, folder, "part").select("p_name", "p_type")
    profiles = [
        profile_table(df, duplicates=False).to_df(spark) for df in (documents, parts)
    ]
    return profiles[0].unionByName(profiles[1]).select(
        "column", F.round("avg_words", 6).alias("avg_words"),
        F.round("avg_chars", 6).alias("avg_chars"), "is_text_like",
    )


@query(
    "rare_heavy_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column",
              round(avg(CASE WHEN n / total < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rare_share,
              count(*) >= 8 AND avg(CASE WHEN n / total < 0.05 THEN 1.0 ELSE 0.0 END) >= 0.5
                AS is_rare_heavy
            FROM (SELECT {c}, count(*) AS n, sum(count(*)) OVER () AS total
                  FROM part GROUP BY {c})"""
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def rare_heavy_columns(spark, folder):
    df = table(spark, folder, "part").select("p_name", "p_brand", "p_type")
    return profile_table(df, duplicates=False).to_df(spark).select(
        "column", F.round("rare_share", 6).alias("rare_share"), "is_rare_heavy"
    )


@query(
    "quality_warnings",
    """WITH t AS (SELECT text, lang, CAST(NULL AS VARCHAR) AS note,
                    CASE WHEN lang = 'en' THEN NULL ELSE source END AS lang_source
                  FROM documents)
       SELECT 'duplicate_rows' AS rule, CAST(NULL AS VARCHAR) AS "column",
         (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)))::DOUBLE AS value FROM t
       UNION ALL SELECT 'missing_values', 'note', 1.0
       UNION ALL SELECT 'missing_values', 'lang_source',
         avg(CASE WHEN lang_source IS NULL THEN 1.0 ELSE 0.0 END) FROM t
       UNION ALL SELECT 'constant', 'note', 0.0
       UNION ALL SELECT 'high_cardinality', 'text',
         count(DISTINCT text)::DOUBLE / count(*) FROM t
       UNION ALL SELECT 'name_like_target', 'lang_source', 1.0""",
)
def quality_warnings(spark, folder):
    df = table(spark, folder, "documents").select(
        "text", "lang", F.lit(None).cast("string").alias("note"),
        F.when(F.col("lang") != "en", F.col("source")).alias("lang_source"),
    )
    return profile_table(df, target="lang").warnings_df(spark)


@query(
    "recommend_fixes",
    f"""WITH t AS (SELECT text, source, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang
                   FROM documents),
        s AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS dup,
                avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) AS miss,
                avg({words_sql('text')}) >= 2 AS texty FROM t),
        r AS (SELECT count(*) >= 8 AND
                avg(CASE WHEN n / total < 0.05 THEN 1.0 ELSE 0.0 END) >= 0.5 AS rare
              FROM (SELECT text, count(*) AS n, sum(count(*)) OVER () AS total
                    FROM t GROUP BY text))
        SELECT dup > 0 AS drop_duplicate_rows, FALSE AS drop_constant_columns,
          CASE WHEN miss >= 0.3 THEN 'drop_rows' WHEN miss > 0 THEN 'fill_simple'
               ELSE 'none' END AS missing_strategy,
          FALSE AS date_extract, texty AS text_extract,
          CASE WHEN texty THEN 'text' ELSE '' END AS text_feature_columns,
          CASE WHEN rare THEN 0.05 ELSE 0.0 END::DOUBLE AS rare_category_min_freq,
          CAST((dup > 0)::INT + (miss > 0)::INT + texty::INT + rare::INT AS INTEGER) AS n_reasons
        FROM s, r""",
)
def recommend_query(spark, folder):
    df = table(spark, folder, "documents").select(
        "text", "source", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang")
    )
    return recommend_fixes(profile_table(df)).to_df(spark)


@query(
    "table_equality",
    """SELECT 'same' AS pair, TRUE AS equal, CAST(0 AS BIGINT) AS differing
       UNION ALL
       SELECT 'filtered', count(*) = 0, count(*) FROM orders WHERE o_orderstatus = 'P'
       UNION ALL
       SELECT 'doubled', count(*) = 0, count(*) FROM orders WHERE o_orderstatus = 'P'""",
)
def table_equality(spark, folder):
    orders = table(spark, folder, "orders")
    shuffled = orders.orderBy(F.col("o_totalprice").desc())
    fewer = orders.filter("o_orderstatus <> 'P'")
    rows = [
        (name, tables_equal(orders, other), table_difference(orders, other).count())
        for name, other in (
            ("same", shuffled), ("filtered", fewer),
            ("doubled", orders.unionByName(orders.filter("o_orderstatus = 'P'"))),
        )
    ]
    return spark.createDataFrame(rows, "pair string, equal boolean, differing long")


ALLOWED_SQL = """SELECT "column", value, rank FROM (
  SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column"
    ORDER BY count(*) DESC, value) AS INTEGER) AS rank
  FROM (SELECT 'p_name' AS "column", p_name AS value FROM part
        UNION ALL SELECT 'p_brand', p_brand FROM part
        UNION ALL SELECT 'p_type', p_type FROM part) GROUP BY "column", value)
  WHERE rank <= 25"""


@query("allowed_values", ALLOWED_SQL)
def allowed_values_query(spark, folder):
    return allowed_values(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])


@query(
    "unseen_values",
    f"""WITH a AS ({ALLOWED_SQL}),
        s AS (SELECT "column", value, count(*) AS n FROM (
          SELECT 'p_name' AS "column", trim(' ' || upper(p_name) || ' ') AS value FROM part
          UNION ALL SELECT 'p_brand', p_brand || CASE WHEN p_size = 50 THEN '!' ELSE '' END
          FROM part) GROUP BY "column", value)
        SELECT "column", value, n FROM s WHERE NOT EXISTS (SELECT 1 FROM a
          WHERE a."column" = s."column" AND lower(trim(a.value)) = lower(s.value))""",
)
def unseen_values_query(spark, folder):
    parts = table(spark, folder, "part")
    allowed = allowed_values(parts, ["p_name", "p_brand", "p_type"])
    batch = parts.select(
        F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("p_name"),
        F.concat("p_brand", F.when(F.col("p_size") == 50, "!").otherwise("")).alias("p_brand"),
        "p_size",
    )
    return unseen_values(batch, allowed)


@query(
    "auto_prepare",
    f"""WITH t AS (SELECT l_linenumber, CASE WHEN l_linenumber > 3 THEN l_quantity END AS l_quantity,
                     l_discount, l_returnflag, l_linestatus FROM ({GAPS_SQL})),
        u AS (SELECT DISTINCT * FROM t),
        f AS (SELECT * FROM u WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL
              AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL)
        {FIX_SUMMARY_SQL}""",
)
def auto_prepare_query(spark, folder):
    """Profile, recommend and fix in one go; here rows get dropped, not filled."""
    df = lineitem_with_gaps(spark, folder).select(
        "l_linenumber", F.when(F.col("l_linenumber") > 3, F.col("l_quantity")).alias("l_quantity"),
        "l_discount", "l_returnflag", "l_linestatus",
    )
    done = auto_prepare(df, rare_grouping=False)
    return fix_summary(done.fixed.df.select(*[col(c) for c in df.columns]))
