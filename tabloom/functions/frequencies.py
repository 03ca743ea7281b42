"""Value counts of many columns in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import canonical_text, counting_key, field_types, quoted
from .runtime import checkpointed

LONG_TEXT = 64


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): one row per column and distinct value, NULL included.

    The columns are stacked and counted together. Counting is combined on the
    map side, so a value that fills a third of the table costs one row per task.
    """
    types = field_types(df)
    stacked = df.select(
        *[canonical_text(c, types[c]).alias(c) for c in columns]
    ).unpivot([], [quoted(c) for c in columns], "column", "value")
    return stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def short_key(text: Column) -> Column:
    """A text of at most ``LONG_TEXT`` characters, or the head of a longer one and its digest.

    Keys are equal exactly for equal texts, and sort like their texts up to equal heads.
    """
    head = F.concat(F.substring(text, 1, LONG_TEXT), F.lit("\x01"), F.sha2(text, 256))
    return F.when(F.length(text) > LONG_TEXT, head).otherwise(text)


def key_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, key, n): as ``value_counts`` without NULLs, by ``short_key``: no long text is shuffled."""
    types = field_types(df)
    stacked = df.select(
        *[short_key(canonical_text(c, types[c])).alias(c) for c in columns]
    ).unpivot([], [quoted(c) for c in columns], "column", "key")
    return (
        stacked.filter(F.col("key").isNotNull())
        .groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"))
    )


def with_texts(df: DataFrame, counted: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``counted`` (column, key, ...) with ``value`` in place of ``key``.

    Short keys are their texts. For the others a second pass reads the texts of wanted
    keys only, one copy a task.
    """
    types = field_types(df)
    long = counted.filter(F.length("key") > LONG_TEXT)
    columns = [r["column"] for r in long.select("column").distinct().collect()]
    if not columns:
        return counted.withColumnRenamed("key", "value")
    wanted = long.select(F.col("column").alias("__c"), F.col("key").alias("__k"))
    if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    stacked = df.select(*[canonical_text(c, types[c]).alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "__c", "__t"
    ).filter(F.length("__t") > LONG_TEXT).withColumn("__k", short_key(F.col("__t")))
    texts = stacked.join(wanted, ["__c", "__k"], "left_semi").groupBy("__c", "__k").agg(
        F.first("__t").alias("__t")
    )
    found = counted.join(
        texts, (F.col("column") == F.col("__c")) & (F.col("key") == F.col("__k")), "left"
    ).withColumn("value", F.coalesce("__t", "key"))
    others = [c for c in counted.columns if c not in ("column", "key")]
    return found.select("column", "value", *others)


def multiplicities(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, n): one row per column and distinct non-null value.

    ``x`` is the value as a double, NULL for texts. Columns are stacked by kind
    (long, double, text), so numbers are counted as numbers, and texts longer
    than a digest travel as their SHA-256.
    """
    types = field_types(df)
    kinds: dict[str, list] = {}
    for c in columns:
        kind, key = counting_key(c, types[c])
        if kind == "text":
            key = F.when(F.length(key) > LONG_TEXT, F.sha2(key, 256)).otherwise(key)
        kinds.setdefault(kind, []).append((c, key))
    parts = []
    for kind, members in kinds.items():
        x = F.lit(None) if kind == "text" else F.col("value")
        stacked = df.select(*[key.alias(c) for c, key in members]).unpivot(
            [], [quoted(c) for c, _ in members], "column", "value"
        )
        parts.append(
            stacked.filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            .select("column", x.cast("double").alias("x"), "n")
        )
    return reduce(DataFrame.unionAll, parts)


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, the smallest one on ties."""
    if not columns:
        return {}
    heads = Window.partitionBy("column").orderBy(F.col("n").desc(), F.substring("key", 1, LONG_TEXT))
    first = key_counts(df, columns).withColumn("rank", F.rank().over(heads)).filter("rank = 1")
    rows = (
        with_texts(df, checkpointed(first.drop("rank")))
        .groupBy("column").agg(F.min("value").alias("value")).collect()
    )
    found = {r["column"]: r["value"] for r in rows}
    return {c: found.get(c) for c in columns}
