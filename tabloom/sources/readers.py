"""Reading tables and checking what a labelled table must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col, nan_to_null, text_to_double
from .files import path_exists

# Texts that stand for a missing value in CSV files.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


#: Standard CSV: quotes are doubled inside quoted fields, blanks belong to the value.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
_SURPLUS = "__surplus_field"


def read_table(
    spark: SparkSession,
    source: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    **options,
) -> DataFrame:
    """Read a table lazily, missing values as NULL.

    CSV needs a header row. Quoted fields may hold quotes, delimiters and line
    breaks; ``multi_line=False`` lets Spark split very large single files, whose
    fields must not hold line breaks then. A field that is exactly one of
    ``MISSING_TEXTS`` is NULL, with and without a schema; blanks are kept. A row with
    fewer fields than the header is filled up with NULL, a row with more is an error
    when it is read. Without ``schema`` columns are inferred as integer, double,
    boolean or text in one pass; dates stay text. With one, fields that don't fit
    their type are NULL.
    """
    if fmt != "csv":
        reader = spark.read.format(fmt).options(**options)
        if schema is not None:
            reader = reader.schema(schema)
        return nan_to_null(reader.load(source))
    options = {**CSV_OPTIONS, "multiLine": multi_line, **options}
    names = csv_header(spark, source, **options)
    duplicates = sorted({n for n in names if names.count(n) > 1})
    if duplicates:
        raise ValueError(f"duplicate column names found: {duplicates}")
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _SURPLUS]])
    raw = spark.read.options(**options).schema(fields).csv(source)
    whole = F.when(
        col(_SURPLUS).isNotNull(),
        F.raise_error(F.lit(f"a row of '{source}' has more fields than its header")),
    ).otherwise(F.lit(True))
    clean = raw.filter(whole.cast("boolean")).select(
        *[F.when(~col(n).isin(MISSING_TEXTS), col(n)).alias(n) for n in names]
    )
    if schema is None:
        return infer_types(clean)
    wanted = spark.createDataFrame([], schema).schema
    if len(wanted) != len(names):
        raise ValueError(f"the schema has {len(wanted)} columns, '{source}' has {len(names)}")
    return nan_to_null(
        clean.toDF(*wanted.fieldNames()).select(
            *[
                (
                    col(f.name) if isinstance(f.dataType, T.StringType)
                    else F.trim(col(f.name)).try_cast(f.dataType)
                ).alias(f.name)
                for f in wanted.fields
            ]
        )
    )


def csv_header(spark: SparkSession, source: str, **options) -> list[str]:
    """Column names as written in the file, before Spark renames duplicates."""
    options = {**CSV_OPTIONS, **options, "header": False}
    first = spark.read.options(**options).csv(source).limit(1).collect()
    if not first:
        raise ValueError(f"'{source}' has no header")
    return [v if v is not None else f"_c{i}" for i, v in enumerate(first[0])]


def infer_types(df: DataFrame) -> DataFrame:
    """Narrow text columns to long, double or boolean where every value allows it."""
    names = df.columns
    if not names:
        return df
    checks = []
    for i, n in enumerate(names):
        text = F.trim(col(n))
        checks += [
            F.count(text).alias(f"n{i}"),
            F.count(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))).alias(f"l{i}"),
            F.count(text_to_double(text)).alias(f"d{i}"),
            F.count_if(F.lower(text).isin("true", "false")).alias(f"b{i}"),
        ]
    row = df.agg(*checks).first()
    out = []
    for i, n in enumerate(names):
        c, total = F.trim(col(n)), row[f"n{i}"]
        if total and row[f"l{i}"] == total:
            out.append(c.try_cast("long").alias(n))
        elif row[f"d{i}"] == total:  # a column without any value counts as double
            out.append(text_to_double(c).alias(n))
        elif row[f"b{i}"] == total:
            out.append((F.lower(c) == "true").alias(n))
        else:
            out.append(col(n))
    return nan_to_null(df.select(*out))


def load_labelled(
    spark: SparkSession, source: str, target: str, fmt: str = "csv", **kwargs
) -> DataFrame:
    """A table with at least one row and the named target column."""
    if not isinstance(source, str) or not source:
        raise ValueError(f"source must be a non-empty string, got {source!r}")
    if not isinstance(target, str) or not target:
        raise ValueError(f"target must be a non-empty string, got {target!r}")
    if not path_exists(spark, source):
        raise FileNotFoundError(f"source not found: {source}")
    df = read_table(spark, source, fmt, **kwargs)
    if df.isEmpty():
        raise ValueError(f"'{source}' has no rows")
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing. Available columns: {df.columns}")
    return df


def load_batch(spark: SparkSession, source: str, fmt: str = "csv", **kwargs) -> DataFrame:
    """A table to score; an empty one is rejected."""
    if not path_exists(spark, source):
        raise FileNotFoundError(f"source not found: {source}")
    df = read_table(spark, source, fmt, **kwargs)
    if df.isEmpty():
        raise ValueError(f"'{source}' has no rows")
    return df
