"""Token counts through a digest cache.

Content is normalised (runs of ASCII blanks become one, outer ones go: the
tokenizer drops blanks, so counts stay) and digested together with the
tokenizer's version. Stored counts are joined by that digest; only distinct
misses are encoded, and their counts are appended to the cache.

Defined results: NULL text counts as empty (0 bytes, 0 tokens); repeated rows and
repeated ids give a row each; an empty table gives no rows and leaves the cache as
it is; columns besides the id and the text are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices, text_or_empty

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def _digest(content: Column, version: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(f"{version}|"), content), 256), 1, 32))


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                counts = [tokens.count(t, path) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array([version] * batch.num_rows, pa.string()),
                    ],
                    ["digest", "n_tokens", "tokenizer"],
                )

    return run


def open_cache(spark, path: str) -> DataFrame:
    """Stored counts; the folder is made if there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def fill_cache(docs: DataFrame, cache_path: str, tokenizer: str, text: str = "text") -> None:
    """Encode the distinct contents whose counts aren't stored, and append them.

    The shuffle carries one row per distinct content and map task at most, so a
    content that fills a third of the table is one row per task. A failed run
    appends nothing; contents that two runs append at once are read as one.
    """
    spark, version = docs.sparkSession, tokens.version(tokenizer)
    stored = open_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest")
    content = docs.select(normalised(text_or_empty(text)).alias("content"))
    distinct = content.select(
        _digest(F.col("content"), version).alias("digest"), "content"
    ).dropDuplicates(["digest"])
    misses = distinct.join(stored, "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(
        cache_path
    )


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer: str,
    limit: int = 2048,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    spark, version = docs.sparkSession, tokens.version(tokenizer)
    fill_cache(docs, cache_path, tokenizer, text)
    stored = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        .filter(F.col("tokenizer") == version)
        .groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    )
    rows = docs.select(
        F.col(key).alias(key),
        F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"),
        _digest(normalised(text_or_empty(text)), version).alias("digest"),
    )
    return rows.join(stored, "digest", "left").select(
        key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
