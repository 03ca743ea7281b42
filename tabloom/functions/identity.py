"""Identity of rows that have no key.

A row of a Parquet file is known by its file and its index in it: that stays the same however
the file is split into tasks and whichever task is run again, and costs no pass. Where a table
doesn't come straight from Parquet files, positions are fixed by a checkpoint instead.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed

#: Digits of a row index in the text of an identity: indexes sort as texts.
INDEX_DIGITS = 12


def file_identity(df: DataFrame) -> Column | None:
    """Text of file and row index, or None if the table isn't read from Parquet files.

    Texts sort by file, then by place in the file.
    """
    identity = F.concat_ws(
        ":", F.col("_metadata.file_path"),
        F.lpad(F.col("_metadata.row_index").cast("string"), INDEX_DIGITS, "0"),
    )
    try:
        df.select(identity).schema
    except AnalysisException:
        return None
    return identity


def with_row_identity(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``, which tells rows apart and is the same whenever a task is run again."""
    identity = file_identity(df)
    if identity is not None:
        # The digest is short; the hash of a path would be enough for a few files only.
        return df.withColumn(name, F.md5(identity))
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def in_source_order(df: DataFrame) -> DataFrame:
    """Rows in the order of the Parquet files they are read from; other tables as they are.

    A range sort by file and index: partitions follow each other, so written parts do too.
    """
    identity = file_identity(df)
    return df if identity is None else df.orderBy(identity)
