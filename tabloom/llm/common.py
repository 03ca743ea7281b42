"""Helpers of the operators in this folder: staging, words, memos, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import ensure_checkpoint_dir

#: Entries that a worker keeps of words it has seen; a full memo starts anew.
MEMO_ENTRIES = 100_000

#: Rows handled at once inside an Arrow batch, so that long texts don't pile up as Python objects.
SLICE_ROWS = 256


class Memo(dict):
    """Bounded memo of a pure function of one key."""

    def __init__(self, make: Callable, limit: int = MEMO_ENTRIES) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint, but columnar: later passes read
    only the columns they need. The folder's retention rule removes the files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


#: ASCII letters that are lower-cased; everything that isn't a letter, a digit or
#: a byte of a longer character ends a word.
_WORD_BYTES = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that sums of hashes can serve as hashes."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return (x ^ (x >> np.uint64(27))) * _MIX


#: Rows of ids, or of ids with short lists, that may be broadcast; counted before.
BROADCAST_ROWS = 1_000_000


def small_or_not(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` marked for broadcast if its counted rows are few; else it is shuffled.

    ``table`` must be staged or cheap, as it is counted first.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
