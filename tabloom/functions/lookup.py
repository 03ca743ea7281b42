"""Left join against a per-key table, safe for hot keys and big tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import col

# A table is broadcast only when both its rows and the bytes of its keys are
# known to stay below these limits.
BROADCAST_ROWS = 500_000
BROADCAST_KEY_BYTES = 64 << 20
HOT_KEYS = 1_000
HOT_KEY_BYTES = 10_000
SALTS = 4_096


def key_bytes(key):
    return F.octet_length(key.cast("string"))


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    key: str,
    table_key: str,
    weight: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    size: tuple[int, int] | None = None,
) -> DataFrame:
    """Add the other columns of ``table`` (one row per ``table_key``) to ``df``.

    ``size`` is (rows, bytes of all keys) of the table when known; otherwise it
    is measured. A small table is broadcast. For a larger one its most frequent
    keys (by ``weight``) are broadcast, and the rows they do not serve meet the
    rest of the table in a shuffle. Served rows travel under a salt made of the
    row and its partition, so a key that holds a third of all rows never lands
    in one task, and a task that is run again sends its rows to the same places.
    """
    extra = [c for c in table.columns if c != table_key]
    if size is None:
        row = (
            table.limit(broadcast_rows + 1)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(key_bytes(col(table_key))).alias("b"))
            .first()
        )
        size = (row["n"], row["b"] or 0)
    small = table.withColumnRenamed(table_key, "__k")
    if size[0] <= broadcast_rows and size[1] <= BROADCAST_KEY_BYTES:
        return df.join(F.broadcast(small), col(key) == F.col("__k"), "left").drop("__k")

    payload = small.select("__k", F.struct(*[col(c) for c in extra]).alias("__v"))
    if weight is None:
        hot = payload.limit(0)
    else:
        hot = (
            small.filter(key_bytes(F.col("__k")) <= HOT_KEY_BYTES)
            .orderBy(F.col(weight).desc(), "__k").limit(HOT_KEYS)
            .select("__k", F.struct(*[col(c) for c in extra]).alias("__v"))
        )
    hot = hot.withColumnsRenamed({"__k": "__hk", "__v": "__hv"})
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    spread = F.xxhash64(*[col(c) for c in hashable], F.spark_partition_id())
    marked = df.withColumn("__spread", spread).join(
        F.broadcast(hot), col(key) == F.col("__hk"), "left"
    )
    # Served rows and rows without a key get a salt that matches nothing.
    served = F.col("__hk").isNotNull() | col(key).isNull()
    marked = marked.withColumn(
        "__salt",
        F.when(served, F.pmod("__spread", F.lit(SALTS)) + 1).otherwise(F.lit(0)),
    ).withColumn("__ck", F.when(~served, col(key)))
    cold = payload.withColumn("__zero", F.lit(0).cast("long"))
    joined = marked.join(
        cold,
        (F.col("__ck") == F.col("__k")) & (F.col("__salt") == F.col("__zero")),
        "left",
    )
    value = F.coalesce(F.col("__hv"), F.col("__v"))
    return joined.select(
        *[col(c) for c in df.columns],
        *[value.getField(c).alias(c) for c in extra],
    )
