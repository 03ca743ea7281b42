"""Session helpers: checkpoint folder and partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; local tests get their own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="run-checkpoints-")
    sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it from there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries made and run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Queries inside remove their shuffle files as they end, not when the driver collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def placed_checkpoint(df: DataFrame) -> DataFrame:
    """``checkpointed``, and known to lie where the last shuffle put it: joins on its keys move the other side only."""
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return checkpointed(df.select("*"))


MAX_TASKS = 10_000


def by_group(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Place groups for a Python function on enough tasks.

    Such groups are small in bytes but long in computing time, so the adaptive
    merging of small partitions must not put them together.
    """
    return df.repartition(max(1, min(groups, MAX_TASKS)), *keys)


def cached_for_iteration(df: DataFrame) -> DataFrame:
    """Keep ``df`` for repeated passes, on at least as many partitions as cores.

    Only a table with fewer partitions than cores, hence a small one, is
    redistributed. The caller unpersists the result.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if kept.rdd.getNumPartitions() >= cores:
        return kept
    wide = kept.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    wide.count()
    kept.unpersist()
    return wide
