"""Rows without keys: identity by file and index, splits without a checkpoint."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.expressions import nan_to_null
from tabloom.functions.identity import file_identity, in_source_order, with_row_identity
from tabloom.operators.split import split_rows
from tabloom.plans import jobs
from tabloom.sources.writers import write_predictions


@pytest.fixture
def files(spark, folder):
    path = f"{folder}/rows"
    df = spark.range(4000).select(
        (F.col("id") % 5).alias("a"), F.sin("id").alias("b"), (F.col("id") % 3 == 0).cast("string").alias("y")
    )
    df.repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    return path


def test_identity_is_that_of_the_file(spark, files):
    df = spark.read.parquet(files)
    assert file_identity(df) is not None
    deep = nan_to_null(df).withColumn("c", F.col("a") + 1).filter("a < 4").withColumnsRenamed({"b": "z"})
    assert file_identity(deep) is not None
    ids = with_row_identity(df, "k")
    assert ids.select("k").distinct().count() == 4000
    # A table that isn't a scan any more has no such identity; positions are written.
    assert file_identity(df.groupBy("a").count()) is None
    assert file_identity(spark.range(5)) is None
    assert with_row_identity(spark.range(5), "k").select("k").distinct().count() == 5


def read_in(spark, files, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = spark.read.parquet(files)
        split = split_rows(df, 0.3, stratify="y")
        plan = split._jdf.queryExecution().toString()
        key = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        return df.rdd.getNumPartitions(), {
            r[0] for r in split.filter("split = 'test'").select(key).collect()
        }, plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_without_keys_is_the_same_on_any_partitioning(spark, files):
    few, one, plan = read_in(spark, files, "1g")
    many, other, _ = read_in(spark, files, "4k")
    assert many > few and one == other and len(one) == 1200
    physical = plan[plan.index("== Physical Plan =="):]
    assert "FileScan parquet" in physical and "ExistingRDD" not in physical and "Exchange" not in physical


def test_equal_rows_are_dealt_out_one_by_one(spark, folder):
    spark.range(1000).select(F.lit(1).alias("v")).coalesce(1).write.parquet(f"{folder}/same")
    parts = split_rows(spark.read.parquet(f"{folder}/same"), 0.25)
    assert parts.filter("split = 'test'").count() == 250


def test_repeated_scans_still_give_exact_sizes(spark, files):
    """A union reads each row twice: two rows of one identity."""
    df = spark.read.parquet(files)
    parts = split_rows(df.unionAll(df), 0.25)
    assert parts.filter("split = 'test'").count() == 2000


def test_training_without_keys(spark, files):
    df = spark.read.parquet(files).withColumn("t", F.col("b") * 2 + F.col("a"))
    done = jobs.train_tabular(df, "t", "regression_linear", features=["a", "b"])
    assert done.metrics["r2"] == pytest.approx(1.0)
    assert done.prepared.test.count() == 800


def test_scored_rows_are_written_in_the_order_of_the_source(spark, folder):
    path = f"{folder}/in"
    values = np.random.default_rng(1).permutation(3000).tolist()
    spark.createDataFrame([(int(v),) for v in values], "v long").coalesce(1).write.option(
        "parquet.block.size", 2048
    ).parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        df = spark.read.parquet(path).withColumn("prediction", F.col("v") * 2)
        out = write_predictions(df, f"{folder}/out", "in.csv", "parquet", source_order=True)
        written = []
        import glob

        for part in sorted(glob.glob(f"{out}/part-*")):
            written += [r["v"] for r in spark.read.parquet(part).coalesce(1).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert written == values
    assert in_source_order(spark.range(3)).count() == 3
