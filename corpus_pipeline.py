"""Five-stage cleaning of ``documents``; every stage calls one operator of ``tabloom.llm``.

A stage gets a session, the documents its predecessor kept and the folder of the tables.
All but the last return the columns of ``documents``, whatever other columns these have.

Rows of one id are one document: where a stage drops a document by its id, all of its rows go.
NULL texts are judged like empty ones; equal rows stay equal rows but in the third stage,
which keeps one of them; of tied copies the smallest id stays, and a NULL id is never the
smallest. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from tabloom.llm.common import small_or_not, stage
from tabloom.llm.queries import tokenizer

#: The stages learn, index and count over what they are given; SQL can't express them.
ORACLE_SQL = None


#: Rows of an Arrow batch: documents are long, and a task holds a batch on both sides.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers; results don't hang on the size of batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with names that no operator uses for all columns but id and text, and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"__given_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, [F.col(n).alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    renamed, back = _apart(docs)
    scored = toxicity.score(renamed, toxicity.train(docs, labels), keep=tuple(renamed.columns))
    return scored.filter("predicted = 0").select(*back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; a document that consists of nothing else goes too."""
    _small_batches(spark)
    renamed, back = _apart(docs)
    cleaned = line_dedup.remove(renamed)
    emptied = (F.col("n_dropped") > 0) & (F.col("text") == "")
    kept = cleaned.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" not in docs.columns:
        return kept.select(*back)
    # A text that lost lines has a new length.
    given = f"__given_{docs.columns.index('n_chars')}"
    kind = docs.schema["n_chars"].dataType
    return kept.withColumn(
        given, F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col(given))
    ).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Near copies share 80 % of their shingles of five words; the contract of the op8 query
    (four words, 85 %) is that query's alone.
    """
    _small_batches(spark)
    found = jaccard_join.join(docs, width=5, percent=80)
    gone = stage(
        found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", "component_id").distinct(),
        "near-copies",
    )
    kept = docs.join(small_or_not(gone.select("doc_id").distinct()), "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "text"]) if repeated else kept).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _small_batches(spark)
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(found.select("doc_id").distinct(), "leaks")
    return docs.join(small_or_not(gone), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of 4096 tokens."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
