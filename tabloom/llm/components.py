"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component.

    ``links`` has long columns a and b. Nodes without links are not listed. A round
    takes minima per node with partial aggregation and joins them back, so a node
    with very many links is spread by the join's skew handling; each round is
    written to the shared folder.
    """
    edges = stage(
        links.filter(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct(),
        "edges",
    )
    if not edges.limit(1).count():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    last = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        # Small star: from now on v < u in every row.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = stage(
            small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        # Settled when the set of edges stays: its size and the exact sum of 64-bit hashes.
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(
        F.col("u").alias("node"), "label"
    )
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return stage(labels.unionAll(roots).distinct(), "labels")
