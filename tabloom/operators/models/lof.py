"""Local outlier factor (Breunig et al. 2000), fitted on one table, scoring another.

Equal vectors are merged first and carry their multiplicity, so a group of
copies costs one row however large it is. All later steps are joins and
aggregations on (point, neighbour) rows, k per point.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.lookup import lookup_join
from ...functions.quantiles import exact_quantiles
from ...functions.runtime import checkpointed
from ..persistence import FittedStage
from .common import anomaly_columns
from .neighbors import nearest_neighbors
from .projections import BANDS, BUCKET_ROWS, approximate_neighbors

# Decision threshold for contamination="auto", and the term that
# keeps the density of copies finite.
AUTO_THRESHOLD = 1.5
DENSITY_EPSILON = 1e-10


def vector_id(x):
    """Identity of a vector by its values; -0.0 counts as 0.0."""
    return F.sha2(F.transform(x, lambda v: v + F.lit(0.0)).cast("string"), 256)


def _distinct(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"))


def _vector_rows(dataset: DataFrame) -> DataFrame:
    x = vector_to_array("features")
    return dataset.select(vector_id(x).alias("id"), x.alias("x"))


class LocalOutlierFactor(Estimator):
    """``search="projections"`` finds neighbours approximately (see ``projections``); ``"exact"`` finds all.

    The mode is the caller's choice and never depends on the table.
    """

    def __init__(
        self,
        n_neighbors: int = 20,
        contamination: float | str = "auto",
        search: str = "exact",
        bands: int = BANDS,
        bucket_rows: int = BUCKET_ROWS,
    ):
        super().__init__()
        if search not in ("exact", "projections"):
            raise ValueError(f"search must be 'exact' or 'projections', got '{search}'")
        self.n_neighbors = n_neighbors
        self.contamination = contamination
        self.search = {"mode": search, "bands": bands, "bucket_rows": bucket_rows}

    def _fit(self, dataset: DataFrame) -> "LocalOutlierFactorModel":
        rows = _vector_rows(dataset)
        points = checkpointed(_distinct(rows))
        n = int(points.agg(F.sum("copies")).first()[0] or 0)
        if n < 2:
            raise ValueError("local outlier factor needs at least 2 rows")
        k = min(self.n_neighbors, n - 1)
        near = checkpointed(_search(points, points, k, self.search, same=True))
        own = points.filter(F.col("copies") > 1).select(
            F.col("id").alias("qid"),
            F.col("id").alias("pid"),
            F.lit(0.0).alias("dist"),
            (F.col("copies") - 1).alias("copies"),
        )
        others = _attach(near, points.select("id", "copies"))
        taken = checkpointed(_take(others.unionByName(own), k))
        reach = taken.groupBy("qid").agg(F.max("dist").alias("kdist"))
        density = _densities(taken, reach, k).withColumnsRenamed({"qid": "id"})
        fitted = checkpointed(
            points.join(reach.withColumnsRenamed({"qid": "id"}), "id").join(density, "id")
        )
        model = LocalOutlierFactorModel(
            {"k": k, "threshold": AUTO_THRESHOLD, "search": self.search}, {"points": fitted}
        )
        if self.contamination != "auto":
            scores = _factors(taken, fitted, k)
            per_row = lookup_join(
                rows.select("id"),
                scores.join(points.select(F.col("id").alias("qid"), "copies"), "qid"),
                "id", "qid", weight="copies",
            ).select(F.col("raw_score").alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
            share = 1.0 - float(self.contamination)
            cut = exact_quantiles(per_row, ["s"], [share], counts={"s": n})["s"][0]
            per_row.unpersist()
            model.state["threshold"] = cut
        return model


class LocalOutlierFactorModel(FittedStage):
    def score(self, dataset: DataFrame) -> DataFrame:
        """Add ``raw_score``: about 1 inside a cluster, greater for outliers."""
        k, points = self.state["k"], self.tables["points"]
        queries = checkpointed(_distinct(_vector_rows(dataset)))
        near = checkpointed(_search(queries, points, k, self.state.get("search") or EXACT))
        taken = checkpointed(_take(_attach(near, points.select("id", "copies")), k))
        scores = _factors(taken, points, k).join(
            queries.select(F.col("id").alias("qid"), F.col("copies").alias("__copies")), "qid"
        )
        keyed = dataset.withColumn("__vector", vector_id(vector_to_array("features")))
        scored = lookup_join(keyed, scores, "__vector", "qid", weight="__copies")
        return scored.drop("__vector", "__copies")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return anomaly_columns(self.score(dataset), self.state["threshold"])


EXACT = {"mode": "exact"}


def _search(queries: DataFrame, points: DataFrame, k: int, search: dict, same: bool = False) -> DataFrame:
    if search["mode"] == "exact":
        return nearest_neighbors(queries, points, k, same=same)
    return approximate_neighbors(
        queries.select("id", "x"), points.select("id", "x"), k, same, search["bands"], search["bucket_rows"]
    )


def _attach(near: DataFrame, table: DataFrame) -> DataFrame:
    """Join per-point columns to (qid, pid, dist); popular neighbours are split off."""
    degree = near.groupBy("pid").agg(F.count(F.lit(1)).alias("degree"))
    weighted = degree.join(table.withColumnRenamed("id", "pid"), "pid")
    return lookup_join(near, weighted, "pid", "pid", weight="degree").drop("degree")


def _take(near: DataFrame, k: int) -> DataFrame:
    """Keep neighbours in order of distance until ``k`` rows are reached; ``w`` sums to k."""
    before = (
        Window.partitionBy("qid").orderBy("dist", "pid")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.coalesce(F.sum("copies").over(before), F.lit(0))
    return (
        near.withColumn("seen", seen)
        .filter(F.col("seen") < k)
        .select("qid", "pid", "dist", F.least(F.col("copies"), F.lit(k) - F.col("seen")).alias("w"))
    )


def _densities(taken: DataFrame, reach: DataFrame, k: int) -> DataFrame:
    """(qid, lrd): inverse mean reachability distance."""
    joined = _attach(taken, reach.withColumnRenamed("qid", "id"))
    mean = F.sum(F.greatest("kdist", "dist") * F.col("w")) / F.lit(float(k))
    return joined.groupBy("qid").agg((1.0 / (mean + F.lit(DENSITY_EPSILON))).alias("lrd"))


def _factors(taken: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(qid, raw_score): mean density of the neighbours over the own density."""
    joined = _attach(
        taken, points.select("id", "kdist", F.col("lrd").alias("neighbor_lrd"))
    )
    mean = F.sum(F.greatest("kdist", "dist") * F.col("w")) / F.lit(float(k))
    return joined.groupBy("qid").agg(
        (
            F.sum(F.col("neighbor_lrd") * F.col("w")) / F.lit(float(k))
            * (mean + F.lit(DENSITY_EPSILON))
        ).alias("raw_score")
    )
