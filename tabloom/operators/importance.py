"""Feature importance: built-in, by coefficient, and by permutation."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import with_row_identity
from ..functions.permute import key_text, permutation_rounds, permuted_columns, series_at_once
from ..functions.runtime import shuffles_dropped

# Repeats and seed of the permutation importance.
REPEATS = 10
SEED = 42


def model_importances(
    spark: SparkSession, model, feature_names: list[str] | None = None
) -> DataFrame | None:
    """(feature, importance, importance_type), or None for models that have neither.

    Tree models give their built-in importances, linear models absolute
    coefficients; a coefficient matrix is averaged over its rows.
    """
    if hasattr(model, "featureImportances"):
        values, kind = model.featureImportances.toArray(), "built_in"
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
        kind = "coefficient"
    elif hasattr(model, "coefficients"):
        values, kind = np.abs(model.coefficients.toArray()), "coefficient"
    else:
        return None
    names = feature_names or [f"feature_{i}" for i in range(len(values))]
    rows = [(str(n), float(v), kind) for n, v in zip(names, values)]
    return spark.createDataFrame(
        rows, "feature string, importance double, importance_type string"
    )


def permutation_importance(
    model: Transformer,
    df: DataFrame,
    task: str = "classification",
    label: str = "label",
    features: str = "features",
    feature_names: list[str] | None = None,
    repeats: int = REPEATS,
    seed: int = SEED,
    keys: list[str] | None = None,
) -> DataFrame:
    """(feature, importance, importance_std): drop of the score when a feature is shuffled.

    The score is accuracy, or negative mean squared error for regression. Each repeat
    permutes the whole column by ranks of keyed hashes (``functions.permute``), so a
    result can be recomputed from the keys alone. What is shuffled grows with features
    times repeats, one number each, and on large tables a few permutations are shuffled
    and scored at a time; changed vectors only exist inside the task that scores them. ``keys`` identify a row; without them rows are told apart by file and
    index, or the table is written once to fix the positions of its rows.
    """
    if not keys:
        df = with_row_identity(df, "__row")
        keys = ["__row"]
    rows = df.select(
        key_text(df, keys).alias("key"), vector_to_array(F.col(features)).alias("x"),
        F.col(label).cast("double").alias("label"),
    )
    first = rows.select("x").first()
    if first is None:
        raise ValueError("permutation importance needs at least 1 row")
    width = len(first["x"])
    measure = score_measure(task)
    whole = model.transform(
        df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"))
    ).agg(measure.alias("score"), F.count(F.lit(1)).alias("n")).first()

    # The feature of a permutation is replaced in the vector; the rest of it stays.
    place = F.floor(F.col("series") / F.lit(repeats)).cast("int")
    changed = F.concat(
        F.slice("x", F.lit(1), place), F.array("value"),
        F.slice("x", place + 2, F.lit(width) - 1 - place),
    )

    def scores(permuted: DataFrame) -> DataFrame:
        vectors = permuted.select("series", "label", array_to_vector(changed).alias("features"))
        return model.transform(vectors).groupBy("series").agg(measure.alias("score"))

    order = (rows, whole["n"], width, repeats, seed)
    if series_at_once(whole["n"]) >= width * repeats:
        each = scores(permuted_columns(*order))
    else:
        spark = df.sparkSession
        with shuffles_dropped(spark):
            # One row for each permutation.
            found = [r for part in permutation_rounds(*order) for r in scores(part).collect()]
        each = spark.createDataFrame(found, "series int, score double")
    names = feature_names or [f"feature_{i}" for i in range(width)]
    drop = F.lit(float(whole["score"])) - F.col("score")
    named = F.element_at(F.array(*[F.lit(str(v)) for v in names]), place + 1)
    return (
        each.groupBy(place.alias("place"), named.alias("feature"))
        .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("importance_std"))
        .drop("place")
    )


def score_measure(task: str) -> Column:
    """Score of predictions as an aggregate: negative mean squared error, or accuracy."""
    if task == "regression":
        return -F.avg((F.col("label") - F.col("prediction")) ** 2)
    return F.avg((F.col("label") == F.col("prediction")).cast("double"))
