"""Cross-fitted target encoding with automatic smoothing.

A category is replaced by a shrunken mean of the target. Rows used for fitting
get the encoding learned on the other of two folds; all other rows get the
encoding learned on everything. All three encodings come from one aggregation
by (column, category, fold).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col, field_types, quoted
from ..functions.runtime import checkpointed
from .features import OTHER, Categories, category_key, lookup_categories
from .split import split_rows

FOLD = "__fold"


@dataclass
class TargetEncoding:
    categories: Categories  # table gains enc_all, enc_0, enc_1
    means: dict[str, float]  # overall, fold 0 and fold 1 ("all", "0", "1")


def assign_folds(
    df: DataFrame, seed: int, keys: list[str] | None, stratify: str | None
) -> DataFrame:
    """Two folds of equal size, dealt by the seeded row order."""
    # The first fold takes the odd row, so the second one is the "test" share.
    folded = split_rows(
        df, 0.5, seed=seed + 1, keys=keys, stratify=stratify, column=FOLD, labels=("1", "0")
    )
    return folded


def fit_target_encoding(
    folded: DataFrame, fitted: Categories, y: Column
) -> TargetEncoding:
    """``folded`` carries the fold column; ``y`` is the target as a double."""
    types = field_types(folded)
    grouped = []
    for c in fitted.columns:
        key = category_key(c, types[c], fitted.modes[c])
        grouped.append(key.alias(c))
    source = folded.select(y.alias("__y"), FOLD, *grouped)
    moments = source.groupBy(FOLD).agg(
        F.count("__y").alias("n"), F.avg("__y").alias("m"), F.var_pop("__y").alias("v")
    ).collect()
    fold_stats = {r[FOLD]: (r["n"], r["m"], r["v"]) for r in moments}
    for f in ("0", "1"):
        fold_stats.setdefault(f, (0, 0.0, 0.0))
    means, variances = _overall(fold_stats)

    stacked = source.unpivot(
        ["__y", FOLD], [quoted(c) for c in fitted.columns], "column", "value"
    )
    per_value = stacked.groupBy("column", "value").agg(
        *[
            agg
            for f in ("0", "1")
            for agg in (
                F.count(F.when(F.col(FOLD) == f, F.col("__y"))).alias(f"n_{f}"),
                F.avg(F.when(F.col(FOLD) == f, F.col("__y"))).alias(f"m_{f}"),
                F.var_pop(F.when(F.col(FOLD) == f, F.col("__y"))).alias(f"v_{f}"),
            )
        ]
    )
    if fitted.other:
        per_value = _merge_rare(per_value, fitted)
    n_all = F.col("n_0") + F.col("n_1")
    m0, m1 = F.coalesce("m_0", F.lit(0.0)), F.coalesce("m_1", F.lit(0.0))
    v0, v1 = F.coalesce("v_0", F.lit(0.0)), F.coalesce("v_1", F.lit(0.0))
    m_all = (F.col("n_0") * m0 + F.col("n_1") * m1) / n_all
    v_all = (
        F.col("n_0") * (v0 + (m0 - m_all) ** 2) + F.col("n_1") * (v1 + (m1 - m_all) ** 2)
    ) / n_all
    encoded = per_value.select(
        "column",
        "value",
        n_all.alias("n"),
        _shrunken(n_all, m_all, v_all, means["all"], variances["all"]).alias("enc_all"),
        # A row of one fold is encoded by what the other fold has seen.
        _shrunken(F.col("n_1"), m1, v1, means["1"], variances["1"]).alias("enc_0"),
        _shrunken(F.col("n_0"), m0, v0, means["0"], variances["0"]).alias("enc_1"),
    )
    categories = Categories(
        fitted.columns, checkpointed(encoded), fitted.sizes, fitted.modes, fitted.other,
        fitted.key_bytes,
    )
    return TargetEncoding(categories, means)


def apply_target_encoding(
    df: DataFrame, encoding: TargetEncoding, training: bool
) -> DataFrame:
    """Replace categories; ``training`` rows carry the fold column."""
    cats, means = encoding.categories, encoding.means
    if not training:
        return lookup_categories(
            df, cats, {"{c}": "enc_all"}, {"enc_all": F.lit(means["all"])}
        )
    out = lookup_categories(
        df,
        cats,
        {"__e0_{c}": "enc_0", "__e1_{c}": "enc_1"},
        {"enc_0": F.lit(means["1"]), "enc_1": F.lit(means["0"])},
    )
    chosen = {
        c: F.when(F.col(FOLD) == "0", col(f"__e0_{c}")).otherwise(col(f"__e1_{c}"))
        for c in cats.columns
    }
    return out.withColumns(chosen).drop(*[f"__e{f}_{c}" for f in (0, 1) for c in cats.columns])


def _overall(stats: dict[str, tuple]) -> tuple[dict[str, float], dict[str, float]]:
    (n0, m0, v0), (n1, m1, v1) = stats["0"], stats["1"]
    m0, m1, v0, v1 = m0 or 0.0, m1 or 0.0, v0 or 0.0, v1 or 0.0
    n = max(n0 + n1, 1)
    mean = (n0 * m0 + n1 * m1) / n
    var = (n0 * (v0 + (m0 - mean) ** 2) + n1 * (v1 + (m1 - mean) ** 2)) / n
    return {"all": mean, "0": m0, "1": m1}, {"all": var, "0": v0, "1": v1}


def _shrunken(n: Column, mean: Column, within: Column, overall: float, total: float) -> Column:
    """Empirical-Bayes mean: weight n*t / (s + n*t), t the overall variance, s the one within."""
    weight = n * F.lit(total)
    return F.when(
        (n > 0) & (within + weight > 0),
        (weight * mean + within * F.lit(overall)) / (within + weight),
    ).otherwise(F.lit(overall))


def _merge_rare(per_value: DataFrame, fitted: Categories) -> DataFrame:
    """Fold the statistics of rare values into the shared bucket of their column."""
    kept = fitted.table.select(
        F.col("column").alias("__c"), F.col("value").alias("__v"), F.lit(True).alias("__keep")
    )
    bucketed = F.col("column").isin(list(fitted.other))
    joined = per_value.join(
        kept, (F.col("column") == F.col("__c")) & (F.col("value") == F.col("__v")), "left"
    )
    value = F.when(bucketed & F.col("__keep").isNull(), F.lit(OTHER)).otherwise(F.col("value"))
    sums = joined.select(
        "column",
        value.alias("value"),
        *[
            e
            for f in ("0", "1")
            for e in (
                F.col(f"n_{f}"),
                (F.col(f"n_{f}") * F.coalesce(f"m_{f}", F.lit(0.0))).alias(f"s_{f}"),
                (
                    F.col(f"n_{f}")
                    * (F.coalesce(f"v_{f}", F.lit(0.0)) + F.coalesce(f"m_{f}", F.lit(0.0)) ** 2)
                ).alias(f"q_{f}"),
            )
        ],
    )
    merged = sums.groupBy("column", "value").agg(
        *[F.sum(f"{k}_{f}").alias(f"{k}_{f}") for f in ("0", "1") for k in ("n", "s", "q")]
    )
    out = merged
    for f in ("0", "1"):
        mean = F.try_divide(F.col(f"s_{f}"), F.col(f"n_{f}"))
        out = out.withColumn(f"m_{f}", mean).withColumn(
            f"v_{f}",
            F.greatest(
                F.try_divide(F.col(f"q_{f}"), F.col(f"n_{f}")) - mean * mean, F.lit(0.0)
            ),
        )
    return out
