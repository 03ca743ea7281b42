"""Recommended fixes and feature settings, derived from the columns of a profile."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .profile import HIGH_MISSING, RARE_FREQUENCY, TableProfile


@dataclass(frozen=True)
class Reason:
    """Why a setting was chosen: a rule, the columns it saw, and what was measured."""

    rule: str
    columns: tuple[str, ...]
    value: float

    @property
    def text(self) -> str:
        where = f" in {', '.join(self.columns)}" if self.columns else ""
        return f"{self.rule}{where} ({self.value:g})"


@dataclass
class Recommendation:
    drop_duplicate_rows: bool = False
    drop_constant_columns: bool = False
    missing_strategy: str = "none"
    preprocess_params: dict = field(default_factory=dict)
    reasons: list[Reason] = field(default_factory=list)

    def to_df(self, spark: SparkSession) -> DataFrame:
        p = self.preprocess_params
        row = (
            self.drop_duplicate_rows,
            self.drop_constant_columns,
            self.missing_strategy,
            bool(p.get("date_extract", False)),
            bool(p.get("text_extract", False)),
            ",".join(p.get("text_feature_columns", [])),
            float(p.get("rare_category_min_freq", 0.0)),
            len(self.reasons),
        )
        return spark.createDataFrame(
            [row],
            "drop_duplicate_rows boolean, drop_constant_columns boolean, "
            "missing_strategy string, date_extract boolean, text_extract boolean, "
            "text_feature_columns string, rare_category_min_freq double, n_reasons int",
        )

    def reasons_df(self, spark: SparkSession) -> DataFrame:
        """(rule, columns, value), one row per reason."""
        return spark.createDataFrame(
            [(r.rule, list(r.columns), float(r.value)) for r in self.reasons],
            "rule string, columns array<string>, value double",
        )


def _flagged(profile: TableProfile, flag: str) -> tuple[str, ...]:
    return tuple(c.column for c in profile.columns if getattr(c, flag))


def recommend_fixes(profile: TableProfile) -> Recommendation:
    """Every reason names its rule; the settings are what the rules found imply."""
    gaps = {c.column: c.missing_ratio for c in profile.columns if c.missing_ratio > 0}
    flags = {
        "constant columns": "is_constant", "date columns": "is_date_like",
        "text columns": "is_text_like", "rare categories": "is_rare_heavy",
    }
    seen = [
        Reason("duplicate rows", (), profile.duplicate_rows),
        Reason("missing values", tuple(gaps), max(gaps.values(), default=0.0)),
    ]
    for rule, flag in flags.items():
        columns = _flagged(profile, flag)
        seen.append(Reason(rule, columns, len(columns)))
    found = {r.rule: r for r in seen if r.value > 0}
    made = Recommendation(reasons=list(found.values()))
    made.drop_duplicate_rows = "duplicate rows" in found
    made.drop_constant_columns = "constant columns" in found
    if "missing values" in found:
        mostly = found["missing values"].value >= HIGH_MISSING
        made.missing_strategy = "drop_rows" if mostly else "fill_simple"
    if "date columns" in found:
        made.preprocess_params["date_extract"] = True
    if "text columns" in found:
        made.preprocess_params |= {
            "text_extract": True,
            "text_feature_columns": list(found["text columns"].columns),
            "text_drop_original": False,
        }
    if "rare categories" in found:
        made.preprocess_params["rare_category_min_freq"] = RARE_FREQUENCY
    return made
