"""The preprocessing estimator: derive, impute, scale, encode, assemble.

``TabularPreprocessor`` is a ``pyspark.ml`` Estimator. Its model turns a raw
table into one with a ``features`` vector and is saved with Parquet side tables
for the categories, so it can be part of a ``PipelineModel``.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_double, canonical_text, col, field_types, nan_to_null
from .features import (
    Categories,
    NumericRule,
    apply_numeric,
    column_roles,
    date_features,
    find_date_columns,
    find_text_columns,
    fit_categories,
    fit_numeric,
    index_categories,
    lookup_categories,
    scale_method,
    text_features,
)
from .persistence import FittedStage
from .target_encoding import (
    FOLD,
    TargetEncoding,
    apply_target_encoding,
    assign_folds,
    fit_target_encoding,
)

FEATURES = "features"
ENCODINGS = ("onehot", "ordinal", "target")


@dataclass
class PreprocessConfig:
    """All settings; the defaults are those of the tabular preprocessing stage."""

    target: str
    features: list[str] | None = None
    keys: list[str] | None = None
    task: str = "classification"
    impute_missing: bool = True
    scale_numeric: bool = True
    scale_strategy: str | None = None
    encode_categoricals: bool = True
    encoding_strategy: str = "onehot"
    rare_category_min_freq: float = 0.0
    date_extract: bool = False
    text_extract: bool = False
    text_feature_columns: list[str] | None = None
    text_drop_original: bool = False
    random_state: int = 42


@dataclass
class PreprocessState:
    """What fitting has learned, apart from the category table."""

    schema: str = ""
    features: list[str] = field(default_factory=list)
    dates: dict[str, int | None] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    numeric: list[dict] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)
    key_bytes: dict[str, int] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    other: dict[str, int] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    positive_label: str | None = None
    feature_names: list[str] = field(default_factory=list)


class TabularPreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``TabularPreprocessorModel``; keyword arguments as in ``PreprocessConfig``."""

    config = Param(
        Params._dummy(), "config", "settings as JSON", typeConverter=TypeConverters.toString
    )

    def __init__(self, target: str = "", **settings):
        super().__init__()
        self._set(config=json.dumps(asdict(PreprocessConfig(target=target, **settings))))

    @property
    def settings(self) -> PreprocessConfig:
        return PreprocessConfig(**json.loads(self.getOrDefault(self.config)))

    def _fit(self, dataset: DataFrame) -> "TabularPreprocessorModel":
        cfg = self.settings
        method = scale_method(cfg.scale_strategy, cfg.scale_numeric)
        if cfg.target not in dataset.columns:
            raise ValueError(f"target column {cfg.target!r} not found in {dataset.columns}")
        features = list(cfg.features or [c for c in dataset.columns if c != cfg.target])
        if not features:
            raise ValueError("dataset must include at least one feature column")
        df = nan_to_null(dataset).filter(col(cfg.target).isNotNull())
        if len(df.limit(4).take(4)) < 4:
            raise ValueError("at least 4 rows are required for train/test split")

        state = PreprocessState(
            schema=df.select(*[col(c) for c in features]).schema.json(), features=features
        )
        if cfg.date_extract:
            state.dates = find_date_columns(df, features)
        derived = date_features(df, state.dates)
        if cfg.text_extract:
            wanted = cfg.text_feature_columns
            pool = [c for c in features if c not in state.dates]
            state.texts = find_text_columns(
                derived.select(*[col(c) for c in pool]),
                None if wanted is None else [c for c in wanted if c in pool],
            )
        derived = text_features(derived, state.texts, cfg.text_drop_original)

        known = set(dataset.columns) - set(features)
        columns = [c for c in derived.columns if c not in known]
        roles = column_roles(derived, columns)
        state.dropped = roles.dropped
        rules = fit_numeric(derived, roles.numeric, cfg.impute_missing, method)
        state.numeric = [asdict(r) for r in rules]

        table = None
        if cfg.encode_categoricals and roles.categorical:
            table = self._fit_categories(cfg, state, derived, roles.categorical)
        if not rules and not state.categorical:
            raise ValueError("no usable feature column: all are empty, dates or of unknown type")
        return TabularPreprocessorModel.of(cfg, state, table)

    @staticmethod
    def _fit_categories(cfg, state, derived, categorical) -> DataFrame | None:
        fitted = fit_categories(derived, categorical, cfg.rare_category_min_freq)
        # A column without any value has nothing to encode.
        usable = [c for c in categorical if fitted.modes[c] is not None]
        if not usable:
            return None
        fitted.columns = usable
        if cfg.encoding_strategy == "target":
            y, state.positive_label = target_as_number(derived, cfg.target, cfg.task)
            folded = assign_folds(
                derived, cfg.random_state, cfg.keys,
                cfg.target if state.positive_label is not None else None,
            )
            encoding = fit_target_encoding(folded, fitted, y)
            fitted, state.means = encoding.categories, encoding.means
        else:
            fitted = index_categories(fitted)
        state.categorical, state.sizes = usable, fitted.sizes
        state.key_bytes = fitted.key_bytes
        state.modes = {c: fitted.modes[c] for c in usable}
        state.other = fitted.other
        return fitted.table


def target_as_number(df: DataFrame, target: str, task: str) -> tuple[Column, str | None]:
    """Target as double: the value itself, or 1 for the second label in sorted order."""
    dtype = field_types(df)[target]
    if task == "regression":
        return as_double(col(target), dtype), None
    labels = class_labels(df, target)
    if len(labels) != 2:
        raise ValueError(f"target encoding needs exactly 2 target classes, found {labels}")
    return (canonical_text(target, dtype) == F.lit(labels[1])).cast("double"), labels[1]


def class_labels(df: DataFrame, target: str, limit: int = 100) -> list[str]:
    """Distinct target values as text, sorted by value; more than ``limit`` is an error."""
    dtype = field_types(df)[target]
    rows = (
        df.filter(col(target).isNotNull())
        .groupBy(col(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"target '{target}' has more than {limit} classes")
    values = sorted(r["v"] for r in rows)
    texts = df.sparkSession.createDataFrame(
        [(i, v) for i, v in enumerate(values)],
        T.StructType([T.StructField("i", T.LongType()), T.StructField(target, dtype)]),
    ) if values else None
    if texts is None:
        return []
    named = texts.select("i", canonical_text(target, dtype).alias("t")).collect()
    return [r["t"] for r in sorted(named, key=lambda r: r["i"])]


class TabularPreprocessorModel(FittedStage):
    """Fitted preprocessing: raw columns in, ``features`` vector out."""

    @classmethod
    def of(
        cls, cfg: PreprocessConfig, learned: PreprocessState, table: DataFrame | None
    ) -> "TabularPreprocessorModel":
        model = cls(
            {"config": asdict(cfg), "learned": asdict(learned)},
            {} if table is None else {"categories": table},
        )
        model.state["learned"]["feature_names"] = model.name_features()
        return model

    @property
    def settings(self) -> PreprocessConfig:
        return PreprocessConfig(**self.state["config"])

    @property
    def learned(self) -> PreprocessState:
        return PreprocessState(**self.state["learned"])

    @property
    def feature_names(self) -> list[str]:
        return self.learned.feature_names

    @property
    def raw_schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.learned.schema))

    def _categories(self) -> Categories:
        s = self.learned
        return Categories(
            s.categorical, self.tables["categories"], s.sizes, s.modes, s.other, s.key_bytes
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._assemble(dataset, training=False)

    def transform_training(self, dataset: DataFrame) -> DataFrame:
        """Features of the rows used for fitting.

        Differs from ``transform`` for target encoding only, where these rows
        get the encoding learned on the other fold.
        """
        return self._assemble(dataset, training=True)

    def _assemble(self, dataset: DataFrame, training: bool) -> DataFrame:
        cfg, s = self.settings, self.learned
        original = dataset.columns
        df = nan_to_null(dataset)
        folds = training and cfg.encoding_strategy == "target" and bool(s.categorical)
        if folds:
            df = assign_folds(
                df, cfg.random_state, cfg.keys,
                cfg.target if s.positive_label is not None else None,
            )
        # Work on copies, so that the raw columns stay in the output.
        raw = {c: f"__raw_{c}" for c in original}
        df = df.withColumns({raw[c]: col(c) for c in original})
        df = date_features(df, s.dates)
        df = text_features(df, s.texts, cfg.text_drop_original)
        rules = [NumericRule(**r) for r in s.numeric]
        df = apply_numeric(df, rules) if rules else df
        inputs = [r.column for r in rules]
        if s.categorical:
            df, encoded = self._encode(df, cfg, folds)
            inputs += encoded
        df = VectorAssembler(
            inputCols=inputs, outputCol=FEATURES, handleInvalid="keep"
        ).transform(_plain_names(df, inputs))
        return df.select(*[col(raw[c]).alias(c) for c in original], FEATURES)

    def _encode(self, df: DataFrame, cfg: PreprocessConfig, folds: bool):
        s, cats = self.learned, self._categories()
        if cfg.encoding_strategy == "target":
            df = apply_target_encoding(df, TargetEncoding(cats, s.means), folds)
            return df, s.categorical
        if cfg.encoding_strategy == "ordinal":
            df = lookup_categories(
                df, cats, {"{c}": "idx"}, {"idx": F.lit(-1).cast("long")}
            )
            return df.withColumns({c: col(c).cast("double") for c in s.categorical}), s.categorical
        # One more index for unseen categories; dropLast turns it into zeros.
        df = lookup_categories(df, cats, {"__i_{c}": "idx"}, {"idx": F.lit(None).cast("long")})
        indexed = [f"__i{i}" for i in range(len(s.categorical))]
        values = []
        for name, c in zip(indexed, s.categorical):
            meta = {"ml_attr": {"type": "nominal", "num_vals": s.sizes[c] + 1, "name": name}}
            value = F.coalesce(col(f"__i_{c}"), F.lit(s.sizes[c])).cast("double")
            values.append(value.alias(name, metadata=meta))
        df = df.select("*", *values)
        outputs = [f"__oh{i}" for i in range(len(indexed))]
        encoder = OneHotEncoder(
            inputCols=indexed, outputCols=outputs, dropLast=True, handleInvalid="error"
        )
        return encoder.fit(df).transform(df), outputs

    def name_features(self) -> list[str]:
        """Names in vector order: ``num__x``, then ``cat__c`` or ``cat__c_value``."""
        cfg, s = self.settings, self.learned
        names = [f"num__{r['column']}" for r in s.numeric]
        if not s.categorical:
            return names
        if cfg.encoding_strategy in ("ordinal", "target"):
            return names + [f"cat__{c}" for c in s.categorical]
        # One row per one-hot feature, as many as the vector is wide.
        rows = self.tables["categories"].select("column", "value", "idx").collect()
        place = {(r["column"], r["idx"]): r["value"] for r in rows}
        return names + [
            f"cat__{c}_{place[(c, i)]}" for c in s.categorical for i in range(s.sizes[c])
        ]


def _plain_names(df: DataFrame, inputs: list[str]) -> DataFrame:
    """The assembler cannot address names with dots; give such columns plain twins."""
    for i, name in enumerate(inputs):
        if "." in name:
            inputs[i] = f"__in{i}"
            df = df.withColumn(f"__in{i}", col(name))
    return df
