"""Derived columns, encoders, scalers, assembly, persistence."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators.features import (
    OTHER,
    column_roles,
    date_features,
    find_date_columns,
    find_text_columns,
    group_rare,
    scale_method,
    text_features,
)
from tabloom.operators.preprocess import TabularPreprocessor, TabularPreprocessorModel
from tabloom.operators.split import split_rows

CITIES = ["paris", "rome", "paris", "oslo", "rome", "paris"]


def encoded(spark):
    return spark.createDataFrame(
        [(i, c, 20 + 5 * i, i % 2) for i, c in enumerate(CITIES)],
        "id long, city string, age long, target long",
    )


def matrix(model, df):
    rows = model.transform(df).select(vector_to_array("features").alias("x")).collect()
    return np.array([r["x"] for r in rows])


def test_date_features(spark):
    df = spark.createDataFrame(
        [("2024-01-05", 1.0), ("2024-03-01 13:45:00", 2.0), ("2023-12-31", 3.0), (None, 4.0), ("x", 5.0)],
        "date_str string, value double",
    )
    found = find_date_columns(df, ["date_str", "value"])
    assert list(found) == ["date_str"]
    out = date_features(df, found)
    assert "date_str" not in out.columns
    rows = [tuple(r)[1:] for r in out.collect()]
    assert rows[0] == (2024, 1, 5, 0, 4)
    assert rows[1] == (2024, 3, 1, 13, 4)
    assert rows[2] == (2023, 12, 31, 0, 6)
    assert rows[3] == rows[4] == (None,) * 5


def test_one_layout_per_date_column(spark):
    df = spark.createDataFrame([("13/01/2024",), ("02/01/2024",), ("25/12/2024",)], "d string")
    out = date_features(df, find_date_columns(df, ["d"]))
    assert [r["d__month"] for r in out.collect()] == [1, 1, 12]


def test_text_features(spark):
    df = spark.createDataFrame(
        [("good stuff", "paris"), (None, "rome"), ("", "oslo")], "review string, city string"
    )
    out = text_features(df, ["review"], drop_original=True)
    assert out.columns == ["city", "review__char_len", "review__word_count"]
    assert [tuple(r)[1:] for r in out.collect()] == [(10, 2), (0, 0), (0, 0)]
    dated = spark.createDataFrame([("2024-01-01", "a b")] * 3, "d string, t string")
    assert find_text_columns(dated) == ["t"]
    assert find_text_columns(dated, ["d", "nope"]) == []


def test_column_roles(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "a", True, 1.0, [1])] * 3, "d string, s string, f boolean, n double, l array<int>"
    )
    roles = column_roles(df, df.columns)
    assert (roles.numeric, roles.categorical, roles.dropped) == (["n"], ["s", "f"], ["d", "l"])


def test_group_rare(spark):
    rows = [("hub",)] * 6 + [("a",), ("b",), ("c",), (None,)]
    df = spark.createDataFrame(rows, "city string")
    got = [r["city"] for r in group_rare(df, ["city"], 0.2).collect()]
    assert sorted(got, key=str) == sorted(["hub"] * 6 + [OTHER] * 3 + [None], key=str)


def test_onehot_unseen_is_zero(spark):
    df = encoded(spark)
    model = TabularPreprocessor("target", features=["city", "age"], scale_strategy="none").fit(df)
    assert model.feature_names == ["num__age", "cat__city_oslo", "cat__city_paris", "cat__city_rome"]
    x = matrix(model, df)
    assert x[0].tolist() == [20.0, 0.0, 1.0, 0.0]
    unseen = df.limit(1).withColumn("city", F.lit("atlantis"))
    assert matrix(model, unseen)[0].tolist() == [20.0, 0.0, 0.0, 0.0]
    missing = df.limit(1).withColumn("city", F.lit(None).cast("string"))
    assert matrix(model, missing)[0].tolist() == [20.0, 0.0, 1.0, 0.0]


def test_ordinal(spark):
    df = encoded(spark)
    model = TabularPreprocessor(
        "target", features=["city"], encoding_strategy="ordinal"
    ).fit(df)
    assert matrix(model, df)[:, 0].tolist() == [1, 2, 1, 0, 2, 1]
    assert matrix(model, df.withColumn("city", F.lit("x")))[0, 0] == -1


def shrunken(values, overall):
    n, m, s, t, mean = len(values), np.mean(values), np.var(values), np.var(overall), np.mean(overall)
    return mean if s + n * t == 0 else (n * t * m + s * mean) / (s + n * t)


def test_target_encoding(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[int(rng.integers(3))], float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    model = TabularPreprocessor(
        "y", task="regression", features=["c"], keys=["id"], encoding_strategy="target",
        random_state=4,
    ).fit(df)
    y = np.array([r[2] for r in rows])
    c = np.array([r[1] for r in rows])
    for value, got in zip(c, matrix(model, df)[:, 0]):
        assert got == pytest.approx(shrunken(y[c == value], y))
    folds = {
        r["id"]: r["f"]
        for r in split_rows(df, 0.5, seed=5, keys=["id"], column="f", labels=("1", "0")).collect()
    }
    f = np.array([folds[i] for i in range(200)])
    trained = model.transform_training(df).select("id", vector_to_array("features")[0].alias("x"))
    for r in trained.collect():
        other = f != f[r["id"]]
        want = shrunken(y[other & (c == c[r["id"]])], y[other])
        assert r["x"] == pytest.approx(want)
    assert matrix(model, df.withColumn("c", F.lit("new")))[0, 0] == pytest.approx(y.mean())


def test_target_encoding_with_rare_bucket_and_binary_target(spark):
    rows = [(i, "big" if i % 2 else f"s{i}", "yes" if i % 3 else "no") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, c string, y string")
    model = TabularPreprocessor(
        "y", features=["c"], keys=["id"], encoding_strategy="target", rare_category_min_freq=0.1
    ).fit(df)
    y = np.array([1.0 if r[2] == "yes" else 0.0 for r in rows])
    small = np.array([r[1] != "big" for r in rows])
    x = matrix(model, df)[:, 0]
    assert x[0] == pytest.approx(shrunken(y[small], y))
    assert x[1] == pytest.approx(shrunken(y[~small], y))


def test_scaling_matches_numpy_after_imputation(spark):
    values = [1.0, None, 4.0, 10.0, None, 5.0]
    df = spark.createDataFrame([(v, 7.0, i % 2) for i, v in enumerate(values)], "a double, k double, y long")
    filled = np.array([4.5 if v is None else v for v in values])
    standard = matrix(TabularPreprocessor("y").fit(df), df)
    np.testing.assert_allclose(standard[:, 0], (filled - filled.mean()) / filled.std())
    np.testing.assert_allclose(standard[:, 1], 0.0)
    minmax = matrix(TabularPreprocessor("y", scale_strategy="MinMaxScaler").fit(df), df)
    np.testing.assert_allclose(minmax[:, 0], (filled - 1.0) / 9.0)
    np.testing.assert_allclose(minmax[:, 1], 0.0)
    raw = matrix(TabularPreprocessor("y", scale_numeric=False).fit(df), df)
    np.testing.assert_allclose(raw[:, 0], filled)


def test_without_imputation_gaps_stay(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 1), (3.0, 0), (5.0, 1)], "a double, y long")
    x = matrix(TabularPreprocessor("y", impute_missing=False).fit(df), df)
    assert np.isnan(x[1, 0]) and x[2, 0] == pytest.approx(0.0)


def test_scale_names():
    assert scale_method(None) == "standard" and scale_method("", False) == "none"
    assert scale_method("Standard_Scaler") == "standard" and scale_method("off") == "none"
    with pytest.raises(ValueError, match="scale_strategy"):
        scale_method("robust")


def test_categoricals_can_be_left_out_and_all_null_columns_are(spark):
    df = encoded(spark).withColumn("empty", F.lit(None).cast("double"))
    model = TabularPreprocessor("target", encode_categoricals=False).fit(df)
    assert model.feature_names == ["num__id", "num__age"]


def test_input_checks(spark):
    with pytest.raises(ValueError, match="not found"):
        TabularPreprocessor("nope").fit(encoded(spark))
    with pytest.raises(ValueError, match="at least one feature"):
        TabularPreprocessor("label").fit(spark.createDataFrame([(1,)] * 4, "label long"))
    with pytest.raises(ValueError, match="at least 4 rows"):
        TabularPreprocessor("y").fit(spark.createDataFrame([(1, 1)] * 3, "x long, y long"))


@pytest.mark.parametrize("strategy", ["onehot", "ordinal", "target"])
def test_saved_models_give_the_same_features(spark, folder, strategy):
    df = encoded(spark).withColumn("when", F.lit("2024-05-06")).withColumn("note", F.lit("a b c"))
    model = TabularPreprocessor(
        "target", keys=["id"], encoding_strategy=strategy, date_extract=True, text_extract=True,
        text_feature_columns=["note"], rare_category_min_freq=0.2,
    ).fit(df)
    PipelineModel([model]).write().overwrite().save(f"{folder}/m")
    loaded = PipelineModel.load(f"{folder}/m").stages[0]
    assert isinstance(loaded, TabularPreprocessorModel)
    assert loaded.feature_names == model.feature_names
    assert "num__when__year" in loaded.feature_names and "num__note__word_count" in loaded.feature_names
    np.testing.assert_array_equal(matrix(model, df), matrix(loaded, df))
    assert set(model.transform(df).columns) == {*df.columns, "features"}
