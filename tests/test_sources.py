"""Readers, writers, run history, bundles, scoring and whole jobs."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.scoring import (
    allowed_values,
    coerce_to_schema,
    coercion_problems,
    output_profile,
    project_to_schema,
    unseen_values,
)
from tabloom.operators.profile import profile_table
from tabloom.plans import jobs
from tabloom.sources.bundles import load_bundle, normalize_task, save_bundle
from tabloom.sources.readers import load_batch, load_labelled, read_table
from tabloom.sources.synthetic import synthetic_transactions
from tabloom.sources.writers import (
    HISTORY_COLUMNS,
    append_history,
    history_row,
    stamped_name,
    write_quality_report,
    write_table,
)


def write(folder, name, text):
    path = Path(folder) / name
    path.write_text(text)
    return str(path)


def test_csv_types_and_missing_values(spark, folder):
    path = write(
        folder, "t.csv",
        "i,gap,f,flag,date,text,none\n1,1,1.5,True,2024-01-01,1d,\n2,NA,2,false,2024-01-02,NULL,\n"
        '3,3,nan,TRUE,2024-01-03,"x, y",\n',
    )
    df = read_table(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {
        "i": "bigint", "gap": "bigint", "f": "double", "flag": "boolean",
        "date": "string", "text": "string", "none": "double",
    }
    rows = [tuple(r) for r in df.orderBy("i").collect()]
    assert rows[1] == (2, None, 2.0, False, "2024-01-02", None, None)
    assert rows[2][2] is None and rows[2][5] == "x, y"


def test_csv_with_a_schema(spark, folder):
    path = write(folder, "t.csv", "a,b\n1,x\n2,y\n")
    df = read_table(spark, path, schema="a int, b string")
    assert df.schema.simpleString() == "struct<a:int,b:string>" and df.count() == 2


def test_source_contract(spark, folder):
    good = write(folder, "good.csv", "x,label\n1,0\n")
    assert load_labelled(spark, good, "label").count() == 1
    with pytest.raises(ValueError, match="source"):
        load_labelled(spark, "", "label")
    with pytest.raises(ValueError, match="target"):
        load_labelled(spark, good, "")
    with pytest.raises(FileNotFoundError):
        load_labelled(spark, f"{folder}/nope.csv", "label")
    with pytest.raises(ValueError, match="no rows"):
        load_labelled(spark, write(folder, "empty.csv", "x,label\n"), "label")
    with pytest.raises(ValueError, match="duplicate column names"):
        load_labelled(spark, write(folder, "dup.csv", "x,x,label\n1,2,3\n"), "label")
    with pytest.raises(ValueError, match="missing. Available"):
        load_labelled(spark, good, "y")
    with pytest.raises(ValueError, match="no rows"):
        load_batch(spark, f"{folder}/empty.csv")


def test_other_formats(spark, folder):
    spark.range(5).write.parquet(f"{folder}/p")
    assert load_batch(spark, f"{folder}/p", "parquet").count() == 5


def test_written_tables_do_not_overwrite(spark, folder):
    path = write_table(spark.range(3), f"{folder}/out")
    assert read_table(spark, path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        write_table(spark.range(3), path)
    write_table(spark.range(100).orderBy(F.rand(1)), f"{folder}/sorted", order_by=["id"])
    files = sorted(Path(f"{folder}/sorted").glob("part-*.csv"))
    lines = [line for f in files for line in f.read_text().split()[1:]]
    assert [int(v) for v in lines] == list(range(100))
    assert stamped_name("/a/b/sales.csv", "cleaned").startswith("sales_cleaned_")


def test_quality_report(spark, folder):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 0)], "feature long, target long")
    write_quality_report(spark, profile_table(df, "target"), f"{folder}/q", "in.csv", "target")
    report = json.loads(spark.read.text(f"{folder}/q/report").first()[0])
    assert set(report) == {"generated_at_utc", "source_csv", "target_column", "summary", "warnings"}
    assert report["summary"]["duplicate_rows"] == 1 and report["source_csv"] == "in.csv"
    assert spark.read.json(f"{folder}/q/columns").count() == 2
    with pytest.raises(ValueError):
        write_quality_report(spark, {"summary": {}}, f"{folder}/q2")


def test_history_keeps_older_columns(spark, folder):
    new = f"{folder}/new"
    metrics = {"accuracy": 0.9, "precision": 0.8, "recall": 0.7, "f1": 0.75, "roc_auc": 0.95}
    for name in ("one", "two"):
        append_history(spark, new, history_row(name, "classification", metrics))
    rows = spark.read.option("header", True).csv(new)
    assert rows.columns == HISTORY_COLUMNS and rows.count() == 2

    old = f"{folder}/old"
    columns = ["timestamp", "pipeline_name", "accuracy", "f1", "auc", "precision", "recall", "owner"]
    spark.createDataFrame([tuple("abcdefgh")], columns).coalesce(1).write.option("header", True).csv(old)
    anomaly = {"roc_auc": 0.6, "precision": 0.5, "recall": 0.4, "f1": 0.45}
    append_history(spark, old, history_row("three", "anomaly", anomaly))
    rows = spark.read.option("header", True).csv(old)
    assert rows.columns == columns
    row = rows.filter("pipeline_name = 'three'").first()
    assert (row["auc"], row["precision"], row["recall"]) == ("0.6", "0.5", "0.4")
    assert row["accuracy"] is None and row["owner"] is None


def test_synthetic_transactions(spark):
    df = synthetic_transactions(spark, rows=5000)
    assert df.columns == ["V1", "V2", "V3", "V4", "Amount", "Class"]
    fraud = df.filter("Class = 1")
    assert 60 < fraud.count() < 140
    assert fraud.filter("Amount < 1000 or abs(V1) > 5").count() == 0
    assert df.filter("Class = 0 and (Amount > 500 or abs(V2) > 2)").count() == 0
    again = synthetic_transactions(spark, rows=5000)
    assert df.exceptAll(again.repartition(3)).isEmpty()


SCHEMA = T.StructType(
    [T.StructField("age", T.LongType()), T.StructField("income", T.DoubleType()),
     T.StructField("member", T.BooleanType()), T.StructField("city", T.StringType())]
)


def test_coercion(spark):
    df = spark.createDataFrame(
        [("30", "1.5", "YES ", "rome", 1), ("31.0", "2", "f", None, 2),
         ("9007199254740993", "-1e3", "0", "x", 3)],
        "age string, income string, member string, city string, extra long",
    )
    rows = [tuple(r) for r in coerce_to_schema(df, SCHEMA).collect()]
    assert rows[0] == (30, 1.5, True, "rome", 1)
    assert rows[1] == (31, 2.0, False, None, 2)
    assert rows[2][0] == 9007199254740993 and rows[2][1] == -1000.0


@pytest.mark.parametrize(
    "column, value, message",
    [
        ("age", "x", "integer expected"), ("age", "1.5", "fraction in"), ("age", None, "integer expected"),
        ("age", "inf", "integer expected"), ("age", "7d", "integer expected"),
        ("income", "1f", "number expected"), ("income", "x", "number expected"),
        ("income", None, "number expected"), ("member", "perhaps", "boolean expected"),
        ("member", None, "boolean expected"),
    ],
)
def test_coercion_errors(spark, column, value, message):
    row = {"age": "1", "income": "1", "member": "t", "city": "a", column: value}
    df = spark.createDataFrame([tuple(row.values())], "age string, income string, member string, city string")
    with pytest.raises(ValueError, match=f"{column}: {message}"):
        coerce_to_schema(df, SCHEMA)
    if value is None:
        assert coercion_problems(df, SCHEMA, on_null="impute").filter("n > 0").isEmpty()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing required columns: \\['income', 'city'\\]"):
        project_to_schema(spark.createDataFrame([(1, True)], "age long, member boolean"), SCHEMA)


def test_output_profiles(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 0.3)], "x long, prediction long, prediction_score double, anomaly_score double")
    assert output_profile(df, "classification", " Simple ").columns == ["prediction", "prediction_score"]
    assert output_profile(df, "anomaly", "simple").columns == ["prediction", "anomaly_score"]
    assert output_profile(df, "regression", "simple").columns == ["prediction"]
    assert output_profile(df, "regression", "wide").columns == df.columns


def test_allowed_and_unseen(spark):
    train = spark.createDataFrame([("a", 1)] * 3 + [("b", 2), ("c", 3)], "s string, n long")
    allowed = allowed_values(train, ["s"], k=2)
    assert {(r["value"], r["rank"]) for r in allowed.collect()} == {("a", 1), ("b", 2)}
    batch = spark.createDataFrame([(" A ", 9), ("c", 9), ("", 9), (None, 9), ("c", 1)], "s string, n long")
    assert [tuple(r) for r in unseen_values(batch, allowed).collect()] == [("s", "c", 2)]


TRAIN = [
    (25 + i, ["rome", "oslo", "paris"][i % 3], 30_000 + 1_500 * i, "yes" if i % 2 else "no")
    for i in range(24)
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(TRAIN)], "id long, age long, city string, income long, label string"
    )


FEATURES = ["age", "city", "income"]


def test_classification_end_to_end(spark, folder, people):
    done = jobs.train_tabular(
        people, "label", "classification_logreg", {"class_weight": True},
        keys=["id"], features=FEATURES, test_size=0.25,
    )
    assert set(done.metrics) >= {"accuracy", "precision", "recall", "f1", "roc_auc", "tp"}
    assert done.predictions.count() == 6
    save_bundle(spark, done.bundle, f"{folder}/b")
    with pytest.raises(FileExistsError):
        save_bundle(spark, done.bundle, f"{folder}/b")
    bundle = load_bundle(spark, f"{folder}/b")
    assert bundle.meta["positive_label"] == "yes"
    assert bundle.meta["feature_allowed_values"]["city"] == ["oslo", "paris", "rome"]

    batch = spark.createDataFrame(
        [("40", "rome", "50000", 1), ("41", "cairo", "60000.0", 2)], "age string, city string, income string, ref long"
    )
    out = jobs.score(bundle, batch)
    assert out.columns == [
        "age", "city", "income", "ref", "prediction", "proba_no", "proba_yes", "prediction_score"
    ]
    rows = out.collect()
    assert len(rows) == 2
    for r in rows:
        assert r["prediction"] in ("yes", "no")
        assert r["proba_no"] + r["proba_yes"] == pytest.approx(1.0)
        assert r["prediction_score"] == r["proba_yes"]
    assert rows[0]["income"] == "50000"
    assert jobs.score(bundle, batch, "simple").columns == ["prediction", "prediction_score"]
    with pytest.raises(ValueError, match="missing required columns: \\['city'\\]"):
        jobs.score(bundle, batch.drop("city"))
    with pytest.raises(ValueError, match="age: integer expected"):
        jobs.score(bundle, batch.withColumn("age", F.lit("old")))
    gap = batch.withColumn("age", F.lit(None).cast("string"))
    assert jobs.score(bundle, gap, on_null="impute").count() == 2

    jobs.record_run(spark, done, "people", f"{folder}/runs", run_id="r1")
    summary = json.loads(spark.read.text(f"{folder}/runs/summaries/r1_people").first()[0])
    assert summary["target_class_counts"] == {"no": 12, "yes": 12}
    assert summary["feature_columns"] == FEATURES


@pytest.mark.parametrize("model_type", ["regression_linear", "regression_ridge", "regression_rf"])
def test_regression_end_to_end(spark, people, model_type):
    done = jobs.train_tabular(
        people, "income", model_type, {"n_estimators": 5, "max_depth": 4} if "rf" in model_type else {},
        keys=["id"], features=["age", "city"],
    )
    assert done.metrics["r2"] > 0.7
    out = jobs.score(done.bundle, people.select("id", "age", "city"))
    assert out.columns == ["id", "age", "city", "prediction"] and out.count() == 24


def test_anomaly_end_to_end_after_date_and_text_extraction(spark, folder, people):
    df = people.withColumns(
        {"joined": F.date_format(F.expr("date_add(date'2024-01-01', int(age))"), "yyyy-MM-dd"),
         "note": F.concat(F.lit("from the city of "), F.col("city"))}
    )
    done = jobs.train_tabular(
        df, "label", "anomaly_isolation_forest", {"contamination": 0.1, "n_estimators": 10},
        keys=["id"], features=["age", "income", "joined", "note"], date_extract=True, text_extract=True,
        text_feature_columns=["note"], text_drop_original=True,
    )
    save_bundle(spark, done.bundle, f"{folder}/b")
    out = jobs.score(load_bundle(spark, f"{folder}/b"), df.drop("label"))
    assert {"prediction", "anomaly_score", "joined", "note"} <= set(out.columns)
    assert {r["prediction"] for r in out.collect()} <= {"Anomaly", "Normal"}


def test_jobs_without_keys_and_fitted_on_all_rows(spark, people):
    for fit_on in ("train", "all"):
        done = jobs.train_tabular(
            people.drop("id"), "label", "classification_rf", {"n_estimators": 5, "max_depth": 3},
            fit_on=fit_on, encoding_strategy="target",
        )
        assert done.predictions.count() == 5
        assert "num____row" not in done.bundle.preprocessor.feature_names


def test_job_errors(spark, people):
    with pytest.raises(ValueError, match="unknown model type"):
        jobs.train_tabular(people, "label", "classification_svm")
    with pytest.raises(ValueError, match="unknown settings"):
        jobs.train_tabular(people, "label", "classification_rf", {"depth": 3}, keys=["id"])
    with pytest.raises(ValueError, match="exactly 2 classes"):
        jobs.train_tabular(people, "city", "classification_rf")
    with pytest.raises(ValueError, match="not found"):
        jobs.train_tabular(people, "nope", "classification_rf")
    with pytest.raises(ValueError, match="test_size"):
        jobs.train_tabular(people, "label", "classification_rf", test_size=1.5, keys=["id"])
    with pytest.raises(ValueError, match="unsupported model task"):
        normalize_task("ranking")
    assert normalize_task("Binary_Classification") == "classification"


def test_bundle_checks(spark, folder):
    with pytest.raises(ValueError, match="not a model bundle"):
        load_bundle(spark, f"{folder}/nothing")


def test_tuning_picks_the_best_and_reports(spark, people):
    best, search = jobs.tune(
        people, "income", "regression_lasso", n_trials=4, keys=["id"], features=["age"], parallelism=2,
    )
    report = search.report(spark).first()
    assert report["best_score"] >= report["baseline_score"]
    assert report["baseline_bytes"] > 0 and report["recommendation"]
    assert -best.metrics["rmse"] == pytest.approx(report["best_score"])


def test_bulk_fix(spark, folder):
    a = write(folder, "a.csv", "x,k\n1,c\n1,c\n,c\n3,c\n4,c\n5,c\n")
    report = jobs.bulk_fix(spark, {"a": a, "b": f"{folder}/missing.csv"}, f"{folder}/out")
    rows = {r["name"]: r for r in report.collect()}
    assert json.loads(rows["a"]["actions"]) == [
        "duplicate rows removed: 1", "constant columns removed: k", "gaps filled: x 1",
    ]
    cleaned = read_table(spark, rows["a"]["cleaned"])
    assert cleaned.columns == ["x"] and cleaned.count() == 5
    assert rows["b"]["error"] and rows["b"]["cleaned"] is None
    assert spark.read.json(f"{folder}/out/report").count() == 2


def test_prepare_then_train(spark, people):
    dirty = people.unionByName(people.limit(3)).withColumn("zone", F.lit("EU"))
    ready = jobs.auto_prepare(dirty, "label")
    assert ready.fixed.df.count() == 24 and "zone" not in ready.fixed.df.columns
    done = jobs.train_tabular(
        ready.fixed.df, "label", "classification_rf", {"n_estimators": 5, "max_depth": 3},
        keys=["id"], features=FEATURES, **ready.preprocess,
    )
    assert np.isfinite(done.metrics["accuracy"])
    assert done.importances(spark).count() == len(done.bundle.preprocessor.feature_names)


def test_csv_keeps_texts(spark, folder):
    path = write(
        folder, "t.csv",
        'a,b,c\n1,"He said ""hi, you""",3\n2,"two\nlines",4\n3,  pad  ,5\n4,   ,6\n5,"NA",7\n6,NA\n',
    )
    rows = [tuple(r) for r in read_table(spark, path).orderBy("a").collect()]
    assert rows == [
        (1, 'He said "hi, you"', 3), (2, "two\nlines", 4), (3, "  pad  ", 5), (4, "   ", 6),
        (5, None, 7), (6, None, None),
    ]
    typed = read_table(spark, path, schema="a int, b string, c double")
    assert typed.schema.simpleString() == "struct<a:int,b:string,c:double>"
    assert [tuple(r) for r in typed.orderBy("a").collect()] == rows


def test_csv_surplus_fields_are_an_error(spark, folder):
    path = write(folder, "t.csv", "a,b\n1,x\n2,y,EXTRA\n")
    with pytest.raises(Exception, match="more fields"):
        read_table(spark, path)
    with pytest.raises(Exception, match="more fields"):
        read_table(spark, path, schema="a int, b string").collect()


def test_csv_round_trip_of_awkward_texts(spark, folder):
    texts = ['"', '""', 'a "q" b', "x,y", "l1\nl2", "r\rs", "c\r\nd", " lead", "trail ", "\\", 'end\\"', "\\\\,", "#no", "'", "é😀", "a;b\tc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = write_table(df.repartition(3), f"{folder}/texts")
    back = read_table(spark, out, schema="id long, text string")
    assert [r["text"] for r in back.orderBy("id").collect()] == texts


def test_anomaly_model_of_normal_rows(spark):
    """Half of the rows are far away: only a fit without them finds them."""
    rows = [(i, float(i % 20), 0) for i in range(200)] + [(200 + i, 500.0 + i % 20, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, bad long")
    done = jobs.train_tabular(
        df, "bad", "anomaly_lof", {"n_neighbors": 5}, normal_only=True, keys=["id"], features=["x"]
    )
    assert done.metrics["recall"] == 1.0
    with pytest.raises(ValueError, match="normal_only"):
        jobs.train_tabular(df, "bad", "classification_rf", normal_only=True, keys=["id"], features=["x"])


def test_a_model_reads_its_source_a_few_times_only(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    n = 400
    df = spark.range(n).select(
        "id", F.concat(F.lit("c"), F.col("id") % 3).alias("kind"),
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 0.5).alias("y"),
    ).withColumn("a", counted("a"))
    jobs.train_tabular(df, "y", "regression_rf", {"n_estimators": 2, "max_depth": 3}, features=["a", "kind"], keys=["id"])
    assert read.value <= 2 * n
