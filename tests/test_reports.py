"""Metric documents, tracker exports and sinks on disk."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalframe.sources import reports


@pytest.fixture()
def run_dir(tmp_path):
    (tmp_path / "metrics_per_task.json").write_text(
        json.dumps({"a": {"test_conf_x": 1.0, "test_acc": 0.5}, "color": {"test_acc": 0.1}, "b": {"test_acc": float("nan"), "test_loss": 2}}, indent=2)
    )
    (tmp_path / "metrics.json").write_text(json.dumps({"test_conf_x": 3.0, "test_acc": 0.7, "instance_count": 9}, indent=2))
    return str(tmp_path)


def test_load_metrics(spark, run_dir):
    table = reports.load_metrics(spark, run_dir)
    assert table.columns == ["task", "instance_count", "test_acc", "test_loss", "test_conf_x"]  # baselines last
    rows = {r["task"]: r for r in table.collect()}
    assert set(rows) == {"a", "b", "total"}  # a contaminated task is left out
    assert rows["b"]["test_acc"] != rows["b"]["test_acc"] and rows["b"]["test_conf_x"] is None
    assert rows["total"]["instance_count"] == 9
    assert [r["task"] for r in reports.load_metrics(spark, run_dir, load=["total"]).collect()] == ["total"]
    with pytest.raises(ValueError):
        reports.load_metrics(spark, run_dir, load=[])


def test_load_runs_takes_keys_from_directories(spark, tmp_path):
    for a, s, v in (("small", "2m", 0.1), ("base", "128b", 0.2)):
        (tmp_path / a / s).mkdir(parents=True)
        (tmp_path / a / s / "metrics.json").write_text(json.dumps({"test_roc_auc": v}))
    runs = reports.load_runs(spark, f"{tmp_path}/*/*/metrics.json", ["assessor_size", "subject_size"])
    assert sorted(map(tuple, runs.collect())) == [("base", "128b", 0.2), ("small", "2m", 0.1)]


def test_tracker_export(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(
        '"step","m-base-for-0-shots - eval/loss","m-base-for-0-shots - eval/roc_auc","m-base-for-0-shots - eval/loss__MIN","other - eval/loss"\n'
        "10,0.5,0.6,0.5,9\n20,0.3,0.8,0.3,9\n30,0.3,0.7,0.3,9\n40,,0.9,,9\n"
    )
    long = reports.unpivot_series(reports.read_tracker_export(spark, str(path)))
    named = reports.parse_series(long, r"^m-(\w+)-for-(\d)-shots$", ["size", "shots"])
    best = reports.values_at_minimal_loss(named, ["size", "shots"])
    rows = {r["metric"]: (r["size"], r["shots"], r["step"], r["value"]) for r in best.collect()}
    assert rows["roc_auc"] == ("base", "0", 20, 0.8) and rows["loss"] == ("base", "0", 20, 0.3)


def test_sinks(spark, tmp_path):
    samples = spark.createDataFrame([("hello, \"x\"", 1.0), ("b", 0.0)], "input string, correct double")
    reports.write_text_and_label(samples, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert back.columns == ["text", "target"] and back.count() == 2
    rows = spark.createDataFrame([("t", 0.5), ("u", 0.6)], "task string, p double")
    reports.write_results(rows.groupBy("task").agg(F.count("*").alias("n")), rows, f"{tmp_path}/out", per_task=True)
    reports.write_results(rows.agg(F.count("*").alias("n")), rows, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/predictions_per_task").where("task = 't'").count() == 1
    assert spark.read.json(f"{tmp_path}/out/metrics").first()["n"] == 2


def test_sized_files_and_their_manifest(spark, tmp_path):
    rows = spark.range(1000).selectExpr("case when id < 700 then '007' when id < 999 then 'b' end as task", "id as k", "cast(id % 3 as double) as p")
    path = f"{tmp_path}/sized"
    reports.write_sized(rows, path, ["task"], target_rows=100)
    back = reports.read_sized(spark, path, ["task"])
    assert sorted(map(tuple, back.select("task", "k", "p").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    files = back.withColumn("f", F.col("_metadata.file_path")).groupBy("task").agg(F.countDistinct("f").alias("n"), F.count("*").alias("rows"))
    assert {r["task"]: r["n"] for r in files.collect()} == {"007": 7, "b": 3, None: 1}
    lost = next(Path(path).glob("task=b/*/*.parquet"))
    (lost.parent / f".{lost.name}.crc").unlink()
    lost.write_bytes(next(Path(path).glob("task=007/*/*.parquet")).read_bytes())  # another number of rows
    with pytest.raises(ValueError, match="manifest"):
        reports.read_sized(spark, path, ["task"])
    copied = spark.createDataFrame([("t", 1.0)] * 50, "task string, p double")  # equal rows can't be told apart
    reports.write_sized(copied, f"{tmp_path}/copied", ["task"], target_rows=10)
    assert reports.read_sized(spark, f"{tmp_path}/copied", ["task"]).count() == 50


def test_flatten_record(spark):
    df = spark.sql("select named_struct('b', 1, 'c', named_struct('d', 'x')) as a, 2 as e")
    flat = reports.flatten_record(df)
    assert flat.columns == ["a.b", "a.c.d", "e"] and tuple(flat.first()) == (1, "x", 2)
