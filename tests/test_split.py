"""Splits: sizes, disjointness, stratification, determinism, alignment."""

import math

import pytest
from pyspark.sql import functions as F

from evalframe.operators import split as X


@pytest.fixture()
def sized(spark):
    """Tasks of 1, 5, 25 and (a hot one) 600 rows of one model."""
    rows = [(f"{t}-{i}", t, "128b", "F", f"text {i}", i % 2) for t, n in (("one", 1), ("five", 5), ("many", 25), ("hot", 600)) for i in range(n)]
    return spark.createDataFrame(rows, "sample_key string, task string, model_name string, model_family string, input string, correct int")


def sizes(marked, side="train"):
    return {r["task"]: r["count"] for r in marked.where(F.col("split") == side).groupBy("task").count().collect()}


def test_instance_split_rounds_half_to_even(sized):
    assert sizes(X.split_instances(sized, 0.5)) == {"five": 2, "many": 12, "hot": 300}  # 0.5 -> 0, 2.5 -> 2, 12.5 -> 12
    assert sizes(X.split_instances(sized, 0.2)) == {"one": 1, "five": 4, "many": 20, "hot": 480}


def test_split_is_complete_disjoint_and_repeatable(sized):
    first = {r["sample_key"]: r["split"] for r in X.split(sized, "instance", 0.3).collect()}
    again = {r["sample_key"]: r["split"] for r in X.split(sized.orderBy(F.desc("sample_key")), "instance", 0.3).collect()}
    other = {r["sample_key"]: r["split"] for r in X.split(sized, "instance", 0.3, seed=1).collect()}
    assert first == again and len(first) == sized.count() and first != other
    train, test = X.train_and_test(X.split(sized, "instance", 0.3))
    assert train.join(test, "sample_key").count() == 0


def test_task_split_rounds_the_test_side_up(spark):
    df = spark.createDataFrame([(f"t{i}", 0) for i in range(118)], "task string, correct int")
    assert X.split_tasks(df, 0.2).where("split = 'test'").count() == math.ceil(118 * 0.2) == 24
    assert X.split_tasks(df.limit(3), 0.0).where("split = 'test'").count() == 0


def test_distribution_shift_trains_on_easy_tasks(spark):
    rows = [(f"t{i:02d}", int(j < i)) for i in range(11) for j in range(10)]
    marked = X.split(spark.createDataFrame(rows, "task string, correct int"), "task_DS", 0.2)
    train = {r["task"] for r in marked.where("split = 'train'").collect()}
    assert train == {f"t{i:02d}" for i in range(3, 11)}  # int(11 * 0.8) = 8 tasks, most accurate first


def test_distribution_shift_ties_go_by_name(spark):
    marked = X.split_distribution_shift(spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "task string, correct int"), 0.5)
    assert {r["task"]: r["split"] for r in marked.collect()} == {"a": "train", "b": "test", "c": "test"}


def test_models_are_aligned_even_with_copies_and_gaps(spark):
    rows = []
    for model in ("8b", "27b", "128b"):
        for i in range(40):
            if (model, i) == ("8b", 7):
                continue  # one model misses an instance
            rows.append((f"{model}-{i}", "t", model, "F", "copy" if i < 10 else f"text {i}", 1))
    df = spark.createDataFrame(rows, "sample_key string, task string, model_name string, model_family string, input string, correct int")
    marked = X.split(df, "instance", 0.25)
    assert marked.count() == len(rows)
    sides = {}
    for r in marked.where("input <> 'copy'").collect():
        sides.setdefault(r["input"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    per_model = {(r["model_name"], r["split"]): r["count"] for r in marked.groupBy("model_name", "split").count().collect()}
    assert per_model[("128b", "train")] == per_model[("27b", "train")] == 30
    assert sum(v for (m, _), v in per_model.items() if m == "8b") == 39


def test_unknown_split(sized):
    with pytest.raises(ValueError):
        X.split(sized, "random")


def test_global_sample_and_cap(sized):
    marked = X.sample_fraction(sized, 0.4)
    assert marked.where("split = 'sample'").count() == round(631 * 0.4)
    assert X.cap_instances(sized, 200).count() == 200
    assert X.cap_instances(sized, 10_000).count() == 631


def test_instance_split_does_not_sort_or_shuffle_the_rows(sized):
    plan = X.split_instances(sized, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Sort" not in plan and "Window" not in plan


def test_rows_without_a_task_stay_on_the_test_side(spark):
    rows = [(f"k{i}", None if i % 5 == 0 else f"t{i % 4}", f"m{i % 2}", "f", f"text {i // 2}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "sample_key string, task string, model_name string, model_family string, input string, correct int")
    splits = [X.split_instances(df, 0.2), X.split_instances_aligned(df, 0.2), X.split_tasks(df, 0.5), X.split_distribution_shift(df, 0.5)]
    for marked in splits:
        assert marked.count() == 80 and marked.where("split is null").isEmpty()
        assert {r["split"] for r in marked.where("task is null").select("split").collect()} == {"test"}
        assert marked.where("task is not null and split = 'train'").count() > 0


def test_aligned_split_moves_no_text(spark):
    """Where few inputs are copied, no exchange carries the input column."""
    rows = [(f"k{i}", f"t{i % 3}", m, "F", f"text {i if i > 4 else 0}", 1.0) for i in range(60) for m in ("a", "b")]
    df = spark.createDataFrame([(f"{k}{m}", *r, m, *rest) for k, *r, m, f, t, c in rows for rest in [(f, t, c)]], "sample_key string, task string, model_name string, model_family string, input string, correct double")
    marked = X.split_instances_aligned(df, 0.3)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    sides = {}
    for r in marked.collect():
        sides.setdefault((r["task"], r["input"]), set()).add(r["split"])
    assert all(len(s) == 1 for (t, text), s in sides.items() if text != "text 0")


def test_samples_by_model_are_pruned(spark, tmp_path):
    from evalframe.sources import logs

    df = spark.createDataFrame([(i, f, s) for i in range(3) for f in ("A", "B") for s in ("8b", "2m")], "k int, model_family string, model_name string")
    logs.write_by_model(df, f"{tmp_path}/m")
    kept = logs.read_by_model(spark, f"{tmp_path}/m", ["A"], ["8b"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 3 and "PartitionFilters: [isnotnull(model_family" in plan
    models = df.groupBy("model_family", "model_name").agg(F.count("*").alias("n")).where("model_name = '2m' and n > 1")
    chosen = logs.of_models(logs.read_by_model(spark, f"{tmp_path}/m"), models)
    assert chosen.count() == 6 and "dynamicpruning" in chosen._jdf.queryExecution().executedPlan().toString().lower()
