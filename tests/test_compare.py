"""Comparison tables, rankings and task sets."""

import pytest
from pyspark.sql import functions as F

from evalframe.operators import compare as C

NAN = float("nan")


def series(spark, **values):
    return spark.createDataFrame(list(values.items()), "task string, v double")


def listed(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture()
def two(spark):
    return series(spark, a=0.5, b=0.2, only=0.9, nan=NAN, total=0.4, c=0.1), series(spark, a=0.6, b=0.9, nan=0.3, total=0.5, c=0.05)


def test_difference_aligns_sorts_and_puts_total_last(two):
    rows = listed(C.difference(*two, sort="diff", sort_direction="desc"), "task", "diff")
    assert [t for t, _ in rows] == ["b", "a", "c", "total"]
    assert rows[0][1] == pytest.approx(0.7)
    assert listed(C.difference(*two), "task") == [("a",), ("b",), ("c",), ("total",)]
    assert C.difference(*two).first()["label"] == "a (0.50)"


def test_thresholds_are_strict(two):
    assert listed(C.difference(*two, sys1_threshold=0.2), "task") == [("a",), ("total",)]
    assert listed(C.difference(*two, sys2_threshold=0.5), "task") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        C.difference(*two, sort="size")


def test_absolute_subtracts_the_reference(two):
    row = C.absolute(*two, sort="results", sort_direction="desc", marker=0.45).first()
    assert (row["task"], row["label"], row["above_marker"]) == ("a", "a (0.60)", True)
    assert row["diff"] == pytest.approx(-0.1)


def run(spark, *rows):
    return spark.createDataFrame(rows, "task string, test_roc_auc double, test_conf_normalized_roc_auc double, test_bs_mcb double, instance_count int")


def test_alignment_and_override(spark):
    a = run(spark, ("x", 0.7, 0.5, 0.1, 101), ("y", 0.7, 0.05, 0.1, 500), ("z", 0.6, 0.5, 0.1, 100), ("w", 0.5, 0.4, 0.1, 300))
    b = run(spark, ("w", 0.8, 0.6, 0.2, 300), ("x", 0.8, 0.6, 0.2, 101), ("v", 0.8, 0.6, 0.2, 101))
    left, right = C.align(a, b)
    assert listed(left, "task") == listed(right, "task") == [("w",), ("x",)]
    C.require_same_tasks(left, right)
    with pytest.raises(AssertionError):
        C.require_same_tasks(a, b)
    assert C.override_baselines(left, right).where("task = 'x'").first()["test_conf_normalized_roc_auc"] == 0.6


def test_merge_checks_counts(spark):
    a, b = run(spark, ("x", 0.7, 0.5, 0.1, 10)), run(spark, ("x", 0.6, 0.5, 0.1, 10))
    assert C.merge_reports(a, b, ("_a", "_b")).first()["test_roc_auc_b"] == 0.6
    with pytest.raises(Exception, match="counts differ"):
        C.merge_reports(a, b.withColumn("instance_count", F.lit(11)), ("_a", "_b")).collect()


def test_minimal_loss_takes_the_earliest_step(spark):
    long = spark.createDataFrame([("r", 1, 0.5, 10.0), ("r", 3, 0.2, 30.0), ("r", 2, 0.2, 20.0), ("s", 1, None, 5.0)], "run string, step int, loss double, value double")
    assert listed(C.at_minimal_loss(long, ["run"]), "run", "step", "value") == [("r", 2, 20.0)]


def test_order_of_sizes(spark):
    grid = spark.createDataFrame([("large", "2m"), ("small", "128b"), ("small", "2m"), ("base", "1b")], "assessor_size string, subject_size string").withColumn("m", F.lit(1.0))
    assert listed(C.report_scaling(grid, "m"), "assessor_size", "subject_size") == [("small", "2m"), ("small", "128b"), ("base", "1b"), ("large", "2m")]


def test_task_sets(spark):
    pairs = [("c", "multiple_choice"), ("g", "generative"), ("g", "scoring"), ("m", "multiple_choice"), ("m", "generative"), ("s", "scoring"), ("g", "generative")]
    types = C.task_types(spark.createDataFrame(pairs, "task string, query_type string"))
    assert dict(listed(C.task_type_counts(types), "type", "n_tasks")) == {"multiple_choice": 2, "generative": 2, "scoring": 2, "mixed": 2}
    sets = {}
    for name, task in listed(C.task_set_algebra(types), "set", "task"):
        sets.setdefault(name, set()).add(task)
    assert sets["generative_non_mpc"] == {"g"} and sets["generative_non_scoring"] == {"m"} and sets["scoring_only"] == {"s"}
    assert sets["mpc_only"] == {"c"} and sets["all_tasks"] == {"c", "g", "m", "s"} and sets["open_ended_or_mpc_only"] == {"g", "c"}
    assert "generative_only" not in sets


def test_preferred_scores_and_cumulative_counts(spark):
    records = spark.createDataFrame(
        [("a", "em", {"em": 10.0}, "a"), ("a", "em", {"em": 20.0}, "a"), ("a", "em", {"em": 90.0}, "sub"), ("b", "bleu", {"bleu": 99.0}, "b"), ("c", "em", {"em": 120.0}, "c")],
        "task string, preferred_score string, score_dict map<string,double>, subtask_description string",
    )
    assert listed(C.preferred_metrics(records), "metric", "n_tasks") == [("em", 2), ("bleu", 1)]
    means = C.preferred_score_means(records)
    assert dict(listed(means, "task", "score")) == {"a": 15.0, "b": 99.0, "c": 120.0}
    assert C.preferred_score_means(records, ["bleu"]).count() == 1
    # the last bin is open at the top: a perfect score and one beyond count
    assert sorted(listed(C.reverse_cumulative(means), "bin", "n", "n_at_least")) == [(15, 1, 3), (98, 2, 2)]
    assert dict(listed(C.count_above(means, [15, 98]), "threshold", "n_above")) == {15.0: 2, 98.0: 2}


def test_numbers_and_first_duplicates(spark):
    df = spark.createDataFrame([(2, "AUC: 0.75, x"), (1, "AUC: 0.75"), (3, "none")], "id int, text string")
    named = df.select("id", C.number_in_text(F.col("text"), "AUC").alias("auc"))
    assert sorted(listed(named, "id", "auc")) == [(1, 0.75), (2, 0.75), (3, None)]
    assert sorted(listed(C.first_of_duplicates(named, ["auc"], ["id"]), "id")) == [(1,), (3,)]
