"""Cleaning, de-duplication and removal of tasks."""

import pytest
from pyspark.sql import Observation

from evalframe.operators import quality as Q


def rows(spark, *groups):
    """groups: (task, query_type, model, labels[, n_targets])."""
    out = []
    for task, kind, model, labels, *more in groups:
        n = more[0] if more else 2
        out += [(task, kind, model, "F", float(y) if y is not None else None, ["t"] * n, [-1.0] * n, [-2.0] * n, "text") for y in labels]
    return spark.createDataFrame(
        out, "task string, query_type string, model_name string, model_family string, correct double, targets array<string>, normalized_scores array<double>, absolute_scores array<double>, input string"
    )


MC, SG = "multiple_choice", "scoring_generative"


def decide(spark, mc, sg):
    cube = Q.performance_cube(rows(spark, ("t", MC, "128b", mc), ("t", SG, "128b", sg)))
    row = Q.query_type_decisions(cube).first()
    return row["keep"], row["drop"]


@pytest.mark.parametrize(
    "mc, sg, keep",
    [
        ([0] * 25, [0] * 25, MC),  # both below, tie
        ([0] * 50, [1] + [0] * 49, SG),  # both below, paired higher
        ([1] * 10, [0] * 10, MC),  # only paired below
        ([0] * 10, [1] * 10, SG),
        ([1] * 10, [1] + [0] * 9, SG),  # both above: paired
        ([1] * 20, [1] + [0] * 19, SG),  # exactly at the threshold is not below
    ],
)
def test_which_type_to_keep(spark, mc, sg, keep):
    assert decide(spark, mc, sg) == (keep, MC if keep == SG else SG)


def test_best_model_ties_go_to_the_first_key(spark):
    df = rows(spark, ("t", MC, "8b", [1, 0]), ("t", MC, "128b", [1, 0]), ("t", MC, "4b", [0, 0]))
    assert Q.best_model(Q.performance_cube(df)).first()["model_name"] == "128b"


def test_reference_model_is_required(spark):
    df = rows(spark, ("t", MC, "8b", [1]))
    for operator in (Q.remove_duplicate_queries, lambda d: Q.remove_bad_tasks(Q.augment(d)), Q.prepare):
        with pytest.raises(ValueError, match="128b"):
            operator(df)
    assert Q.remove_duplicate_queries(df, reference_size="8b").count() == 1


def test_drops_the_type_for_all_models(spark):
    df = rows(spark, ("t", MC, "128b", [1, 1]), ("t", SG, "128b", [1, 1]), ("t", MC, "8b", [1]), ("t", SG, "8b", [0]))
    kept = Q.remove_duplicate_queries(df)
    assert {(r["query_type"], r["model_name"]) for r in kept.collect()} == {(SG, "128b"), (SG, "8b")}


def test_task_mixed_only_for_another_model_raises(spark):
    df = rows(spark, ("t", MC, "128b", [1, 1]), ("t", MC, "8b", [0]), ("t", SG, "8b", [0]))
    with pytest.raises(AssertionError):
        Q.remove_duplicate_queries(df)


def test_more_than_two_types_raise(spark):
    df = rows(spark, ("t", MC, "128b", [1]), ("t", SG, "128b", [1]), ("t", "other", "128b", [1]))
    with pytest.raises(Exception, match="three query types"):
        Q.remove_duplicate_queries(df)


def test_binarize_drops_null_nan_and_fractions(spark):
    seen = Observation("dropped")
    df = rows(spark, ("t", MC, "128b", [0, 1, 0.5, None, float("nan")]))
    kept = Q.binarize(df, seen)
    assert sorted(r["correct"] for r in kept.collect()) == [0, 1]
    assert dict(kept.dtypes)["correct"] == "int" and seen.get["n_nonbinary"] == 3


def test_clean_and_its_legacy_mode(spark):
    df = Q.augment(rows(spark, ("a", MC, "128b", [1], 1), ("a", SG, "128b", [1], 1), ("a", MC, "128b", [1], 2)))
    assert Q.clean(df).count() == 2
    assert Q.clean(df, legacy_noop=True).count() == 3


def test_bad_tasks_use_the_mean_number_of_targets(spark):
    # mean of 2 and 8 targets is 5: the limit is 1/5 + 0.05 = 0.25, not mean(1/n) + 0.05
    df = rows(spark, ("at", MC, "128b", [1, 0], 2), ("at", MC, "128b", [0, 0], 8), ("low", MC, "128b", [0, 0, 0, 1, 0], 5),
              ("gen", SG, "128b", [1] + [0] * 19), ("bad", SG, "128b", [1] + [0] * 20))
    kept = Q.remove_bad_tasks(Q.augment(df))
    assert {r["task"] for r in kept.select("task").distinct().collect()} == {"at", "gen"}


def test_describe_equals_pandas(spark):
    df = rows(spark, ("t", MC, "128b", [0, 1, 1, 0.5, None]), ("t", SG, "128b", [1]))
    got = {r["query_type"]: r for r in Q.describe(df, ["query_type"]).collect()}
    want = df.where("query_type = 'multiple_choice'").toPandas()["correct"].describe()
    for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
        assert got[MC][ours] == pytest.approx(want[theirs])
    assert got[SG]["std"] is None


def test_two_pass_preparation_equals_the_steps(spark):
    df = rows(
        spark, ("both", MC, "128b", [1, 0, 0.5, 1]), ("both", SG, "128b", [1, 1, 0]), ("both", MC, "8b", [0]), ("both", SG, "8b", [0.5, 1]),
        ("bad", MC, "128b", [0, 0, 1], 2), ("bad", MC, "8b", [1], 2), ("single", MC, "128b", [1, 1], 1), ("ok", SG, "128b", [1, None, 0]),
    )
    columns = ["task", "query_type", "model_name", "correct", "input"]
    for options in ({}, {"filter_bad_tasks": True}, {"filter_bad_tasks": True, "include_model": True}):
        ours = sorted(map(tuple, Q.prepare(df, **options).select(*columns).collect()))
        steps = sorted(map(tuple, Q.wrangle(Q.remove_duplicate_queries(df), **options).select(*columns).collect()))
        assert ours == steps and ours


def test_minimum_instances(spark):
    df = spark.createDataFrame([("a", 99), ("b", 100), ("c", 101)], "task string, instance_count int")
    assert [r["task"] for r in Q.at_least(df, 100).collect()] == ["b", "c"]
    assert [r["task"] for r in Q.at_least(df, 100, strict=True).collect()] == ["c"]
