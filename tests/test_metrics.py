"""Metrics: hand-made edges, brute force on random data, identities."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.metrics import baselines, binary, correlation, multiclass, report
from evalframe.metrics.histogram import pool_adjacent_violators


def frame(spark, labels, probs, task="t"):
    rows = [(task, float(y), float(p)) for y, p in zip(labels, probs)]
    return spark.createDataFrame(rows, "task string, y double, p double")


def isotonic(labels, probs):
    """Brute force: max over lo<=i of min over hi>=i of the mean label on distinct probabilities."""
    points = sorted(set(probs))
    sums = [(sum(y for y, p in zip(labels, probs) if p == q), sum(p == q for p in probs)) for q in points]
    mean = lambda lo, hi: sum(s for s, _ in sums[lo : hi + 1]) / sum(n for _, n in sums[lo : hi + 1])
    fit = [max(min(mean(lo, hi) for hi in range(i, len(points))) for lo in range(i + 1)) for i in range(len(points))]
    return dict(zip(points, fit))


def auroc(labels, probs):
    pairs = [(a, b) for a, ya in zip(probs, labels) if ya for b, yb in zip(probs, labels) if not yb]
    return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)


@pytest.mark.parametrize("distinct", [3, 17, 1000])
def test_against_brute_force(spark, distinct):
    rng = random.Random(distinct)
    probs = [rng.randint(0, distinct) / distinct for _ in range(120)]
    labels = [int(rng.random() < 0.2 + 0.6 * p) for p in probs]
    row = binary.scores(frame(spark, labels, probs), "y", "p").first()
    fit = isotonic(labels, probs)
    rate = sum(labels) / len(labels)
    bs = np.mean([(y - p) ** 2 for y, p in zip(labels, probs)])
    iso = np.mean([(y - fit[p]) ** 2 for y, p in zip(labels, probs)])
    tp = sum(y and p > 0.5 for y, p in zip(labels, probs))
    assert row["accuracy"] == pytest.approx(np.mean([(p > 0.5) == bool(y) for y, p in zip(labels, probs)]))
    assert row["precision"] == pytest.approx(tp / sum(p > 0.5 for p in probs))
    assert row["recall"] == pytest.approx(tp / sum(labels))
    assert row["roc_auc"] == pytest.approx(auroc(labels, probs))
    assert row["bs"] == pytest.approx(bs)
    assert row["bs_mcb"] == pytest.approx(bs - iso)
    assert row["bs_dsc"] == pytest.approx(rate * (1 - rate) - iso)
    assert row["bs"] == pytest.approx(row["bs_mcb"] - row["bs_dsc"] + row["bs_unc"], rel=1e-5)
    assert row["bs_mcb"] >= -1e-12 and row["bs_dsc"] >= -1e-12


@pytest.mark.parametrize("seed", range(6))
def test_pooling_equals_the_fit(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 5, 200).astype(float)
    pos = np.floor(rng.random(200) * (n + 1))
    starts = pool_adjacent_violators(pos, n)
    means = np.add.reduceat(pos, starts) / np.add.reduceat(n, starts)
    assert (np.diff(means) > 0).all()
    lo = np.repeat(means, np.diff(np.append(starts, 200)))
    cp, cn = np.cumsum(pos), np.cumsum(n)
    want = [max(min((cp[h] - cp[l] + pos[l]) / (cn[h] - cn[l] + n[l]) for h in range(i, 200)) for l in range(i + 1)) for i in range(0, 200, 17)]
    assert np.allclose(lo[::17], want)


def test_pooling_falls_back_on_slow_inputs():
    """A long rise ended by a deep fall needs one round per step; the stack finishes it."""
    pos = np.append(np.arange(1.0, 400.0), -1e6)
    starts = pool_adjacent_violators(pos, np.ones(400))
    assert list(starts) == [0]


def test_ranges_are_merged_exactly(spark):
    """Many probability ranges (no coalescing) give the single-range result, also for a merge of several levels."""
    rng = random.Random(5)
    probs = [rng.random() for _ in range(4000)]
    labels = [int(rng.random() < p) for p in probs]
    df = frame(spark, labels, probs).withColumn("task", F.when(F.rand(1) < 2, F.lit("t")))
    one = binary.scores(df.coalesce(1), "y", "p", ["task"]).first()
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "66")
    try:
        many = binary.scores(df, "y", "p", ["task"]).first()
        plain = binary.scores(df, "y", "p", ["task"], ["roc_auc"]).first()
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)
    for c in binary.metric_columns(binary.TEST_METRICS):
        assert many[c] == pytest.approx(one[c], rel=1e-9, abs=1e-12), c
    assert plain["roc_auc"] == pytest.approx(one["roc_auc"])
    assert one["roc_auc"] == pytest.approx(auroc(labels, probs))


def test_recorded_calibration_case_stays_in_bounds(spark):
    # A published case whose isotonic fit once left [0, 1]
    labels = [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 1]
    probs = [0.18340617, 0.18658939, 0.18315548, 0.16983712, 0.25035772, 0.1721356, 0.16754772,
             0.19691958, 0.17372875, 0.18496932, 0.24394462, 0.17942533, 0.16504768, 0.16173083]
    df = frame(spark, labels, probs)
    fitted = [r["p_iso"] for r in binary.recalibrated(df, "y", "p", ["task"]).collect()]
    assert all(0 <= v <= 1 for v in fitted)
    assert sorted(fitted) == pytest.approx([1 / 12] * 12 + [1.0] * 2)
    row = binary.scores(df, "y", "p", [], ["brier_score"]).first()
    assert row["bs"] == pytest.approx(row["bs_mcb"] - row["bs_dsc"] + row["bs_unc"])


def test_recalibration_matches_fit_across_ranges(spark):
    rng = random.Random(11)
    probs = [rng.randint(0, 90) / 90 for _ in range(600)]
    labels = [int(rng.random() < p) for p in probs]
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = binary.recalibrated(frame(spark, labels, probs), "y", "p").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)
    fit = isotonic(labels, probs)
    assert len(rows) == 600
    assert all(r["p_iso"] == pytest.approx(fit[r["p"]]) for r in rows)


def test_single_class_and_undefined_ratios(spark):
    row = binary.scores(frame(spark, [0, 0, 0, 0], [0.1, 0.2, 0.3, 0.4]), "y", "p").first()
    assert math.isnan(row["roc_auc"])
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert row["accuracy"] == row["balanced_accuracy"] == 1.0
    zero = binary.scores(frame(spark, [1, 1], [0.1, 0.9]), "y", "p", [], ["roc_auc"], single_class=0.0).first()
    assert zero["roc_auc"] == 0.0


def test_perfect_classifier_and_ties(spark):
    perfect = binary.scores(frame(spark, [0, 1, 0, 1], [0, 1, 0, 1]), "y", "p").first()
    assert perfect["bs"] == 0 and perfect["roc_auc"] == 1 and perfect["f1"] == 1
    tied = binary.scores(frame(spark, [0, 1, 0, 1], [0.5] * 4), "y", "p").first()
    assert tied["roc_auc"] == 0.5 and tied["recall"] == 0.0  # one half is not above one half
    assert tied["bs_mcb"] == pytest.approx(0) and tied["bs_dsc"] == pytest.approx(0)


def test_reversed_scores_mirror_auroc(spark):
    rng = random.Random(2)
    probs = [rng.randint(0, 30) / 30 for _ in range(200)]
    labels = [int(rng.random() < 0.4) for _ in probs]
    one = binary.scores(frame(spark, labels, probs), "y", "p", [], ["roc_auc"]).first()[0]
    other = binary.scores(frame(spark, labels, [1 - p for p in probs]), "y", "p", [], ["roc_auc"]).first()[0]
    assert one == pytest.approx(1 - other)


def test_unknown_metric_is_an_error(spark):
    with pytest.raises(KeyError):
        binary.scores(frame(spark, [0], [0.1]), "y", "p", [], ["nope"])


def test_null_labels_and_probabilities_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 0.9), (None, 0.2), (0.0, None), (0.0, 0.1)], "y double, p double")
    assert binary.scores(df, "y", "p", [], ["accuracy"], counts=True).first()["n"] == 2


@pytest.fixture()
def samples(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        task, model = f"t{i % 4}", ("128b", "F") if i % 3 else ("8b", "F")
        rows.append((f"k{i}", task, *model, i % 4, int(rng.random() < 0.2 + 0.2 * (i % 4)), rng.random(), [-rng.random(), -3.0], [-rng.random() * 2, -4.0]))
    df = spark.createDataFrame(
        rows, "sample_key string, task string, model_name string, model_family string, shots int, correct int, assr double, normalized_scores array<double>, absolute_scores array<double>"
    )
    return df.withColumns({"conf_normalized": F.exp(F.array_max("normalized_scores")), "conf_absolute": F.exp(F.array_max("absolute_scores"))})


def test_distribution_baseline_is_calibrated_per_cell(samples):
    rows = baselines.with_distribution_baseline(samples)
    parts = binary.scores(rows, "correct", "conf_distribution", ["task", "model_name"], ["brier_score"]).collect()
    assert all(abs(r["bs_mcb"]) < 1e-9 and abs(r["bs_dsc"]) < 1e-9 for r in parts)


def test_report_total_and_per_task_agree_with_plain_sums(samples):
    total = report.test_report(samples, "assr").first()
    assert total["instance_count"] == 400
    per_task = {r["task"]: r for r in report.test_report(samples, "assr", ["task"]).collect()}
    for r in samples.groupBy("task").agg(F.avg("correct").alias("a"), F.count("*").alias("n")).collect():
        assert per_task[r["task"]]["test_task_accuracy"] == pytest.approx(r["a"])
        assert per_task[r["task"]]["instance_count"] == r["n"]
    macro = np.mean([r["test_task_accuracy"] for r in per_task.values()])
    assert total["test_task_accuracy"] == pytest.approx(macro)
    assert len(total.asDict()) == 4 * 10 + 2


def test_baselines_are_taken_within_each_evaluated_group(samples):
    by_shots = report.test_report(samples, "assr", ["shots"]).collect()
    for row in by_shots:
        alone = report.test_report(samples.where(F.col("shots") == row["shots"]), "assr").first()
        assert row["test_conf_distribution_bs"] == pytest.approx(alone["test_conf_distribution_bs"])


def test_merge_needs_the_same_paths(spark):
    stats = spark.createDataFrame([("a", "train", 1.0), ("a", "test", 2.0), ("b", "train", 3.0)], "path string, split string, value double")
    with pytest.raises(Exception, match="every side"):
        report.merge_sides(stats, "split", ["train", "test"]).collect()
    one = stats.where("split = 'train'").drop("split")
    assert report.merge(one, one, "x", "y").count() == 2


def test_analyse_counts_nonbinary_rows(samples):
    odd = samples.withColumn("correct", F.when(F.col("sample_key") == "k0", 0.5).otherwise(F.col("correct").cast("double")))
    values = {r["path"]: r["value"] for r in report.analyse(odd).collect()}
    assert values["stats/n_instances"] == 399 and values["stats/n_instances_nonbinary"] == 1
    assert values["stats/n_tasks"] == 4 and len(values) == 18


def test_task_performance_skips_single_rows(spark, samples):
    lone = samples.limit(1).withColumn("task", F.lit("lone"))
    rows = report.task_performance(samples.unionByName(lone), "assr").collect()
    assert {r["task"] for r in rows} == {"t0", "t1", "t2", "t3"}


def test_multiclass_needs_every_class(spark):
    probs = [[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6], [0.5, 0.3, 0.2]]
    df = spark.createDataFrame([(p, y) for p, y in zip(probs, [0, 1, 2, 0])], "probs array<double>, y int")
    assert multiclass.auroc_weighted(df, "y", "probs").first()[0] == pytest.approx(1.0)
    missing = spark.createDataFrame([(p, y) for p, y in zip(probs, [0, 1, 1, 0])], "probs array<double>, y int")
    assert math.isnan(multiclass.auroc_weighted(missing, "y", "probs").first()[0])


def test_correlations_and_p_values(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 7.0]
    y = [2.1, 2.9, 3.2, 4.8, 5.1, 4.9, 8.0]
    df = spark.createDataFrame(list(zip(x, y)) + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    row = correlation.pearson(df, "x", "y").first()
    assert row["n"] == 7 and row["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert 0 < row["p"] < 0.001
    assert correlation.spearman(df, "x", "y").first()["spearman"] == pytest.approx(
        np.corrcoef([1, 2, 3, 4, 5.5, 5.5, 7], [1, 2, 3, 4, 6, 5, 7])[0, 1]
    )


@pytest.mark.parametrize("r, n, p", [(0.5, 3, 2 / 3), (0.0, 10, 1.0), (0.6319, 10, 0.05), (0.3610, 30, 0.05), (1.0, 8, 0.0)])
def test_p_value_table(r, n, p):
    assert correlation.pearson_p(r, n) == pytest.approx(p, abs=2e-4)


def test_rows_without_a_task_stay_in_baselines_and_reports(spark):
    rows = [(None if i % 4 == 0 else "a", "F", "8b" if i % 3 else None, i % 2, (i % 10) / 10, (i % 7) / 7) for i in range(40)]
    df = spark.createDataFrame(rows, "task string, model_family string, model_name string, correct int, conf_normalized double, conf_absolute double")
    based = baselines.with_distribution_baseline(df)
    assert based.count() == 40 and based.where("conf_distribution is null").isEmpty()
    total = report.test_report(df, "conf_normalized", metrics=["accuracy"]).first()
    assert total["instance_count"] == 40
    assert total["test_accuracy"] == df.where("cast(conf_normalized > 0.5 as int) = correct").count() / 40
    per_task = {r["task"]: r["instance_count"] for r in report.test_report(df, "conf_normalized", ["task"], ["accuracy"]).collect()}
    assert per_task == {None: 10, "a": 30}


def test_isotonic_fit_streams_through_small_batches(spark):
    """One group with 99 % of the rows and all probabilities distinct, NULL keys, batches of 7 rows, many ranges."""
    rng = random.Random(5)
    rows = [("hot" if i % 100 else rng.choice([None, "a", "b"]), i / 3000, int(rng.random() < i / 3000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, p double, y int").repartition(8)
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "70",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["g"]: r for r in binary.scores(df, "y", "p", ["g"], ["brier_score", "roc_auc"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for g in ("hot", None, "a", "b"):
        mine = sorted((p, y) for h, p, y in rows if h == g)
        blocks = []
        for _, y in mine:
            blocks.append([y, 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                k, m = blocks.pop()
                blocks[-1] = [blocks[-1][0] + k, blocks[-1][1] + m]
        n, pos = len(mine), sum(y for _, y in mine)
        bs, iso = sum((p - y) ** 2 for p, y in mine) / n, sum(k * (1 - k / m) for k, m in blocks) / n
        assert got[g]["bs"] == pytest.approx(bs) and got[g]["bs_mcb"] == pytest.approx(bs - iso)
        wins = sum(1 for p, y in mine if y for q, z in mine if not z and q < p)
        if 0 < pos < n:
            assert got[g]["roc_auc"] == pytest.approx(wins / (pos * (n - pos)))


def test_confusion_by_name(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.7), (0, 0.1), (0, 0.3)], "y int, p double")
    row = binary.scores(df, "y", "p", [], ["confusion_matrix"]).first()
    assert (row["tn"], row["fn"], row["fp"], row["tp"]) == (2, 1, 1, 1)
