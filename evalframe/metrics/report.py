"""Reports built from the metrics: test reports, split statistics, accuracy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.features import best_accuracy, log_mean_exp, lookup, mean_chance, worst_accuracy
from evalframe.functions.features import confidence, correct_target_likelihoods
from evalframe.functions.text import share_longer_than
from evalframe.metrics import binary
from evalframe.metrics.baselines import BASELINES, attach, label_cells, score_systems, task_accuracy, with_distribution_baseline
from evalframe.operators.quality import binary_label
from evalframe.operators.split import DEFAULT_SEED, mark_all
from evalframe.runtime import join_per_key, materialize, seeded_hash
from evalframe.sources.catalog import MODEL_PARAMETERS


def test_report(
    df: DataFrame, p: str, keys: list[str] | None = None, metrics: list[str] | None = None, label: str = "correct"
) -> DataFrame:
    """Assessor metrics, the baselines' metrics and the instance count, named ``test_*``.

    ``keys=["task"]`` gives the per-task report in the same single job.
    """
    keys, metrics = list(keys or []), list(metrics or binary.TEST_METRICS)
    cells = label_cells(df, keys, label)
    rows = with_distribution_baseline(df, label=label, keys=keys, cells=cells)
    systems = {"test_": p} | {f"test_conf_{b}_": f"conf_{b}" for b in BASELINES}
    table = score_systems(rows, systems, keys, metrics, label)
    accuracy = task_accuracy(cells, keys).withColumnRenamed("task_accuracy", "test_task_accuracy")
    sizes = cells.groupBy(*keys).agg(F.sum("n").alias("instance_count"))
    return attach(attach(table, accuracy, keys), sizes, keys)


test_report.__test__ = False  # not a test case


def report_with_long_share(
    df: DataFrame, p: str, keys: list[str], max_tokens: int, text: str = "input", metrics: list[str] | None = None, label: str = "correct"
) -> DataFrame:
    """The test report of each group beside the share of its texts of more than ``max_tokens`` tokens (``n_long_sequences``)."""
    long = share_longer_than(df, max_tokens, keys, text).select(*keys, "n_long_sequences")
    return attach(test_report(df, p, keys, metrics, label), long, keys)


def tasks_and_total(df: DataFrame, *aggregates: Column, group: str = "task", total: str = "total") -> DataFrame:
    """Per-task rows plus one row over everything, in one pass (grouping sets)."""
    rows = df.groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping(group).alias("_total"), *aggregates)
    named = F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(group))
    return rows.withColumn(group, named).drop("_total")


# ---- statistics of a split -------------------------------------------------

CONFIDENCES = {"conf-normalized": "conf_normalized", "conf-absolute": "conf_absolute"}


def _long(wide: DataFrame, keys: list[str], paths: dict[str, str]) -> DataFrame:
    """Unpivot named columns to (keys…, path, value)."""
    entries = F.array(*[F.struct(F.lit(path).alias("path"), F.col(c).cast("double").alias("value")) for c, path in paths.items()])
    return wide.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def analyse(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sizes, accuracy and confidence quality of each group as (keys…, path, value).

    AUROC is 0 where only one class occurs. The confidences are taken from the scores of the
    targets, or as they are where ``df`` has both as columns.
    """
    keys = list(keys or [])
    if not set(CONFIDENCES.values()) <= set(df.columns):
        df = df.withColumns({"conf_normalized": confidence("normalized_scores"), "conf_absolute": confidence("absolute_scores")})
    valid = binary_label()
    sizes = df.groupBy(*keys).agg(
        F.countDistinct(F.when(valid, F.col("task"))).alias("n_tasks"),
        F.count_if(valid).alias("n_instances"),
        F.count_if(~valid).alias("n_nonbinary"),
        F.avg(F.when(valid, F.col("correct").cast("double"))).alias("task_acc"),
    )
    paths = {
        "n_tasks": "stats/n_tasks",
        "n_instances": "stats/n_instances",
        "n_nonbinary": "stats/n_instances_nonbinary",
        "task_acc": "metrics/task-acc",
    }
    rows = df.where(valid)
    names = {"accuracy": "acc", "balanced_accuracy": "balanced_acc", "roc_auc": "roc_auc",
             "bs": "bs", "bs_mcb": "bs_mcb", "bs_dsc": "bs_dsc", "bs_unc": "bs_unc"}
    systems = {f"{kind}/": column for kind, column in CONFIDENCES.items()}
    metrics = ["accuracy", "balanced_accuracy", "roc_auc", "brier_score"]
    quality = score_systems(rows, systems, keys, metrics, single_class=0.0)
    quality_paths = {f"{prefix}{m}": f"metrics/{prefix}{name}" for prefix in systems for m, name in names.items()}
    return _long(sizes, keys, paths).unionByName(_long(quality, keys, quality_paths))


def merge_sides(stats: DataFrame, side: str, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Put the sides of a long statistics table next to each other; every path must exist on each side."""
    keys = list(keys or [])
    cells = [F.max(F.when(F.col(side) == n, F.col("value"))).alias(n) for n in names]
    wide = stats.groupBy(*keys, "path").agg(F.countDistinct(side).alias("_k"), *cells)
    first = F.when(F.col("_k") == len(names), F.col(names[0])).otherwise(
        F.raise_error(F.concat(F.lit("not every side has the path "), F.col("path")))
    )
    return wide.withColumn(names[0], first).drop("_k")


def merge(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """Two (path, value) tables side by side."""
    both = a.withColumn("_side", F.lit(a_name)).unionByName(b.withColumn("_side", F.lit(b_name)))
    return merge_sides(both, "_side", [a_name, b_name])


def stats_sweep(
    df: DataFrame,
    shots_sets: list[list[int]],
    test_fraction: float = 0.2,
    seed: int = DEFAULT_SEED,
    key: str = "sample_key",
) -> DataFrame:
    """Train/test statistics for each set of shots × each kind of split, in one job.

    ``df`` is read once: what the statistics need of a row, its hash, label and confidences, is stored, tagged with the
    sets of shots it belongs to. Splits within each set are decided per task and marked in one scan of that table.
    """
    tags = [F.when(F.col("shots").isin(s), F.lit(",".join(map(str, s)))) for s in shots_sets]
    narrow = df.select(
        F.explode(F.array_compact(F.array(*tags))).alias("shots_set"), "task", "correct", seeded_hash(seed, key).alias("_h"),
        confidence("normalized_scores").alias("conf_normalized"), confidence("absolute_scores").alias("conf_absolute"),
    )
    marked = mark_all(materialize(narrow, "sweep"), test_fraction, seed, ("shots_set",))
    keys = ["shots_set", "split_type"]
    return merge_sides(analyse(marked, [*keys, "split"]), "split", ["train", "test"], keys)


# ---- per-task tables ---------------------------------------------------------


def task_performance(df: DataFrame, p: str, label: str = "correct") -> DataFrame:
    """Assessor quality per task beside the subject's confidence; single-row tasks are left out.

    AUROCs are NULL where only one class occurs.
    """
    systems = {"": p, "lm_": "conf_normalized"}
    table = score_systems(df, systems, ["task"], ["roc_auc", "brier_score", "accuracy"], label, counts=True)
    null_if_nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    rate = F.col("pos") / F.col("n")
    return table.where("n > 1").select(
        "task", "bs", F.col("bs_mcb").alias("mcb"), F.col("bs_dsc").alias("dsc"), F.col("bs_unc").alias("unc"),
        null_if_nan("roc_auc"), null_if_nan("lm_roc_auc"), rate.alias("task_accuracy"), "accuracy", F.col("n").alias("count"),
        (F.col("accuracy") - F.greatest(rate, 1 - rate)).alias("acc_improvement"),
    )


def quantification(test: DataFrame, train: DataFrame, predictors: dict[str, str], label: str = "correct") -> DataFrame:
    """How well mean predictions give the task accuracy: mean absolute and squared error over tasks.

    ``predictors`` maps a name to a column of ``test``; the name ``mean`` is the
    global mean label of ``train``.
    """
    means = test.groupBy("task").agg(
        F.avg(F.col(label).cast("double")).alias("_truth"), *[F.avg(c).alias(f"_{n}") for n, c in predictors.items()]
    )
    overall = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    names = [*predictors, "mean"]
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{n}").alias("value")) for n in names])
    errors = means.withColumn("_mean", overall).select("_truth", F.explode(entries).alias("e"))
    gap = F.col("_truth") - F.col("e.value")
    return errors.groupBy(F.col("e.name").alias("name")).agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("me"))


def accuracy_table(df: DataFrame) -> DataFrame:
    """Accuracy by (task, model, shots) beside chance, absolute and relative gain."""
    table = df.groupBy("task", "model_name", "shots").agg(
        F.avg(F.col("correct").cast("double")).alias("acc"),
        mean_chance().alias("random_acc"),
        F.avg("n_targets").alias("n_targets"),
    )
    gain = F.col("acc") - F.col("random_acc")
    return table.withColumn("rel_acc_improvement", F.try_divide(gain, 1 - F.col("random_acc"))).withColumn(
        "acc_improvement", gain
    )


def accuracy_slice(df: DataFrame, model_name: str, shots: int) -> DataFrame:
    """One model and number of shots of the accuracy table, best task first."""
    one = accuracy_table(df.where((F.col("model_name") == model_name) & (F.col("shots") == shots)))
    return one.orderBy(F.desc("acc"), "task")


def scaling_table(df: DataFrame, by_shots: bool = False) -> DataFrame:
    """Accuracy, targets, parameters and log-mean-exp likelihoods by (task, model[, shots])."""
    keys = ["task", "model_name"] + (["shots"] if by_shots else [])
    parameters = lookup("model_name", MODEL_PARAMETERS).cast("double")
    return correct_target_likelihoods(df).groupBy(*keys).agg(
        F.avg(F.col("correct").cast("double")).alias("correct"),
        F.avg("n_targets").alias("n_targets"),
        F.avg(parameters).alias("parameters"),
        log_mean_exp("target_likelihood_normalized").alias("target_likelihood_normalized"),
        log_mean_exp("target_likelihood_absolute").alias("target_likelihood_absolute"),
    )


def accuracy_bounds(df: DataFrame) -> DataFrame:
    """Observed accuracy per (task, model) between the bounds its likelihood sets."""
    table = scaling_table(df)
    targets = df.groupBy("task").agg(F.avg("n_targets").alias("task_n_targets"))
    likelihood = F.exp("target_likelihood_normalized")
    return join_per_key(table, targets, ["task"]).select(
        "task", "model_name", "parameters", likelihood.alias("likelihood"), "correct",
        worst_accuracy(likelihood).alias("acc_worst"),
        best_accuracy(likelihood, F.col("task_n_targets")).alias("acc_best"),
    )
