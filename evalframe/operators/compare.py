"""Comparison of metric tables: differences, alignments, rankings, task sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.features import mean_chance, report_label
from evalframe.metrics.correlation import pearson
from evalframe.metrics.report import tasks_and_total
from evalframe.operators.quality import at_least
from evalframe.runtime import materialize, seeded_hash
from evalframe.sources.catalog import ASSESSOR_SIZES, MODEL_SIZES

TOTAL = "total"


def _exists(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def _aligned(
    a: DataFrame,
    b: DataFrame,
    names: tuple[str, str],
    minuend: int,
    thresholds: tuple[float | None, float | None],
    sort: str,
    direction: str,
) -> DataFrame:
    """Two (task, value) series side by side where both have a value, ``total`` last."""
    x, y = names
    if sort not in ("name", x, y, "diff"):
        raise ValueError(f"sort is 'name', 'diff' or one of {names}, not {sort!r}")
    left = a.select("task", F.col(a.columns[-1]).alias(x))
    data = left.join(b.select("task", F.col(b.columns[-1]).alias(y)), "task").where(_exists(x) & _exists(y))
    diff = F.col(x) - F.col(y) if minuend == 0 else F.col(y) - F.col(x)
    data = data.withColumn("diff", diff)
    for name, threshold in zip(names, thresholds):
        if threshold is not None:
            data = data.where(F.col(name) > threshold)
    key = "task" if sort == "name" else sort
    ordered = F.asc(key) if direction == "asc" else F.desc(key)
    return data.orderBy(F.col("task") == TOTAL, ordered, "task")


def series(table: DataFrame, metric: str) -> DataFrame:
    return table.select("task", metric)


def difference(
    sys1: DataFrame,
    sys2: DataFrame,
    sys1_threshold: float | None = None,
    sys2_threshold: float | None = None,
    sort: str = "name",
    sort_direction: str = "asc",
) -> DataFrame:
    """(task, sys1, sys2, diff = sys2 - sys1) with the row label ``task (sys1)``."""
    data = _aligned(sys1, sys2, ("sys1", "sys2"), 1, (sys1_threshold, sys2_threshold), sort, sort_direction)
    return data.withColumn("label", report_label(F.col("task"), F.col("sys1")))


def absolute(
    results: DataFrame,
    reference: DataFrame,
    results_threshold: float | None = None,
    reference_threshold: float | None = None,
    sort: str = "name",
    sort_direction: str = "asc",
    marker: float | None = None,
) -> DataFrame:
    """(task, results, reference, diff = results - reference) with the label ``task (reference)``."""
    names, thresholds = ("results", "reference"), (results_threshold, reference_threshold)
    data = _aligned(results, reference, names, 0, thresholds, sort, sort_direction)
    data = data.withColumn("label", report_label(F.col("task"), F.col("reference")))
    return data if marker is None else data.withColumn("above_marker", F.col("results") > marker)


# ---- the standard reports -----------------------------------------------------

MINIMUM_INSTANCES = 100


def report_in_distribution(results: DataFrame) -> dict[str, DataFrame]:
    kept = at_least(results, MINIMUM_INSTANCES)
    return {
        "auroc": difference(
            series(kept, "test_conf_normalized_roc_auc"), series(kept, "test_roc_auc"), sys1_threshold=0.1, sort="diff"
        ),
        "mcb": absolute(
            series(kept, "test_bs_mcb"), series(kept, "test_conf_normalized_bs_mcb"), sort="results", sort_direction="desc"
        ),
    }


def report_out_of_distribution(results: DataFrame) -> dict[str, DataFrame]:
    kept = at_least(results, MINIMUM_INSTANCES)
    return {
        "auroc": absolute(
            series(kept, "test_conf_normalized_roc_auc"), series(kept, "test_roc_auc"),
            reference_threshold=0.1, sort="results", marker=0.5,
        ),
        "mcb": absolute(
            series(kept, "test_bs_mcb"), series(kept, "test_conf_normalized_bs_mcb"), sort="results", sort_direction="desc"
        ),
    }


def tag_tasks(table: DataFrame, suffix: str) -> DataFrame:
    return table.withColumn("task", F.concat("task", F.lit(suffix)))


def align_subjects(assessors: DataFrame, subjects: DataFrame, metric: str = "test_roc_auc", minimum: int = 30) -> DataFrame:
    """(task, assessors, subjects) where both have the metric and enough instances."""
    a = at_least(assessors, minimum).select("task", F.col(metric).alias("assessors"))
    s = at_least(subjects, minimum).select("task", F.col(metric).alias("subjects"))
    return a.join(s, "task").where(_exists("assessors") & _exists("subjects"))


def report_correlation(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Aligned rows of several (assessors, subjects) pairs, tasks tagged, and their Pearson correlation."""
    tagged = [align_subjects(tag_tasks(a, suffix), tag_tasks(s, suffix)) for suffix, (a, s) in pairs.items()]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    return rows, pearson(rows, "subjects", "assessors")


def report_multitask(multi: DataFrame, single: DataFrame) -> dict[str, DataFrame]:
    multi, single = at_least(multi, MINIMUM_INSTANCES), at_least(single, MINIMUM_INSTANCES)
    return {
        "auroc": difference(series(multi, "test_roc_auc"), series(single, "test_roc_auc"), sort="diff"),
        "mcb": absolute(
            series(multi, "test_bs_mcb"), series(single, "test_bs_mcb"), sort="results", sort_direction="desc"
        ),
    }


def report_population(reference: DataFrame, largest: DataFrame, finetuned: DataFrame) -> dict[str, DataFrame]:
    reference = at_least(reference, MINIMUM_INSTANCES)
    tables = {}
    for name, table in (("largest", largest), ("finetuned", finetuned)):
        other = at_least(table, MINIMUM_INSTANCES)
        tables[f"auroc_{name}"] = difference(series(reference, "test_roc_auc"), series(other, "test_roc_auc"), sort="diff")
        tables[f"mcb_{name}"] = difference(
            series(reference, "test_bs_mcb"), series(other, "test_bs_mcb"), sort="diff", sort_direction="desc"
        )
    return tables


def position_in(column: str, order: list[str]) -> Column:
    """Rank of a value in a fixed list; NULL (sorted first) when not listed."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return F.when(position > 0, position - 1)


def report_scaling(runs: DataFrame, metric: str) -> DataFrame:
    """Metric by (assessor_size, subject_size), in order of size."""
    return runs.select("assessor_size", "subject_size", F.col(metric).alias("metric")).orderBy(
        position_in("assessor_size", ASSESSOR_SIZES), position_in("subject_size", MODEL_SIZES)
    )


def report_shots(runs: DataFrame, metric: str) -> DataFrame:
    """Metric by (truncation_side, shots) beside the share of long sequences for that many shots."""
    share = F.avg("n_long_sequences").over(Window.partitionBy("shots"))  # one row per run: a handful
    lines = runs.select("truncation_side", "shots", F.col(metric).alias("metric"), share.alias("long_share"))
    return lines.orderBy("truncation_side", "shots")


# ---- alignment and merging ------------------------------------------------------


def align(a: DataFrame, b: DataFrame, minimum: int = 100, auroc: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Both tables restricted to usable tasks they share, sorted by task."""
    usable = lambda t: at_least(t, minimum, strict=True).where(F.col("test_conf_normalized_roc_auc") > auroc)
    a, b = usable(a), usable(b)
    semi = lambda x, y: x.join(y.select("task"), "task", "left_semi").orderBy("task")
    return semi(a, b), semi(b, a)


def require_same_tasks(a: DataFrame, b: DataFrame) -> None:
    tasks = lambda t: t.select("task").distinct()
    if not tasks(a).exceptAll(tasks(b)).unionAll(tasks(b).exceptAll(tasks(a))).limit(1).isEmpty():
        raise AssertionError("The tables cover different tasks.")


def override_baselines(df: DataFrame, reference: DataFrame, prefix: str = "test_conf_") -> DataFrame:
    """Take the baseline columns from a reference run of the same tasks."""
    columns = [c for c in reference.columns if c.startswith(prefix)]
    return df.drop(*columns).join(reference.select("task", *columns), "task")


def accuracy_over_random(df: DataFrame, total: str = "_total") -> DataFrame:
    """Per task and overall: accuracy minus the chance of guessing."""
    gain = F.avg(F.col("correct").cast("double")) - mean_chance()
    return tasks_and_total(df, gain.alias("acc_diff"), total=total)


def with_accuracy_over_random(report: DataFrame, gains: DataFrame) -> DataFrame:
    """A report with the gain over guessing of each task, also as a signed percentage."""
    percent = F.col("acc_diff") * 100
    sign = F.when(percent < 0, "-").otherwise("+")
    whole = F.format_number(F.abs(percent), 0)
    return report.join(gains, "task").withColumn("gain", F.concat(sign, whole, F.lit("%")))


def merge_reports(a: DataFrame, b: DataFrame, suffixes: tuple[str, str], count: str = "instance_count") -> DataFrame:
    """Inner join on task; shared columns get suffixes, and the counts must agree."""
    shared = [c for c in a.columns if c in b.columns and c != "task"]
    rename = lambda t, s: t.withColumnsRenamed({c: f"{c}{s}" for c in shared})
    joined = rename(a, suffixes[0]).join(rename(b, suffixes[1]), "task")
    if count not in shared:
        return joined
    one, two = f"{count}{suffixes[0]}", f"{count}{suffixes[1]}"
    checked = F.when(F.col(one).eqNullSafe(F.col(two)), F.col(one)).otherwise(
        F.raise_error(F.concat(F.lit("Instance counts differ for task "), F.col("task")))
    )
    return joined.withColumn(one, checked)


def at_minimal_loss(long: DataFrame, keys: list[str], loss: str = "loss", step: str = "step", value: str = "value") -> DataFrame:
    """Per series, the value at the step of minimal loss (earliest step on ties)."""
    best = F.min(F.struct(F.col(loss), F.col(step), F.col(value)))
    return long.where(F.col(loss).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col(f"_b.{step}").alias(step), F.col(f"_b.{value}").alias(value)
    )


def top_tasks(table: DataFrame, metric: str, k: int = 5) -> DataFrame:
    return table.orderBy(F.desc(metric), "task").limit(k)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded_hash(seed, F.col(key).cast("string")), key).limit(n)


# ---- task sets -----------------------------------------------------------------

TASK_SETS = ["multiple_choice", "generative", "scoring", "mixed"]


def task_types(queries: DataFrame) -> DataFrame:
    """(task, type) with type ``mixed`` added for tasks of several types."""
    pairs = queries.select("task", F.col("query_type").alias("type")).distinct()
    mixed = pairs.groupBy("task").agg(F.count("*").alias("_k")).where("_k > 1").select("task", F.lit("mixed").alias("type"))
    return pairs.unionByName(mixed)


def task_type_counts(types: DataFrame) -> DataFrame:
    return types.groupBy("type").agg(F.count("*").alias("n_tasks"))


def task_set(types: DataFrame, name: str) -> DataFrame:
    return types.where(F.col("type") == name).select("task")


def task_set_algebra(types: DataFrame) -> DataFrame:
    """(set, task) for the differences, intersections and unions of the task sets.

    The (small) table of types is written once, as every set reads it.
    """
    types = materialize(types, "types")
    sets = {name: task_set(types, name) for name in TASK_SETS}
    choice, generative, scoring, mixed = (sets[n] for n in TASK_SETS)
    generative_non_mpc = generative.subtract(choice)
    scoring_non_mpc = scoring.subtract(choice)
    mpc_only = choice.subtract(mixed)
    shared = generative_non_mpc.intersect(scoring_non_mpc)
    combined = {
        "generative_non_mpc": generative_non_mpc,
        "generative_non_scoring": generative.subtract(scoring),
        "generative_only": generative.subtract(mixed),
        "scoring_non_generative": scoring.subtract(generative),
        "scoring_non_mpc": scoring_non_mpc,
        "scoring_only": scoring.subtract(mixed),
        "mpc_only": mpc_only,
        "all_tasks": choice.union(generative).union(scoring).distinct(),
        "open_ended": shared,
        "open_ended_or_mpc_only": shared.union(mpc_only).distinct(),
    }
    rows = None
    for name, tasks in combined.items():
        part = tasks.select(F.lit(name).alias("set"), "task")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def preferred_metrics(records: DataFrame) -> DataFrame:
    """Number of tasks per preferred metric, most frequent first."""
    return (
        records.select("task", F.col("preferred_score").alias("metric")).distinct()
        .groupBy("metric").agg(F.count("*").alias("n_tasks")).orderBy(F.desc("n_tasks"), "metric")
    )


def preferred_score_means(records: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Mean preferred score per task, subtask records left out.

    With ``metrics``, only tasks that prefer one of them somewhere.
    """
    if metrics is not None:
        wanted = records.where(F.col("preferred_score").isin(metrics)).select("task").distinct()
        records = records.join(wanted, "task", "left_semi")
    own = records.where(F.col("subtask_description") == F.col("task"))
    return own.groupBy("task").agg(F.avg(F.element_at("score_dict", F.col("preferred_score"))).alias("score"))


def reverse_cumulative(scores: DataFrame, bins: int = 99, column: str = "score") -> DataFrame:
    """For each unit bin from 0: tasks in the bin and tasks at or above it. The last bin is open at the top.

    Scores below 0 and missing ones are left out.
    """
    inside = scores.where(F.col(column) >= 0)
    binned = inside.select(F.least(F.floor(column), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # <= `bins` rows
    return counts.withColumn("n_at_least", F.sum("n").over(above))


def reverse_cumulative_share(scores: DataFrame, bins: int = 99, column: str = "score") -> DataFrame:
    """``reverse_cumulative`` with the share of the counted tasks that are in the bin or above it."""
    curve = reverse_cumulative(scores, bins, column)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # <= `bins` rows
    return curve.withColumn("share_at_least", F.col("n_at_least") / F.max("n_at_least").over(whole))


def count_above(scores: DataFrame, thresholds: list[float], column: str = "score") -> DataFrame:
    limits = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return scores.select(column, limits.alias("threshold")).groupBy("threshold").agg(
        F.count_if(F.col(column) > F.col("threshold")).alias("n_above")
    )


def word_contributions(words: DataFrame, minimum: int = 10) -> DataFrame:
    """Mean contribution and count per word, frequent words only, highest first."""
    return (
        words.groupBy("word")
        .agg(F.avg("contribution").alias("mean_contribution"), F.count("word").alias("word_count"))
        .where(F.col("word_count") >= minimum)
        .orderBy(F.desc("mean_contribution"), "word")
    )


def number_in_text(text: Column, label: str) -> Column:
    """The number after ``<label>: `` in a text, NULL if there is none."""
    found = F.regexp_extract(text, label + r": ([0-9.]+)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def first_of_duplicates(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """Keep the first row (by ``order``) of each combination of ``subset``.

    A min over structs: partial aggregation first, so many copies of one
    combination never meet in one sorted group.
    """
    rest = [c for c in df.columns if c not in subset and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_f")
    return df.groupBy(*subset).agg(first).select(*subset, "_f.*").select(*df.columns)


def value_counts(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("count")).orderBy(F.desc("count"))
