"""De-duplication of query types, cleaning, and removal of tasks that are too hard.

All decisions derive from one small table, the performance cube: one pass over
the samples gives counts and label sums by (task, query type, model); best
model, duplicate query types and bad tasks are read off it.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe import schema as S
from evalframe.functions.features import augment, prepend_features
from evalframe.operators.quantiles import exact_quantiles
from evalframe.runtime import join_null_safe, join_per_key, materialize
from evalframe.sources.catalog import REFERENCE_MODEL_SIZE

log = logging.getLogger(__name__)

MODEL = ["model_name", "model_family"]
THRESHOLD = 0.05


def performance_cube(df: DataFrame) -> DataFrame:
    """Counts and sums by (task, query_type, model_name, model_family), written once."""
    sums = [F.count("*").alias("n"), F.count("correct").alias("n_labelled"), F.sum("correct").alias("sum_correct")]
    if "n_targets" in df.columns:
        sums.append(F.sum("n_targets").alias("sum_n_targets"))
    return materialize(df.groupBy("task", "query_type", *MODEL).agg(*sums), "cube")


def best_model(cube: DataFrame) -> DataFrame:
    """The model with the highest mean label over everything; ties: first in key order."""
    mean = F.sum("sum_correct") / F.sum("n_labelled")
    return (
        cube.groupBy(*MODEL)
        .agg(F.try_divide(F.sum("sum_correct"), F.sum("n_labelled")).alias("mean_correct"))
        .where("mean_correct is not null")
        .orderBy(F.desc("mean_correct"), *MODEL)
        .limit(1)
    )


def check_models(cube: DataFrame, reference_size: str = REFERENCE_MODEL_SIZE) -> int:
    """Number of models; raises without the reference size, warns about several models."""
    seen = cube.agg(
        F.countDistinct(F.struct(*MODEL)).alias("models"),
        F.coalesce(F.bool_or(F.col("model_name") == reference_size), F.lit(False)).alias("has_reference"),
    ).first()
    if seen["models"] > 1:
        log.warning("Data contains multiple models; decisions follow the best one.")
    if not seen["has_reference"]:
        raise ValueError(f"no rows of the reference size {reference_size}; name another one")
    return seen["models"]


def best_model_scores(cube: DataFrame) -> DataFrame:
    """Per (task, query_type) of the best model: rows and mean label (and mean n_targets)."""
    best = cube.join(best_model(cube).select(*MODEL), MODEL, "left_semi")
    means = [
        F.sum("n").alias("n"),
        F.try_divide(F.sum("sum_correct"), F.sum("n_labelled")).alias("mean_correct"),
    ]
    if "sum_n_targets" in cube.columns:
        means.append((F.sum("sum_n_targets") / F.sum("n")).alias("mean_n_targets"))
    return best.groupBy("task", "query_type").agg(*means)


def tasks_with_both(scores: DataFrame) -> DataFrame:
    """Tasks with two query types for the best model; more than two is an error."""
    per_task = scores.groupBy("task").agg(F.countDistinct("query_type").alias("n_types"))
    checked = F.when(F.col("n_types") <= 2, F.col("n_types")).otherwise(
        F.raise_error(F.lit("a task has three query types or more"))
    )
    return per_task.withColumn("n_types", checked.cast("bigint")).where("n_types = 2")


def type_to_keep(choice_mean: Column, paired_mean: Column, threshold: float = THRESHOLD) -> Column:
    """Prefer the paired form unless only the choice form clears the threshold."""
    return (
        F.when(
            (choice_mean < threshold) & (paired_mean < threshold),
            F.when(paired_mean > choice_mean, F.lit(S.PAIRED)).otherwise(F.lit(S.MULTIPLE_CHOICE)),
        )
        .when(paired_mean < threshold, F.lit(S.MULTIPLE_CHOICE))
        .otherwise(F.lit(S.PAIRED))
    )


def query_type_decisions(cube: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each task with both types: (task, keep, drop)."""
    scores = best_model_scores(cube)
    both = scores.join(tasks_with_both(scores).select("task"), "task", "left_semi")
    mean_of = lambda kind: F.max(F.when(F.col("query_type") == kind, F.col("mean_correct")))
    means = both.groupBy("task").agg(
        mean_of(S.MULTIPLE_CHOICE).alias("choice_mean"), mean_of(S.PAIRED).alias("paired_mean")
    )
    keep = type_to_keep(F.col("choice_mean"), F.col("paired_mean"), threshold)
    drop = F.when(F.col("keep") == S.PAIRED, S.MULTIPLE_CHOICE).otherwise(S.PAIRED)
    return means.withColumn("keep", keep).withColumn("drop", drop)


def _require_one_type(cube: DataFrame) -> None:
    kinds = cube.groupBy("task").agg(F.countDistinct("query_type").alias("k"))
    if not kinds.where("k > 1").limit(1).isEmpty():
        raise AssertionError("a task is left with several query types")


def remove_duplicate_queries(
    df: DataFrame, threshold: float = THRESHOLD, reference_size: str = REFERENCE_MODEL_SIZE
) -> DataFrame:
    """Keep one query type per task, for all models, as decided on the best model."""
    cube = performance_cube(df)
    check_models(cube, reference_size)
    dropped = materialize(query_type_decisions(cube, threshold).select("task", F.col("drop").alias("query_type")), "drop")
    keys = ["task", "query_type"]
    _require_one_type(cube.join(dropped, keys, "left_anti"))
    return df.join(dropped, keys, "left_anti")


def binary_label(column: str = "correct") -> Column:
    """True for labels 0 and 1; NULL, NaN and fractions are not labels."""
    return F.coalesce(F.col(column).isin(0.0, 1.0), F.lit(False))


def binarize(df: DataFrame, observation=None) -> DataFrame:
    """Drop rows without a binary label and make the label an int.

    Pass a ``pyspark.sql.Observation`` to learn the number of dropped rows as a
    by-product of whatever action runs.
    """
    if observation is not None:
        df = df.observe(observation, F.count(F.when(~binary_label(), 1)).alias("n_nonbinary"))
    return df.where(binary_label()).withColumn("correct", F.col("correct").cast("int"))


def clean(df: DataFrame, legacy_noop: bool = False) -> DataFrame:
    """Drop multiple-choice samples with a single target.

    ``legacy_noop`` reproduces a tag mismatch under which nothing is dropped.
    """
    if legacy_noop:
        return df
    single = (F.col("query_type") == S.MULTIPLE_CHOICE) & (F.col("n_targets") == 1)
    return df.where(~F.coalesce(single, F.lit(False)))


def bad_tasks(cube: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Tasks the best model fails at, with the query type that shows it.

    Multiple choice: mean label below 1 / (mean number of targets) + threshold;
    paired: below the threshold.
    """
    scores = best_model_scores(cube)
    limit = F.when(F.col("query_type") == S.MULTIPLE_CHOICE, 1 / F.col("mean_n_targets") + threshold).when(
        F.col("query_type") == S.PAIRED, F.lit(threshold)
    )
    return scores.withColumn("minimum", limit).where(F.col("mean_correct") < F.col("minimum"))


def remove_bad_tasks(
    df: DataFrame, threshold: float = THRESHOLD, reference_size: str = REFERENCE_MODEL_SIZE
) -> DataFrame:
    cube = performance_cube(df)
    check_models(cube, reference_size)
    return join_per_key(df, bad_tasks(cube, threshold).select("task").distinct(), ["task"], "left_anti")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_columns(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group…, column, count, mean, std, min, q25, q50, q75, max) of each numeric column, NULLs left out.

    Quartiles are exact, by ``exact_quantiles``: no buffer of a group's values.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*group, F.explode(cells).alias("c")).select(*group, "c.*").where("x is not null")
    keys = [*group, "column"]
    plain = long.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    quartiles = exact_quantiles(long, keys, "x", list(QUARTILES.values()))
    cells = [F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for name, p in QUARTILES.items()]
    table = join_null_safe(plain, quartiles.groupBy(*keys).agg(*cells), keys)
    return table.select(*keys, "count", "mean", "std", "min", *QUARTILES, "max")


def describe(df: DataFrame, group: list[str], column: str = "correct") -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of one column per group."""
    return describe_columns(df, group, [column]).drop("column")


def at_least(df: DataFrame, minimum: int, column: str = "instance_count", strict: bool = False) -> DataFrame:
    """Keep groups with enough instances (>=, or > with ``strict``)."""
    return df.where(F.col(column) > minimum if strict else F.col(column) >= minimum)


def wrangle(
    df: DataFrame,
    include_model: bool = False,
    include_n_targets: bool = False,
    filter_bad_tasks: bool = False,
) -> DataFrame:
    """binarize → augment → clean → [bad tasks] → prepend features."""
    df = df.transform(binarize).transform(augment).transform(clean)
    if filter_bad_tasks:
        df = remove_bad_tasks(df)
    return prepend_features(df, include_model, include_n_targets)


def prepare(
    df: DataFrame,
    include_model: bool = False,
    include_n_targets: bool = False,
    filter_bad_tasks: bool = False,
    reference_size: str = REFERENCE_MODEL_SIZE,
) -> DataFrame:
    """``remove_duplicate_queries`` and ``wrangle`` with two passes over the samples.

    The first pass takes the sums both decisions need (all labels, and the
    labels that survive binarize and clean); the second keeps the (task, query
    type) pairs decided on.
    """
    usable = binary_label() & ((F.col("query_type") != S.MULTIPLE_CHOICE) | (F.size("targets") != 1))
    cube = df.groupBy("task", "query_type", *MODEL).agg(
        F.count("*").alias("n"),
        F.count("correct").alias("n_labelled"),
        F.sum("correct").alias("sum_correct"),
        F.count_if(usable).alias("n_usable"),
        F.sum(F.when(usable, F.col("correct"))).alias("sum_usable"),
        F.sum(F.when(usable, F.size("targets"))).alias("sum_n_targets"),
    )
    cube = materialize(cube, "cube")
    check_models(cube, reference_size)
    duplicates = query_type_decisions(cube.drop("sum_n_targets")).select("task", F.col("drop").alias("query_type"))
    kept = materialize(cube.join(duplicates, ["task", "query_type"], "left_anti"), "kept")
    _require_one_type(kept)
    pairs = kept.select("task", "query_type").distinct()
    if filter_bad_tasks:
        usable_cube = kept.where("n_usable > 0").select(
            "task", "query_type", *MODEL, F.col("n_usable").alias("n"), F.col("n_usable").alias("n_labelled"),
            F.col("sum_usable").alias("sum_correct"), "sum_n_targets",
        )
        check_models(usable_cube, reference_size)
        pairs = pairs.join(bad_tasks(usable_cube).select("task"), "task", "left_anti")
    rows = join_per_key(df, pairs, ["task", "query_type"], "left_semi")
    rows = rows.transform(binarize).transform(augment).transform(clean)
    return prepend_features(rows, include_model, include_n_targets)
