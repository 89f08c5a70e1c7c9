"""Baselines next to an assessor: task averages and the subject's own confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.metrics import binary
from evalframe.runtime import join_null_safe, materialize

CELL = ["model_family", "model_name", "task"]
BASELINES = ["distribution", "normalized", "absolute"]


def label_cells(df: DataFrame, keys: list[str] | None = None, label: str = "correct") -> DataFrame:
    """Rows and label sums per (keys…, family, name, task), written once.

    Distribution baseline, task accuracy and instance counts all follow from it.
    """
    cells = df.groupBy(*dict.fromkeys([*(keys or []), *CELL])).agg(
        F.count("*").alias("n"), F.count(label).alias("n_labelled"), F.sum(F.col(label).cast("double")).alias("sum_label")
    )
    return materialize(cells, "cells")


def _mean_label(cells: DataFrame, group: list[str], name: str) -> DataFrame:
    return cells.groupBy(*group).agg(F.try_divide(F.sum("sum_label"), F.sum("n_labelled")).alias(name))


def with_distribution_baseline(
    df: DataFrame,
    name: str = "conf_distribution",
    label: str = "correct",
    keys: list[str] | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Mean label per (family, name, task) on each row, within each group of ``keys``.

    The mean is taken over the evaluated rows themselves: an oracle of the
    task's difficulty, not a prediction. Rows without a family, name or task
    are kept: those that lack the same form a cell.
    """
    cells = label_cells(df, keys, label) if cells is None else cells
    group = list(dict.fromkeys([*(keys or []), *CELL]))
    return join_null_safe(df, materialize(_mean_label(cells, group, name), "per-key"), group)


def long_scores(df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per (row, score column): ``system`` names the column, ``p`` holds its value."""
    pairs = F.array(*[F.struct(F.lit(name).alias("system"), F.col(c).cast("double").alias("p")) for name, c in columns.items()])
    return df.select(*keep, F.explode(pairs).alias("_s")).select(*keep, "_s.*")


def score_systems(
    df: DataFrame,
    columns: dict[str, str],
    keys: list[str],
    metrics: list[str],
    label: str = "correct",
    single_class: float = binary.NAN,
    counts: bool = False,
) -> DataFrame:
    """All metrics of several score columns in one job, one wide row per group.

    ``columns`` maps an output prefix to a score column. ``counts`` adds ``n`` and ``pos`` to each.
    """
    rows = long_scores(df, columns, [*keys, label])
    table = binary.scores(rows, label, "p", [*keys, "system"], metrics, single_class, counts)
    names = binary.metric_columns(metrics) + (["n", "pos"] if counts else [])
    cells = [
        F.max(F.when(F.col("system") == prefix, F.col(m))).alias(f"{prefix}{m}") for prefix in columns for m in names
    ]
    return table.groupBy(*keys).agg(*cells)


def task_accuracy(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Macro average: mean over tasks of the mean label."""
    per_task = _mean_label(cells, list(dict.fromkeys([*keys, "task"])), "_a")
    return per_task.groupBy(*keys).agg(F.avg("_a").alias("task_accuracy"))


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join two reports of the same groups; without keys both are one row."""
    if keys:
        return join_null_safe(left, right, keys)
    columns = {c: right.select(c).scalar() for c in right.columns}
    return left.withColumns(columns)


def baseline_metrics(
    df: DataFrame, keys: list[str] | None = None, metrics: list[str] | None = None, label: str = "correct"
) -> DataFrame:
    """Every metric of the three baselines, prefixed, and the macro task accuracy."""
    keys, metrics = list(keys or []), list(metrics or binary.TEST_METRICS)
    cells = label_cells(df, keys, label)
    rows = with_distribution_baseline(df, label=label, keys=keys, cells=cells)
    prefixes = {f"conf_{b}_": f"conf_{b}" for b in BASELINES}
    return attach(score_systems(rows, prefixes, keys, metrics, label), task_accuracy(cells, keys), keys)
