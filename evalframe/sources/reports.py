"""Metric tables on disk: JSON reports of runs, tracker exports, CSV sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe import schema as S
from evalframe.runtime import join_null_safe, materialize
from evalframe.sources import catalog

BASELINE_PREFIX = "test_conf_"


def per_task_rows(documents: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """``{task: {metric: value}}`` documents → (keys…, task, metrics)."""
    parsed = F.from_json(text, S.METRICS_PER_TASK)
    return documents.select(*keys, F.explode(parsed).alias("task", "metrics"))


def total_rows(documents: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """``{metric: value}`` documents → one row each, named ``total``."""
    return documents.select(*keys, F.lit("total").alias("task"), F.from_json(text, S.METRIC_MAP).alias("metrics"))


def baselines_last(columns: list[str]) -> list[str]:
    """Stable order with the baseline columns at the end."""
    return sorted(columns, key=lambda c: c.startswith(BASELINE_PREFIX))


def widen(rows: DataFrame, metrics: list[str], keys: Sequence[str] = ()) -> DataFrame:
    """The metric map as columns, in the given order, baselines last."""
    return rows.select(
        *keys, "task", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in baselines_last(metrics)]
    )


def drop_contaminated(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("task").isin(catalog.CONTAMINATED_TASKS))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document (whole file) with its path."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


MOST_METRICS = 10_000


def metric_names(rows: DataFrame) -> list[str]:
    """The metric names that occur, the columns of the report; more than ``MOST_METRICS`` raise."""
    names = rows.select(F.explode(F.map_keys("metrics"))).distinct().limit(MOST_METRICS + 1).collect()
    if len(names) > MOST_METRICS:
        raise ValueError(f"more than {MOST_METRICS} metrics: name the ones to load")
    return sorted(r[0] for r in names)


def load_metrics(
    spark: SparkSession,
    directory: str,
    load: Sequence[str] = ("total", "task"),
    metrics: list[str] | None = None,
) -> DataFrame:
    """Per-task rows (less the contaminated tasks) and the total row of one run."""
    parts = []
    if "task" in load:
        parts.append(drop_contaminated(per_task_rows(read_documents(spark, f"{directory}/metrics_per_task.json"))))
    if "total" in load:
        parts.append(total_rows(read_documents(spark, f"{directory}/metrics.json")))
    if not parts:
        raise ValueError("load must name 'task' or 'total'")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return widen(rows, metrics or metric_names(rows))


def keys_from_path(path: Column | str, names: Sequence[str]) -> list[Column]:
    """The last directories above the file, outermost first, as named columns; of ``key=value`` the value."""
    parts = F.split(path, "/")
    value = lambda i: F.regexp_replace(F.element_at(parts, -(len(names) + 1) + i), "^[^=]*=", "")
    return [value(i).alias(n) for i, n in enumerate(names)]


def load_runs(
    spark: SparkSession, pattern: str, names: Sequence[str], metrics: list[str] | None = None
) -> DataFrame:
    """Total rows of many run directories in one scan, keyed by directory names.

    E.g. ``load_runs(spark, "runs/*/*/metrics.json", ["assessor_size", "subject_size"])``.
    """
    return runs_from_documents(read_documents(spark, pattern), names, metrics)


def runs_from_documents(documents: DataFrame, names: Sequence[str], metrics: list[str] | None = None) -> DataFrame:
    """(value, path) metric documents → one row per run, keyed by the directories above the file."""
    rows = total_rows(documents, keys=["path"])
    wide = widen(rows, metrics or metric_names(rows), ["path"])
    return wide.select(*keys_from_path("path", names), *[c for c in wide.columns if c not in ("path", "task")])


def flatten_record(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to columns named by their path."""
    def leaves(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                quoted = ".".join(f"`{p}`" for p in [*path, f.name])
                yield F.col(quoted).alias(sep.join([*path, f.name]))

    return df.select(*leaves(df.schema, []))


# ---- tracker exports ---------------------------------------------------------


def read_tracker_export(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV: one row per step, one column per ``<run> - eval/<metric>`` series."""
    header = spark.read.option("header", True).csv(path)
    series = [c for c in header.columns if " - " in c]
    return header.select("step", *[F.col(f"`{c}`").cast("double").alias(c) for c in series])


def unpivot_series(wide: DataFrame, step: str = "step") -> DataFrame:
    """(step, series, value) from one column per series, missing cells left out."""
    names = [c for c in wide.columns if c != step]
    long = wide.select(F.col(step).cast("bigint").alias("step"), *[F.col(f"`{c}`") for c in names]).unpivot(
        "step", [F.col(f"`{c}`") for c in names], "series", "value"
    )
    return long.where("value is not null")


def parse_series(long: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    """Split ``<run> - eval/<metric>`` into the run's keys and the metric; other series are left out.

    ``pattern`` is a regex on the run name with one group per key.
    """
    run, metric = F.split_part("series", F.lit(" - eval/"), F.lit(1)), F.split_part("series", F.lit(" - eval/"), F.lit(2))
    named = long.withColumns({"_run": run, "metric": metric}).where(F.col("_run").rlike(pattern) & (F.col("metric") != ""))
    extracted = {k: F.regexp_extract("_run", pattern, i + 1) for i, k in enumerate(keys)}
    return named.withColumns(extracted).select(*keys, "metric", "step", "value")


def values_at_minimal_loss(long: DataFrame, keys: list[str], loss: str = "loss") -> DataFrame:
    """Long (value, keys…, metric): each metric at its run's step of minimal loss."""
    at = F.min(F.struct(F.col("value").alias("v"), F.col("step").alias("s"))).alias("_b")
    steps = long.where(F.col("metric") == loss).groupBy(*keys).agg(at).select(*keys, F.col("_b.s").alias("step"))
    return long.join(steps, [*keys, "step"]).select("value", *keys, "metric", "step")


# ---- sinks --------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("errorifexists").csv(path)


def write_text_and_label(samples: DataFrame, path: str) -> None:
    """CSV of (text, integer label) with a header."""
    write_csv(samples.select(F.col("input").alias("text"), F.col("correct").cast("int").alias("target")), path)


ROWS_PER_FILE = 1_000_000


def write_sized(df: DataFrame, path: str, keys: list[str], target_rows: int = ROWS_PER_FILE) -> None:
    """Parquet with a folder per value of ``keys``, in files of about ``target_rows``, and a manifest of rows per key.

    Rows are counted per key first; a key gets ceil(rows / target) files whatever the number of tasks, and a
    key that holds much of the table is written by as many tasks as it has files. No file has more than
    twice the target, also where rows repeat. The manifest is written last: a folder without one is not complete.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_files", F.ceil(F.col("n") / target_rows))
    counts = materialize(counts, "files-per-key")
    files = counts.agg(F.coalesce(F.sum("_files"), F.lit(1))).first()[0]
    spread = join_null_safe(df, counts.select(*keys, "_files"), keys)
    spread = spread.withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.col("_files"))).drop("_files")
    spread.repartition(max(1, files), *keys, "_file").write.option("maxRecordsPerFile", 2 * target_rows).partitionBy(*keys, "_file").parquet(path)
    counts.drop("_files").write.parquet(f"{path}_manifest")


def read_sized(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What ``write_sized`` wrote; raises if a key has another number of rows than the manifest says."""
    rows, manifest = spark.read.parquet(path), spark.read.parquet(f"{path}_manifest")
    rows = rows.drop("_file").withColumns({k: F.col(k).cast(manifest.schema[k].dataType) for k in keys})  # folder names lose the type
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    wrong = manifest.select(*keys, "n").exceptAll(found).unionByName(found.exceptAll(manifest.select(*keys, "n"))).limit(3).collect()
    if wrong:
        raise ValueError(f"{path} does not hold what its manifest says: {wrong}")
    return rows


def write_results(metrics: DataFrame, predictions: DataFrame, path: str, per_task: bool = False, target_rows: int = ROWS_PER_FILE) -> None:
    """Metrics as JSON, predictions as parquet; per task both have a folder per task, the predictions in sized files."""
    if not per_task:
        metrics.write.json(f"{path}/metrics")
        predictions.write.parquet(f"{path}/predictions")
        return
    metrics.repartition(F.col("task")).write.partitionBy("task").json(f"{path}/metrics_per_task")
    write_sized(predictions, f"{path}/predictions_per_task", ["task"], target_rows)
