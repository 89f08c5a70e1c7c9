"""Result files: one nested JSON document per (task, model), and the views on them.

Filters on task and model act on the file path, so Spark prunes files before
opening them; filters on queries act on the array, before it is expanded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe import schema as S
from evalframe.sources import catalog


@dataclass(frozen=True)
class LogFilter:
    """Which tasks, models and queries to read. ``None`` means no restriction."""

    tasks: str | list[str] | None = None
    model_families: list[str] | None = None
    model_sizes: list[str] | None = None
    query_types: list[str] | None = None
    query_functions: list[str] | None = None
    shots: list[int] | None = None
    include_unknown_shots: bool = False
    exclude_faulty_tasks: bool = True
    include_queries: bool = True

    def __post_init__(self):
        unknown = set(self.query_types or []) - set(S.QUERY_TYPES)
        if unknown:
            raise ValueError(f"Unknown query types: {sorted(unknown)}")


# ---- keys from the path -------------------------------------------------


def model_from_stem(stem: Column) -> tuple[Column, Column]:
    """``x_<family>_<size>[_<rest>…]`` → (family with the rest appended by blanks, size)."""
    parts = F.split(stem, "_")
    rest = F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)))
    return F.concat_ws(" ", F.get(parts, F.lit(1)), rest), F.get(parts, F.lit(2))


ENDING = r"\.json(\.gz)?$"  # packed or not


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), ENDING, "")


def model_from_path(path: Column) -> tuple[Column, Column]:
    return model_from_stem(stem_of(path))


def task_from_path(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


# ---- filters ------------------------------------------------------------


def filter_tasks(df: DataFrame, tasks, exclude_faulty: bool = True, column: str = "task") -> DataFrame:
    """Keep the tasks of a list (by name or explicit), less the faulty ones."""
    task = F.col(column)
    if tasks is None:
        dropped = catalog.NOT_IN_FULL_LIST + (catalog.FAULTY_TASKS if exclude_faulty else [])
        return df.where(~task.isin(dropped))
    return df.where(task.isin(catalog.resolve_tasks(tasks, exclude_faulty=exclude_faulty)))


def exclude_faulty(df: DataFrame, column: str = "task") -> DataFrame:
    return df.where(~F.col(column).isin(catalog.FAULTY_TASKS))


def filter_models(
    df: DataFrame,
    families: list[str] | None,
    sizes: list[str] | None,
    family_column: str = "model_family",
    size_column: str = "model_name",
) -> DataFrame:
    if families is not None:
        df = df.where(F.col(family_column).isin(families))
    if sizes is not None:
        df = df.where(F.col(size_column).isin(sizes))
    return df


def shots_condition(shots: Column, wanted: list[int] | None, include_unknown: bool) -> Column:
    """NULL shots pass only with ``include_unknown``, whatever the list says."""
    known = shots.isNotNull()
    if wanted is not None:
        known = F.coalesce(shots.isin(wanted), F.lit(False))
    return known | shots.isNull() if include_unknown else known


def query_condition(query: Column, spec: LogFilter) -> Column:
    keep = shots_condition(query["shots"], spec.shots, spec.include_unknown_shots)
    if spec.query_types is not None:
        keep = keep & F.coalesce(query["query_type"].isin(spec.query_types), F.lit(False))
    if spec.query_functions is not None:
        keep = keep & F.coalesce(query["function"].isin(spec.query_functions), F.lit(False))
    return keep


def filter_queries(files: DataFrame, spec: LogFilter) -> DataFrame:
    """Filter the query array of each file, before any expansion."""
    return files.withColumn("queries", F.filter("queries", lambda q: query_condition(q, spec)))


def filter_scores(files: DataFrame, shots: list[int] | None, include_unknown: bool = False) -> DataFrame:
    keep = lambda s: shots_condition(s["number_of_shots"], shots, include_unknown)
    return files.withColumn("scores", F.filter("scores", keep))


# ---- scans and views ----------------------------------------------------


def read_result_files(
    spark: SparkSession, logdir: str, spec: LogFilter = LogFilter(), multi_line: bool = True
) -> DataFrame:
    """Scan ``<logdir>/<task>/x_<family>_<size>.json``, packed (``.json.gz``) or not, one row per document.

    Raises when nothing matches. Documents that do not parse fail the job.
    """
    tasks = spec.tasks
    listed = tasks is not None
    directories = "*"
    if listed:
        names = catalog.resolve_tasks(tasks, exclude_faulty=spec.exclude_faulty_tasks)
        if not names:
            raise ValueError("the list names no task to read")
        directories = "{" + ",".join(names) + "}"
    shape = S.RAW_FILE if spec.include_queries else S.RAW_FILE_HEADER
    raw = (
        spark.read.schema(shape)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .json(f"{logdir.rstrip('/')}/{directories}/*.{{json,json.gz}}")
    )
    path = F.col("_metadata.file_path")
    family, size = model_from_stem(F.regexp_replace(F.col("_metadata.file_name"), ENDING, ""))
    files = raw.select("*", path.alias("path"), task_from_path(path).alias("_dir"), family.alias("_f"), size.alias("_s"))
    if not listed:
        files = filter_tasks(files, None, spec.exclude_faulty_tasks, "_dir")
    files = filter_models(files, spec.model_families, spec.model_sizes, "_f", "_s").drop("_dir", "_f", "_s")
    files = files.select(
        "path",
        F.col("task.task_name").alias("task"),
        F.col("model.model_family").alias("model_family"),
        F.col("model.model_name").alias("model_name"),
        F.col("model.flop_matched_non_embedding_params").alias("parameters"),
        *[c for c in ("queries", "scores") if c in raw.columns],
    )
    return filter_queries(files, spec) if spec.include_queries else files


FILE_KEYS = ["task", "model_family", "model_name"]


def files_per_task(files: DataFrame) -> DataFrame:
    """Per task, a map from model to the header of its file (bounded by the number of models)."""
    header = F.struct(F.size("queries").alias("n_queries"), F.size("scores").alias("n_scores"))
    model = F.concat_ws("/", "model_family", "model_name")
    return files.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct(model, header))).alias("models"))


def queries_of(files: DataFrame) -> DataFrame:
    """One row per query, in file order.

    What is expanded is an expression: for a bare column Spark infers a filter on its size, and where
    the column is computed, the filter computes it once more. It leaves the queries as they are, so that
    their samples are not copied.
    """
    columns = ["query_type", "function", "shots"]
    empty = F.array().cast(files.schema["queries"].dataType)
    rows = files.select(*FILE_KEYS, F.posexplode(F.coalesce("queries", empty)).alias("query_idx", "q"))
    fields = [F.col(f"q.{c}").alias(c) for c in columns]
    return rows.select(*FILE_KEYS, "query_idx", *fields, F.size("q.samples").alias("n_samples"), F.col("q.samples").alias("samples"))


def samples_of(queries: DataFrame) -> DataFrame:
    """One row per sample, in query order."""
    keys = [*FILE_KEYS, "query_idx", "query_type", "function", "shots"]
    return queries.select(*keys, F.posexplode("samples").alias("sample_idx", "s")).select(*keys, "sample_idx", "s.*")


def score_records_of(files: DataFrame) -> DataFrame:
    return files.select(*FILE_KEYS, F.posexplode("scores").alias("score_idx", "r")).select(
        *FILE_KEYS, "score_idx", "r.*"
    )


# ---- samples kept by model ------------------------------------------------


def write_by_model(samples: DataFrame, path: str) -> None:
    """Parquet with a folder per model family and size: conditions on either choose folders."""
    samples.write.partitionBy("model_family", "model_name").parquet(path)


def read_by_model(
    spark: SparkSession, path: str, families: list[str] | None = None, sizes: list[str] | None = None
) -> DataFrame:
    """The samples of some models; the folders of all others are not listed as input."""
    return filter_models(spark.read.parquet(path), families, sizes)


def of_models(samples: DataFrame, models: DataFrame) -> DataFrame:
    """The samples of the models that a query chose: ``models`` has (model_family, model_name).

    Where ``samples`` are kept by model and ``models`` is small, Spark reads the folders chosen at run time.
    """
    return samples.join(models.select("model_family", "model_name").distinct(), ["model_family", "model_name"])
