"""Consistency checks of the logs: same samples, same order, same counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.features import lookup
from evalframe.functions.text import same_instance
from evalframe.metrics.report import tasks_and_total
from evalframe.runtime import join_per_key, materialize
from evalframe.sources.catalog import TOO_LARGE_TASKS
from evalframe.sources.logs import FILE_KEYS

POSITION = ["task", "query_idx", "sample_idx"]


def input_mismatches(samples: DataFrame, reference_model: str) -> DataFrame:
    """Samples whose input differs from the reference model's at the same position.

    The reference is a fixed part of all samples, and what Spark expects of rows expanded from arrays
    is far below their number: both sides are sorted by position, neither is gathered to be broadcast.
    """
    reference = samples.where(F.col("model_name") == reference_model).select(
        *POSITION, F.col("input").alias("reference_input")
    )
    others = samples.where(F.col("model_name") != reference_model)
    return others.join(reference.hint("merge"), POSITION).where(F.col("input") != F.col("reference_input"))


def require_same_order(samples: DataFrame, reference_model: str) -> None:
    first = input_mismatches(samples, reference_model).limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['model_name']} has different samples")


def first_models(files: DataFrame) -> DataFrame:
    """Per task, the reference: the first model in key order."""
    first = F.min(F.struct("model_family", "model_name"))
    return files.groupBy("task").agg(first.alias("_m")).select(
        "task", F.col("_m.model_family").alias("ref_family"), F.col("_m.model_name").alias("ref_name")
    )


def first_model_records(records: DataFrame, files: DataFrame) -> DataFrame:
    """Score records of each task's first model."""
    ref = first_models(files).withColumnRenamed("task", "_task")
    same = (F.col("task") == F.col("_task")) & (F.col("model_family") == F.col("ref_family")) & (F.col("model_name") == F.col("ref_name"))
    return records.join(ref, same, "left_semi")


def _fingerprints(files: DataFrame) -> DataFrame:
    """Files with their queries reduced to metadata and a hash of each input.

    Comparing needs the inputs' equality, not their text, so texts are not
    shuffled.
    """
    slim = F.transform(
        "queries",
        lambda q: F.struct(
            q["function"].alias("function"),
            q["shots"].alias("shots"),
            F.size(q["samples"]).alias("n_samples"),
            F.transform(q["samples"], lambda s: F.md5(s["input"])).alias("inputs"),
        ),
    )
    return files.select(*FILE_KEYS, slim.alias("queries"))


def query_meta_equal(a, b):
    """Same function, number of samples and shots (NULL equals NULL)."""
    return (
        a["function"].eqNullSafe(b["function"])
        & a["n_samples"].eqNullSafe(b["n_samples"])
        & a["shots"].eqNullSafe(b["shots"])
    )


def order_faults(files: DataFrame) -> DataFrame:
    """(task, model, reason) for files that differ from the task's first model.

    Reasons: no queries; another number of queries; another query at a
    position; other inputs at a position. Tasks whose reference is empty are
    not judged.
    """
    slim = materialize(_fingerprints(files), "fingerprints")
    named = materialize(first_models(slim), "first-models")
    own = slim.join(named, "task")
    is_reference = (F.col("model_family") == F.col("ref_family")) & (F.col("model_name") == F.col("ref_name"))
    reference = own.where(is_reference).where(F.size("queries") > 0).select("task", F.col("queries").alias("expected"))
    pairs = own.where(~is_reference).join(reference, "task")
    zipped = F.arrays_zip(F.col("queries").alias("a"), F.col("expected").alias("b"))
    both = F.filter(zipped, lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    shared = pairs.withColumn("_both", both)
    empty = F.coalesce(F.size("queries"), F.lit(0)) < 1
    meta = F.exists("_both", lambda z: ~query_meta_equal(z["a"], z["b"]))
    order = F.exists("_both", lambda z: query_meta_equal(z["a"], z["b"]) & (z["a"]["inputs"] != z["b"]["inputs"]))
    reasons = F.array_compact(
        F.array(
            F.when(empty, "no queries"),
            F.when(~empty & (F.size("queries") != F.size("expected")), "different number of queries"),
            F.when(~empty & meta, "different query"),
            F.when(~empty & order, "different sample order"),
        )
    )
    return shared.select(*FILE_KEYS, F.explode(reasons).alias("reason"))


def faulty_models(faults: DataFrame) -> DataFrame:
    """Per task, the set of faulty models (bounded by the number of models)."""
    name = F.concat_ws("/", "model_family", "model_name")
    return faults.groupBy("task").agg(F.array_sort(F.collect_set(name)).alias("models"))


# ---- shots ------------------------------------------------------------------


def _continues(query, previous):
    """Same type and one more shot than the query before (NULL before counts as 0)."""
    one_more = F.coalesce(previous["shots"], F.lit(0)) + 1 == query["shots"]
    return query["query_type"].eqNullSafe(previous["query_type"]) & F.coalesce(one_more, F.lit(False))


_SERIES_ROW = "struct<query_idx:int,query_type:string,shots:int,series:int,head_idx:int>"
_SERIES_STATE = f"struct<last:{_SERIES_ROW},rows:array<{_SERIES_ROW}>>"


def _series_rows() -> Column:
    """Each query of a file with its series and the place of the query that the series starts at.

    One fold over the file's own array: nothing is shuffled, and the state holds
    places, no texts.
    """
    start = F.struct(F.lit(None).cast(_SERIES_ROW), F.array().cast(f"array<{_SERIES_ROW}>")).cast(_SERIES_STATE)

    def step(state, q):
        last = state["last"]
        goes_on = last.isNotNull() & _continues(q, last)
        position = F.size(state["rows"])
        row = F.struct(
            position, q["query_type"], q["shots"],
            F.when(goes_on, last["series"]).otherwise(F.coalesce(last["series"] + 1, F.lit(0))),
            F.when(goes_on, last["head_idx"]).otherwise(position),
        ).cast(_SERIES_ROW)
        return F.struct(row, F.concat(state["rows"], F.array(row))).cast(_SERIES_STATE)

    headers = F.transform("queries", lambda q: F.struct(q["query_type"].alias("query_type"), q["shots"].alias("shots")))
    return F.aggregate(headers, start, step, lambda state: state["rows"])


def shot_series(files: DataFrame) -> DataFrame:
    """Number the runs of consecutive queries that differ only by one more shot.

    A new series starts when the type changes, shots are NULL, or shots are not
    the previous ones plus one.
    """
    rows = files.select(*FILE_KEYS, F.explode(_series_rows()).alias("q"))
    return rows.select(*FILE_KEYS, "q.query_idx", "q.query_type", "q.shots", "q.series")


def shot_violations(files: DataFrame) -> DataFrame:
    """Samples that are not the instance their series starts with (few-shot identity).

    A sample and its counterpart are fetched from the file's array by their places; of a file, only their
    texts go into the rows.
    """
    samples = lambda place: F.get("queries", place)["samples"]
    later = F.filter(_series_rows(), lambda q: q["query_idx"] > q["head_idx"])

    def texts(q: Column) -> Column:
        text = lambda s, i: F.struct(
            q["series"].alias("series"), q["query_idx"].alias("query_idx"), i.alias("sample_idx"),
            s["input"].alias("input"), F.get(samples(q["head_idx"]), i)["input"].alias("reference"),
        )
        return F.coalesce(F.transform(samples(q["query_idx"]), text), F.array())

    rows = files.select(*FILE_KEYS, F.explode(F.flatten(F.transform(later, texts))).alias("s")).select(*FILE_KEYS, "s.*")
    same = F.coalesce(same_instance(F.col("input"), F.col("reference")), F.lit(False))
    return rows.where(F.col("input").isNotNull() & ~same)


# ---- counts -----------------------------------------------------------------


def query_totals(files: DataFrame, total: str = "total") -> DataFrame:
    """#queries and #samples per task and overall."""
    sized = files.select(
        "task",
        F.coalesce(F.size("queries"), F.lit(0)).alias("_q"),
        F.coalesce(F.aggregate("queries", F.lit(0), lambda acc, q: acc + F.size(q["samples"])), F.lit(0)).alias("_s"),
    )
    return tasks_and_total(sized, F.sum("_q").alias("n_queries"), F.sum("_s").alias("n_samples"), total=total)


def sample_sizes(files: DataFrame) -> DataFrame:
    """Per file, the list of its queries' sizes."""
    return files.select(*FILE_KEYS, F.transform("queries", lambda q: F.size(q["samples"])).alias("sizes"))


def equal_instances(df: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Per task: do all models have the same inputs, as often each?

    Decided per (task, input) from counts per model; texts are compared by
    128-bit hash and no list of inputs is ever gathered.
    """
    keys = [*(within or []), "task"]
    counts = df.groupBy(*keys, "model_name", F.unhex(F.md5("input")).alias("_i")).agg(F.count("*").alias("_c"))
    per_model = materialize(counts, "inputs-per-model")  # read twice, the rows only once
    per_input = per_model.groupBy(*keys, "_i").agg(
        F.count("*").alias("_k"), (F.min("_c") == F.max("_c")).alias("_even")
    )
    sizes = per_model.groupBy(*keys, "model_name").agg(F.sum("_c").alias("_n")).groupBy(*keys).agg(
        F.count("*").alias("n_models"), (F.countDistinct("_n") == 1).alias("same_count")
    )
    joined = join_per_key(per_input, sizes, keys)
    return joined.groupBy(*keys, "n_models", "same_count").agg(
        F.bool_and(F.col("_even") & (F.col("_k") == F.col("n_models"))).alias("same_instances")
    )


def model_counts(df: DataFrame, models: list[str]) -> DataFrame:
    """Rows per task × model as a pivot; ``equal`` compares each model with the first."""
    cells = [F.nullif(F.count_if(F.col("model_name") == m), F.lit(0)).alias(m) for m in models]
    table = df.groupBy("task").agg(*cells)
    equal = F.lit(True)
    for m in models[1:]:
        equal = equal & F.coalesce(F.col(m) == F.col(models[0]), F.lit(False))
    return table.withColumn("equal", equal)


def same_size_for_all_shots(df: DataFrame) -> DataFrame:
    """Tasks with as many instances for each number of shots."""
    sizes = df.groupBy("task", "shots").agg(F.count("*").alias("n"))
    return sizes.groupBy("task").agg((F.countDistinct("n") == 1).alias("same")).where("same").select("task")


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row: tasks, largest (model, shots) size, records, equality of sizes, shots and models."""
    cells = materialize(df.groupBy("task", "model_name", "shots").agg(F.count("*").alias("n")), "cells")
    largest = cells.groupBy("model_name", "shots").agg(F.sum("n").alias("n")).agg(F.max("n"))
    kinds = cells.groupBy("task").agg(F.countDistinct("n").alias("k"))
    return cells.agg(
        F.countDistinct("task").alias("n_tasks"),
        F.sum("n").alias("n_records"),
        F.countDistinct("shots").alias("n_shots"),
        F.countDistinct("model_name").alias("n_models"),
    ).withColumns(
        {
            "n_unique_instances": largest.scalar(),
            "equal_per_shot_and_model": kinds.agg(F.countDistinct("k") == 1).scalar(),
        }
    )


def target_mismatches(df: DataFrame) -> DataFrame:
    """Rows with another number of target values than targets."""
    return df.where(F.size("targets") != F.size("target_values"))


def single_target_confidence(df: DataFrame) -> DataFrame:
    """Single-target rows per (task, label), with the highest confidence among them."""
    single = df.where(F.size("targets") == 1)
    return single.groupBy("task", "correct").agg(F.count("*").alias("count"), F.max("conf_absolute").alias("max_conf"))


def duplicate_instances(df: DataFrame, surviving: DataFrame) -> DataFrame:
    """Tasks with more than one query type that survive filtering: half their rows are duplicates."""
    several = df.groupBy("task").agg(F.countDistinct("query_type").alias("n_types")).where("n_types > 1")
    sizes = surviving.groupBy("task").agg(F.count("*").alias("_n"))
    return several.join(sizes, "task").select("task", "n_types", (F.col("_n") / 2).alias("n_duplicates"))


def target_count_spread(df: DataFrame) -> DataFrame:
    """Mean, variance and count of the number of targets per task."""
    return df.groupBy("task").agg(
        F.avg("n_targets").alias("mean"), F.var_samp("n_targets").alias("var"), F.count("n_targets").alias("count")
    )


def nonempty_in_list_order(df: DataFrame, tasks: list[str]) -> DataFrame:
    """The tasks of a list that have rows, in list order."""
    listed = F.array(*[F.lit(t) for t in tasks])
    found = df.where(F.col("task").isin(tasks)).select("task").distinct()
    return found.select((F.array_position(listed, F.col("task")) - 1).cast("int").alias("pos"), "task").orderBy("pos")


def sizes_by_query_type(df: DataFrame) -> DataFrame:
    """#tasks and #rows by query type."""
    return df.groupBy("query_type").agg(F.countDistinct("task").alias("n_tasks"), F.count("*").alias("n_rows"))


def unusable_for_original_task(df: DataFrame, too_large: dict[str, str] | None = None) -> DataFrame:
    """(task, reason) for tasks that cannot be trained on directly."""
    reasons = TOO_LARGE_TASKS if too_large is None else too_large
    kinds = df.groupBy("task").agg(F.countDistinct("n_targets").alias("_k"))
    variable = F.when(F.col("_k") > 1, "Variable number of targets")
    reason = F.coalesce(lookup("task", reasons), variable) if reasons else variable
    return kinds.select("task", reason.alias("reason")).where("reason is not null")


def contamination(df: DataFrame) -> DataFrame:
    """(task, n_shared): inputs of a task present on both sides of a split.

    One aggregate per (task, input) tells on which sides it occurs; texts are
    compared by 128-bit hash.
    """
    sides = df.groupBy("task", F.md5("input").alias("_i")).agg(
        F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") == "test").alias("in_test")
    )
    return sides.where("in_train and in_test").groupBy("task").agg(F.count("*").alias("n_shared"))
