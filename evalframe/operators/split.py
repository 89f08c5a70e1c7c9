"""Train/test splits by instance, by task, by task accuracy, or aligned across models.

Draws are ordered by a seeded md5, so they repeat on any cluster, and cut
exactly by ``lowest_hash_cut``: no group is sorted or collected as a whole.
``within`` names columns that separate independent splits held in one frame.
Rows without a task are in no stratum; they are kept, on the test side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.runtime import join_null_safe, join_per_key, lowest_hash_cut, materialize, number_rows, seeded_hash

DEFAULT_SEED = 42


def _mark(df: DataFrame, cuts: DataFrame, group: list[str], below: str, above: str) -> DataFrame:
    """Label rows whose hash is up to the group's cut; a group without a cut is above it."""
    if group:
        df, cut = df.join(cuts.select(*group, "cut"), group, "left"), F.col("cut")
    else:
        cut = F.lit(cuts.first()["cut"])
    drawn = F.coalesce(F.col("_h") <= cut, F.lit(False))
    return df.withColumn("split", F.when(drawn, below).otherwise(above)).drop("_h", "cut")


def _train_size(test_fraction: float) -> Column:
    return F.rint(F.lit(1 - test_fraction) * F.col("n"))  # half to even


def split_instances(
    df: DataFrame,
    test_fraction: float,
    seed: int = DEFAULT_SEED,
    key: str = "sample_key",
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Stratified by task: in each task, round((1-f)·n) rows go to train. ``key`` is unique per row."""
    group = [*within, "task"]
    hashed = df.withColumn("_h", seeded_hash(seed, key))
    cuts = lowest_hash_cut(hashed, group, "_h", _train_size(test_fraction))
    return _mark(hashed, cuts, group, "train", "test")


_MODEL = ["model_name", "model_family"]


def _instances(narrow: DataFrame) -> DataFrame:
    """(task, input_md5, model…, copies): how often each model has each input; stored, a row per distinct one."""
    return materialize(narrow.groupBy("task", "input_md5", *_MODEL).agg(F.count("*").alias("copies")), "instances")


def number_copies(df: DataFrame, key: str = "sample_key", instances: DataFrame | None = None) -> DataFrame:
    """(task, input_md5, occurrence, key) of the rows whose (task, model, input) occurs more than once, numbered by key.

    All other rows are occurrence 1 of their input. Only keys and hashes of copies are ordered: texts stay where they are.
    """
    narrow = df.select("task", *_MODEL, F.md5("input").alias("input_md5"), key)
    several = (_instances(narrow) if instances is None else instances).where("copies > 1").drop("copies")
    same = ["task", "input_md5", *_MODEL]
    copies = join_null_safe(narrow, several.withColumn("_copied", F.lit(True)), same).where("_copied").drop("_copied")
    numbered = number_rows(copies, ["task", *_MODEL, "input_md5"], [F.col(key)], "occurrence")
    return numbered.select("task", "input_md5", "occurrence", key)


def split_instances_aligned(
    df: DataFrame, test_fraction: float, seed: int = DEFAULT_SEED, key: str = "sample_key"
) -> DataFrame:
    """Instance split with one decision per instance, valid for every model.

    An instance is (task, input, occurrence), so the same question lands on the
    same side for all models whether or not their logs agree in size and order. A row decides by itself,
    from the hash of its input and its task's cut; only the numbers of copies are looked up by key. Where copies
    are few, as many as a broadcast takes, no row is moved.
    """
    hashed = lambda occurrence: seeded_hash(seed, "input_md5", occurrence.cast("string"))
    instances = _instances(df.select("task", *_MODEL, F.md5("input").alias("input_md5")))
    numbers = materialize(number_copies(df, key, instances).select(F.col(key).alias("_copy"), "occurrence"), "copies")
    drawn = instances.groupBy("task", "input_md5").agg(F.max("copies").alias("n"))
    drawn = drawn.select("task", "input_md5", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("o"))
    cuts = lowest_hash_cut(drawn.select("task", hashed(F.col("o")).alias("_h")), ["task"], "_h", _train_size(test_fraction))
    rows = df.join(numbers, F.col(key) == F.col("_copy"), "left")
    rows = rows.withColumn("input_md5", F.md5("input")).withColumn("_h", hashed(F.coalesce("occurrence", F.lit(1))))
    return _mark(rows.drop("_copy", "occurrence", "input_md5"), cuts, ["task"], "train", "test")


def task_draw(tasks: DataFrame, test_fraction: float, seed: int = DEFAULT_SEED, within: tuple[str, ...] = ()) -> DataFrame:
    """(within…, task, split) of a table of distinct tasks: ceil(f · number of tasks) random ones are test."""
    tasks = materialize(tasks.select(*within, "task", seeded_hash(seed, "task").alias("_h")), "tasks")
    cuts = lowest_hash_cut(tasks, list(within), "_h", F.ceil(F.lit(test_fraction) * F.col("n")))
    return _mark(tasks, cuts, list(within), "test", "train")


def split_tasks(
    df: DataFrame, test_fraction: float, seed: int = DEFAULT_SEED, within: tuple[str, ...] = ()
) -> DataFrame:
    """Whole tasks: ceil(f · number of tasks) random ones are test."""
    tasks = df.where("task is not null").select(*within, "task").distinct()
    return _task_sides(df, task_draw(tasks, test_fraction, seed, within), within)


def _task_sides(df: DataFrame, sides: DataFrame, within: tuple[str, ...]) -> DataFrame:
    return join_per_key(df, sides, [*within, "task"], "left").fillna({"split": "test"})


def task_ranks(accuracy: DataFrame, test_fraction: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(within…, task, split) of a table of tasks with their accuracy ``acc``: the easiest int((1-f) · number of tasks) are train."""
    ranked = materialize(number_rows(accuracy.select(*within, "task", "acc"), list(within), [F.desc("acc"), F.asc("task")], "rank"), "ranked")
    sizes = ranked.groupBy(*within).agg(F.count("*").alias("_n"))
    if within:
        ranked = join_per_key(ranked, sizes, list(within))
    else:
        ranked = ranked.withColumn("_n", F.lit(sizes.first()["_n"]))
    side = F.when(F.col("rank") <= F.floor(F.col("_n") * F.lit(1 - test_fraction)), "train").otherwise("test")
    return ranked.select(*within, "task", side.alias("split"))


def split_distribution_shift(df: DataFrame, test_fraction: float, within: tuple[str, ...] = ()) -> DataFrame:
    """Whole tasks by mean label: the easiest int((1-f) · number of tasks) are train."""
    accuracy = df.where("task is not null").groupBy(*within, "task").agg(F.avg(F.col("correct").cast("double")).alias("acc"))
    return _task_sides(df, task_ranks(accuracy, test_fraction, within), within)


def mark_all(rows: DataFrame, test_fraction: float, seed: int = DEFAULT_SEED, within: tuple[str, ...] = ()) -> DataFrame:
    """A stored table's rows once per kind of split, with ``split_type`` and ``split``.

    ``rows`` has the rows' seeded hash ``_h``. All decisions are one small table with a row per task;
    rows then decide for all three kinds at once.
    """
    group = [*within, "task"]
    cuts = lowest_hash_cut(rows.where("task is not null"), group, "_h", _train_size(test_fraction)).select(*group, "cut")
    tasks = materialize(rows.where("task is not null").groupBy(*group).agg(F.avg(F.col("correct").cast("double")).alias("acc")), "tasks")
    sides = cuts.join(task_draw(tasks, test_fraction, seed, within).withColumnRenamed("split", "_task"), group)
    sides = sides.join(task_ranks(tasks, test_fraction, within).withColumnRenamed("split", "_shift"), group)
    marked = join_per_key(rows, sides, group, "left")
    drawn = F.when(F.coalesce(F.col("_h") <= F.col("cut"), F.lit(False)), "train").otherwise("test")
    kinds = {"instance": drawn, "task": F.coalesce("_task", F.lit("test")), "task_DS": F.coalesce("_shift", F.lit("test"))}
    cells = F.array(*[F.struct(F.lit(k).alias("split_type"), side.alias("split")) for k, side in kinds.items()])
    return marked.withColumn("_s", F.explode(cells)).select(*[c for c in rows.columns if c != "_h"], "_s.*")


def split(
    df: DataFrame, kind: str, test_fraction: float = 0.2, seed: int = DEFAULT_SEED, key: str = "sample_key"
) -> DataFrame:
    """Add ``split`` (train/test) by instance, task or task_DS."""
    if kind == "instance":
        several = "model_name" in df.columns and df.select("model_name").distinct().limit(2).count() > 1
        divide = split_instances_aligned if several else split_instances
        return divide(df, test_fraction, seed, key)
    if kind == "task":
        return split_tasks(df, test_fraction, seed)
    if kind == "task_DS":
        return split_distribution_shift(df, test_fraction)
    raise ValueError(f"kind is instance, task or task_DS, not {kind!r}")


def train_and_test(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(marked.where(F.col("split") == side).drop("split") for side in ("train", "test"))


def sample_fraction(df: DataFrame, fraction: float, seed: int = DEFAULT_SEED, key: str = "sample_key") -> DataFrame:
    """Global sample without strata: round(fraction · n) rows ``sample``, the others ``rest``."""
    hashed = df.withColumn("_h", seeded_hash(seed, key))
    cuts = lowest_hash_cut(hashed, [], "_h", F.rint(F.lit(fraction) * F.col("n")))
    return _mark(hashed, cuts, [], "sample", "rest")


def cap_instances(df: DataFrame, n: int, seed: int = DEFAULT_SEED, key: str = "sample_key") -> DataFrame:
    """A seeded draw of at most ``n`` rows (test runs), exact by a hash cut: no task holds them all."""
    hashed = df.withColumn("_h", seeded_hash(seed, key))
    cuts = lowest_hash_cut(hashed, [], "_h", F.least(F.lit(n), F.col("n")))
    return _mark(hashed, cuts, [], "drawn", "rest").where("split = 'drawn'").drop("split")


def largest_model(df: DataFrame, sizes: list[str]) -> DataFrame:
    """Rows of the last size of a list ordered by size."""
    return df.where(F.col("model_name") == sizes[-1])
