"""Session settings and the few distributed building blocks the operators share.

Everything here exists because one task, one model or one group of copies may
hold a large part of all rows: running totals, exact cuts and joins with a
per-key table must not funnel such a group through a single task.
"""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "evalframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on (AQE with skew handling, UTC)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder intermediate tables go to: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is chosen only in local mode, where there is one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="evalframe-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def ship_by_value(module_name: str) -> None:
    """Send a module's functions to the Python workers with the task.

    The few helpers that run inside tasks then need no installed package there.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def _scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/evalframe/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place for a table, in the application's own folder."""
    return f"{_scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored in the scratch folder.

    For its end: DataFrames that operators returned read from there.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return a scan of it.

    Cuts the lineage, survives lost executors, and gives the optimizer the true
    size of the table: a later join broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where AQE
    splits skewed keys.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_per_key(df: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join rows with a table holding one row per key, sized before it is joined."""
    return df.join(materialize(per_key, "per-key"), on, how)


def join_null_safe(df: DataFrame, per_key: DataFrame, on: list[str]) -> DataFrame:
    """Keep every row of ``df`` and add what ``per_key`` has for its key; NULL keys match each other."""
    renamed = per_key.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in per_key.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(renamed, same, "left").drop(*[f"_k_{c}" for c in on])


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Use all cores when a small input would feed fewer tasks than there are cores.

    A large input has more partitions than cores and is left as it is, unless ``rows_per_task``
    asks for more of them: for rows that cost much more than their size.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task is not None:
        tasks = max(tasks, -(-df.count() // rows_per_task))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def by_range(df: DataFrame, group: list[str], order: list[Column | str], part: str = "_part") -> DataFrame:
    """Spread rows over tasks by (group, order) range and number the ranges.

    Range partitioning samples its input, so a group of any size is cut into
    many ranges of similar size, and ``part`` grows with the order.
    """
    return df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn(part, F.spark_partition_id())


def _exclusive(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def prefix_sums(df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Exact running totals (excluding the row itself) within groups of any size.

    ``sums`` maps a new column to the column it accumulates. Rows are ranged and
    summed inside their range. Only a range's first and last group can go on in
    another range, so what is carried over is a table of two rows per range.
    """
    ranged = materialize(by_range(df, group, order), "ranged")
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    local = ranged.select("*", *[_exclusive(c, inside).alias(f"_l_{n}") for n, c in sums.items()])
    here = F.struct(*group, "_part").alias("_here")  # one key column: NULLs in a group compare equal
    rows = ranged.select("*", here)
    if group:
        ends = ranged.groupBy("_part").agg(F.min(F.struct(*group)).alias("_a"), F.max(F.struct(*group)).alias("_z"))
        ends = ends.select("_part", F.explode(F.array_distinct(F.array("_a", "_z"))).alias("_g")).select("_g.*", "_part")
        rows = join_per_key(rows, ends.select(here), ["_here"], "left_semi")
    totals = rows.groupBy(*group, "_part", "_here").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    lower = Window.partitionBy(*group).orderBy("_part")
    carried = totals.select("_here", *[_exclusive(f"_t_{n}", lower).alias(f"_o_{n}") for n in sums])
    return join_per_key(local.select("*", here), carried, ["_here"], "left").select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def number_rows(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    """Exact ``row_number()`` within groups of any size (order must be total)."""
    return prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, {"_before": "_one"}).select(
        *df.columns, (F.col("_before") + 1).cast("int").alias(name)
    )


# A histogram has 4096 buckets per group; the bucket a cut falls into is divided again
# until ordering its rows is a small matter for one task, however large the group.
HASH_BUCKET_DIGITS = 3
HASH_DIGITS = 32
ORDERED_ROWS = 100_000


def seeded_hash(seed: int, *columns: Column | str) -> Column:
    """The random order of all seeded draws: md5 of ``seed|col|col…``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def _bucket_of_cut(hist: DataFrame, group: list[str]) -> DataFrame:
    """Per group, the bucket ``_b`` that holds row ``_rest``, that row's place in it, and the bucket's size ``_c``."""
    running = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulated = hist.withColumn("_cum", F.sum("_c").over(running))
    hit = (F.col("_rest") > F.col("_cum") - F.col("_c")) & (F.col("_rest") <= F.col("_cum"))
    return cumulated.groupBy(*group).agg(
        F.max("n").alias("n"),
        F.max("take").alias("take"),
        F.max(F.when(hit, F.col("_b"))).alias("_b"),
        F.max(F.when(hit, F.col("_rest") - F.col("_cum") + F.col("_c"))).alias("_rest"),
        F.max(F.when(hit, F.col("_c"))).alias("_c"),
    )


def lowest_hash_cut(
    df: DataFrame, group: list[str], hash_column: str, take: Column, ordered_rows: int = ORDERED_ROWS
) -> DataFrame:
    """Per group, the hash of the ``take``-th smallest row: rows up to it are drawn.

    ``take`` is an expression over ``n``, the group's row count. A histogram over
    hash prefixes finds the bucket the cut falls into. A bucket of more than
    ``ordered_rows`` rows is divided by its next digits, and so on; only a small
    bucket is ordered. Rows of one hash are counted, not ordered. Returns
    (group…, n, take, cut), ``cut`` NULL where nothing is drawn.
    """
    prefix = lambda digits: F.substring("_h", 1, digits)
    first = prefix(HASH_BUCKET_DIGITS)
    keyed = df.select(*group, F.col(hash_column).alias("_h"))
    whole = Window.partitionBy(*group)
    hist = (
        keyed.groupBy(*group, first.alias("_b"))
        .agg(F.count("*").alias("_c"))
        .select("*", F.sum("_c").over(whole).alias("n"))
        .withColumn("take", take.cast("bigint"))
        .withColumn("_rest", F.col("take"))
    )

    def rows_of(buckets: DataFrame) -> DataFrame:
        buckets = buckets.withColumn("_first", F.substring("_b", 1, HASH_BUCKET_DIGITS))
        joined = keyed.withColumn("_first", first).join(buckets.drop("_c"), [*group, "_first"])
        return joined.where(F.col("_h").startswith(F.col("_b"))).drop("_first", "_b")

    found = materialize(_bucket_of_cut(hist, group), "cut")
    for digits in range(2 * HASH_BUCKET_DIGITS, HASH_DIGITS + HASH_BUCKET_DIGITS, HASH_BUCKET_DIGITS):
        large = F.coalesce(F.col("_c") > ordered_rows, F.lit(False))
        if found.where(large).isEmpty():
            break
        divided = rows_of(found.where(large)).groupBy(*group, prefix(digits).alias("_b")).agg(
            F.count("*").alias("_c"), *[F.max(c).alias(c) for c in ("n", "take", "_rest")]
        )
        found = materialize(found.where(~large).unionByName(_bucket_of_cut(divided, group)), "cut")
    running = Window.partitionBy(*group).orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        rows_of(found.where("_b is not null"))
        .groupBy(*group, "_h")
        .agg(F.count("*").alias("_c"), F.max("_rest").alias("_rest"))
        .withColumn("_cum", F.sum("_c").over(running))
        .where(F.col("_cum") >= F.col("_rest"))
        .groupBy(*group)
        .agg(F.min("_h").alias("cut"))
    )
    sizes = found.select(*group, "n", "take")
    if group:
        return materialize(sizes.join(cuts, group, "left"), "cuts")
    return sizes.withColumn("cut", cuts.select("cut").scalar())
