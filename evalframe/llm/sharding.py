"""A seeded global shuffle into shards, in two passes over the data.

Pass one scatters rows uniformly into buckets that fit a task's memory. Pass
two draws a Fisher-Yates permutation of each bucket. The buckets end to end
are a uniformly random order of all rows, and shard ``s`` of ``n`` is the
``s``-th of ``n`` equal stretches of it: the law is ``rows``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.llm.common import without
from evalframe.runtime import materialize, scratch_path, ship_by_value

ship_by_value(__name__)

BUCKET_BYTES = 16 << 20
RUN = 1024  # buckets whose offsets one window adds up


def shuffle_into_shards(df: DataFrame, n_shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
                        bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` with ``shard`` (from 0) and ``slot`` (their place in the shard, gapless from 0).

    Counts of shards differ by one at most. Every row goes to exactly one
    shard, repeated rows and rows with NULLs too: the bucket is a hash of the
    seed, the id and the row's place in the input, so that no id or text can
    fill a bucket. ``df`` must read the same rows in the same order each time
    (a table does). An empty table gives no rows. Input columns named
    ``shard`` or ``slot`` are replaced. A row larger than ``bucket_bytes``
    only makes its own bucket larger.
    """
    rows = without(df, "shard", "slot")
    plan, size = "_bucket", F.octet_length(F.col(f"`{text_col}`"))
    volume = rows.agg(F.coalesce(F.sum(F.coalesce(size, F.lit(0)) + 64), F.lit(0))).first()[0]
    n_buckets = max(1, -(-int(volume) // bucket_bytes))
    place = F.monotonically_increasing_id()
    placed = rows.withColumn("_place", place)
    placed = placed.withColumn(plan, F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col("_place")), F.lit(n_buckets)))
    offsets = bucket_offsets(materialize(placed.groupBy(plan).agg(F.count("*").alias("_rows")), "buckets"), plan)
    offsets = materialize(offsets, "offsets")
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return (
        placed.join(offsets, plan)
        .groupBy(plan)
        .applyInArrow(bucket_shuffler(n_shards, seed, rows.columns), schema)
    )


def bucket_offsets(counts: DataFrame, plan: str) -> DataFrame:
    """(bucket, _offset, _total): rows before each bucket. Summed in runs of buckets, then over runs."""
    runs = counts.withColumn("_run", F.floor(F.col(plan) / RUN))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("_run").agg(F.sum("_rows").alias("_r"))  # one row per 1024 buckets
    totals = totals.select("_run", F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_run").orderBy(plan).rowsBetween(Window.unboundedPreceding, -1)
    total = counts.agg(F.sum("_rows").alias("_t"))
    return (
        runs.withColumn("_in", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(totals, "_run")
        .select(plan, (F.col("_base") + F.col("_in")).alias("_offset"))
        .withColumn("_total", total.scalar())
    )


def bucket_shuffler(n_shards: int, seed: int, columns: list[str]):
    """The function that permutes one bucket and cuts it where a shard ends."""

    def shuffle(table: pa.Table) -> pa.Table:
        bucket, offset, total = (table.column(c)[0].as_py() for c in ("_bucket", "_offset", "_total"))
        # rows arrive in any order; from their order in the input the permutation is the same in every run
        arrived = np.argsort(table.column("_place").to_numpy())
        order = arrived[np.random.default_rng([seed, bucket]).permutation(table.num_rows)]  # Fisher-Yates
        place = offset + np.arange(table.num_rows, dtype=np.int64)
        shard = shard_of(place, total, n_shards)
        slot = place - shard_start(shard, total, n_shards)
        out = table.select(columns).take(pa.array(order))
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    return shuffle


def shard_of(place: np.ndarray, total: int, n_shards: int) -> np.ndarray:
    """The first ``total % n_shards`` shards have one row more."""
    small, more = divmod(total, n_shards)
    large = more * (small + 1)
    return np.where(place < large, place // (small + 1), more + (place - large) // max(small, 1))


def shard_start(shard: np.ndarray, total: int, n_shards: int) -> np.ndarray:
    small, more = divmod(total, n_shards)
    return shard * small + np.minimum(shard, more)


def write_shards(shuffled: DataFrame, path: str | None = None) -> DataFrame:
    """Write shards as folders ``shard=…`` of Parquet files and return a scan of them."""
    path = path or scratch_path(shuffled.sparkSession, "shards")
    shuffled.write.partitionBy("shard").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)
