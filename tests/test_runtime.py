"""The distributed building blocks against brute force, with hot groups and several ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evalframe import runtime
from evalframe.runtime import join_per_key, lowest_hash_cut, materialize, number_rows, prefix_sums, seeded_hash, spread


@pytest.fixture()
def skewed(spark):
    """A third of the rows in one group, one group with NULL key, many tiny groups; small ranges."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(3)
    rows = [(rng.choice(["hot", None, *[f"g{i}" for i in range(40)]]) if rng.random() < 0.66 else "hot", i, rng.randint(0, 9)) for i in range(3000)]
    yield rows, spark.createDataFrame(rows, "g string, i int, x bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_prefix_sums_match_brute_force(skewed):
    rows, df = skewed
    got = {r["i"]: r["before"] for r in prefix_sums(df, ["g"], [F.col("i")], {"before": "x"}).collect()}
    running, want = {}, {}
    for g, i, x in sorted(rows, key=lambda r: r[1]):
        want[i] = running.get(g, 0)
        running[g] = want[i] + x
    assert got == want


def test_row_numbers_without_groups(skewed):
    rows, df = skewed
    numbered = number_rows(df, [], [F.desc("x"), F.col("i")]).collect()
    want = {i: n for n, (_, i, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])), 1)}
    assert {r["i"]: r["rn"] for r in numbered} == want


def test_hash_cut_draws_exactly(skewed):
    rows, df = skewed
    hashed = df.where("g is not null").withColumn("h", seeded_hash(7, F.col("i").cast("string")))
    cuts = lowest_hash_cut(hashed, ["g"], "h", F.rint(F.col("n") * 0.4))
    sizes = {}
    for g, _, _ in rows:
        if g is not None:
            sizes[g] = sizes.get(g, 0) + 1
    drawn = {r["g"]: r["c"] for r in hashed.join(cuts, "g").where("h <= cut").groupBy("g").agg(F.count("*").alias("c")).collect()}
    assert drawn == {g: round(n * 0.4) for g, n in sizes.items() if round(n * 0.4)}


def test_hash_cut_divides_large_buckets_and_counts_equal_hashes(spark):
    rows = [("hot", "abc" + seeded) for seeded in (f"{i * 7919 % 4096:029x}" for i in range(2000))]
    rows += [("hot", "abd" + "0" * 29)] * 500 + [("small", f"{i:032x}") for i in range(5)] + [("same", "f" * 32)] * 300
    df = spark.createDataFrame(rows, "g string, h string")
    by_group = {}
    for g, h in rows:
        by_group.setdefault(g, []).append(h)
    for share in (0.3, 0.9, 1.0):
        cuts = {r["g"]: r["cut"] for r in lowest_hash_cut(df, ["g"], "h", F.ceil(F.col("n") * share), ordered_rows=10).collect()}
        assert cuts == {g: sorted(hs)[math.ceil(len(hs) * share) - 1] for g, hs in by_group.items()}
    whole = lowest_hash_cut(df, [], "h", F.lit(1500), ordered_rows=10).first()
    assert whole["cut"] == sorted(h for _, h in rows)[1499]


def test_hash_cut_of_nothing_and_everything(spark):
    df = spark.range(50).select(seeded_hash(1, F.col("id").cast("string")).alias("h"))
    assert lowest_hash_cut(df, [], "h", F.lit(0)).first()["cut"] is None
    everything = lowest_hash_cut(df, [], "h", F.col("n")).first()
    assert everything["n"] == 50 and df.where(F.col("h") > everything["cut"]).count() == 0


def test_per_key_join_is_broadcast_only_when_small(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 10)
    means = rows.groupBy("k").agg(F.avg("id").alias("m"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(join_per_key(rows, means, ["k"]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in plan(join_per_key(rows, means, ["k"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, [1.0], {"a": 2.0}), (2, None, None)], "i int, a array<double>, m map<string,double>")
    back = materialize(df)
    assert back.schema.simpleString() == df.schema.simpleString() and back.count() == 2


def test_spread_leaves_large_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide) is wide
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_scratch_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "scratch_root", lambda spark: f"file:{tmp_path}")
    table = materialize(spark.range(3), "numbers")
    assert table.count() == 3 and any(tmp_path.rglob("*.parquet"))
    runtime.drop_scratch(spark)
    assert not any(tmp_path.rglob("*.parquet"))


def test_spread_bounds_the_rows_of_a_task(spark):
    rows = spark.range(0, 100, 1, 12)
    assert spread(rows, 2).rdd.getNumPartitions() == 50
    assert spread(rows, 1000) is rows or spark.sparkContext.defaultParallelism > 12
