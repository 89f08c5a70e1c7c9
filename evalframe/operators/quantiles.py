"""Exact quantiles of groups of any size, by narrowing an interval around each wanted rank.

A sketch of bounded size gives values that a rank lies between; counting the rows below, at and between them makes
that exact and leaves the open interval that holds the rank. The next round looks at
that interval only, until it has so few rows that they can be ordered. All ranks of all groups share their rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.runtime import materialize

ORDERED_ROWS = 20_000  # an interval of at most so many rows is ordered by one task
GRID = 256  # values that a sketch is asked for
ACCURACY = 10_000  # a sketch's ranks are wrong by one part in so many, far less than a step of the grid


def _inside(x: Column) -> Column:
    """Is the value in the rank's open interval? A NULL bound is none."""
    return (F.col("low").isNull() | (x > F.col("low"))) & (F.col("high").isNull() | (x < F.col("high")))


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return same


def _open_rows(rows: DataFrame, ranks: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The rows in the intervals of the ranks that are still open, with the rank's columns."""
    own = ranks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "rank", "low", "high", "before", "rows")
    return rows.join(own, _same(keys)).where(_inside(F.col(x))).drop(*[f"_k_{k}" for k in keys])


def order_statistics(rows: DataFrame, keys: list[str], x: str, ranks: DataFrame, ordered_rows: int = ORDERED_ROWS) -> DataFrame:
    """(keys…, rank, value): the value at each rank (from 0) of the sorted values of its group.

    ``rows`` has (keys…, x) without NULLs; ``ranks`` has (keys…, rank, rows), the last the group's number of rows.
    """
    none = F.lit(None).cast("double")
    ranks = ranks.select(*keys, F.col("rank").cast("long").alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("before"), F.col("rows").cast("long").alias("rows"), none.alias("value"))
    ranks = materialize(ranks, "ranks")
    while True:
        wide = (F.col("rows") > ordered_rows) & F.col("value").isNull()
        large = ranks.where(wide)
        if large.isEmpty():
            break
        grid = F.percentile_approx(x, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY).alias("grid")
        interval = [*keys, "rank", "before", "low", "high", "rows"]
        sketch = _open_rows(rows, large, keys, x).groupBy(*interval).agg(grid)
        at = (F.col("rank") - F.col("before")) / F.col("rows") * GRID
        around = sketch.select(
            *interval,
            F.element_at("grid", F.greatest(F.floor(at) - 1, F.lit(0)).cast("int") + 1).alias("a"),
            F.element_at("grid", F.least(F.ceil(at) + 1, F.lit(GRID)).cast("int") + 1).alias("b"),
        )
        around = materialize(around, "around-ranks")
        bounds = around.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "rank", "before", "low", "high", "rows", "a", "b")
        v = F.col(x)
        counted = rows.join(bounds, _same(keys)).where(_inside(v)).groupBy(*interval, "a", "b").agg(
            F.count_if(v < F.col("a")).alias("under"),
            F.count_if(v == F.col("a")).alias("at_a"),
            F.count_if((v > F.col("a")) & (v < F.col("b"))).alias("between"),
            F.count_if((v == F.col("b")) & (F.col("b") > F.col("a"))).alias("at_b"),
        )
        r = F.col("rank") - F.col("before")
        ends = [F.col("under"), F.col("under") + F.col("at_a"), F.col("under") + F.col("at_a") + F.col("between")]
        ends.append(ends[2] + F.col("at_b"))
        pick = lambda *choices: F.when(r < ends[0], choices[0]).when(r < ends[1], choices[1]).when(r < ends[2], choices[2]).when(r < ends[3], choices[3]).otherwise(choices[4])
        a, b, zero = F.col("a"), F.col("b"), F.lit(0).cast("long")
        narrowed = counted.select(
            *keys, "rank",
            pick(F.col("low"), none, a, none, b).alias("low"),
            pick(a, none, b, none, F.col("high")).alias("high"),
            (F.col("before") + pick(zero, zero, ends[1], zero, ends[3])).alias("before"),
            pick(F.col("under"), zero, F.col("between"), zero, F.col("rows") - ends[3]).alias("rows"),
            pick(none, a, none, b, none).alias("value"),
        )
        ranks = materialize(ranks.where(~wide).unionByName(narrowed), "ranks")
    known = ranks.where("value is not null").select(*keys, "rank", "value")
    rest = _open_rows(rows, ranks.where("value is null"), keys, x).groupBy(*keys, "rank", "before").agg(F.array_sort(F.collect_list(x)).alias("v"))
    place = (F.col("rank") - F.col("before") + 1).cast("int")
    return known.unionByName(rest.select(*keys, "rank", F.element_at("v", place).alias("value")))


def exact_quantiles(rows: DataFrame, keys: list[str], x: str, probabilities: list[float], ordered_rows: int = ORDERED_ROWS) -> DataFrame:
    """(keys…, p, quantile), interpolated between the two values next to the rank p * (n - 1).

    NULLs don't count; NaN is larger than all numbers. A group of NULL keys is a group like any other.
    """
    rows = rows.select(*keys, F.col(x).cast("double").alias(x)).where(F.col(x).isNotNull())
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("rows")), "sizes")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    wanted = sizes.select(*keys, "rows", wanted).withColumn("_at", F.col("p") * (F.col("rows") - 1))
    wanted = wanted.withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")})
    ranks = wanted.select(*keys, "rows", F.explode(F.array("_low", "_high")).alias("rank")).distinct()
    values = materialize(order_statistics(rows, keys, x, ranks, ordered_rows), "order-statistics")
    both = values.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "rank", "value")
    near = wanted.join(both, _same(keys) & ((F.col("rank") == F.col("_low")) | (F.col("rank") == F.col("_high"))))
    share = F.col("_at") - F.col("_low")
    value = lambda side: F.max(F.when(F.col("rank") == F.col(side), F.col("value")))
    ends = near.groupBy(*keys, "p", share.alias("_share")).agg(value("_low").alias("_a"), value("_high").alias("_b"))
    exact = F.when((F.col("_share") == 0) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise(F.col("_a") + F.col("_share") * (F.col("_b") - F.col("_a")))
    return ends.select(*keys, "p", exact.alias("quantile"))
