"""Score histograms and the order-dependent sums behind AUROC and calibration.

Rows are first reduced to one per (group, probability). That histogram is cut
into probability ranges, each range is summed (and pooled) on its own, and the
few range results of a group are merged. Pooling reads its rows in order and holds
the blocks of one group at a time. So a group with any number of rows,
or any number of distinct probabilities, is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.runtime import by_range, ship_by_value

ship_by_value(__name__)

# Sums a histogram row carries: rows, positives, positives and rows decided 1,
# squared error, and (positive, lower negative) pairs with ties counted half.
SUMS = ["n", "pos", "tp", "pp", "sq", "u"]
MERGE_FAN_IN = 64


def histogram(df: DataFrame, label: str, p: str, keys: list[str]) -> DataFrame:
    """One row per (keys, p): ``pos`` positives among ``n`` rows."""
    y, prob = F.col(label).cast("double"), F.col(p).cast("double")
    rows = df.select(*keys, y.alias("_y"), prob.alias("p")).where("_y is not null and p is not null")
    return rows.groupBy(*keys, "p").agg(F.sum("_y").alias("pos"), F.count("*").cast("double").alias("n"))


def with_decision_sums(hist: DataFrame) -> DataFrame:
    p, pos, n = F.col("p"), F.col("pos"), F.col("n")
    return hist.withColumns(
        {
            "tp": F.when(p > 0.5, pos).otherwise(0.0),
            "pp": F.when(p > 0.5, n).otherwise(0.0),
            "sq": pos * (1 - p) * (1 - p) + (n - pos) * p * p,
        }
    )


def ranged(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram cut into probability ranges ``_part``, with in-range pair counts ``u``."""
    inside = Window.partitionBy(*keys, "_part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    negatives = F.col("n") - F.col("pos")
    below = F.coalesce(F.sum(negatives).over(inside), F.lit(0.0))
    return by_range(hist, keys, [F.col("p")]).withColumn("u", F.col("pos") * (below + negatives / 2))


def totals(hist: DataFrame, keys: list[str], ranks: bool) -> DataFrame:
    """The sums per group; ``u`` only with ``ranks``, which costs one range shuffle."""
    hist = with_decision_sums(hist)
    plain = [c for c in SUMS if c != "u"]
    if not ranks:
        return hist.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in plain])
    parts = ranged(hist, keys).groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in SUMS])
    lower = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(lower), F.lit(0.0))
    shifted = parts.withColumn("u", F.col("u") + F.col("pos") * carried)
    return shifted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


# ---- pool adjacent violators ---------------------------------------------


def pool_adjacent_violators(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First index of each block of the isotonic fit of pos/n (weights n), in order.

    Whole falling runs are pooled at once; a stack finishes inputs that would
    need many such rounds.
    """
    starts = np.arange(len(pos))
    for _ in range(32):
        mean = pos / n
        rising = np.empty(len(mean), dtype=bool)
        rising[:1] = True
        rising[1:] = mean[1:] > mean[:-1]
        if rising.all():
            return starts
        heads = np.flatnonzero(rising)
        pos, n, starts = np.add.reduceat(pos, heads), np.add.reduceat(n, heads), starts[heads]
    stack: list[list[float]] = []
    for start, k, m in zip(starts, pos, n):
        block = [start, k, m]
        while stack and stack[-1][1] * block[2] >= block[1] * stack[-1][2]:
            last = stack.pop()
            block = [last[0], last[1] + block[1], last[2] + block[2]]
        stack.append(block)
    return np.array([b[0] for b in stack], dtype=int)


def _block_schema(hist: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in hist.schema.fields}
    columns = [f"`{k}` {types[k]}" for k in keys]
    columns += ["_part int", "part_lo int", "part_hi int", "p_lo double", "p_hi double"]
    return ", ".join(columns + [f"{c} double" for c in SUMS])


def _changes(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Which rows differ from the row before in one of the columns (NULLs are equal); the first row does."""
    changed = np.zeros(len(rows), dtype=bool)
    changed[:1] = True
    for c in columns:
        codes = pd.factorize(rows[c], use_na_sentinel=False)[0]
        changed[1:] |= codes[1:] != codes[:-1]
    return changed


def _same_key(a: list, b: list) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def _pooled(rows: pd.DataFrame, first: np.ndarray, keys: list[str]) -> tuple[pd.DataFrame, int]:
    """The blocks of each group of ``rows``, and where those of the last group start; ``first`` marks first rows."""
    pos, n = rows["pos"].to_numpy(), rows["n"].to_numpy()
    heads = np.flatnonzero(first)
    starts = [h + pool_adjacent_violators(pos[h:e], n[h:e]) for h, e in zip(heads, [*heads[1:], len(rows)])]
    last = sum(len(x) for x in starts[:-1])
    starts = np.concatenate(starts)
    ends = np.append(starts[1:], len(rows)) - 1
    out = {c: rows[c].to_numpy()[starts] for c in [*keys, "_part", "part_lo", "p_lo"]}
    out |= {c: rows[c].to_numpy()[ends] for c in ("part_hi", "p_hi")}
    out |= {c: np.add.reduceat(rows[c].to_numpy(), starts) for c in SUMS}
    return pd.DataFrame(out), last


def _pool_in_order(keys: list[str], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pool rows that arrive ordered by (keys, _part, p_lo); only the group under way is held, as blocks.

    ``u`` of a row counts lower negatives inside its own sub-range ``_sub``;
    those of earlier sub-ranges of its group are added here.
    """
    group = [*keys, "_part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_blocks, key, sub, sub_offset = None, None, None, 0.0
        for rows in batches:
            if rows.empty:
                continue
            first = _changes(rows, group)
            subs = first | _changes(rows, ["_sub"])
            goes_on = open_blocks is not None and _same_key(key, [rows[c].iloc[0] for c in group])
            held = float((open_blocks["n"] - open_blocks["pos"]).sum()) if goes_on else 0.0
            negatives = (rows["n"] - rows["pos"]).to_numpy()
            before = np.cumsum(negatives) - negatives
            row_group = np.cumsum(first) - 1
            before = before - before[np.flatnonzero(first)][row_group] + np.where(row_group == 0, held, 0.0)
            offsets = before[np.flatnonzero(subs)]
            if goes_on and rows["_sub"].iloc[0] == sub:
                offsets[0] = sub_offset
            offset = offsets[np.cumsum(subs) - 1]
            key, sub, sub_offset = [rows[c].iloc[-1] for c in group], rows["_sub"].iloc[-1], offset[-1]
            rows = rows.assign(u=rows["u"].to_numpy() + rows["pos"].to_numpy() * offset)[columns]
            if open_blocks is not None:
                first[0] = not goes_on
                head = np.zeros(len(open_blocks), dtype=bool)
                head[0] = True
                rows, first = pd.concat([open_blocks, rows], ignore_index=True), np.append(head, first)
            blocks, last = _pooled(rows, first, keys)
            blocks = blocks[columns]
            if last:
                yield blocks.iloc[:last]
            open_blocks = blocks.iloc[last:]
        if open_blocks is not None:
            yield open_blocks

    return run


def cut_into_ranges(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram with its sums, cut into probability ranges ``_part``."""
    return by_range(with_decision_sums(hist), keys, [F.col("p")])


def isotonic_blocks(parts: DataFrame, keys: list[str], n_parts: int, in_place: bool = False) -> DataFrame:
    """Blocks of the isotonic fit per group, from a histogram cut into ranges.

    Ranges are fitted on their own, then neighbouring fits are merged
    ``MERGE_FAN_IN`` at a time; pooling is associative, so the result is exact.
    ``in_place`` says that each task holds whole ranges already.
    """
    part = F.col("_part")
    blocks = parts.select(
        *keys, "_part", F.monotonically_increasing_id().alias("_sub"), part.alias("part_lo"), part.alias("part_hi"),
        F.col("p").alias("p_lo"), F.col("p").alias("p_hi"), *[c for c in SUMS if c != "u"],
        (F.col("pos") * (F.col("n") - F.col("pos")) / 2).alias("u"),
    )
    schema = _block_schema(parts, keys)
    pool = _pool_in_order(keys, [*keys, "_part", "part_lo", "part_hi", "p_lo", "p_hi", *SUMS])

    def pooled(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions(*keys, "_part", "p_lo").mapInPandas(pool, schema)

    blocks = pooled(blocks if in_place else blocks.repartition(*keys, "_part"))
    remaining = n_parts
    while remaining > 1:
        remaining = -(-remaining // MERGE_FAN_IN)
        merged = blocks.withColumn("_sub", part.cast("bigint")).withColumn("_part", F.floor(part / MERGE_FAN_IN).cast("int"))
        blocks = pooled(merged.repartition(*keys, "_part"))
    return blocks


def max_parts(df: DataFrame) -> int:
    """Upper bound of the number of ranges a range shuffle makes."""
    conf = df.sparkSession.conf
    initial = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(conf.get("spark.sql.shuffle.partitions")), int(initial or 0))


def calibrated_totals(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``totals`` plus ``iso``: the summed squared error of the isotonic fit."""
    blocks = isotonic_blocks(cut_into_ranges(hist, keys), keys, max_parts(hist), in_place=True)
    residual = F.col("pos") * (1 - F.col("pos") / F.col("n"))
    return blocks.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], F.sum(residual).alias("iso"))
