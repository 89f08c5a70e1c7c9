"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks of ``block_rows`` rows. With weight ``w`` a
source's block ``j`` (from 0) is released at slot ``floor(j / w)`` and due by
slot ``ceil((j + 1) / w)``; each slot goes to the released block with the
earliest deadline. Every source then has, at every slot, less than one block
more or less than its weight times the slots so far.

Weights are whole parts, so the schedule repeats after as many slots as there
are parts: one period is computed, whatever the size of the data, and a
block's slot follows from its number. When a source has no whole share left,
the others go on by their own parts, from lag zero, as the next phase. No row
is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.llm.common import without
from evalframe.runtime import materialize

BLOCK_ROWS = 64
GROUP_ROWS = 10_000  # rows of a source that one window numbers
MAX_SOURCES = 256  # bounds the schedule, with MAX_PARTS: 4 MB
MAX_PARTS = 4096
NO_SOURCE = ""  # a NULL source counts as this one


def pfair_period(parts: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period; ties of deadlines go to the smaller name."""
    total = sum(parts.values())
    waiting = [(0, -(-total // p), name, 0) for name, p in parts.items()]  # release, deadline, name, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    order = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (due, name, block))
        _, name, block = heapq.heappop(ready)
        order.append(name)
        following = block + 1
        heapq.heappush(waiting, (following * total // parts[name], -(-(following + 1) * total // parts[name]), name, following))
    return order


def phases(blocks: Mapping[str, int], parts: Mapping[str, int]) -> list[dict]:
    """Each phase: the sources in it, their first blocks, its first slot and its period."""
    done = dict.fromkeys(blocks, 0)
    out, slot = [], 0
    while live := sorted(s for s in blocks if done[s] < blocks[s]):
        own = {s: parts[s] for s in live}
        period = pfair_period(own)
        places: dict[str, list[int]] = {s: [] for s in live}
        for place, name in enumerate(period):
            places[name].append(place)

        def end(s: str) -> int:  # slots of this phase up to the source's last block
            rest = blocks[s] - done[s] - 1
            return rest // own[s] * len(period) + places[s][rest % own[s]] + 1

        length = min(map(end, live))
        whole, rest = divmod(length, len(period))
        out.append({"slot": slot, "first": {s: done[s] for s in live}, "places": places, "period": len(period)})
        for s in live:
            done[s] += whole * own[s] + sum(p < rest for p in places[s])
        slot += length
    return out


def mix(df: DataFrame, weights: Mapping[str, int], default_weight: int = 1, source_col: str = "source", id_col: str = "doc_id",
        seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows with ``phase``, ``slot`` (of the block, gapless from 0) and ``row_in_block``: their order in the mixture.

    ``weights`` are whole parts of each source; others have ``default_weight``.
    Phase 0 is the stretch in which every source is still there and the mixture
    has exactly the target weights. Within a source the order is a seeded hash
    of the id. A NULL source is the source "". Rows that repeat an id are
    mixed like others. An empty table gives no rows. Input columns named like
    the three added ones are replaced. More than ``MAX_SOURCES`` sources or a
    weight below one raise ValueError.
    """
    rows = without(df, "phase", "slot", "row_in_block")
    numbered = number_in_source(rows, source_col, id_col, seed)
    sizes = {r["_source"]: r["n"] for r in numbered[1].limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    parts = {s: int(weights.get(s, default_weight)) for s in sizes}
    if any(p < 1 for p in parts.values()) or sum(parts.values()) > MAX_PARTS:
        raise ValueError(f"weights are whole parts from 1, {MAX_PARTS} together at most")
    plan = [
        (s, n, f, len(p["places"][s]), p["period"], p["slot"], p["places"][s])
        for n, p in enumerate(phases({s: -(-c // block_rows) for s, c in sizes.items()}, parts))
        for s, f in p["first"].items()
    ]
    session = df.sparkSession
    table = session.createDataFrame(plan, "_source string, phase int, _first long, _parts long, _period long, _slot long, _places array<int>")
    # one row per source: its phases in order (at most MAX_SOURCES rows, so this side may be broadcast)
    by_source = table.groupBy("_source").agg(
        F.array_sort(F.collect_list(F.struct("phase", "_first", "_parts", "_period", "_slot", "_places"))).alias("_phases")
    )
    block = F.floor(F.col("_n") / block_rows)
    at = F.element_at(F.filter("_phases", lambda p: p["_first"] <= F.col("_block")), -1)
    into = F.col("_block") - F.col("_at._first")
    slot = F.col("_at._slot") + F.floor(into / F.col("_at._parts")) * F.col("_at._period") + F.element_at(
        F.col("_at._places"), (into % F.col("_at._parts") + 1).cast("int")
    )
    out = numbered[0].withColumn("_block", block).join(F.broadcast(materialize(by_source, "schedule")), "_source").withColumn("_at", at)
    return out.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.col("_at.phase").alias("phase"),
        slot.cast("long").alias("slot"),
        (F.col("_n") % block_rows).cast("int").alias("row_in_block"),
    )


def number_in_source(rows: DataFrame, source_col: str, id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_source`` and ``_n``, their number in it from 0; and the sizes (_source, n).

    A hash of the id deals each source to groups of about ``GROUP_ROWS`` rows,
    more groups for a larger source. Counts per group give where each begins.
    """
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE))
    keyed = rows.select("*", source.alias("_source"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias("_hash"))
    sizes = materialize(keyed.groupBy("_source").agg(F.count("*").alias("n")), "source-sizes")
    groups = sizes.select("_source", F.ceil(F.col("n") / GROUP_ROWS).alias("_groups"))
    dealt = keyed.join(groups, "_source").withColumn("_group", F.pmod(F.col("_hash"), F.col("_groups")))
    counts = materialize(dealt.groupBy("_source", "_group").agg(F.count("*").alias("_c")), "group-sizes")
    before = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_source", "_group", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    # rows that repeat an id follow their contents: a task that runs again numbers them alike; equal rows are interchangeable
    content = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])
    inside = Window.partitionBy("_source", "_group").orderBy("_hash", F.col(f"`{id_col}`"), content)
    numbered = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(materialize(starts, "group-starts"), ["_source", "_group"])
    return numbered.withColumn("_n", F.col("_start") + F.col("_in")).drop("_hash", "_groups", "_group", "_in", "_start"), sizes


def mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mixture: sorted by range, so that files follow it."""
    return mixed.orderBy("slot", "row_in_block").drop("phase", "slot", "row_in_block")
