"""Mining hard negatives: exact searches of score windows, filtered by the triangle inequality of angles.

The angles of every vector to a few reference directions are stored. The angle between
two vectors is at least the difference and at most the sum of their angles to any
reference (and 2 pi less that sum), so the stored angles give an interval for their
cosine, and with the norms one for their inner product, widened by more than
rounding can do. Only what may fall into a window that is asked for is scored, in whole numbers.

Rows are sorted by label, nearest reference and angle to it, over tasks by range, and
packed in groups; a run of rows in a group is a tile. The test is made first between a block of
anchors and a group, before either is moved, then between an anchor and a tile. Each of the two
searches, for positives and for negatives, visits a few promising groups per block
first; what they find narrows the windows for all other groups.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import bound_batches
from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

REFERENCES = 16
SAMPLE_ROWS = 2048  # rows that the reference directions are chosen from
GROUP_ROWS = 4096
BLOCK_ROWS = 1024
TILE_ROWS = 128
GROUPS_PER_TASK = 16
BLOCKS_PER_TASK = 16
FIRST_GROUPS = 4  # groups that a block visits first
SAFE_ANGLE = 1e-5  # angles are stored in single precision
LOWEST, HIGHEST = -(2**63), 2**63 - 1
NO_ID = HIGHEST


def whole_points(vectors: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles."""
    return np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(vectors), width)


def norms_of(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points * points).sum(axis=1))


def directions(points: np.ndarray) -> np.ndarray:
    """Unit vectors of points that are far apart in angle: each next one is the farthest from those before."""
    points = points[norms_of(points) > 0]
    if not len(points):
        return np.zeros((0, points.shape[1]))
    unit = points / norms_of(points)[:, None]
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(REFERENCES, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def angles_to(points: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The angle of each point to each reference; a zero vector, whose score is 0 whatever its angle, counts as at a right angle."""
    norms = norms_of(points)
    cosine = points @ references.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as arrays:
        return {k: arrays[k] for k in arrays.files}


def compact(points: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they fit in."""
    for kind in (np.int16, np.int32):
        if np.abs(points).max(initial=0) <= np.iinfo(kind).max:
            return points.astype(kind)
    return points


def score_bounds(least: np.ndarray, most: np.ndarray, norms: tuple, others: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of inner products from bounds of angles and (least, largest) norms of both sides."""
    top, bottom = np.cos(np.maximum(least - SAFE_ANGLE, 0)), np.cos(np.minimum(most + SAFE_ANGLE, np.pi))
    small, large = norms[0] * others[0], norms[1] * others[1]
    slack = 1e-6 + 1e-9 * large
    return np.ceil(np.where(bottom < 0, large, small) * bottom - slack), np.floor(np.where(top < 0, small, large) * top + slack)


def angle_bounds(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) angle between vectors whose angles to the references (last axis) lie in the given (least, most)."""
    apart = np.maximum(one[0] - other[1], other[0] - one[1])
    least = np.maximum(apart.max(axis=-1, initial=0), 0)
    most = np.minimum((one[1] + other[1]).min(axis=-1, initial=np.pi), (2 * np.pi - one[0] - other[0]).min(axis=-1, initial=np.pi))
    return least, most


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of up to 64 bits."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return (np.frompyfunc(int, 1, 1)(a) @ np.frompyfunc(int, 1, 1)(b).T).astype(np.int64)


def window_of(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers n with low * score <= 100 * n <= high * score, from and to, without overflow."""
    hundreds, rest = score // 100, score % 100
    return low * hundreds - (-low * rest) // 100, high * hundreds + high * rest // 100


class Group:
    """Rows in the order they are sorted by, cut into tiles."""

    def __init__(self, blob: bytes):
        self.__dict__ |= load(blob)
        self.points = self.points.astype(np.float64)
        self.starts = np.arange(0, len(self.ids), TILE_ROWS)
        span = lambda x: (np.minimum.reduceat(x, self.starts, axis=0), np.maximum.reduceat(x, self.starts, axis=0))
        self.tile_angles, self.tile_norms = span(self.angles.astype(np.float64)), span(self.norms)


class Asks:
    """A block of anchors and the questions they have: per question the ``k`` best scores in its window."""

    def __init__(self, blob: bytes, k: int):
        self.__dict__ |= load(blob)
        self.points = self.points.astype(np.float64)
        self.k = k
        self.score = np.full((len(self.of), k), LOWEST, np.int64)
        self.found = np.full((len(self.of), k), NO_ID, np.int64)
        self.scored = 0

    def visit(self, group: Group, alike: bool) -> None:
        """Search a group for rows of the anchor's label, or of other labels."""
        _, code = np.unique(np.concatenate([self.labels, group.labels]), return_inverse=True)
        own, theirs = code[: len(self.labels)], code[len(self.labels) :]
        first, last = theirs[group.starts], theirs[np.append(group.starts[1:], len(theirs)) - 1]
        inside = (first <= own[:, None]) & (own[:, None] <= last)
        useful = inside if alike else ~((first == last) & inside)
        one = self.angles.astype(np.float64)[:, None, :]
        least, most = angle_bounds((one, one), tuple(x[None] for x in group.tile_angles))
        lower, upper = score_bounds(least, most, (self.norms[:, None],) * 2, tuple(x[None] for x in group.tile_norms))
        open_ = useful[self.of] & (lower[self.of] <= self.high[:, None])
        for tile in np.argsort(-upper.max(axis=0), kind="stable"):
            asks = np.flatnonzero(open_[:, tile] & (upper[self.of, tile] >= self.low))
            if len(asks):
                rows = slice(group.starts[tile], group.starts[tile] + TILE_ROWS)
                self.score_tile(asks, group, rows, own, theirs[rows], alike)

    def score_tile(self, asks: np.ndarray, group: Group, rows: slice, own: np.ndarray, theirs: np.ndarray, alike: bool) -> None:
        anchors, at = np.unique(self.of[asks], return_inverse=True)
        ids = group.ids[rows]
        scores = whole_products(self.points[anchors], group.points[rows])
        allowed = ((own[anchors, None] == theirs) == alike) & (self.ids[anchors, None] != ids)
        self.scored += scores.size
        scores, low = scores[at], self.low[asks, None]
        take = allowed[at] & (scores <= self.high[asks, None]) & ((scores > low) | ((scores == low) & (ids <= self.low_id[asks, None])))
        ask, column = np.nonzero(take)
        if not len(ask):
            return
        changed, ask = np.unique(ask, return_inverse=True)
        mine = asks[changed]
        of = np.concatenate([np.repeat(np.arange(len(mine)), self.k), ask])
        all_scores = np.concatenate([self.score[mine].ravel(), scores[take]])
        all_ids = np.concatenate([self.found[mine].ravel(), ids[column]])
        order = np.lexsort((all_ids, ~all_scores, of))
        of = of[order]
        kept = order[np.arange(len(of)) - np.searchsorted(of, of) < self.k]
        self.score[mine], self.found[mine] = all_scores[kept].reshape(-1, self.k), all_ids[kept].reshape(-1, self.k)
        full = self.found[mine, -1] != NO_ID
        self.low[mine[full]], self.low_id[mine[full]] = self.score[mine[full], -1], self.found[mine[full], -1]


FOUND = pa.schema([("block", pa.int64()), ("ask", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_TYPE = "block long, ask long, id long, score long"
PACKED = "width int, at long, first string, last string, angle_min array<float>, angle_max array<float>, norm_min double, norm_max double, blob binary"
ASKS = "block long, low long, high long, blob binary"


def nearest_reference(references: dict[int, np.ndarray], scale: float) -> Callable:
    """Adds the nearest reference (``home``) and the angle to it: what rows are sorted by."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.float32)
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                if len(references.get(width, ())):
                    at = np.flatnonzero(widths == width)
                    angles = angles_to(whole_points(batch.column("vector").take(pa.array(at)), width, scale), references[width])
                    home[at], angle[at] = angles.argmin(axis=1), angles.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(angle)], names=[*batch.schema.names, "home", "angle"])

    return rows


def packed(references: dict[int, np.ndarray], scale: float, size: int) -> Callable:
    """Runs of at most ``size`` rows of one width, in the order given, with the bounds of what they hold."""

    def pack(table: pa.Table, at: int) -> pa.RecordBatch:
        width = table["width"][0].as_py()
        points = whole_points(table["vector"].combine_chunks(), width, scale)
        norms, angles = norms_of(points), angles_to(points, references.get(width, np.zeros((0, width))))
        labels = table["label"].to_pylist()
        blob = dump(ids=table["id"].to_numpy(), labels=np.array(labels, dtype=str), points=compact(points), norms=norms, angles=angles)
        values = [width, at, labels[0], labels[-1], angles.min(axis=0), angles.max(axis=0), norms.min(), norms.max(), blob]
        types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.float64(), pa.float64(), pa.binary()]
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows:
                widths = held["width"].to_numpy()
                end = min(size, int(np.searchsorted(widths, widths[0], side="right")))
                if end == held.num_rows and end < size:
                    break  # more of this run may come
                yield pack(held.slice(0, end).combine_chunks(), (part << 32) + made)
                made, held = made + 1, held.slice(end)
        if held is not None and held.num_rows:
            yield pack(held.combine_chunks(), (part << 32) + made)

    return rows


def pack_rows(rows: DataFrame, references: dict[int, np.ndarray], scale: float, size: int, count: int, label: str) -> DataFrame:
    """Rows in range order, packed; ties of all sort columns may make a task's range long, never a pack."""
    order = ["width", "label", "home", "angle"]
    ranged = rows.repartitionByRange(max(1, -(-count // size)), *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(packed(references, scale, size), PACKED), label)


def questions(table: pa.Table) -> pa.Table:
    """One open question per anchor of a block."""
    block = load(table["blob"][0].as_py())
    n = len(block["ids"])
    open_ = dict(of=np.arange(n), low=np.full(n, LOWEST), low_id=np.full(n, NO_ID), high=np.full(n, HIGHEST))
    return asked(table["at"][0].as_py(), block | open_)


def asked(block: int, arrays: dict[str, np.ndarray]) -> pa.Table:
    low, high = int(arrays["low"].min(initial=HIGHEST)), int(arrays["high"].max(initial=LOWEST))
    values = pa.array([block], pa.int64()), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([dump(**arrays)], pa.binary())
    return pa.table(list(values), names=["block", "low", "high", "blob"])


NOTHING_ASKED = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=["block", "low", "high", "blob"])


def narrowed(k: int) -> Callable:
    """A block's questions with the k-th best score found for them as the least that is of use."""

    def rows(asks: pa.Table, found: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return NOTHING_ASKED
        arrays = load(asks["blob"][0].as_py())
        if found.num_rows:
            ask, ids, score = (found[c].to_numpy() for c in ("ask", "id", "score"))
            order = np.lexsort((ids, ~score, ask))
            ask, ids, score = ask[order], ids[order], score[order]
            rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
            arrays["low"][ask[rank == k - 1]], arrays["low_id"][ask[rank == k - 1]] = score[rank == k - 1], ids[rank == k - 1]
        return asked(asks["block"][0].as_py(), arrays)

    return rows


def windows(low: int, high: int) -> Callable:
    """A block's questions for negatives: one per anchor and positive, those with an empty window left out."""

    def rows(asks: pa.Table, positives: pa.Table) -> pa.Table:
        if not asks.num_rows or not positives.num_rows:
            return NOTHING_ASKED
        arrays = load(asks["blob"][0].as_py())
        score = positives["score"].to_numpy()
        least, most = window_of(score, low, high)
        open_ = least <= most
        if not open_.any():
            return NOTHING_ASKED
        arrays |= dict(of=positives["ask"].to_numpy()[open_], low=least[open_], low_id=np.full(open_.sum(), NO_ID), high=most[open_])
        arrays |= dict(positive_id=positives["id"].to_numpy()[open_], positive_score=score[open_])
        return asked(asks["block"][0].as_py(), arrays)

    return rows


def searching(k: int, alike: bool) -> Callable:
    """Blocks against groups: what is found for the questions."""

    def rows(asks: pa.Table, groups: pa.Table) -> pa.Table:
        out = []
        if asks.num_rows and groups.num_rows:
            blocks = [(b.as_py(), set(v.as_py()), Asks(blob.as_py(), k)) for b, v, blob in zip(asks["block"], asks["visits"], asks["blob"])]
            for at, blob in zip(groups["at"].to_pylist(), groups["blob"]):
                group = Group(blob.as_py())
                for _, visits, block in blocks:
                    if at in visits:
                        block.visit(group, alike)
            for number, _, block in blocks:
                ask, place = np.nonzero(block.found != NO_ID)
                out.append(pa.table([np.full(len(ask), number), ask, block.found[ask, place], block.score[ask, place]], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return rows


def overlapping(asks: DataFrame, blocks: DataFrame, groups: DataFrame, parts: int, alike: bool) -> DataFrame:
    """(part, batch, block, group, upper): the pairs of a block and a group whose scores may fall into a window.

    ``asks`` are a few rows per thousand anchors, ``groups`` one per some thousand rows; no vector is moved.
    """
    side = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("at", "width", "first", "last", "angle_min", "angle_max", "norm_min", "norm_max")])
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    ours = asks.join(side(blocks, "b_"), F.col("block") == F.col("b_at"))
    ours = ours.select("batch", "block", "low", "high", F.struct("b_width", "b_first", "b_last", "b_angle_min", "b_angle_max", "b_norm_min", "b_norm_max").alias("b"), every_part)
    theirs = groups.select("part", F.col("at").alias("group"), F.struct("width", "first", "last", "angle_min", "angle_max", "norm_min", "norm_max").alias("g"))
    met = ours.join(theirs, "part").where("b.b_width = g.width")
    if alike:
        met = met.where("b.b_first <= g.last and g.first <= b.b_last")
    else:
        met = met.where("not (g.first = g.last and b.b_first = b.b_last and g.first = b.b_first)")
    far = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") - q)
    apart = F.concat(F.array(F.lit(0.0)), far(F.col("g.angle_min"), F.col("b.b_angle_max")), far(F.col("b.b_angle_min"), F.col("g.angle_max")))
    together = F.concat(
        F.array(F.lit(float(np.pi))),
        F.zip_with("g.angle_max", "b.b_angle_max", lambda p, q: p.cast("double") + q),
        F.zip_with("g.angle_min", "b.b_angle_min", lambda p, q: F.lit(2 * float(np.pi)) - p - q),
    )
    met = met.withColumns({"top": F.cos(F.greatest(F.lit(0.0), F.array_max(apart) - SAFE_ANGLE)), "bottom": F.cos(F.least(F.lit(float(np.pi)), F.array_min(together) + SAFE_ANGLE))})
    small, large = F.col("g.norm_min") * F.col("b.b_norm_min"), F.col("g.norm_max") * F.col("b.b_norm_max")
    slack = 1e-6 + 1e-9 * large
    upper = F.floor(F.when(F.col("top") < 0, small).otherwise(large) * F.col("top") + slack)
    lower = F.ceil(F.when(F.col("bottom") < 0, large).otherwise(small) * F.col("bottom") - slack)
    return met.withColumns({"upper": upper, "lower": lower}).where("upper >= low and lower <= high").select("part", "batch", "block", "group", "upper")


def search(asks: DataFrame, blocks: DataFrame, groups: DataFrame, parts: int, k: int, alike: bool) -> DataFrame:
    """(block, ask, id, score, rank) of the ``k`` best of each question; ``asks`` is a stored table of (block, low, high, blob)."""
    batches = max(1, -(-blocks.count() // BLOCKS_PER_TASK))
    numbered = lambda df: df.withColumn("batch", F.pmod(F.xxhash64("block"), F.lit(batches)))

    def visit(asks: DataFrame, pairs: DataFrame) -> DataFrame:
        visits = pairs.groupBy("part", "batch", "block").agg(F.collect_list("group").alias("visits"))  # the groups of a part
        some_asks = numbered(asks).join(visits, ["batch", "block"])
        some_groups = groups.select("part", "at", "blob").join(pairs.select("part", "batch", F.col("group").alias("at")).distinct(), ["part", "at"])
        return some_asks.groupBy("part", "batch").cogroup(some_groups.groupBy("part", "batch")).applyInArrow(searching(k, alike), FOUND_TYPE)

    pairs = overlapping(numbered(asks), blocks, groups, parts, alike)
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("upper"), "group"))
    pairs = materialize(pairs.withColumn("place", place), "overlapping")
    first = materialize(visit(asks, pairs.where(F.col("place") <= FIRST_GROUPS)), "found-first")
    again = materialize(asks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(narrowed(k), ASKS), "narrowed")
    rest = pairs.where(F.col("place") > FIRST_GROUPS).join(again.select("block", "low"), "block").where("upper >= low").drop("low")
    found = first.unionByName(materialize(visit(again, rest), "found-rest"))
    best = Window.partitionBy("block", "ask").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    Components become floor(scale * x), scores are inner products. An anchor's positives are the first other rows
    of its label; for each, the first rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score are returned. Higher scores come first, ties by the smaller id.
    Rows without an id, a label or a vector, or with a NULL or non-finite component, take no part; vectors of
    different lengths are not compared. A row with the anchor's own id is no candidate; rows that repeat an id
    are anchors and candidates each by themselves. Vectors so long that a score may exceed 64 bits raise. Empty tables give no rows;
    other columns are not looked at.
    """
    bound_batches(df.sparkSession)
    x, key = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = df.where(key.isNotNull() & F.col(f"`{label_col}`").isNotNull() & (F.size(x) > 0) & whole).select(
        key.cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), x.cast("array<double>").alias("vector"),
        F.size(x).alias("width"), is_anchor.alias("asks"),
    )
    sample = rows.orderBy(F.xxhash64("id"), "id").select("vector", "width").limit(SAMPLE_ROWS).toArrow()
    references = {}
    for width in np.unique(sample["width"].to_numpy()).tolist():
        own = sample.filter(pc.equal(sample["width"], width))["vector"].combine_chunks()
        references[width] = directions(whole_points(own, width, scale))
    schema = "id long, label string, vector array<double>, width int, asks boolean, home int, angle float"
    placed = rows.mapInArrow(nearest_reference(references, scale), schema)
    count, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    groups = pack_rows(placed, references, scale, GROUP_ROWS, count, "groups")
    blocks = pack_rows(placed.where("asks"), references, scale, BLOCK_ROWS, asking, "anchors")
    several, longest = groups.agg(F.count("*"), F.coalesce(F.max("norm_max"), F.lit(0.0))).first()
    if longest * longest >= 2.0**62:
        raise ValueError("inner products may exceed 64 bits")
    parts = max(1, -(-several // max(1, min(GROUPS_PER_TASK, several // 32))))
    groups = groups.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)))
    open_ = materialize(blocks.groupBy("at").applyInArrow(questions, ASKS), "asks")
    near = materialize(search(open_, blocks, groups, parts, positives, True), "positives")
    hard = materialize(open_.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(windows(low, high), ASKS), "windows")
    found = search(hard, blocks, groups, parts, negatives, False)

    def named(asks: pa.Table, found: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        if not asks.num_rows or not found.num_rows:
            return pa.table([pa.array([], pa.int32() if n == "rank" else pa.int64()) for n in names], names=names)
        arrays, ask = load(asks["blob"][0].as_py()), found["ask"].to_numpy()
        columns = [arrays["ids"][arrays["of"][ask]], arrays["positive_id"][ask], found["rank"], found["id"], arrays["positive_score"][ask], found["score"]]
        return pa.table(columns, names=names)

    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return hard.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(named, result)
