"""Exact top-k by inner product: ball-tree branch and bound per shard.

Vectors are dealt to shards of bounded size, each with a ball tree. Queries
are searched in blocks. A task holds one block and a group of shards; it visits
a tree's nodes in the order of the largest inner product a ball allows, and a
query's current k-th score, carried from shard to shard, rules out the rest.
The first group a block visits gives every query its score to beat in all
other groups.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

SHARD_ROWS = 4096
SHARDS_PER_TASK = 4
QUERY_ROWS = 512
LEAF_ROWS = 64
LARGEST = 2**62  # scores beyond are held at it
NO_ID = np.iinfo(np.int64).max


def scaled(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """floor(scale * x) of equally long vectors, as whole doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(vectors), -1)


@dataclass
class Ball:
    """A tree over points put in leaf order. Node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    ids: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least_id: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> Ball:
        with np.load(io.BytesIO(blob)) as arrays:
            return Ball(**{k: arrays[k] for k in arrays.files})


def build(ids: np.ndarray, points: np.ndarray) -> Ball:
    """Halve each ball along the line through two far points until ``LEAF_ROWS`` are left."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF_ROWS))))
    nodes = 2 ** (depth + 1) - 1
    order = np.arange(len(ids))
    begin, end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    centre, radius, least = np.zeros((nodes, points.shape[1])), np.zeros(nodes), np.full(nodes, NO_ID)
    end[0] = len(ids)
    for node in range(nodes):
        own = order[begin[node] : end[node]]
        if not len(own):
            continue
        some = points[own]
        centre[node] = some.mean(axis=0)
        away = some - centre[node]
        far = np.sqrt((away**2).sum(axis=1))
        radius[node], least[node] = far.max(), ids[own].min()
        if 2 * node + 2 < nodes:
            one = away[far.argmax()]
            other = away[((away - one) ** 2).sum(axis=1).argmax()]
            half = len(own) // 2
            order[begin[node] : end[node]] = own[np.argpartition(away @ (other - one), half)] if len(own) > 1 else own
            middle = begin[node] + half
            begin[2 * node + 1], end[2 * node + 1] = begin[node], middle
            begin[2 * node + 2], end[2 * node + 2] = middle, end[node]
    return Ball(ids[order], points[order], begin, end, centre, radius, least)


class Search:
    """The k best of each query of a block, over as many trees as are visited."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray, least_id: np.ndarray):
        self.ids, self.queries, self.k = ids, queries, k
        self.norm = np.sqrt((queries**2).sum(axis=1))
        self.score = np.full((len(ids), k), -LARGEST - 1, np.int64)
        self.found = np.full((len(ids), k), NO_ID, np.int64)
        self.least, self.least_id = least.copy(), least_id.copy()  # the k-th score to beat and its id

    def visit(self, tree: Ball) -> None:
        self.tree = tree
        if len(tree.ids):
            self.down(0, np.arange(len(self.ids)), self.bound(0, np.arange(len(self.ids))))

    def bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        """The largest inner product that a point of the ball can have, rounded up for floating point."""
        centre = self.queries[rows] @ self.tree.centre[node]
        reach = self.norm[rows] * self.tree.radius[node]
        size = np.linalg.norm(self.tree.centre[node]) + self.tree.radius[node]
        return np.floor(centre + reach + 1e-6 + 1e-9 * self.norm[rows] * size)

    def down(self, node: int, rows: np.ndarray, bound: np.ndarray) -> None:
        least = self.least[rows]
        open_ = (bound > least) | ((bound == least) & (self.tree.least_id[node] <= self.least_id[rows]))
        rows = rows[open_]
        if not len(rows):
            return
        left, right = 2 * node + 1, 2 * node + 2
        if right >= len(self.tree.begin):
            self.leaf(node, rows)
            return
        bounds = self.bound(left, rows), self.bound(right, rows)
        first = bounds[0] >= bounds[1]
        self.down(left, rows[first], bounds[0][first])
        self.down(right, rows[~first], bounds[1][~first])
        self.down(right, rows[first], bounds[1][first])
        self.down(left, rows[~first], bounds[0][~first])

    def leaf(self, node: int, rows: np.ndarray) -> None:
        tree = self.tree
        points, ids = tree.points[tree.begin[node] : tree.end[node]], tree.ids[tree.begin[node] : tree.end[node]]
        score = products(self.queries[rows], points)
        least, least_id = self.least[rows, None], self.least_id[rows, None]
        take = ((score > least) | ((score == least) & (ids <= least_id))) & (ids != self.ids[rows, None])
        at, column = np.nonzero(take)
        if not len(at):
            return
        changed = np.unique(at)
        old = np.repeat(changed, self.k)
        row = np.concatenate([old, at])
        all_scores = np.concatenate([self.score[rows[changed]].ravel(), score[at, column]])
        all_ids = np.concatenate([self.found[rows[changed]].ravel(), ids[column]])
        order = np.lexsort((all_ids, -all_scores, row))
        row, all_scores, all_ids = row[order], all_scores[order], all_ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.k  # every changed query has k places
        mine = rows[changed]
        self.score[mine] = all_scores[best].reshape(-1, self.k)
        self.found[mine] = all_ids[best].reshape(-1, self.k)
        worst, worst_id = self.score[mine, -1], self.found[mine, -1]
        better = (worst > self.least[mine]) | ((worst == self.least[mine]) & (worst_id < self.least_id[mine]))
        self.least[mine[better]], self.least_id[mine[better]] = worst[better], worst_id[better]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products: in doubles where all sums are exact, else in Python's integers."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -LARGEST, LARGEST).astype(np.int64)


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's ``k`` largest inner products, ties to the smaller id.

    Components become floor(scale * x). A vector that is NULL or holds NULL or a
    non-finite component takes no part, nor does a row without an id. Vectors of
    different lengths are not compared. Rows with the query's own id are not its
    candidates; a query has fewer than ``k`` rows if there are fewer candidates.
    Rows that repeat an id are candidates, and queries, each by themselves.
    Scores beyond 2**62 are held there. An empty table gives no rows.
    """
    x = F.col(f"`{vector_col}`")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & whole).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), x.cast("array<double>").alias("vector"), F.size(x).alias("width"), is_query.alias("asks"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "vectors")
    count, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-count // SHARD_ROWS)), max(1, -(-asking // QUERY_ROWS))
    groups = -(-shards // SHARDS_PER_TASK)

    def tree(table: pa.Table) -> pa.Table:
        ids, points = table["id"].to_numpy(), scaled(table["vector"].combine_chunks(), scale)
        return pa.table({"shard": table["shard"][:1], "width": table["width"][:1], "tree": pa.array([build(ids, points).dump()], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))
    trees = materialize(dealt.groupBy("shard", "width").applyInArrow(tree, "shard long, width int, tree binary"), "ball-trees")
    trees = trees.withColumn("part", F.pmod("shard", F.lit(groups)))
    asks = rows.where("asks").select("row", "id", "vector", "width", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("long").alias("block"))
    home = F.pmod("block", F.lit(groups))

    def search(queries: pa.Table, shards_: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids = queries["id"].to_numpy()
        state = Search(ids, scaled(queries["vector"].combine_chunks(), scale), k, queries["least"].to_numpy().copy(), queries["least_id"].to_numpy().copy())
        for blob in shards_["tree"]:
            state.visit(Ball.load(blob.as_py()))
        keep = state.found.ravel() != NO_ID
        return pa.table({
            "row": np.repeat(queries["row"].to_numpy(), k)[keep], "query_id": np.repeat(ids, k)[keep],
            "vec_id": state.found.ravel()[keep], "score": state.score.ravel()[keep],
        })

    def visit(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        return queries.groupBy("block", "part", "width").cogroup(pairs.groupBy("block", "part", "width")).applyInArrow(
            search, "row long, query_id long, vec_id long, score long"
        )

    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    pairs = trees.select("part", "width", "tree", every_block)  # each query block meets each shard once
    none = F.lit(-LARGEST - 1).cast("long").alias("least"), F.lit(int(NO_ID)).cast("long").alias("least_id")
    first = visit(asks.select("*", home.alias("part"), *none), pairs.where(F.col("part") == home))
    found = first
    if groups > 1:
        found = first = materialize(first, "first-group")
        best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))))  # k rows at most
        beat = first.groupBy("row").agg(best.alias("b")).select(
            "row",
            F.when(F.size("b") == k, -F.element_at("b", -1)["s"]).otherwise(none[0]).alias("least"),
            F.when(F.size("b") == k, F.element_at("b", -1)["v"]).otherwise(none[1]).alias("least_id"),
        )
        known = asks.join(beat, "row", "left").withColumns({"least": F.coalesce("least", none[0]), "least_id": F.coalesce("least_id", none[1])})
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
        rest = known.withColumn("part", others).where(F.col("part") != home)
        found = first.unionByName(visit(rest, pairs.where(F.col("part") != home)))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
