"""N-gram Jaccard join: documents whose sets of word shingles are similar, and the groups that links form.

1. Each document's set of shingle hashes is made once. Sets are dealt by hash to
   buckets, which keep the shingles that at least two different sets hold.
2. A set can only link with another if it shares most of its shingles, and then
   both hold a common shingle among their rarest ones (prefix filter, which
   loses no link). Sets that share such a shingle form candidate components.
3. In a component the shingles are hashed into groups. The counts per group are
   a point, points are indexed by an R-tree, and the sum of the coordinate
   minima bounds the overlap of a set with any set below a node. Pairs that
   survive are verified on the sets.

Sets equal to each other count as one throughout. Documents that are linked already
need no further proof, so the pairs of a large group of near copies are not
enumerated. High-dimensional count vectors can't tell unrelated documents of a
whole corpus apart by a tree alone, hence the lossless steps 1 and 2 before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import bound_batches, chain, connected_components, small, text_slices, word_hashes, words_of
from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

WORDS = 5
PERCENT = 75
BUCKET_SHINGLES = 1_000_000  # shingles that one task sorts
TILE_SHINGLES = 2_000_000  # shingles of a component that one task compares
LEAF = 8
HOT = 16  # sets of one slice that a bucket gets to know of a shingle at most; the others go by rows


def needed(a, b, percent: int):
    """The least overlap of linked sets of these sizes: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(texts: pa.Array, words: int, seed: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has one shingle of all of them."""
    tokens, counts = words_of(texts)
    hashes = word_hashes(tokens)
    ends = np.cumsum(counts)
    seeds = [chain(np.full(1, seed, np.uint64), np.full(1, n, np.uint64))[0] for n in range(words + 1)]
    whole = np.full(max(0, len(hashes) - words + 1), seeds[words], np.uint64)
    for k in range(words):
        whole = chain(whole, hashes[k : len(hashes) - words + 1 + k])
    out = []
    for begin, end in zip(ends - counts, ends):
        n = end - begin
        if n >= words:
            out.append(np.unique(whole[begin : end - words + 1]))
        elif n:
            one = np.full(1, seeds[n], np.uint64)
            for h in hashes[begin:end]:
                one = chain(one, np.full(1, h, np.uint64))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_rows(words: int, buckets: int, seed: int):
    """Per slice of texts a row per bucket: the sets' shingles in it, and some of the documents themselves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"), words, seed)
            marks = [xxhash.xxh3_128_digest(s.tobytes(), seed=seed) for s in sets]
            node = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2) if marks else np.zeros((0, 2), np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            docs = pa.StructArray.from_arrays(
                [batch.column("id"), pa.array(size), pa.array(node[:, 0]), pa.array(node[:, 1]), batch.column("text_hash")],
                ["id", "n", "node", "check", "text_hash"],
            )
            _, once = np.unique(node[:, 0], return_index=True)
            keys = np.concatenate([sets[i] for i in once]) if len(once) else np.zeros(0, np.uint64)
            owner = np.repeat(node[once, 0], size[once])
            hot_keys, hot_owner, cold = split_hot(keys, owner)
            keys, owner = keys[cold], owner[cold]
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # keeps the shingles of a set together
            keys, owner, bucket = keys[order], owner[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            share = np.linspace(0, len(docs), buckets + 1).astype(np.int64)  # documents ride along
            hot = np.linspace(0, len(hot_keys), buckets + 1).astype(np.int64)
            columns = {"bucket": [], "keys": [], "owners": [], "runs": [], "docs": [], "hot": []}
            for b in range(buckets):
                own = owner[cuts[b] : cuts[b + 1]]
                change = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                if not len(own) and share[b] == share[b + 1] and hot[b] == hot[b + 1]:
                    continue
                columns["bucket"].append(b)
                columns["keys"].append(keys[cuts[b] : cuts[b + 1]].tobytes())
                columns["owners"].append(own[change].tobytes())
                columns["runs"].append(np.diff(np.append(change, len(own))).astype(np.int32).tobytes())
                columns["docs"].append(docs[share[b] : share[b + 1]].to_pylist())
                columns["hot"].append(np.stack([hot_owner[hot[b] : hot[b + 1]], hot_keys[hot[b] : hot[b + 1]].view(np.int64)], axis=1).tobytes())
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema(
                [("bucket", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("runs", pa.binary()), ("docs", pa.list_(docs.type)), ("hot", pa.binary())]
            ))

    return rows


def split_hot(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries beyond the first ``HOT`` of a shingle in this slice, and which entries are left."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.arange(len(keys)) - np.searchsorted(ordered, ordered)
    cold = np.ones(len(keys), bool)
    cold[order[rank >= HOT]] = False
    return keys[~cold], owner[~cold], cold


ROW = "bucket long, keys binary, owners binary, runs binary, docs array<struct<id:long,n:long,node:long,check:long,text_hash:long>>, hot binary"
OUT = "id long, n long, node long, check long, text_hash long, key long"


def shared_shingles(table: pa.Table) -> pa.Table:
    """Of one bucket: its documents, and (node, key) of the shingles that two sets hold at least."""
    read = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    keys = read("keys", np.uint64)
    owner = np.repeat(read("owners", np.int64), read("runs", np.int32))
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])) if len(keys) else np.zeros(0, bool)
    keys, owner = keys[new], owner[new]
    same = np.append(keys[1:] == keys[:-1], False) if len(keys) else np.zeros(0, bool)
    shared = same | np.append(False, same[:-1]) if len(keys) else same
    hot = read("hot", np.int64).reshape(-1, 2)  # with HOT others in their slice, these are shared
    node, key = np.concatenate([owner[shared], hot[:, 0]]), np.concatenate([keys[shared].view(np.int64), hot[:, 1]])
    docs = pa.concat_arrays([c.flatten() for c in table["docs"].chunks]).flatten()
    none = pa.nulls(len(node), pa.int64())
    gone = pa.nulls(len(docs[0]), pa.int64())
    join = lambda a, b: pa.chunked_array([a, b])
    return pa.table({
        "id": join(docs[0], none), "n": join(docs[1], none), "node": join(docs[2], pa.array(node)),
        "check": join(docs[3], none), "text_hash": join(docs[4], none), "key": join(gone, pa.array(key)),
    })


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links lead to.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A row without words, or
    with a NULL text, has no shingles and links with nothing. Rows with equal sets
    are linked. Rows that repeat an id are one node of the graph if their sets are
    equal, else two. A NULL id counts as smaller than none: it is a component's id
    only if all its ids are NULL. An empty table gives no rows; other columns are
    not looked at. Shingles are compared by 64-bit hashes.
    """
    return grouped(df, id_col, text_col, words, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id")).alias("component_id")
    )


def grouped(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, text_hash, n, least) of every row; ``least`` is the (no_id, id, text_hash) of its component that comes first."""
    sets, entries = stored_sets(df, id_col, text_col, words)
    # one row per distinct set, however many copies it has
    nodes = sets.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("rep"), F.max("n").alias("n"))
    nodes = materialize(nodes, "distinct-sets")
    eligible = enough_shared(entries, nodes, percent)
    candidate = connected_components(candidate_edges(eligible, percent))
    linked = verified_edges(eligible, candidate, percent)
    group = connected_components(linked).withColumnRenamed("component", "root")
    named = group.join(nodes, "node").groupBy("root").agg(F.min("rep").alias("least"))
    names = materialize(group.join(named, "root").select(F.col("node").alias("in"), "least"), "component-names")
    names = nodes.join(names, nodes.node == F.col("in"), "left").select(F.col("node").alias("of"), F.coalesce("least", "rep").alias("least"))
    return sets.join(names, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left").select("id", "text_hash", "n", "least")


def stored_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """The documents (id, n, node, check, text_hash), and (node, key) of the shingles that several sets hold.

    ``node`` is a 64-bit and ``check`` another 64-bit hash of a set. Should two
    sets have the same node, the hashes are made anew with another seed.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-int(volume) // (6 * BUCKET_SHINGLES)))  # a word has about six bytes
    seed = 0
    while True:
        table = rows.mapInArrow(set_rows(words, buckets, seed), ROW).groupBy("bucket").applyInArrow(shared_shingles, OUT)
        table = materialize(table, "shingles")
        sets = table.where("n is not null").select("id", "n", "node", "check", "text_hash")
        if sets.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").isEmpty():
            return sets, table.where("n is null").select("node", "key")
        seed += 1


def enough_shared(entries: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, key, n, df) of sets that share enough shingles with others to link with any.

    A set of ``n`` shingles needs ``percent`` % of them in another set. What only
    other sets hold that can't link doesn't count, so the filter runs twice.
    """
    for _ in range(2):
        counts = entries.groupBy("node").agg(F.count("*").alias("c"))
        able = counts.join(nodes, "node").where(100 * F.col("c") >= percent * F.col("n")).select("node", "n")
        # a set whose copies lie in several slices may have come with a hot shingle twice
        entries = entries.select("node", "key").join(small(materialize(able, "able"), 24), "node").distinct()
        several = entries.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        entries = materialize(entries.join(several, "key"), "shared")
    return entries


def candidate_edges(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets that share a shingle among their rarest, as a star around the block's smallest set.

    A set of n shingles that links with another shares one of its first
    n - ceil(percent * n / 100) + 1 in any common order of shingles. The order is
    by how many sets hold a shingle, then by hash; those that no other holds come first.
    """
    n, own = F.col("n"), Window.partitionBy("node")
    prefix = n - F.ceil(percent * n / F.lit(100)) + 1
    ranked = entries.select(
        "node", "key", prefix.alias("prefix"), (n - F.count("*").over(own)).alias("alone"),
        F.row_number().over(own.orderBy("df", "key")).alias("rank"),
    )
    ranked = materialize(ranked.where("alone + rank <= prefix").select("node", "key"), "prefixes")
    hubs = ranked.groupBy("key").agg(F.min("node").alias("hub"))
    return ranked.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def verified_edges(entries: DataFrame, candidate: DataFrame, percent: int) -> DataFrame:
    """(a, b) of links, enough to connect what links connect.

    A component of more than ``TILE_SHINGLES`` shingles first compares all sets
    with one of them, its hub. Sets that link with the hub needn't be compared among
    each other; the rest meet all others tile by tile.
    """
    sized = entries.join(candidate.select("node", "component"), "node")
    weight = sized.groupBy("component").agg(F.count("*").alias("weight"))
    tiles = materialize(weight.select("component", F.ceil(F.col("weight") / TILE_SHINGLES).cast("int").alias("tiles")), "tiles")
    sets = sized.groupBy("component", "node", "n").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # one document's own shingles
    large = tiles.where("tiles > 1")
    if large.isEmpty():
        hub_edges = None
        sets = sets.withColumns({"tiles": F.lit(1), "linked": F.lit(False)})
    else:
        hubs = candidate.join(large, "component").groupBy("component").agg(F.min("node").alias("hub"))
        own = sized.join(large.select("component"), "component")
        hub = own.join(hubs, "component").where("node = hub").select("component", "key", "hub", F.col("n").alias("hub_n"))
        overlap = own.join(hub, ["component", "key"]).where("node <> hub").groupBy("node", "n", "hub", "hub_n").agg(F.count("*").alias("i"))
        enough = 100 * F.col("i") >= percent * (F.col("n") + F.col("hub_n") - F.col("i"))
        hub_edges = materialize(overlap.where(enough).select(F.col("node").alias("a"), F.col("hub").alias("b")), "hub-links")
        star = hub_edges.select(F.col("a").alias("node")).union(hub_edges.select("b")).distinct().withColumn("linked", F.lit(True))
        sets = sets.join(tiles, "component").join(star, "node", "left").fillna({"linked": False})
    # a linked set meets the tiles of sets that are not linked to the hub; those meet every tile
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    sets = sets.withColumn("tile", F.when(F.col("linked"), F.col("tiles") + tile).otherwise(tile))
    free = F.sequence(F.lit(0), F.col("tiles") - 1)
    every = F.sequence(F.lit(0), 2 * F.col("tiles") - 1)
    met = sets.withColumn("other", F.explode(F.when(F.col("linked"), free).otherwise(every))).where("tiles > 1 or other = 0")
    met = met.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
    found = met.groupBy("component", "i", "j").applyInArrow(linker(percent), "a long, b long")
    return found if hub_edges is None else found.union(hub_edges)


def linker(percent: int):
    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")  # which links connect the sets depends on their order
        keys = [np.asarray(k, np.int64) for k in table["keys"].combine_chunks().to_numpy(zero_copy_only=False)]
        a, b = links(keys, table["n"].to_numpy(), percent, np.asarray(table["linked"].to_pylist(), bool))
        node = table["node"].to_numpy()
        return pa.table({"a": node[a], "b": node[b]})

    return link


def group_counts(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """How many members of each set hash into each group."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (chain(np.concatenate(sets).view(np.uint64), np.uint64(1)) % np.uint64(groups)).astype(np.int64)
    return np.bincount(owner * groups + group, minlength=len(sets) * groups).reshape(len(sets), groups)


class Tree:
    """An R-tree in an array: node ``i`` covers a stretch of ``order`` and has children ``2i + 1``, ``2i + 2``."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(1, len(points)) / LEAF))))
        nodes = 2 ** (depth + 1) - 1
        self.order, self.begin, self.end = np.arange(len(points)), np.zeros(nodes, int), np.zeros(nodes, int)
        self.end[0] = len(points)
        self.high, self.size = np.zeros((nodes, points.shape[1])), np.zeros(nodes, int)
        for node in range(nodes):
            own = self.order[self.begin[node] : self.end[node]]
            if not len(own):
                continue
            self.high[node], self.size[node] = points[own].max(axis=0), size[own].min()
            if 2 * node + 2 < nodes:
                spread = np.ptp(points[own], axis=0)
                half = len(own) // 2
                self.order[self.begin[node] : self.end[node]] = own[np.argsort(points[own, spread.argmax()], kind="stable")]
                for child, cut in ((2 * node + 1, (self.begin[node], self.begin[node] + half)), (2 * node + 2, (self.begin[node] + half, self.end[node]))):
                    self.begin[child], self.end[child] = cut


def links(sets: list[np.ndarray], size: np.ndarray, percent: int, linked: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links that connect what all links of these sets connect. ``size`` counts members that no other set holds too.

    Sets marked ``linked`` are connected already and are not compared with each other.
    """
    n = len(sets)
    root = np.arange(n)
    if linked is not None and linked.any():
        root[linked] = np.flatnonzero(linked)[0]
    groups = int(2 ** np.clip(np.ceil(np.log2(max(1.0, float(np.median(size)) / 2))), 4, 10))
    points = group_counts(sets, groups)
    tree = Tree(points, size)
    a, b = [], []
    for q in range(n):
        stack = [0]
        while stack:
            node = stack.pop()
            members = tree.order[tree.begin[node] : tree.end[node]]
            members = members[(members > q) & (root[members] != root[q])]
            if not len(members):
                continue
            bound = np.minimum(points[q], tree.high[node]).sum()
            if bound < needed(int(size[q]), int(tree.size[node]), percent):
                continue
            if 2 * node + 2 < len(tree.begin):
                stack += [2 * node + 1, 2 * node + 2]
                continue
            bound = np.minimum(points[q], points[members]).sum(axis=1)
            for m in members[bound >= needed(size[q], size[members], percent)]:
                if root[m] != root[q]:
                    both = len(np.intersect1d(sets[q], sets[m], assume_unique=True))
                    if 100 * both >= percent * (size[q] + size[m] - both):
                        a.append(q)
                        b.append(int(m))
                        root[root == root[m]] = root[q]
    return a, b


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each group of linked rows: the one whose id names the group.

    Rows without words all stay. Rows that repeat an id are told apart by a hash of the
    text: of a group's texts under the id that stays one stays, and texts that don't link
    with the group are not touched by it. Rows equal in id and text stay or go together.
    """
    groups = materialize(grouped(df, id_col, text_col, words, percent), "components")
    key = F.struct("id", "text_hash")
    first = F.struct("least.id", "least.text_hash")
    drop = groups.where((F.col("n") > 0) & ~key.eqNullSafe(first)).select(key.alias("_drop")).distinct()
    own = F.struct(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`")))
    return df.join(small(drop, 32), own.eqNullSafe(F.col("_drop")), "left_anti")
