"""Grouping spelling variants: words one edit apart, found in k-d trees over letter counts.

A word's point holds how often each letter occurs in it. Replacing a letter moves one
count up by one and another down by one, inserting one moves one count up; so words
one edit apart are at an L1 distance of two at most, and a box of points can be left
out if the query is outside it by more than one upwards or by more than one (an
insertion: at all) downwards. Whether the letters of two points that are left also
are in the right order is then looked up in the words.

Words are dealt to shards by a tree of the same kind for each length, learned on a bounded
sample; a shard larger than expected is cut into blocks. A word is a member of one
shard, and a query in those others that its reach overlaps: of its own length those
after its own, so that a pair is met once, and of the length plus one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import bound_batches
from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"
SHARD_WORDS = 16_384  # members that one task puts into a tree
SAMPLE_WORDS = 1 << 18  # words that the shards' borders are learned on
SAMPLED_PER_SHARD = 64  # at least, so that borders are about where they would be for all words
LEAF_WORDS = 24
DIMENSIONS = 32  # 26 letters, all others in six groups: a count of a group moves no more than its letters'
COMPARED = 1 << 21  # letters that are compared at a time
MEMBER, SAME, SHORTER = 0, 1, 2  # what a row is to its shard: in the tree, a query, a query of one letter less
NONE = np.iinfo(np.int64).max


def letters_of(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """How often each letter, or group of letters, occurs in each word."""
    plain = (letters >= 97) & (letters <= 122)
    column = np.where(plain, letters - 97, 26 + letters % (DIMENSIONS - 26)).astype(np.int64)
    place = column + DIMENSIONS * np.arange(len(letters))[:, None]
    return np.bincount(place.ravel(), minlength=DIMENSIONS * len(letters)).reshape(-1, DIMENSIONS).astype(np.int32)


@dataclass
class Borders:
    """A k-d tree that only says where it is cut: node -> (dimension, largest count on the left, left, right), or a leaf's number."""

    cuts: list[tuple[int, int, int, int] | int] = field(default_factory=list)
    leaves: int = 0

    @staticmethod
    def learn(points: np.ndarray, most: float) -> Borders:
        """Cut until a leaf has at most ``most`` points, or none of its points differ."""
        self = Borders()

        def add(own: np.ndarray) -> int:
            node = len(self.cuts)
            self.cuts.append(self.leaves)
            cut = middle(points[own]) if len(own) > most else None
            if cut is None:
                self.leaves += 1
                return node
            left = points[own, cut[0]] <= cut[1]
            self.cuts[node] = (*cut, add(own[left]), add(own[~left]))
            return node

        add(np.arange(len(points)))
        return self

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        leaf = np.zeros(len(points), np.int64)
        open_ = [(0, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            cut = self.cuts[node]
            if isinstance(cut, int):
                leaf[rows] = cut
            elif len(rows):
                left = points[rows, cut[0]] <= cut[1]
                open_ += [(cut[2], rows[left]), (cut[3], rows[~left])]
        return leaf

    def within(self, points: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows): the leaves each point reaches by one step up and ``down`` steps down."""
        none = np.zeros(len(points), np.int32)
        open_ = [(0, np.arange(len(points)), none, none, {})]
        while open_:
            node, rows, up, low, box = open_.pop()
            if not len(rows):
                continue
            cut = self.cuts[node]
            if isinstance(cut, int):
                yield cut, rows
                continue
            dim, most, left, right = cut
            least, largest = box.get(dim, (None, None))
            own = points[rows, dim]
            before = 0 if largest is None else np.maximum(own - largest, 0)
            lower = low - before + np.maximum(own - most, 0)
            keep = lower <= down
            open_.append((left, rows[keep], up[keep], lower[keep], {**box, dim: (least, most)}))
            before = 0 if least is None else np.maximum(least - own, 0)
            upper = up - before + np.maximum(most + 1 - own, 0)
            keep = upper <= 1
            open_.append((right, rows[keep], upper[keep], low[keep], {**box, dim: (most + 1, largest)}))


def middle(points: np.ndarray) -> tuple[int, int] | None:
    """The dimension in which points differ most, and a count that halves them; None if they are equal."""
    spread = points.var(axis=0)
    dim = int(spread.argmax())
    if spread[dim] == 0:
        return None
    values, n = np.unique(points[:, dim], return_counts=True)
    return dim, int(values[np.abs(np.cumsum(n)[:-1] - len(points) / 2).argmin()])


class Tree:
    """A k-d tree over the counts of a block's members, with the box of the points of each node."""

    def __init__(self, counts: np.ndarray):
        self.order = np.arange(len(counts))
        self.nodes: list[tuple] = []  # (from, to, least counts, largest counts, left, right)
        self.grow(counts, 0, len(counts))

    def grow(self, counts: np.ndarray, begin: int, end: int) -> int:
        own = self.order[begin:end]
        node, points = len(self.nodes), counts[own]
        box = points.min(axis=0), points.max(axis=0)
        self.nodes.append((begin, end, *box, -1, -1))
        cut = middle(points) if end - begin > LEAF_WORDS else None
        if cut is not None:
            left = points[:, cut[0]] <= cut[1]
            self.order[begin:end] = np.concatenate([own[left], own[~left]])
            half = begin + int(left.sum())
            self.nodes[node] = (begin, end, *box, self.grow(counts, begin, half), self.grow(counts, half, end))
        return node

    def search(self, queries: np.ndarray, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, members) of the leaves that queries can't be ruled out for."""
        open_ = [(0, np.arange(len(queries)))]
        while open_:
            node, rows = open_.pop()
            begin, end, least, largest, left, right = self.nodes[node]
            points = queries[rows]
            near = (np.maximum(least - points, 0).sum(axis=1) <= 1) & (np.maximum(points - largest, 0).sum(axis=1) <= down)
            rows = rows[near]
            if not len(rows):
                continue
            if left < 0:
                yield rows, self.order[begin:end]
            else:
                open_ += [(left, rows), (right, rows)]


def one_edit(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which words are one replaced letter, or one letter more in the member, apart: queries by members."""
    if queries.shape[1] == members.shape[1]:
        return (queries[:, None] != members[None]).sum(axis=2) == 1
    before, after = queries[:, None] == members[None, :, :-1], queries[:, None] == members[None, :, 1:]
    near = (before | after).all(axis=2)  # needed, not yet enough: first the one, from some letter on the other
    at = np.nonzero(near)
    head = np.cumprod(before[at], axis=1, dtype=np.int32).sum(axis=1)
    tail = np.cumprod(after[at][:, ::-1], axis=1, dtype=np.int32).sum(axis=1)
    near[at] = head + tail >= queries.shape[1]
    return near


def pairs(queries: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) one edit apart; both are the letters of words, the queries of as many letters or one less."""
    down = 1 if queries.shape[1] == members.shape[1] else 0
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, COMPARED // (LEAF_WORDS * max(1, members.shape[1])))
    for rows, own in Tree(counts_of(members)).search(counts_of(queries), down):
        for at in range(0, len(rows), step):
            for first in range(0, len(own), LEAF_WORDS):  # equal points may be more than a leaf holds
                some, part = rows[at : at + step], own[first : first + LEAF_WORDS]
                a, b = np.nonzero(one_edit(queries[some], members[part]))
                found.append((some[a], part[b]))
    return tuple(np.concatenate(x) for x in zip(*found))


NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_in_block(table: pa.Table) -> pa.Table:
    """Per word of a block that has near words there: how many, and the one of largest n (ties: the smallest)."""
    role, words, n = table["role"].to_numpy(), table["word"].to_pylist(), table["n"].to_numpy()
    length = table["length"][0].as_py()
    member, same, shorter = (np.flatnonzero(role == r) for r in (MEMBER, SAME, SHORTER))
    empty = pa.Table.from_arrays([pa.array([], t) for t in NEAR.types], schema=NEAR)
    if not len(member):
        return empty
    letters = letters_of([words[i] for i in member], length)
    both = np.concatenate([member, same])
    a, b = pairs(letters_of([words[i] for i in both], length), letters)
    once = (a >= len(member)) | (a < b)  # two members are met from either side
    a, b = [both[a[once]]], [member[b[once]]]
    if len(shorter):
        c, d = pairs(letters_of([words[i] for i in shorter], length - 1), letters)
        a, b = a + [shorter[c]], b + [member[d]]
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return empty
    of, to = np.concatenate([a, b]), np.concatenate([b, a])
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[to], -n[to], of))
    own, first, count = np.unique(of[order], return_index=True, return_counts=True)
    best = to[order][first]
    return pa.Table.from_arrays(
        [pa.array([words[i] for i in own], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[i] for i in best], pa.string())],
        schema=NEAR,
    )


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(length, words, n, counts) of the words of each length of a batch."""
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        length = np.fromiter(map(len, words), np.int64, len(words))
        for own in np.unique(length).tolist():
            at = np.flatnonzero(length == own)
            some = [words[i] for i in at]
            yield own, some, n[at], counts_of(letters_of(some, own))


def members_of(borders: dict[int, Borders]):
    """(length, leaf) of each word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, words, _, counts in by_length(batches):
            leaf = borders[length].home(counts) if length in borders else np.zeros(len(words), np.int64)
            yield pa.RecordBatch.from_pydict({"length": pa.array(np.full(len(words), length, np.int32)), "leaf": pa.array(leaf)})

    return rows


def routed(borders: dict[int, Borders], blocks: dict[tuple[int, int], int]):
    """Each word as a member of its block, and as a query of all blocks that can hold a near word that isn't met otherwise."""
    plain = Borders([0], 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, words, n, counts in by_length(batches):
            home = borders.get(length, plain).home(counts)
            block = np.fromiter((sum(w.encode()) for w in words), np.int64, len(words))
            out = []

            def send(at: np.ndarray, of_length: int, leaf: int, to_block: int, role: int) -> None:
                if len(at):
                    out.append((at, of_length, leaf, to_block, role))

            for leaf in np.unique(home).tolist():
                own, several = np.flatnonzero(home == leaf), blocks[length, leaf]
                for b in range(several):
                    send(own[block[own] % several == b], length, leaf, b, MEMBER)
                    send(own[block[own] % several < b], length, leaf, b, SAME)
            for of_length, role, down in ((length, SAME, 1), (length + 1, SHORTER, 0)):
                for leaf, at in borders.get(of_length, plain).within(counts, down):
                    at = at[home[at] < leaf] if role == SAME else at
                    for b in range(blocks.get((of_length, leaf), 0)):
                        send(at, of_length, leaf, b, role)
            text = pa.array(words, pa.string())
            for at, of_length, leaf, b, role in out:
                fixed = [pa.array(np.full(len(at), x, t)) for x, t in ((of_length, np.int32), (leaf, np.int64), (b, np.int64), (role, np.int32))]
                yield pa.RecordBatch.from_arrays([*fixed, text.take(pa.array(at)), pa.array(n[at])], names=["length", "leaf", "block", "role", "word", "n"])

    return rows


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones; ``words`` is a stored table of distinct (word, n)."""
    total = words.count()
    every = max(1, -(-total // SAMPLE_WORDS))
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word", "n").toArrow()
    most = max(SAMPLED_PER_SHARD, SHARD_WORDS * sample.num_rows / max(total, 1)) if every > 1 else SHARD_WORDS
    points: dict[int, list[np.ndarray]] = {}
    for length, _, _, counts in by_length(iter(sample.to_batches())):
        points.setdefault(length, []).append(counts)
    borders = {length: Borders.learn(np.concatenate(p), most) for length, p in points.items()}
    # a row per shard: SAMPLE_WORDS / SAMPLED_PER_SHARD of them, and one for each further length
    sizes = words.mapInArrow(members_of(borders), "length int, leaf long").groupBy("length", "leaf").count().collect()
    blocks = {(r.length, r.leaf): -(-r["count"] // SHARD_WORDS) for r in sizes}
    sent = words.mapInArrow(routed(borders, blocks), "length int, leaf long, block long, role int, word string, n long")
    found = sent.groupBy("length", "leaf", "block").applyInArrow(near_in_block, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): where following the forms ends.

    Each round doubles the steps that are taken; a form's n is a multiple of its word's, so there are few.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return reached


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5, typo_every: int | None = None
) -> DataFrame:
    """(word, n): the runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, by how often they occur.

    With ``typo_every``, a run whose unsigned crc32 of ``<id>:<run>`` that number divides loses its code point at
    the crc modulo its length: misspellings for tests. NULL ids are written as nothing, NULL texts have no words.
    """
    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER_CASE)
    runs = df.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("word"))
    runs = runs.where(F.length("word") >= least_letters)
    if typo_every is not None:
        crc = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("crc") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("crc", crc).select(F.when(F.col("crc") % typo_every == 0, less).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.length("word") >= least_letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row (word, n) of ``words``.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of largest n, ties to the smallest in code-point order, if that n is at least ``ratio``
    (2 or more) times its own; the root is reached by following forms. Rows of one word are added up
    first; a NULL word or n is left out. Words of any length are compared, the empty word with those of one
    letter. An empty table gives no rows; other columns are not looked at.
    """
    if ratio < 2:
        raise ValueError("a form must occur more often than its word")
    bound_batches(words.sparkSession)
    words = words.where("word is not null and n is not null").groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n"))
    words = materialize(words, "words")
    if words.isEmpty():
        nothing = F.lit(None).cast("string")
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), nothing.alias("form"), F.col("n").alias("form_n"), nothing.alias("root"))
    near = words.join(near_words(words), "word", "left")
    own = F.col("best_n") >= ratio * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(own, F.col("best")).alias("form"), F.when(own, F.col("best_n")).alias("form_n"))
    near = materialize(near, "near-words")
    ends = roots(near.where("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_groups(df: DataFrame, ratio: int = 5, **counting) -> DataFrame:
    """The variants among the words of a table of texts; ``counting`` are options of ``word_counts``."""
    return spelling_variants(word_counts(df, **counting), ratio)
