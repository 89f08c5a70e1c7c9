"""Scoring texts by a language model with deleted interpolation.

p(word | previous) mixes the maximum-likelihood estimates of the word pair and
of the word with a uniform share. The weights depend on how often the previous word
occurs, in classes of powers of two. Expectation-maximisation learns them on a
part of the training texts that is deleted from the counts for it; the counts used to
score are those of all training texts.

Texts are cut into chunks. A chunk sends its distinct words and pairs, as sorted
64-bit hashes with counts, to the buckets of the hash space; a bucket adds up what
all chunks sent and answers each with the totals in the same order. So each
distinct pair of a chunk is shuffled once, however often it occurs there, and no
count table is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import bound_batches, chain, id_fold, text_slices, word_hashes, words_of
from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

FOLDS = 10  # fold 0 is held out
DELETED = 1  # the fold that the weights are learned on
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 2_000_000  # words and pairs that one task adds up
END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word is a space
STEPS = 4  # bins per power of two when estimates are gathered for learning
FLOOR = 0.1


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(chunk, deleted, rows): the rows of a slice of a task's input, those of the deleted fold apart."""
    at = 0
    for batch in text_slices(batches, size=CHUNK_BYTES):
        part = batch.column("part")[0].as_py()
        fold = batch.column("fold").to_numpy()
        for deleted in (False, True):
            rows = np.flatnonzero((fold == DELETED) == deleted)
            if len(rows):
                yield (part << 24) + 2 * at + deleted, deleted, batch.take(pa.array(rows))
        at += 1


class Tokens:
    """The words of a chunk's texts, each text followed by an end, which is also what comes before its first word."""

    def __init__(self, texts: pa.Array):
        words, counts = words_of(texts)
        self.length = counts + 1
        ends = np.cumsum(self.length) - 1
        self.word = np.full(int(self.length.sum()), END, np.uint64)
        inner = np.ones(len(self.word), bool)
        inner[ends] = False
        self.word[inner] = word_hashes(words)
        pair = chain(np.concatenate([[END], self.word[:-1]]).astype(np.uint64), self.word)
        self.words, self.at_word = np.unique(self.word, return_inverse=True)
        self.pairs, self.at_pair = np.unique(pair, return_inverse=True)
        self.starts = ends + 1 - self.length


def sent(buckets: int):
    """Per chunk, kind and bucket: the sorted keys and their counts in training texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, deleted, batch in chunk_rows(batches):
            tokens = Tokens(batch.column("text"))
            training = np.repeat(batch.column("fold").to_numpy() != 0, tokens.length)
            columns = {c: [] for c in ("bucket", "kind", "chunk", "deleted", "keys", "n")}
            for kind, keys, at in ((1, tokens.words, tokens.at_word), (2, tokens.pairs, tokens.at_pair)):
                n = np.bincount(at[training], minlength=len(keys)).astype(np.uint32)
                cuts = np.searchsorted(keys, bucket_starts(buckets))
                for b, (i, j) in enumerate(zip(cuts, np.append(cuts[1:], len(keys)))):
                    if i < j:
                        for name, value in zip(columns, (b, kind, chunk, deleted, keys[i:j].tobytes(), n[i:j].tobytes())):
                            columns[name].append(value)
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema(
                [("bucket", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("deleted", pa.bool_()), ("keys", pa.binary()), ("n", pa.binary())]
            ))

    return rows


def bucket_starts(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


SENT = "bucket long, kind int, chunk long, deleted boolean, keys binary, n binary"
TOTALS = "chunk long, kind int, bucket long, total binary, kept binary, distinct long, distinct_kept long, tokens long, tokens_kept long"


def totals(table: pa.Table) -> pa.Table:
    """Per chunk, the totals of the keys it sent: over all training texts, and without the deleted fold."""
    blobs = table["keys"].to_pylist()
    keys = [np.frombuffer(b, np.uint64) for b in blobs]
    sizes = [len(k) for k in keys]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.frombuffer(b"".join(table["n"].to_pylist()), np.uint32).astype(np.float64)
    deleted = np.repeat(np.array(table["deleted"].to_pylist(), bool), sizes)
    total = np.bincount(at, n, len(unique)).astype(np.int64)
    kept = total - np.bincount(at[deleted], n[deleted], len(unique)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    once = [1] + [0] * (len(sizes) - 1)  # what holds for the bucket stands in its first row
    whole = lambda x: pa.array([int(x) * o for o in once], pa.int64())
    blob = lambda x: pa.array([x[at[i:j]].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
    less = pa.array([kept[at[i:j]].tobytes() if deleted[i] else None for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.table({
        "chunk": table["chunk"], "kind": table["kind"], "bucket": table["bucket"], "total": blob(total), "kept": less,
        "distinct": whole((total > 0).sum()), "distinct_kept": whole((kept > 0).sum()), "tokens": whole(total.sum()), "tokens_kept": whole(kept.sum()),
    })


def texts_of(only_deleted: bool):
    """Texts with the chunk they are in, as ``sent`` cut them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, deleted, batch in chunk_rows(batches):
            if deleted or not only_deleted:
                yield pa.record_batch(
                    [pa.array(np.full(batch.num_rows, chunk)), batch.column("at"), batch.column("id"), batch.column("fold"), batch.column("text")],
                    ["chunk", "at", "id", "fold", "text"],
                )

    return rows


def estimates(texts: pa.Table, answers: pa.Table, column: str, n_tokens: int, vocabulary: int) -> tuple[pa.Table, Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's texts in order, its tokens, and per token: the word's count, the estimates by pair and by word, and the class."""
    texts = texts.sort_by("at")
    tokens = Tokens(texts["text"].combine_chunks())
    counts = {}
    for kind, keys in ((1, tokens.words), (2, tokens.pairs)):
        rows = answers.filter(pa.compute.equal(answers["kind"], kind)).sort_by("bucket")
        counts[kind] = np.frombuffer(b"".join(rows[column].to_pylist()), np.int64)
        if len(counts[kind]) != len(keys):
            raise ValueError("the texts were not read in the same order again; store them as a table first")
    word = counts[1][tokens.at_word]
    end = counts[1][np.searchsorted(tokens.words, END)]
    before = np.concatenate([[end], word[:-1]])
    by_pair = counts[2][tokens.at_pair] / np.maximum(before, 1)
    by_word = word / max(n_tokens, 1)
    return texts, tokens, word, by_pair, by_word, classes(before)


def classes(count: np.ndarray) -> np.ndarray:
    """0 for a word that was not seen, else one more than the whole part of the count's binary logarithm."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int32)


def evidence(n_tokens: int, vocabulary: int):
    """Per class, how many deleted tokens have which estimates (in bins, relative to the uniform share)."""

    def gather(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            none = pa.array([], pa.int32())
            return pa.table({"class": none, "pair": none, "word": none, "n": pa.array([], pa.int64())})
        _, _, _, by_pair, by_word, of = estimates(texts, answers, "kept", n_tokens, vocabulary)
        cells = np.stack([of, binned(by_pair * (vocabulary + 1)), binned(by_word * (vocabulary + 1))], axis=1)
        cells, n = np.unique(cells, axis=0, return_counts=True)
        return pa.table({"class": cells[:, 0], "pair": cells[:, 1], "word": cells[:, 2], "n": n})

    return gather


def binned(ratio: np.ndarray) -> np.ndarray:
    """Bins of a logarithm; -1000 for zero."""
    return np.where(ratio > 0, np.round(STEPS * np.log2(np.maximum(ratio, 1e-30))), -1000).astype(np.int32)


def learn_weights(cells: list[tuple[int, int, int, int]], rounds: int = 200) -> np.ndarray:
    """Weights (pair, word, uniform) of each class by expectation-maximisation.

    Classes without evidence get the weights of all evidence together; without any
    evidence all three weigh the same. The uniform share never falls to zero.
    """
    table = np.array(cells, np.float64).reshape(-1, 4)
    ratio = np.where(table[:, 1:3] > -1000, 2.0 ** (table[:, 1:3] / STEPS), 0.0)
    each = np.column_stack([ratio, np.ones(len(table))])
    n_classes = 66

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights = start
        for _ in range(rounds):
            share = each[rows] * weights
            share *= (table[rows, 3] / share.sum(axis=1))[:, None]
            weights = share.sum(axis=0) / share.sum()
        return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum()

    even = np.full(3, 1 / 3)
    pooled = fit(np.ones(len(table), bool), even) if len(table) else even
    out = np.tile(pooled, (n_classes, 1))
    for k in range(n_classes):
        rows = table[:, 0] == k
        if rows.any():
            out[k] = fit(rows, even)
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]  # a word never seen has no pairs
    return out


def scorer(weights: np.ndarray, n_tokens: int, vocabulary: int):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        texts, tokens, word, by_pair, by_word, of = estimates(texts, answers, "total", n_tokens, vocabulary)
        mixed = weights[of, 0] * by_pair + weights[of, 1] * by_word + weights[of, 2] / (vocabulary + 1)
        base = (word + FLOOR) / (n_tokens + FLOOR * (vocabulary + 1))
        add = lambda x: np.add.reduceat(x, tokens.starts)
        return pa.table({
            "id": texts["id"], "held_out": pa.array(texts["fold"].to_numpy() == 0), "n_tokens": pa.array(tokens.length, pa.int64()),
            "n_known": pa.array(add((word > 0).astype(np.int64))), "base_score": add(np.log10(base)), "score": add(np.log10(mixed)),
        })

    return score


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end.
    Rows whose crc32(id) modulo 10 is 0 are held out (a NULL id is), all others are
    learned from. ``base_score`` is by single words with 0.1 added to each count.
    Both are log10 probabilities of the whole text. A NULL text is an empty one and
    has just the end. Rows that repeat an id, or a text, count and score each by
    themselves. Without training rows all words are unknown. An empty table gives no
    rows; other columns are not looked at. ``df`` must read the same rows in the same
    order each time, as a table does; if it doesn't, a ValueError says so.
    """
    bound_batches(df.sparkSession)
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        id_fold(f"`{id_col}`", FOLDS).cast("int").alias("fold"), F.spark_partition_id().cast("long").alias("part"),
        F.monotonically_increasing_id().alias("at"),
    )
    volume = df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()[0]
    buckets = max(1, -(-int(volume) // (6 * BUCKET_KEYS)))  # a word has about six bytes
    answers = materialize(rows.mapInArrow(sent(buckets), SENT).groupBy("bucket", "kind").applyInArrow(totals, TOTALS), "ngram-totals")
    sums = answers.where("kind = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "distinct_kept", "tokens", "tokens_kept")]).first()
    text_schema = "chunk long, at long, id long, fold int, text string"
    shape = answers.select("chunk", "kind", "bucket", "total", "kept")
    deleted = rows.mapInArrow(texts_of(True), text_schema).groupBy("chunk").cogroup(shape.where("kept is not null").groupBy("chunk"))
    cells = deleted.applyInArrow(evidence(sums.tokens_kept, sums.distinct_kept), "class int, pair int, word int, n long")
    # classes and bins are few, whatever the size of the data
    cells = cells.groupBy("class", "pair", "word").agg(F.sum("n").alias("n")).orderBy("class", "pair", "word").collect()
    weights = learn_weights([tuple(c) for c in cells])
    scored = rows.mapInArrow(texts_of(False), text_schema).groupBy("chunk").cogroup(shape.groupBy("chunk")).applyInArrow(
        scorer(weights, sums.tokens, sums.distinct), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sums.tokens).cast("long").alias("train_tokens"), "base_score", "score")
