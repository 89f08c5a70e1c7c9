"""Removing passages that occur earlier in the corpus, found by difference-cover anchors.

A passage counts from ``window`` words on. In each document only the positions
whose place modulo a period is in a difference cover get an anchor, the hash of the
few words that begin there. The cover has every difference modulo the period, so
two equal windows of ``window`` words, wherever they begin, have a position in common
at which both have an anchor, and the anchors are equal. Anchors that occur once in
the corpus thus rule out every window around them.

A match is extended to whole windows without pairing the places that share an
anchor: windows around a repeated anchor are hashed as a whole, and of each hash
the first place in the corpus stays. Anchors only choose what is looked at; a chance
equality among their 48 bits costs work, not correctness. Windows are compared by 96
bits: over 10^13 windows (100 TB of text) two different ones are alike with a chance
of 1 in 1,000.

Texts are stored once, compressed, in chunks. A chunk sends the distinct hashes it
has to buckets of the hash space and gets bits back, so neither anchors nor windows
are rows of their own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from evalframe.llm.common import bound_batches, chain, mix, text_slices, word_hashes, words_of
from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

# A perfect difference set for each period; every difference modulo the period occurs in it.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LEAST_ANCHOR = 8  # words of an anchor, if the window leaves a choice
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 2_000_000
NO_ID = np.iinfo(np.int64).min  # a NULL id comes before all others
LANE = np.uint64(0xD6E8FEB86659FD93)
KEY_BITS = np.uint64(16)  # an anchor keeps the upper 48 of 64


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, words of an anchor): two equal windows hold a pair of equal anchors."""
    period = max((p for p in COVERS if window - p + 1 >= min(LEAST_ANCHOR, window)), default=1)
    return period, COVERS[period], window - period + 1


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each position on, made from those of powers of two of them."""
    result, taken, power, size = None, 0, words, 1
    while n:
        if n & 1:
            if result is None:
                result = power
            else:
                both = min(len(result), max(len(power) - taken, 0))
                result = chain(result[:both], power[taken : taken + both])
            taken += size
        n >>= 1
        if n:
            power = chain(power[: max(len(power) - size, 0)], power[size:])
            size *= 2
    return result


class Chunk:
    """Some documents in the order of their ids, as one array of words."""

    def __init__(self, blob: bytes, window: int):
        table = pa.ipc.open_stream(io.BytesIO(blob)).read_all().combine_chunks()
        self.ids, self.null = table["id"].fill_null(NO_ID).to_numpy(), table["id"].is_null().to_numpy()
        self.words, self.count = words_of(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.binary()), lower=False)
        self.hashes = word_hashes(self.words)
        self.end = np.cumsum(self.count)
        self.begin = self.end - self.count
        self.window = window
        self.period, cover, self.anchor_words = cover_of(window)
        at = np.arange(len(self.hashes)) - np.repeat(self.begin, self.count)  # a word's place in its document
        left = np.repeat(self.count, self.count) - at
        starts = np.isin(at % self.period, cover) & (left >= self.anchor_words) & np.repeat(self.count >= window, self.count)
        self.starts = np.flatnonzero(starts)
        self.whole = left >= window  # a window may begin here
        keys = window_hashes(self.hashes, self.anchor_words)[self.starts] >> KEY_BITS if len(self.starts) else np.zeros(0, np.uint64)
        self.keys, self.key_at, self.key_count = np.unique(keys, return_inverse=True, return_counts=True)

    @staticmethod
    def dump(ids: pa.Array, texts: pa.Array) -> bytes:
        order = np.argsort(ids.fill_null(NO_ID).to_numpy(), kind="stable")
        table = pa.table({"id": ids, "text": texts.cast(pa.binary())}).take(pa.array(order))
        out = io.BytesIO()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        return out.getvalue()

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows around repeated anchors: (first places, 96-bit hash in two parts), distinct, and the places that repeat one of them here."""
        marked = np.zeros(len(self.hashes) + self.period + 1, np.int64)
        marked[1 + self.starts[repeated[self.key_at]]] = 1
        before = np.cumsum(marked)
        near = before[self.period :][: len(self.hashes)] - before[: len(self.hashes)]
        at = np.flatnonzero(self.whole & (near > 0))
        one = window_hashes(self.hashes, self.window)[at] if len(at) else np.zeros(0, np.uint64)
        two = (window_hashes(mix(self.hashes ^ LANE), self.window)[at] if len(at) else one) >> np.uint64(32)
        order = np.lexsort((at, two, one))
        new = np.ones(len(at), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        first = np.sort(order[new])
        return at[first], one[first], two[first].astype(np.uint32), at[order[~new]]


def bucket_of(high: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its upper 32 of 48 or 64 bits given as 32."""
    return ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of equal values; only values that occur are visited."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    edges = [0, *cuts.tolist(), len(sorted_values)]
    return [(int(sorted_values[a]), a, b) for a, b in zip(edges[:-1], edges[1:]) if a < b]


def pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


CHUNKS = "chunk long, words long, blob binary"
ANCHORS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("again", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary())])
ANSWERS = "kind int, chunk long, bucket long, bits binary"
ANSWER = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


def into_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as compressed chunks; a text longer than a chunk is one by itself."""
    part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def chunk() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        texts = rows["text"].combine_chunks().fill_null("")
        words = int(words_of(texts, lower=False)[1].sum())
        blob = Chunk.dump(rows["id"].combine_chunks(), texts)
        return pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 32) + made], pa.int64()), "words": pa.array([words], pa.int64()), "blob": pa.array([blob], pa.binary())})

    for batch in text_slices(batches, size=CHUNK_BYTES):
        more = batch.column("text").nbytes
        if held and size + more > CHUNK_BYTES:
            yield chunk()
            made, held, size = made + 1, [], 0
        held.append(batch)
        size += more
    if held:
        yield chunk()


def send_anchors(window: int, buckets: int):
    """Per chunk and bucket: the sorted distinct anchors, and which of them occur in the chunk more than once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                chunk = Chunk(blob.as_py(), window)
                out = [
                    (b, number, pack_keys(chunk.keys[i:j]), np.packbits(chunk.key_count[i:j] > 1).tobytes())
                    for b, i, j in runs(bucket_of(chunk.keys >> np.uint64(16), buckets))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ANCHORS.types)] if out else [pa.array([], t) for t in ANCHORS.types], schema=ANCHORS)

    return rows


def answer(kind: int, table: pa.Table, hits: np.ndarray, sizes: list[int]) -> pa.Table:
    """Bits for each row of the bucket that has a hit."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    chunks, buckets = table["chunk"].to_pylist(), table["bucket"].to_pylist()
    out = [(kind, chunks[k], buckets[k], np.packbits(hits[i:j]).tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if hits[i:j].any()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ANSWER.types)] if out else [pa.array([], t) for t in ANSWER.types], schema=ANSWER)


def repeated_anchors(table: pa.Table) -> pa.Table:
    """A bucket's anchors that occur in two chunks, or twice in one."""
    keys = [unpack_keys(b.as_py()) for b in table["keys"]]
    sizes = [len(k) for k in keys]
    again = np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n) for b, n in zip(table["again"], sizes)])
    _, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    several = count > 1
    several[at[again > 0]] = True
    return answer(1, table, several[at], sizes)


def bits_of(answers: pa.Table, kind: int, buckets: np.ndarray) -> np.ndarray:
    """What the buckets said to the keys that were sent them, in the order of the keys."""
    said = np.zeros(len(buckets), bool)
    spans = {b: (i, j) for b, i, j in runs(buckets)}
    for k, bucket, bits in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
        if k == kind:
            i, j = spans[bucket]
            said[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
    return said


def candidates(chunk: Chunk, answers: pa.Table, buckets: int):
    """The distinct windows of a chunk around anchors that are repeated anywhere, ordered by bucket, then by place."""
    repeated = bits_of(answers, 1, bucket_of(chunk.keys >> np.uint64(16), buckets))
    at, one, two, again = chunk.windows(repeated)
    bucket = bucket_of(one >> np.uint64(32), buckets)
    order = np.argsort(bucket, kind="stable")
    return at[order], one[order], two[order], bucket[order], again


def send_windows(window: int, buckets: int):
    """Per chunk and bucket: the hashes of its candidate windows in the order of their places, and the ids they are in, by runs."""

    def rows(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if chunks.num_rows and answers.num_rows:
            chunk = Chunk(chunks["blob"][0].as_py(), window)
            at, one, two, bucket, _ = candidates(chunk, answers, buckets)
            doc = np.searchsorted(chunk.end, at, side="right")
            keys = np.concatenate([one.astype("<u8").view(np.uint8).reshape(-1, 8), two.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
            for b, i, j in runs(bucket):
                spans = runs(doc[i:j])
                ids = chunk.ids[[d for d, _, _ in spans]]
                length = np.array([y - x for _, x, y in spans], np.uint32)
                out.append((b, chunks["chunk"][0].as_py(), keys[i:j].tobytes(), ids.astype(np.int64).tobytes(), length.tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), WINDOWS.types)] if out else [pa.array([], t) for t in WINDOWS.types], schema=WINDOWS)

    return rows


def later_windows(table: pa.Table) -> pa.Table:
    """A bucket's windows that another document, or chunk of an equal id, has before."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint8).reshape(-1, 12)
    one, two = np.ascontiguousarray(keys[:, :8]).view("<u8").ravel(), np.ascontiguousarray(keys[:, 8:]).view("<u4").ravel()
    ids = [np.frombuffer(b.as_py(), np.int64) for b in table["ids"]]
    length = np.frombuffer(b"".join(table["runs"].to_pylist()), np.uint32)
    chunk = np.repeat(table["chunk"].to_numpy(), [len(i) for i in ids])
    place = np.empty(len(length), np.int64)
    place[np.lexsort((chunk, np.concatenate(ids)))] = np.arange(len(length))
    order = np.lexsort((np.repeat(place, length), two, one))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    return answer(2, table, later, [len(b.as_py()) // 12 for b in table["keys"]])


def remove(window: int, buckets: int):
    """A chunk's documents without the words of windows that occur before."""

    def rows(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(chunks["blob"][0].as_py(), window)
        gone = np.zeros(len(chunk.hashes) + 1, np.int64)
        if answers.num_rows:
            at, _, _, bucket, again = candidates(chunk, answers, buckets)
            starts = np.concatenate([at[bits_of(answers, 2, bucket)], again])
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
        kept = np.cumsum(gone)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(kept)])
        bounds = left[np.concatenate([[0], chunk.end])]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), chunk.words.filter(pa.array(kept)).cast(pa.string()))
        return pa.table({
            "id": pa.array(chunk.ids, pa.int64(), mask=chunk.null),
            "n_words": pa.array(chunk.count, pa.int64()),
            "n_removed": pa.array(chunk.count - np.diff(bounds), pa.int64()),
            "kept": pc.binary_join(lists, " "),
        })

    return rows


def drop_repeated_passages(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): each document without the passages that start earlier in the corpus.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they are. Every word goes that lies in a window of
    ``window`` words whose words also start earlier: in a document of smaller id, or
    before in the same one. Windows are judged on the input. ``kept`` are the words that
    stay, joined by one space. Ids are whole numbers; a NULL id comes first, and of rows
    that repeat an id one, by the place in the input, comes first and the others lose
    what it has. A NULL text has no words; texts shorter than a window stay whole. Any
    text length is handled, one text by one task. An empty table gives no rows; other
    columns are not looked at.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be a whole number: documents are ordered by it")
    bound_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chunks = materialize(rows.mapInArrow(into_chunks, CHUNKS), "chunks")
    words = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    period, cover, _ = cover_of(window)
    buckets = max(1, -(-words * len(cover) // period // BUCKET_KEYS))
    texts = chunks.select("chunk", "blob")
    anchors = texts.mapInArrow(send_anchors(window, buckets), "bucket long, chunk long, keys binary, again binary")
    repeated = materialize(anchors.groupBy("bucket").applyInArrow(repeated_anchors, ANSWERS), "repeated-anchors")
    whole = texts.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(
        send_windows(window, buckets), "bucket long, chunk long, keys binary, ids binary, runs binary"
    )
    later = materialize(whole.groupBy("bucket").applyInArrow(later_windows, ANSWERS), "later-windows")
    return texts.groupBy("chunk").cogroup(repeated.unionByName(later).groupBy("chunk")).applyInArrow(
        remove(window, buckets), "id long, n_words long, n_removed long, kept string"
    ).withColumnRenamed("id", id_col)
