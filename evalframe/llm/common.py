"""What several operators share: column names, byte-level words, stable hashes, components.

All operators follow the same rules for odd inputs: a NULL text counts as an
empty text, a NULL id is an id like any other, and an input column named like
a column the operator adds is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

SLICE_BYTES = 1 << 20  # text a task holds as arrays at a time
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Let a join broadcast ``df`` if it is small. Its rows are counted; a larger one joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python in batches of at most ``BATCH_BYTES``, or one row.

    By default a batch holds up to 64 MB, which the sending and the receiving side
    hold more than once; texts are worked on in slices of 1 MB anyway.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower()  # a plain number of bytes, or one with a unit
    if not (now.rstrip("b").isdigit() and int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a NULL id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``size`` bytes of text, or one row."""
    for batch in batches:
        _, bounds = doc_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def doc_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each begins (one more than texts)."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.binary())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Byte strings that lie end to end in ``data``."""
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+``, by default with A-Z lower-cased, and how many each text has."""
    data, bounds = doc_bytes(texts)
    inside = ~BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    packed = np.cumsum(inside, dtype=np.int32)
    total = int(packed[-1]) if len(packed) else 0
    ends = np.append(packed[starts] - 1, total) if len(starts) else np.zeros(1, np.int64)
    kept = data[inside]
    return binary_array(LOWER[kept] if lower else kept, ends), np.diff(np.searchsorted(starts, bounds))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    coded = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return hashes[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits."""
    values = (values ^ (values >> np.uint64(30))) * MIX[1]
    values = (values ^ (values >> np.uint64(27))) * MIX[2]
    return values ^ (values >> np.uint64(31))


def chain(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of all but its last part and that part's hash."""
    return mix(first * MIX[0] + then)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that edges (a, b) lead to.

    Labels travel along edges and then jump to their label's label, so the
    number of rounds grows with the logarithm of the longest path for the
    star-like edges the operators make. Each round is a stored table. Both directions
    of an edge come from one row: edges that are computed twice needn't be the same.
    """
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = materialize(edges.select(F.inline(F.array(there, back))), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        heard = edges.join(labels, edges.b == labels.node).select(F.col("a").alias("node"), "component")
        lower = labels.union(heard).groupBy("node").agg(F.min("component").alias("component"))
        lower = materialize(lower, "labels")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = lower.join(up, "component").select("node", F.col("next").alias("component"))
        jumped = materialize(jumped, "labels")
        before = labels.select("node", F.col("component").alias("old"))
        if jumped.join(before, "node").where("component <> old").isEmpty():
            return jumped
        labels = jumped
