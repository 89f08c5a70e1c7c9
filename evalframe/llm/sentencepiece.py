"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is its bytes with a marker (a space) in front. No piece holds a marker
after another character, so the best segmentation falls apart at the start of
each run of markers: the distinct units between those places are segmented
once per slice of a task's rows, all of them side by side.

Encoding is lossless. A character without a piece becomes one byte piece per
UTF-8 byte; so does a literal U+2581, which stands for itself and not for a
space. Lone decoding errors become U+FFFD, control pieces decode to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.llm.common import binary_array, bound_batches, doc_bytes, text_slices, without
from evalframe.runtime import ship_by_value

ship_by_value(__name__)

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1 << 20  # bound of what is sent to every executor
MARKER = "▁"
UNKNOWN_PENALTY = 10.0  # below the lowest piece score, as in the public implementation
SIDE_BY_SIDE = 64  # bytes of the longest unit that is segmented together with others
BYTE = -2  # mark: this position is reached by a byte piece


@dataclass
class Vocabulary:
    """Pieces as bytes (markers as spaces), their log scores, and the trie over those that text can match."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @property
    def byte_score(self) -> float:
        return float(self.scores[np.isfinite(self.scores)].min()) - UNKNOWN_PENALTY


def load_vocabulary(path: str = MODEL_PATH, scores: str = "rank") -> Vocabulary:
    """Read a model file with byte fallback.

    ``scores="model"`` takes the file's log scores. A merge model has ranks
    there, no probabilities; ``"rank"`` turns the order of its scores into
    log probabilities by Zipf's law, log(1 / (rank * harmonic number)).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"a vocabulary of {n} pieces exceeds the bound of {MAX_PIECES}")
    names = [model.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int32)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    own = np.array([model.get_score(i) for i in plain], np.float64)
    return vocabulary({i: names[i] for i in plain}, dict(zip(plain, own if scores == "model" else zipf(own))), byte_ids, n)


def zipf(scores: np.ndarray) -> np.ndarray:
    rank = np.empty(len(scores), np.float64)
    rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
    return -np.log(rank) - np.log((1 / np.arange(1, len(scores) + 1)).sum())


def vocabulary(names: dict[int, str], scores: dict[int, float], byte_ids: np.ndarray, size: int) -> Vocabulary:
    pieces, by_id = [b""] * size, np.full(size, -np.inf)
    for i, name in names.items():
        if MARKER in name.lstrip(MARKER):
            raise ValueError(f"piece {i} has a marker after another character")
        pieces[i], by_id[i] = name.replace(MARKER, " ").encode(), scores[i]
    for byte, i in enumerate(byte_ids):
        pieces[i] = bytes([byte])
    return Vocabulary(pieces, by_id, byte_ids, *double_array({pieces[i]: i for i in names}))


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: state ``s`` goes on byte ``c`` to ``t = base[s] + c`` if ``check[t] == s``."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in keys.items():
        at = 0
        for c in key:
            to = children[at].get(c)
            if to is None:
                children.append({})
                ends.append(-1)
                to = children[at][c] = len(children) - 1
            at = to
        ends[at] = value
    room = 2 * len(children) + 1024
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    free = np.ones(room, bool)
    free[0] = False
    value[0] = ends[0]
    low, tail, queue = 257, 257, [(0, 0)]
    for node, state in queue:
        codes = sorted(children[node])
        if not codes:
            continue
        while not free[low]:
            low += 1
        start = low if len(codes) < 3 else max(low, tail - 1024)  # wide nodes go behind, narrow ones fill the gaps
        while True:
            slots = np.flatnonzero(free[start : start + 512]) + start - codes[0]
            slots = slots[(slots > 0) & (slots + 256 < room)]
            for c in codes[1:]:
                slots = slots[free[slots + c]]
            if len(slots):
                break
            start += 512
            if start + 4096 > room:
                base, value = (np.append(x, np.full(room, f, np.int32)) for x, f in ((base, 0), (value, -1)))
                check, free, room = np.append(check, np.full(room, -1, np.int32)), np.append(free, np.ones(room, bool)), 2 * room
        base[state] = slots[0]
        for c in codes:
            to = int(slots[0]) + c
            free[to], check[to], value[to] = False, state, ends[children[node][c]]
            queue.append((children[node][c], to))
        tail = max(tail, to)
    used = int(np.flatnonzero(~free)[-1]) + 1 + 256
    return base[:used].copy(), check[:used].copy(), value[:used].copy()


def char_lengths(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins with each byte; 0 inside a character."""
    return np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0], [1, 0, 2, 3], 4)


def segment(units: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all units end to end, and where each unit's begin (one more than units)."""
    data, bounds = doc_bytes(units)
    length = np.diff(bounds)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit numbers, counts, ids
    for number in np.flatnonzero(length > SIDE_BY_SIDE):
        ids = segment_one(data[bounds[number] : bounds[number + 1]].tobytes(), vocab)
        parts.append((np.array([number]), np.array([len(ids)]), np.array(ids, np.int32)))
    short = np.flatnonzero(length <= SIDE_BY_SIDE)
    short = short[np.argsort(length[short], kind="stable")]
    for at in range(0, len(short), 16384):
        some = short[at : at + 16384]
        parts.append((some, *segment_many(data, bounds[some], length[some], vocab)))
    counts = np.zeros(len(units), np.int64)
    for some, count, _ in parts:
        counts[some] = count
    starts = np.concatenate([[0], np.cumsum(counts)])
    ids = np.empty(starts[-1], np.int32)
    for some, count, own in parts:
        ids[ragged(starts[some], count)] = own
    return ids, starts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each stretch, one stretch after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def segment_many(data: np.ndarray, starts: np.ndarray, length: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of many short units: position by position, all units at once."""
    n, width = len(starts), int(length.max(initial=0))
    column = np.arange(width)
    inside = column < length[:, None]
    text = np.zeros((n, width), np.int32)
    text[inside] = data[ragged(starts, length)]
    chars = np.where(inside, char_lengths(text), 0)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    piece, back = np.full((n, width + 1), BYTE, np.int32), np.zeros((n, width + 1), np.int32)
    for i in range(width):
        begin = np.flatnonzero(chars[:, i])
        rows, state = begin, np.zeros(len(begin), np.int32)
        single = np.zeros(n, bool)
        for j in range(i, width):
            keep = inside[rows, j]
            rows, state = rows[keep], state[keep]
            to = vocab.base[state] + text[rows, j]
            keep = vocab.check[to] == state
            rows, state = rows[keep], to[keep]
            if not len(rows):
                break
            found = vocab.value[state]
            hit = np.flatnonzero(found >= 0)
            at, ids = rows[hit], found[hit]
            single[at[chars[at, i] == j + 1 - i]] = True
            score = best[at, i] + vocab.scores[ids]
            better = score > best[at, j + 1]
            at, ids = at[better], ids[better]
            best[at, j + 1], piece[at, j + 1], back[at, j + 1] = score[better], ids, i
        at = begin[~single[begin]]
        to = i + chars[at, i]
        score = best[at, i] + vocab.byte_score
        better = score > best[at, to]
        best[at[better], to[better]], piece[at[better], to[better]] = score[better], BYTE
    ids, count = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
    rows, at = np.flatnonzero(length > 0), length[length > 0].astype(np.int64)
    while len(rows):
        count[rows] += 1
        own = piece[rows, at]
        byte = own == BYTE
        ids[rows, width - count[rows]] = np.where(byte, vocab.byte_ids[text[rows, at - 1]], own)
        at = np.where(byte, at - 1, back[rows, at])
        rows, at = rows[at > 0], at[at > 0]
    return count, ids[np.arange(width) >= width - count[:, None]]


def segment_one(unit: bytes, vocab: Vocabulary) -> list[int]:
    """The same for one unit of any length."""
    n, base, check, value, scores = len(unit), vocab.base, vocab.check, vocab.value, vocab.scores
    best, piece, back = [-np.inf] * (n + 1), [BYTE] * (n + 1), [0] * (n + 1)
    best[0], i = 0.0, 0
    sizes = char_lengths(np.frombuffer(unit, np.uint8)).tolist()
    while i < n:
        state, single = 0, False
        for j in range(i, n):
            to = base[state] + unit[j]
            if check[to] != state:
                break
            state = to
            if value[state] >= 0:
                single |= j + 1 - i == sizes[i]
                score = best[i] + scores[value[state]]
                if score > best[j + 1]:
                    best[j + 1], piece[j + 1], back[j + 1] = score, int(value[state]), i
        to = i + sizes[i]
        if not single and best[i] + vocab.byte_score > best[to]:
            best[to], piece[to] = best[i] + vocab.byte_score, BYTE
        i = to
    ids = []
    while n:
        if piece[n] == BYTE:
            ids.append(int(vocab.byte_ids[unit[n - 1]]))
            n -= 1
        else:
            ids.append(piece[n])
            n = back[n]
    return ids[::-1]


def encode_texts(texts: pa.Array, vocab: Vocabulary) -> pa.ListArray:
    """Piece ids of each text; none for an empty text."""
    data, bounds = doc_bytes(texts)
    filled = np.flatnonzero(np.diff(bounds))
    heads = bounds[filled] + np.arange(len(filled))  # where each marker goes
    marked = np.empty(len(data) + len(filled), np.uint8)
    own = np.ones(len(marked), bool)
    own[heads] = False
    marked[own], marked[heads] = data, 0x20
    space = marked == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[heads] = True
    starts = np.flatnonzero(first)
    units = binary_array(marked, np.append(starts, len(marked))).dictionary_encode()
    ids, begin = segment(units.dictionary, vocab)
    codes = units.indices.to_numpy() if len(units) else np.zeros(0, np.int64)
    counts = np.diff(begin)[codes]
    tokens = ids[ragged(begin[:-1][codes], counts)]
    per_text = np.zeros(len(texts), np.int64)
    if len(filled):
        per_text[filled] = np.add.reduceat(counts, np.searchsorted(starts, heads))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), pa.array(tokens, pa.int32()))


def decode_ids(ids: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    """The text of each list of ids; NULL counts as no ids, and ids outside the vocabulary decode to nothing."""
    lengths = np.array([len(p) for p in vocab.pieces] + [0])
    flat, starts = b"".join(vocab.pieces), np.concatenate([[0], np.cumsum(lengths)])[:-1]
    pieces = np.frombuffer(flat, np.uint8)
    ids = ids.fill_null([]) if ids.null_count else ids
    bounds = ids.offsets.to_numpy().astype(np.int64)
    tokens = ids.values.fill_null(-1).to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    tokens = np.where((tokens < 0) | (tokens >= len(vocab.pieces)), len(vocab.pieces), tokens)
    count = lengths[tokens]
    data = pieces[ragged(starts[tokens], count)]
    ends = np.concatenate([[0], np.cumsum(count)])[bounds - bounds[0]]
    lead = ends[:-1][np.diff(ends) > 0]
    lead = lead[data[lead] == 0x20]  # the marker that encoding put in front
    kept = np.ones(len(data), bool)
    kept[lead] = False
    bounds = ends - np.searchsorted(lead, ends)
    raw = binary_array(data[kept], bounds)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())


def _with_column(df: DataFrame, vocab: Vocabulary, source: str, name: str, kind: T.DataType, fn, sliced: bool) -> DataFrame:
    bound_batches(df.sparkSession)
    rows = without(df, name)
    shipped = df.sparkSession.sparkContext.broadcast(vars(vocab))  # at most MAX_PIECES pieces

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(**shipped.value)
        for batch in text_slices(batches, source) if sliced else batches:
            yield batch.append_column(name, fn(batch.column(source), own))

    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def encode(df: DataFrame, vocab: Vocabulary, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the piece ids of its texts. NULL and empty texts have no ids; a column named ``out`` is replaced."""
    return _with_column(df, vocab, text_col, out, T.ArrayType(T.IntegerType(), False), encode_texts, True)


def decode(df: DataFrame, vocab: Vocabulary, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its piece ids."""
    return _with_column(df, vocab, ids_col, out, T.StringType(), decode_ids, False)


def round_trip(df: DataFrame, vocab: Vocabulary, text_col: str = "text") -> DataFrame:
    """Ids and decoded texts, and whether decoding gives the text (NULL as empty) again."""
    return decode(encode(df, vocab, text_col), vocab).withColumn("exact", F.col("decoded") == F.coalesce(F.col(text_col), F.lit("")))
