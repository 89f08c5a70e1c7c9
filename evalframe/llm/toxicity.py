"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits and signs that stand for
letters) and matched by an Aho-Corasick automaton whose terms are words and
beginnings of words. Each word counts its heaviest term unless an exception
phrase covers it; the sum, as it is and per words of the text, gives the score.

Terms, weights, exceptions and the score's scale are learned from labelled
texts: terms and exceptions from one part, the scale from another.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.llm.common import bound_batches, id_fold, small, text_slices, without
from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

# fixed values: letters and signs that look like a Latin letter
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ſ": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
}
FOLD = str.maketrans(LOOK_ALIKES)
# fixed values: signs that stand for a letter, but only before one: at the end of a word they are punctuation
SIGNS = str.maketrans({"@": "a", "$": "s", "!": "i", "€": "e"})
BEFORE_LETTER = re.compile(r"(?:(?<=\w)[@$!€]+|(?<!\w)[@$€])(?=[^\W\d_])")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
NOT_WORD = re.compile(r"[\W_]+")
BEGINNINGS = (4, 5, 6, 7)
FIT_ROWS = 20_000  # labelled rows that are learned from, at most (about)
LEAST_TEXTS = 3  # labelled texts that a term or an exception must occur in
MOST_TERMS = 1_000_000  # significant terms, or exceptions; more raise
SURE = 1.64  # standard errors that a log odds ratio is lowered by
SURPRISE = 24.0  # least G statistic of a term: chance in one of a million, as about so many terms are looked at


def fold(text: str) -> str:
    """Words in folded letters between single spaces, with a space at either end."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", INVISIBLE.sub("", low))
    low = BEFORE_LETTER.sub(lambda m: m[0].translate(SIGNS), low)
    return f" {NOT_WORD.sub(' ', low.translate(FOLD)).strip()} "


@dataclass
class Lexicon:
    """Terms begin with a space and whole words end with one; exceptions have a space at both ends."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    scale: tuple[float, float, float] = (0.0, 0.0, 0.0)  # constant, log sum per 100 words, log sum

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        if len(machine):
            machine.make_automaton()
        return machine


def matches(folded: str, machine) -> dict[int, float]:
    """Where words with a term begin, with the heaviest weight, less those inside an exception phrase."""
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    if len(machine):
        for end, (size, weight) in machine.iter(folded):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
    if not excused:
        return found
    excused.sort()
    kept, here, covered = {}, 0, -1  # both lists are in order: one pass over each
    for at in sorted(found):
        while here < len(excused) and excused[here][0] <= at:
            covered, here = max(covered, excused[here][1]), here + 1
        if at >= covered:
            kept[at] = found[at]
    return kept


def measure(text: str | None, machine) -> tuple[float, int]:
    folded = fold(text or "")
    return sum(matches(folded, machine).values()), max(1, folded.count(" ") - 1)


def inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(100 * weight / words), np.log1p(weight)], axis=1)


def learn(docs: DataFrame, labels: DataFrame, fit: Column, calibrate: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn a lexicon from the labelled rows that ``fit`` and ``calibrate`` (over the id) choose.

    About ``fit_rows`` labelled ids at most, chosen by a hash of the id, are
    learned from; that bounds what is broadcast and collected. An id with
    several labels has the highest. Copies of a text count once. Every term that occurs in
    ``LEAST_TEXTS`` of them and is surely commoner in toxic texts (``SURPRISE``) is taken. Without labels of
    both kinds the lexicon is empty and every score is the share of label 1.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    known = known.select(id_col, "_y", F.when(fit, 0).when(calibrate, 1).alias("_part")).where("_part is not null")
    known = materialize(known, "labelled")
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("text")).join(small(known, 24), id_col)
    once = rows.groupBy(F.xxhash64("text").alias("_h")).agg(F.min(id_col).alias(id_col)).select(id_col)
    rows = materialize(rows.join(small(once, 16), id_col), "labelled-texts")  # fit_rows texts

    counts = rows.where("_part = 0").mapInArrow(count_terms, "term string, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = rows.where("_part = 0").agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("t"), F.coalesce(F.sum(1 - F.col("_y")), F.lit(0)).alias("c")).first()
    lexicon = Lexicon()
    if sizes.t and sizes.c:
        odds = log_odds(F.col("toxic"), F.col("clean"), sizes.t, sizes.c)
        sure = (F.col("toxic") >= LEAST_TEXTS) & (surprise(F.col("toxic"), F.col("clean"), sizes.t, sizes.c) >= SURPRISE)
        best = counts.where(sure).select("term", odds.alias("weight")).where("weight > 0")
        lexicon.terms = {r.term: r.weight for r in all_of(best)}
        chosen = rows.sparkSession.sparkContext.broadcast(vars(lexicon).copy())  # at most MOST_TERMS terms
        phrases = rows.where("_part = 0").mapInArrow(lambda b: count_phrases(b, Lexicon(**chosen.value)), "term string, toxic long, clean long")
        phrases = phrases.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        harmless = phrases.where(F.col("clean") >= LEAST_TEXTS).select("term", log_odds(F.col("clean"), F.col("toxic"), sizes.c, sizes.t).alias("weight"))
        lexicon.exceptions = [r.term for r in all_of(harmless.where("weight > 0"))]
    shipped = rows.sparkSession.sparkContext.broadcast(vars(lexicon).copy())
    measured = rows.where("_part = 1").mapInArrow(lambda b: measure_rows(b, Lexicon(**shipped.value)), "_y int, weight double, words long").toPandas()
    lexicon.scale = logistic(inputs(measured["weight"].to_numpy(float), measured["words"].to_numpy(float)), measured["_y"].to_numpy(float))
    return lexicon


def surprise(own: Column, other: Column, n_own: int, n_other: int) -> Column:
    """The G statistic of a term's counts in texts of both labels: twice the log likelihood ratio against equal shares."""
    share = (own + other) / F.lit(n_own + n_other)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    cells = [(own, n_own * share), (other, n_other * share), (n_own - own, n_own * (1 - share)), (n_other - other, n_other * (1 - share))]
    return 2 * sum((part(seen, expected) for seen, expected in cells), F.lit(0.0))


def all_of(terms: DataFrame) -> list:
    """All rows (term, weight) in order: what is significant in ``FIT_ROWS`` texts. None are left out: too many raise."""
    rows = terms.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} significant terms: learn from fewer or shorter texts")
    return sorted(rows, key=lambda r: (-r.weight, r.term))


def log_odds(own: Column, other: Column, n_own: int, n_other: int) -> Column:
    """Log odds ratio of a term in texts of one label against the other, less ``SURE`` standard errors."""
    a, b, c, d = own + 0.5, n_own - own + 0.5, other + 0.5, n_other - other + 0.5
    return F.log(a / b) - F.log(c / d) - SURE * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either label each word, and each beginning of one, occurs."""
    for batch in text_slices(batches):
        seen = Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("_y").to_pylist()):
            words = set(fold(text).split())
            seen[bool(y)].update({f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n})
        yield counted(seen)


def count_phrases(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """The same for pairs of neighbouring words of which one has a term."""
    machine = lexicon.automaton()
    for batch in text_slices(batches):
        seen = Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("_y").to_pylist()):
            folded, phrases = fold(text), set()
            for at in matches(folded, machine):
                end = folded.index(" ", at + 1)
                if at:
                    phrases.add(folded[folded.rindex(" ", 0, at) : end + 1])
                if end + 1 < len(folded):
                    phrases.add(folded[at : folded.index(" ", end + 1) + 1])
            seen[bool(y)].update(phrases)
        yield counted(seen)


def counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = sorted(seen[0].keys() | seen[1].keys())
    columns = pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())
    return pa.record_batch(list(columns), ["term", "toxic", "clean"])


def measure_rows(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    machine = lexicon.automaton()
    for batch in batches:
        pairs = [measure(t, machine) for t in batch.column("text").to_pylist()]
        yield pa.record_batch(
            [batch.column("_y"), pa.array([w for w, _ in pairs], pa.float64()), pa.array([n for _, n in pairs], pa.int64())], ["_y", "weight", "words"]
        )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method; the constant is not shrunk.

    A step that would raise the loss is halved until it doesn't: where the inputs all but separate the labels,
    whole steps lead ever farther away.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    if 0 < y.sum() < len(y):
        shrink = np.diag([1e-9, ridge, ridge])
        loss = lambda w: np.logaddexp(0, (1 - 2 * y) * (x @ w)).sum() + w @ shrink @ w / 2
        for _ in range(200):
            p = np.exp(-np.logaddexp(0, -(x @ w)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
            before = loss(w)
            while loss(w + step) > before and np.abs(step).max() >= 1e-9:
                step = step / 2
            if np.abs(step).max() < 1e-9:
                break
            w = w + step
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5).

    NULL and empty texts score like a text without any term. Columns of these
    names are replaced. Rows are scored one by one, so repeated rows score alike.
    """
    bound_batches(docs.sparkSession)
    rows = without(docs, "score", "predicted")
    shipped = docs.sparkSession.sparkContext.broadcast(vars(lexicon).copy())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(**shipped.value)
        machine = own.automaton()
        for batch in text_slices(batches, text_col):
            pairs = np.array([measure(t, machine) for t in batch.column(text_col).to_pylist()]).reshape(-1, 2)
            value = 1 / (1 + np.exp(-np.clip(inputs(pairs[:, 0], pairs[:, 1]) @ np.array(own.scale), -500, 500)))
            yield batch.append_column("score", pa.array(value)).append_column("predicted", pa.array((value >= 0.5).astype(np.int32)))

    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, *extra]))


def learn_by_fold(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> Lexicon:
    """Learn from folds 1 to 3 of 5, calibrate on fold 4; fold 0 is held out."""
    part = id_fold(id_col, 5)
    return learn(docs, labels, part.isin(1, 2, 3), part == 4, id_col, **options)
