"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evalframe.llm import spelling
from evalframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts: dict[str, int], ratio: int = 5) -> set[tuple]:
    by_length: dict[int, list[str]] = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    others = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(others[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n, len(others[w]), form[w], counts.get(form[w]), root))
    return rows


def got(df) -> set[tuple]:
    rows = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vocabulary(draw: random.Random, size: int) -> dict[str, int]:
    counts = {}
    letters = "abcdeéÿñ漢"
    while len(counts) < size:
        word = "".join(draw.choices(letters, k=draw.randrange(1, 8)))
        for _ in range(3):  # a chain of variants, each less frequent
            counts.setdefault(word, draw.choice([1, 2, 5, 25, 26, 125, 700, 4000]))
            at = draw.randrange(len(word) + 1)
            word = word[:at] + draw.choice(["", draw.choice(letters)]) + word[at + draw.randrange(2) :] or "a"
    return counts


@pytest.mark.parametrize("shard,sample", [(16384, 1 << 18), (40, 1 << 18), (40, 100)])
def test_random_words(spark, monkeypatch, shard, sample):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", sample)
    monkeypatch.setattr(spelling, "SAMPLED_PER_SHARD", 8)
    counts = vocabulary(random.Random(shard + sample), 700)
    df = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n long, form int").repartition(3)
    assert got(spelling.spelling_variants(df)) == brute(counts)


def test_odd_inputs(spark):
    long = "x" * 50_000
    counts = {"": 500, "a": 5, "ab": 100, "ba": 100, long: 5, long[1:]: 25, long[:-1] + "y": 25, "😀b": 20, "é": 4}
    rows = [(w, n) for w, n in counts.items()] + [(None, 9), ("zzzz", None)]
    df = spark.createDataFrame(rows, "word string, n long")
    want = brute(counts)
    assert got(spelling.spelling_variants(df)) == want
    halves = spark.createDataFrame([(w, n - 2) for w, n in counts.items()] + [(w, 2) for w in counts], "word string, n long")
    assert got(spelling.spelling_variants(halves)) == want
    assert {r[0]: r[3] for r in want}["a"] == ""  # ties and order: the empty word has the largest n
    assert got(spelling.spelling_variants(df.where("false"))) == set()
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, 1)


def test_ties_go_to_the_smallest_word(spark):
    df = spark.createDataFrame([("color", 1), ("colors", 50), ("colour", 50), ("dolor", 50)], "word string, n long")
    assert {r.word: r.form for r in spelling.spelling_variants(df).collect()} == {"color": "colors", "colors": None, "colour": None, "dolor": None}


def test_equal_points_beyond_a_shard(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 16)
    words = {"".join(w) for w in (random.Random(1).sample("abcdefgh", 8) for _ in range(150))}  # one count vector
    words |= {w[:-1] + "a" for w in list(words)[:30]}
    counts = {w: 1 + 7 * (k % 3) for k, w in enumerate(sorted(words))}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.spelling_variants(df)) == brute(counts)


def test_edits_and_reach():
    draw = random.Random(5)
    for _ in range(300):
        a = "".join(draw.choices("abz", k=draw.randrange(1, 7)))
        b = "".join(draw.choices("abz", k=len(a) + draw.randrange(2)))
        both = spelling.letters_of([a], len(a)), spelling.letters_of([b], len(b))
        assert bool(spelling.one_edit(*both)[0, 0]) == near(a, b)
        if near(a, b):
            assert np.abs(spelling.counts_of(both[0]) - spelling.counts_of(both[1])).sum() <= 2


def corrupted(rows, every=199) -> dict[str, int]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_word_counts(spark):
    texts = ["Straße STRASSE strasse Éclair éclair × ÷÷÷÷÷÷ abc-defghi abcdefg_hij", None, "", "x" * 300_000, "12345 abcdef abcdef", "ABCDEF abcdef abcdef"]
    rows = [(k if k != 4 else None, t) for k, t in enumerate(texts * 2)]
    df = spark.createDataFrame([(i, t, "e", 3) for i, t in rows], "doc_id long, text string, word string, crc int")
    for every in (2, 3, 199):
        assert {r.word: r.n for r in spelling.word_counts(df, typo_every=every).collect()} == corrupted(rows, every)
    assert spelling.word_counts(df.where("false")).isEmpty()
    assert {r.word: r.n for r in spelling.word_counts(df, least_letters=1, least_count=1).collect()}["abc"] == 2


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_spelling_variants"](spark, SF)) == brute(corrupted(rows))
