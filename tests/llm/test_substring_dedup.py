"""Substring deduplication against a plain scan of all windows."""

from __future__ import annotations

import random

import pytest

from evalframe.llm import substring_dedup
from evalframe.llm.substring_dedup import COVERS, cover_of, drop_repeated_passages

SCHEMA = "doc_id long, text string, n_words string, chunk int"


def brute(rows, window):
    """(id, words, removed, kept) with rows in the order given for equal ids."""
    docs = sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    seen, out = set(), []
    for _, (doc_id, text) in docs:
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((doc_id, len(words), len(gone), kept))
    return out


def got(spark, rows, window, partitions=3):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(partitions)
    return [tuple(r) for r in drop_repeated_passages(df, window).collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("period", COVERS)
def test_covers_have_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


@pytest.mark.parametrize("window", [1, 2, 8, 9, 10, 20, 27, 38, 100])
def test_an_anchor_fits_into_any_alignment(window):
    period, _, words = cover_of(window)
    assert words >= 1 and period - 1 + words <= window


@pytest.mark.parametrize("window", [1, 3, 10, 20])
def test_random_texts_with_copied_passages(spark, monkeypatch, window):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "BUCKET_KEYS", 500)
    draw = random.Random(window)
    words = [f"w{k}" for k in range(4000 if window > 3 else 300)] + ["É", "ß x"]
    rows = []
    for k in range(60):
        text = [draw.choice(words) for _ in range(draw.randrange(0, 120))]
        for _ in range(draw.randrange(3)):
            source = draw.choice(rows)[1].split(" ") if rows else []
            at = draw.randrange(max(1, len(source)))
            text[draw.randrange(len(text) + 1) : 0] = source[at : at + draw.randrange(1, 60)]
        rows.append((k * 7 % 61, " ".join(text)))
    rows.append((1000, "  ".join(["a b"] * 50)))  # repeats itself
    rows.append((1001, rows[3][1].replace(" ", "\t\n")))
    want = brute(rows, window)
    assert any(r[2] for r in want) and order(got(spark, rows, window)) == order(want)


def test_odd_inputs(spark):
    long = " ".join(f"x{k}" for k in range(30))
    rows = [(None, long), (5, long), (6, None), (7, ""), (8, " \n"), (9, "short text"), (10, "short text"), (11, "z " * 19)]
    want = {r[0]: r[1:] for r in brute(rows, 20)}
    assert {r[0]: r[1:] for r in got(spark, rows, 20)} == want
    assert want[5] == (30, 30, "") and want[6] == (0, 0, "")
    assert got(spark, [], 20) == []


def test_repeated_ids_keep_one(spark):
    long = " ".join(f"x{k}" for k in range(30))
    rows = got(spark, [(4, long), (4, long), (4, long), (3, "a")], 20)
    assert sorted(r[2] for r in rows) == [0, 0, 30, 30]


def test_a_very_long_text_and_a_passage_in_all(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    long = " ".join(f"v{k}" for k in range(400_000))
    rows = [(0, long + " " + passage), (1, passage + " " + long)] + [(k, f"own{k} " + passage) for k in range(2, 300)]
    result = {r[0]: r for r in got(spark, rows, 20, 8)}
    assert result[0][1:3] == (400_025, 0) and result[1][1:] == (400_025, 400_025, "")
    assert all(result[k][1:] == (26, 25, f"own{k}") for k in range(2, 300))


def test_ids_must_have_an_order(spark):
    with pytest.raises(ValueError):
        drop_repeated_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError):
        drop_repeated_passages(spark.createDataFrame([(1, "b")], "doc_id long, text string"), 0)
