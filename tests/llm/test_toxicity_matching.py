"""Matching against a plain scan of all terms at all places."""

from __future__ import annotations

import random
import time

from evalframe.llm.toxicity import Lexicon, fold, matches


def plain(folded: str, lexicon: Lexicon) -> dict[int, float]:
    found = {}
    for term, weight in lexicon.terms.items():
        for at in range(len(folded)):
            if weight > 0 and folded.startswith(term, at):
                found[at] = max(found.get(at, 0.0), weight)
    for phrase in lexicon.exceptions:
        for at in range(len(folded)):
            if folded.startswith(phrase, at):
                found = {a: w for a, w in found.items() if not at <= a < at + len(phrase) - 1}
    return found


def test_matches_equal_a_plain_scan():
    draw = random.Random(8)
    words = ["bad", "badly", "ba", "good", "x", "not", "worse", "worst"]
    for _ in range(300):
        terms = {f" {draw.choice(words)}{draw.choice(['', ' '])}": draw.random() for _ in range(draw.randrange(6))}
        exceptions = list({" " + " ".join(draw.choices(words, k=draw.randrange(1, 4))) + " " for _ in range(draw.randrange(5))})
        lexicon = Lexicon(terms, [e for e in exceptions if e not in terms])
        text = fold(" ".join(draw.choices(words, k=draw.randrange(25))))
        assert matches(text, lexicon.automaton()) == plain(text, lexicon)


def test_many_exceptions_take_linear_time():
    lexicon = Lexicon({" bad ": 1.0}, [" not bad "])
    text, machine = fold("not bad, " * 64_000 + "bad"), lexicon.automaton()
    start = time.perf_counter()
    assert len(matches(text, machine)) == 1 and time.perf_counter() - start < 2


def test_signs_stand_for_letters_only_before_letters():
    assert fold("You idiot! What an ass! Cost: 5$") == " you idiot what an ass cost s "
    assert fold("a$$hole sh!t @ss hate|speech h3ll") == " asshole shit ass hate speech hell "
    assert fold("mail a@b.c") == " mail aab c "
