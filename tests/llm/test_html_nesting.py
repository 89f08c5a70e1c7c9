"""Deep nesting, words in inline elements, and a plain version with whole paths."""

from __future__ import annotations

import random
import time

from evalframe.llm import html_text


def test_inline_elements_keep_their_words_whatever_their_class():
    page = '<article><p>The <span class="search">query</span> word and <a class="login" href="#">a link</a> end.</p></article>'
    assert html_text.main_text(page) == "The query word and a link end."


def test_reader_comments_go():
    page = '<article><p>Text of the article.</p></article><div class="commentlist"><p>What a reader wrote.</p></div><ul id="comments"><li>More.</li></ul>'
    assert html_text.main_text(page) == "Text of the article."


def test_deep_nesting_takes_linear_time():
    start = time.perf_counter()
    assert html_text.main_text("<article>" + "<div><p>line of text " * 100_000).count("line of text") == 100_000
    assert html_text.main_text("<b>" * 100_000 + "x</i>" * 100_000) == "x" * 100_000
    assert time.perf_counter() - start < 20


def test_holders_are_the_elements_around_a_line():
    draw = random.Random(4)
    for _ in range(300):
        depth, page, want = [], "", []
        for k in range(draw.randrange(1, 30)):
            if draw.random() < 0.5:
                depth.append(draw.choice(["div", "section", "article"]))
                page += f"<{depth[-1]}>"
            elif depth and draw.random() < 0.5:
                page += f"</{depth.pop()}>"
            page += f"<p>line {k}</p>"
            want.append((f"line {k}", tuple(depth)))
        lines, holders = html_text.lines_of(page)
        got = []
        for text, _, holder in lines:
            path = []
            while holder:
                path.append(holders[holder][0])
                holder = holders[holder][1]
            got.append((text, tuple(reversed(path))))
        assert got == want
