"""Word and window hashes, exact chunks, and pages that make scanners slow; no Spark."""

import time

import numpy as np
import pytest

from cadenza.llm import common
from cadenza.llm.chunks import ChunkEncoder
from cadenza.llm.html_text import main_text
from cadenza.llm.line_dedup import Lines

FLIP = str.maketrans("ab", "ba")


def thue_morse(k):
    s = "a"
    for _ in range(k):
        s += s.translate(FLIP)
    return s


def spans(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, *common.word_spans(data, np.array([0, len(data)]))[:2]


@pytest.mark.parametrize("k", [3, 6, 7, 9, 10, 11, 12])
def test_structured_words_differ(k):
    one, other = thue_morse(k), thue_morse(k).translate(FLIP)
    data, starts, ends = spans(f"{one} {other} {one} {one}b")
    h = common.span_hash(data, starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    assert common.distinct_spans(data, starts, ends)[1].tolist() in ([x[0], x[1], x[0], x[2]] for x in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)))
    got = ChunkEncoder(lambda chunks: [[len(c), c[0]] for c in chunks])([(data, starts, ends)])[0][0].tolist()
    assert got == [x for a, b in zip(starts.tolist(), ends.tolist()) for x in (b - a, data[a])]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "span_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data, starts, ends = spans("x yy x yy zz longerthaneightbytes longerthaneightbytez " + "w" * 500 + " " + "w" * 499 + "v")
    first, which = common.distinct_spans(data, starts, ends)
    assert which.tolist() == [0, 1, 0, 1, 2, 3, 4, 5, 6] and first.tolist() == [0, 1, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 35, 64])
def test_rabin_karp_is_the_polynomial(width):
    h = np.random.default_rng(1).integers(0, 2**64, 120, dtype=np.uint64)
    v, want = [int(x) % common.PRIME for x in h], []
    for i in range(len(v) - width + 1):
        total = 0
        for x in v[i : i + width]:
            total = (total * common.BASE + x) % common.PRIME
        want.append(total)
    assert common.rabin_karp(h, width).tolist() == want


def test_a_document_of_five_million_lines():
    data = np.frombuffer(b"a\nb\n" * 2_500_000, np.uint8)
    lines = Lines(data, np.array([0, len(data)]))
    lines.sets()
    assert len(lines.sid) == 5_000_000 and len(np.unique(lines.sid)) == 2 and (lines.n == 1).all()


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a '" * 250_000, "<div>x" * 20_000, "<div class='ad'>x" * 20_000, "<script>" + "</script " * 100_000, "<li><b>" * 20_000, "</b>" * 100_000])
def test_odd_pages_take_time_in_proportion(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 6


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "header-fixed", "share-count"])
def test_wrappers_with_telling_names_keep_their_article(name):
    text = "A first sentence, long enough, with points. And another one."
    assert main_text(f"<body><div class='{name}'><h1>Title</h1><p>{text}</p></div></body>") == f"Title\n{text}"


def test_linked_items_of_an_article_stay():
    page = "<article><p>Long enough a text, here. Yes.</p><ul><li><a href=x>Source title</a></li></ul><table><tr><td><a>Linked cell</a></td></tr></table></article>"
    assert main_text(page) == "Long enough a text, here. Yes.\nSource title\nLinked cell"
