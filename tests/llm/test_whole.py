"""Whole jobs: what operators and stages must not leave out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import line_dedup as lines_
from cadenza.llm import mixing
from cadenza.llm.html_text import main_text
from cadenza.llm.queries import QUERIES

from .test_dedup import brute_lines, frame


def short_lines(seed=21):
    r = random.Random(seed)
    pool = [[f"v{r.randrange(40)}" for _ in range(r.choice((1, 2, 3, 4, 5, 6)))] for _ in range(80)]
    rows = [(0, "And ornd."), (1, "other words here\nAnd ornd.\nornd. And"), (2, "a b c d\na b c d e\nb a d c a")]
    for i in range(3, 90):
        rows.append((i, "\n".join(" ".join(r.choice(pool)) for _ in range(r.randrange(1, 6)))))
    return rows


def without(rows, gone):
    return {i: "\n".join(t for k, t in enumerate(text.split("\n")) if k not in gone[i]) for i, text in rows}


@pytest.mark.parametrize("percent", [80, 60, 50])
def test_short_lines_against_brute_force(spark, percent):
    rows = short_lines()
    got = lines_.line_dedup(frame(spark, rows), percent=percent, least_words=1).collect()
    assert {x["doc_id"]: x["text"] for x in got} == without(rows, brute_lines(rows, percent, 1))


def test_a_shorter_line_of_the_same_words_hides_no_line(spark):
    rows = [(0, "a b c d e"), (1, "a b c d\na b c d a")]
    got = lines_.line_dedup(frame(spark, rows), least_words=5).collect()
    assert {x["doc_id"]: x["text"] for x in got} == {0: "a b c d e", 1: "a b c d"} == without(rows, brute_lines(rows, 80, 5))


def test_op4_and_the_line_stage_take_short_lines(spark, tmp_path):
    rows = short_lines()
    gone = brute_lines(rows, 80, 1)
    assert 1 in gone[1]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["n_dropped"] for x in got} == {i: len(gone[i]) for i, _ in rows}
    left = corpus_pipeline.line_stage(spark, docs, "unused").collect()
    assert {x["doc_id"]: x["text"] for x in left} == {i: t for i, t in without(rows, gone).items() if t.split()}


def test_mixing_meets_its_targets_at_the_share_of_op3(spark):
    r = random.Random(31)
    rows = [(k, "hot" if r.random() < 0.33 else f"s{k % 12}", r.choices(["en", "de", "fr", "es"], [60, 15, 15, 10])[0], f"t{int(r.paretovariate(1.2)) % 8}", r.randrange(1, 200)) for k in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_words long")
    rates = mixing.sampling_rates(df, mixing.MARGINS, "n_words", None, 0.7, 0.7, 10_000).toPandas()
    kept = rates["tokens"] * rates["rate"]
    assert 0.2 < kept.sum() / rates["tokens"].sum() <= 0.7 + 1e-9 and rates["rate"].max() <= 1
    for c in mixing.MARGINS:
        goal = (rates["tokens"].groupby(rates[c]).sum()) ** 0.7
        now = kept.groupby(rates[c]).sum()
        assert (abs(now / now.sum() / (goal / goal.sum()) - 1) < 0.005).all()


def test_bounded_rates_make_up_for_cells_that_are_full():
    cells, margins, goals = np.array([10.0, 90.0, 90.0, 10.0]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([60.0, 60.0]), np.array([50.0, 70.0])]
    rate, met = mixing.bounded(cells, margins, goals, np.array([3.0, 0.5, 0.5, 3.0]))
    assert met and rate.max() == 1
    for index, goal in zip(margins, goals, strict=True):
        assert np.allclose(np.bincount(index, cells * rate), goal, rtol=2e-3)


TEXT = "First paragraph of the page, with commas, and a full stop.\nSecond paragraph, also of some length, to the end."
BODY = "".join(f"<p>{t}</p>" for t in TEXT.split("\n"))


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class=no-sidebar", "div class=side-by-side", "div class=main-header-layout", "div id=legal-text", "div class=sidebar", "div role=form", "form method=post", "header"])
def test_wrappers_that_hold_the_page_are_kept(wrapper):
    assert main_text(f"<html><head><title>T</title></head><body><{wrapper}><article>{BODY}</article></{wrapper.split()[0]}></body></html>") == TEXT
    assert main_text(f"<body><{wrapper}>{BODY}</{wrapper.split()[0]}><footer>All rights.</footer></body>") == TEXT


def test_small_marked_elements_still_go():
    for name in ("ad", "cookie-notice", "nav-left", "widget area"):
        assert main_text(f"<body><article>{BODY}<div class='{name}'>Buy this, now.</div></article></body>") == TEXT
    assert main_text("<body><div class=ad>Buy this, now, it is the best of all.</div><article><p>A short text, but the page's.</p></article></body>") == "A short text, but the page's."


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><meta charset=utf-8><title>T</title><style>p{}</style>", "<title>T</title>"])
def test_head_without_an_end_tag(head):
    assert main_text(f"<!DOCTYPE html><html>{head}<body><article>{BODY}</article></body></html>") == TEXT
    assert main_text(f"<!DOCTYPE html><html>{head}{BODY}</html>") == TEXT


LONG = [f"Sentence {k} of the text, which says this and that, and comes to its end after some words. " * 4 for k in range(6)]


def test_text_beside_article_cards_is_kept():
    cards = "".join(f"<article><h3>Card {k}</h3><p>{'A teaser of another page, with a comma, and some more words for its ratio to count. ' * 2}</p></article>" for k in range(4))
    text = "".join(f"<p>{t}</p>" for t in LONG)
    want = [t.strip() for t in LONG]
    for page in (f"<div class=text>{text}</div><div class=cards>{cards}</div>", f"<div class=cards>{cards}</div><div class=text>{text}</div>"):
        got = main_text(f"<html><body>{page}</body></html>").split("\n")
        assert [t for t in got if t in want] == want


def test_paths_below_the_threshold_go_without_a_common_container():
    links = "".join(f"<div><span>Item {k}</span></div>" for k in range(30))
    page = f"<html><body><div><div>{links}</div><section><h2>Head</h2>{''.join(f'<p>{t}</p>' for t in LONG[:3])}<ul><li>One<li>Two</ul></section><blockquote>{''.join(f'<p>{t}</p>' for t in LONG[3:])}</blockquote></div></body></html>"
    assert main_text(page).split("\n") == ["Head", *(t.strip() for t in LONG[:3]), "One", "Two", *(t.strip() for t in LONG[3:])]


def test_short_blocks_among_the_text_stay():
    rows = "".join(f"<tr><td>a{k}<td>b{k}</tr>" for k in range(12))
    inner = f"<h1>Title</h1><p>{LONG[0]}</p><h2>Part</h2><table>{rows}</table><p>Sh is.</p><p>{LONG[1]}</p><pre>x = 1</pre>"
    want = ["Title", LONG[0].strip(), "Part", *(f"{c}{k}" for k in range(12) for c in "ab"), "Sh is.", LONG[1].strip(), "x = 1"]
    for tag in ("article", "main", "div"):
        assert main_text(f"<body><{tag}>{inner}</{tag}></body>").split("\n") == want
