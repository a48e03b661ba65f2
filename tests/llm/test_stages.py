"""Each stage behind the language stage on its own input, against a plain version; lines of any length take part."""

import pytest

import corpus_pipeline
from cadenza.llm.queries import tokenizer_path

from .test_dedup import WORD, brute_components, brute_lines
from .test_pipeline import corpus, stage  # noqa: F401

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def whole(corpus):  # noqa: F811
    return [(r["doc_id"], r["text"] or "") for r in corpus.collect()]


def test_line_stage_takes_every_line(spark, corpus, whole):  # noqa: F811
    gone = brute_lines(whole, 80, 1)
    want = {}
    for i, t in whole:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if not gone[i] or WORD.search(left):
            want[i] = left
    got = stage(spark, "line_dedup", corpus).collect()
    assert {r["doc_id"]: r["text"] or "" for r in got} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_near_stage_keeps_one_of_a_group(spark, corpus, whole):  # noqa: F811
    component = brute_components(whole, 5, 80)
    assert {r["doc_id"] for r in stage(spark, "near_dedup", corpus).collect()} == {i for i, (_, c) in component.items() if c == i}


def test_mixing_stage_keeps_whole_rows(spark, corpus):  # noqa: F811
    mixed = stage(spark, "mixing", corpus)
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert mixed.exceptAll(corpus).count() == 0 and 0.4 < words(mixed) / words(corpus) < 0.9


def test_encoding_stage_equals_the_library(spark, corpus, whole):  # noqa: F811
    tok = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in stage(spark, "bpe", corpus).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in whole}
    assert [n for n, _ in corpus_pipeline.STAGES][1:] == ["line_dedup", "near_dedup", "mixing", "bpe"]
