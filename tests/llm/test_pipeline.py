"""The pipeline's stages on a small corpus, each against a plain version of what it should do."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from .test_dedup import WORD, brute_components, brute_lines
from .test_text import SAMPLES

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def corpus(spark):
    r, rows = random.Random(12), []
    for k in range(160):
        name = r.choice(["en", "de", "fr", "es"])
        words = [r.choice(SAMPLES[name]) + r.choice(("", "", str(r.randrange(500)))) for _ in range(r.randrange(30, 90))]
        text = "\n".join(" ".join(words[i : i + 15]) for i in range(0, len(words), 15))
        rows.append((len(rows), text, name, f"src{r.randrange(3)}", len(text)))
        if r.random() < 0.3:
            rows.append((len(rows), text.replace(words[3], "changed"), name, "src0", len(text)))
        if r.random() < 0.1:
            rows.append((len(rows), text, None, None, None))
    rows += [(len(rows) + k, t, "en", "src1", 0) for k, t in enumerate((None, "", "123 456", "!!! ???"))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def stage(spark, name, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "unused")
    assert name == "bpe" or out.columns == list(corpus_pipeline.COLUMNS)
    return out.cache()


def test_stages(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    all_rows = {r["doc_id"]: r for r in corpus.collect()}

    found = stage(spark, "language_id", corpus)
    kept = {r["doc_id"]: r for r in found.collect()}
    lettered = {i for i, r in all_rows.items() if any(map(str.isalpha, r["text"] or ""))}
    assert set(kept) <= lettered and len(kept) >= len(lettered) - 2
    right = [r["lang"] == all_rows[i]["lang"] for i, r in kept.items() if all_rows[i]["lang"]]
    assert sum(right) >= 0.97 * len(right)

    lines = stage(spark, "line_dedup", found)
    gone = brute_lines([(i, r["text"]) for i, r in kept.items()], 80, 5)
    want = {}
    for i, r in kept.items():
        text = "\n".join(t for k, t in enumerate(r["text"].split("\n")) if k not in gone[i])
        if not gone[i] or WORD.search(text):
            want[i] = (text, len(text) if gone[i] or r["n_chars"] is not None else len(text))
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t for i, (t, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = stage(spark, "near_dedup", lines)
    component = brute_components([(i, t) for i, (t, _) in want.items()], 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, c) in component.items() if c == i}

    mixed = stage(spark, "mixing", near)
    size = lambda df: df.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert mixed.exceptAll(near).count() == 0 and 0.5 < size(mixed) / size(near) < 0.9

    tok = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    encoded = stage(spark, "bpe", mixed).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in encoded} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_stages_on_no_rows(spark, corpus):
    docs = corpus.limit(0)
    for name, _ in corpus_pipeline.STAGES:
        docs = stage(spark, name, docs)
    assert docs.count() == 0


def test_one_query_for_each_operator():
    numbers = defaultdict(list)
    for name in QUERIES:
        numbers[int(name[2:].split("_")[0])].append(name)
    assert sorted(numbers) == list(range(1, 11)) and all(len(x) == 1 for x in numbers.values())
    assert set(ORACLE_SQL) <= set(QUERIES)
