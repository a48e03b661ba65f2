"""Tokens, records, language, pages, search and mixing against libraries and brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import language_id as lang
from cadenza.llm import mixing
from cadenza.llm import token_records as rec
from cadenza.llm.bpe import PairIndexBPE, bpe_encode
from cadenza.llm.chunks import ids_per_document, space_cuts
from cadenza.llm.html_text import extract_text, main_text
from cadenza.llm.queries import tokenizer_path
from cadenza.llm.top_k import BlockIndex, top_k

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    None, "", " ", "\n\n", "a", "Hello, World!  Two  spaces\tand tabs\r\nlines", "it's we'll I'd don't 'quoted' '", "x<|endoftext|>y <|startoftext|> <|endoftext|>", "nbsp between   words em 　wide",
    "é è ñ ß Ünïcödé ÀÉÎ", "é combining ́ alone", "数字 123 и кириллица ελληνικά Σίσυφος ΟΔΟΣ", "emoji 🙂👍🏽 end", "a.b,c;d:e!f?g(h)i[j]k{l}m\"n-o/p*q#r%s&t$u=v+w~x@y^z_0", "1234567890 3.14 a1b2", "\x1c\x1d control \x01 chars\x7f", "ABC " * 300, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", " lead and trail ", "İstanbul ẞ ﬁ", "<", "a<b", "tab\tx y", "x \x1f y", "İ I ı i", "word" * 2000,
]


def texts(seed=2, n=150):
    r = random.Random(seed)
    pool = [c for t in ODD if t for c in t.split(" ")] + ["the", "of", "and", "Straße", "l'été", "can't", "...", "--", "(see", "end.)"]
    return ODD + ["".join(r.choice(pool) + r.choice((" ", " ", "  ", "\n", "\t", "")) for _ in range(r.randrange(1, 80))) for _ in range(n)]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "row", "ids", "n_tokens", "score")})


def test_bpe_equals_the_library(spark):
    path, values = tokenizer_path("word_bpe_49k.json"), texts()
    tok = tokenizers.Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe_encode(frame(spark, values), path).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(got[i]["ids"]) == raw, repr(t)
        assert (got[i]["n_tokens"], got[i]["decoded"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), decoded, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_merging_all_pieces_at_once_equals_one_by_one():
    bpe, r = PairIndexBPE(tokenizer_path("word_bpe_49k.json")), random.Random(1)
    words = ["".join(r.choice("abcehilnorst") for _ in range(r.randrange(1, 25))) for _ in range(800)] + ["a" * k for k in range(1, 30)] + ["abab" * 5]
    ranks = {(a, b): (k, c) for k, (a, b, c) in enumerate(bpe.merges.tolist())}
    for w, got in zip(words, bpe.merge(words), strict=True):
        s = [bpe.vocab[c] for c in w[:-1]] + [bpe.vocab[w[-1] + bpe.suffix]]
        while True:
            best = min(((ranks[p][0], k) for k, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
            if best is None:
                break
            k = best[1]
            s[k : k + 2] = [ranks[s[k], s[k + 1]][1]]
        assert got == s


def test_records_equal_the_library_and_read_back(spark):
    path, values = tokenizer_path("byte_bpe_50k.json"), texts(3)
    tok = tokenizers.Tokenizer.from_file(path)
    got = rec.token_records(frame(spark, values), path, end_id=2).orderBy("doc_id").collect()
    at = 0
    for i, (t, r) in enumerate(zip(values, got, strict=True)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes())), repr(t)
        at += len(ids)


def test_chunks_go_through_the_library_together(monkeypatch):
    path, r, sent, kind = tokenizer_path("byte_bpe_50k.json"), random.Random(6), [], tokenizers.Tokenizer
    tok = tokenizers.Tokenizer.from_file(path)

    class Counting:
        def __init__(self, path):
            self.tok = kind.from_file(path)

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return self.tok.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", type("Loader", (), {"from_file": Counting}))
    monkeypatch.setattr(rec, "_ENCODERS", {})
    encoder = rec.library_encoder(path)
    values = [*texts(7), "".join(r.choice(" éab.,c") + "".join(r.choice("aeioulnrst") for _ in range(9)) for _ in range(6000))]
    raw = [(t or "").encode() for t in values]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends = space_cuts(data, offs)
    ids, counts = encoder([(data, starts, ends)])[0]
    at = ids_per_document(starts, counts, offs)
    for t, a, b in zip(values, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert len(sent) < len(encoder.cache) / 3


def test_records_shuffle_by_seed(spark, tmp_path):
    path, values = tokenizer_path("byte_bpe_50k.json"), texts(4, 20)
    rec.write_records(frame(spark, values), f"file://{tmp_path}/d", path)
    index = rec.build_index(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/i")
    one, two, other = ([r["doc_id"] for r in rec.read_shuffled(spark, f"file://{tmp_path}/d", index, s).collect()] for s in (1, 1, 2))
    assert one == two != other and sorted(one) == list(range(len(values)))


def test_damaged_frames_are_found():
    data = rec.frame(7, np.array([1, 2, 50000]), 2) + rec.frame(None, np.array([], int), 2)
    assert [(d, ids.tolist()) for _, _, d, ids in rec.frames(data)] == [(7, [1, 2, 50000]), (None, [])]
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(rec.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(rec.frames(data[:-3]))
    assert struct.unpack("<Q", data[:8])[0] == 10 + 6


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    assert bpe_encode(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert rec.token_records(none, tokenizer_path("byte_bpe_50k.json"), 2).count() == 0
    assert lang.language_id(none.withColumn("lang", F.lit("en")), F.lit(True)).count() == 0
    assert extract_text(none.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.lit("h").alias("html"))).count() == 0


SAMPLES = {
    "en": "the of and to in that was for with this have from they which would there their about people could other".split(),
    "de": "der die und das nicht mit auf für ist sich den werden eine auch nach über wird zwischen können schon".split(),
    "fr": "le la les des est une pour dans que qui avec sur pas plus être cette tout faire même très".split(),
    "es": "el los las una por con para como más pero sus este entre cuando muy sin sobre también hasta desde".split(),
    "it": "il della che per una con sono non anche come più alla questo essere stato nella degli quando molto senza".split(),
    "nl": "het een van dat niet zijn voor met aan ook door maar naar worden over deze hebben kunnen onder tegen".split(),
}


@pytest.mark.parametrize("names", [("en", "de", "fr", "es"), tuple(SAMPLES)])
def test_language_id_on_held_out_texts(spark, names):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(SAMPLES[n]) for _ in range(r.randrange(5, 60))), n) for k, n in enumerate(r.choice(names) for _ in range(600))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 ... !!", "en"), (1003, "a", None), (1004, "数字", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in lang.language_id(df, F.col("doc_id") % 4 != 2).collect()}
    held = [(k, n) for k, t, n in rows if k % 4 == 2 and k < 1000]
    assert sum(got[k]["lang_pred"] == n for k, n in held) >= 0.97 * len(held)
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1004]["lang_pred"] != "und"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert {x["lang_pred"] for x in lang.language_id(df, F.lit(False)).collect()} == {"und"}


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9):
        c = lang.codewords(k)
        assert min((c[a] != c[b]).sum() for a in range(k) for b in range(a)) >= max(1, c.shape[1] // 4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site name</h1><p>Slogan of the site, with a comma.</p></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them. Accept?</p></div><div class="layout"><aside class=sidebar><p>Popular: this, that.</p></aside>
<{open}><h2>Head &amp; line</h2><p>First paragraph, with some   text &lt;here&gt; and an&nbsp;entity.<p>Second <b>bold <a href=/y>link</a></b> paragraph;<br>broken line.
<form><input name=q><label>Mail</label><button>Send, now.</button></form><!-- <p>hidden</p> --><ul><li>One item.</li><li>Two items.</li></ul>
<div class="ad banner">Buy this, now!</div><blockquote>A quote, at last.</blockquote></{close}>
<section id="comments"><h3>Comments</h3><p>A reader says this, and that, and more.</p></section></div><footer>&copy; 2024, all rights.</footer></body></html>"""
WANT = "Head & line\nFirst paragraph, with some text <here> and an entity.\nSecond bold link paragraph; broken line.\nOne item.\nTwo items.\nA quote, at last."


@pytest.mark.parametrize("tag", ["article", "main", "div id=content", "div", "section"])
def test_main_text(tag):
    assert main_text(PAGE.replace("{open}", tag).replace("{close}", tag.split()[0])) == WANT


def test_pages_that_are_hardly_pages(spark):
    assert [main_text(x) for x in ("", "<", "plain text", "<p>one", "<p></p>", "</p></div>x", "<script>never closed <p>x", "<p title='a>b'>y</p>", "<p a=\"unclosed>z</p>")] == ["", "<", "plain text", "one", "", "x", "", "y", "z"]
    rows = [(1, None, None), (1, "u", "<article><p>" + "word, " * 50_000 + "</p></article>"), (None, "u", "<p>x</p>")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "row": F.lit(1)})).collect()
    assert sorted((r["url"] or "", r["n_chars"]) for r in got) == [("", 0), ("u", 1), ("u", 299_999)]


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(r.normal(size=(300, 16)))]
    rows += [(k, rows[k % 7][1]) for k in range(300, 340)] + [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (450, [float("inf")] * 16), (403, [1.0] * 8), (500, [2.0] * 8), (None, [1.0] * 16), (50, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "part", "values")})
    clean = [(k, np.floor(256 * np.array(v)).astype(np.int64)) for k, v in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = {}
    for q, v in {(q, tuple(v)) for q, v in clean if q % 50 == 0}:
        score = sorted((-int(np.dot(v, w)), k) for k, w in clean if k != q and len(w) == len(v))
        want.setdefault(q, []).extend((k, -s) for s, k in score[:5])
    want = {q: sorted(x, key=lambda p: (-p[1], p[0]))[:5] for q, x in want.items()}
    got = {}
    for x in top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert got == {q: x for q, x in want.items() if x}


def test_blocks_are_pruned_where_bounds_allow():
    r = np.random.default_rng(2)
    centres = np.repeat(r.normal(size=(50, 32)) * 4, 64, 0)
    vectors = np.floor(256 * (centres + 0.05 * r.normal(size=centres.shape)))
    index = BlockIndex(np.arange(len(vectors)), vectors)
    ids, scores = index.search(0, vectors[0], 5)
    best = sorted((-(vectors[k] @ vectors[0]), k) for k in range(1, len(vectors)))[:5]
    assert [(-s, i) for i, s in zip(ids, scores)] == best and index.scored < len(vectors) / 4


def test_raking_meets_all_margins():
    r = np.random.default_rng(8)
    cells = r.integers(1, 1000, 60).astype(float)
    margins = [np.arange(60) % 3, np.arange(60) // 3 % 4, np.arange(60) // 12]
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4]), np.full(5, 0.2)]
    w = cells * mixing.rake(cells, margins, targets)
    for m, t in zip(margins, targets, strict=True):
        assert np.allclose(np.bincount(m, w) / w.sum(), t, atol=1e-6)


def test_mixing_reaches_its_targets(spark):
    r = random.Random(5)
    rows = [(k, "big" if r.random() < 0.8 else f"s{k % 3}", r.choice(["en", "de"]), r.choice("xyz"), r.randrange(1, 50)) for k in range(20_000)] + [(None, None, None, None, None), (7, "big", "en", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_words long").withColumns({"rate": F.lit(1), "tokens": F.lit(2)})
    target = {"source": {"big": 0.4, "s0": 0.2, "s1": 0.2, "s2": 0.2}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mix_sources(df, targets=target, keep_share=0.3)
    total = got.agg(F.sum("n_words")).first()[0]
    assert abs(total / sum(x[4] or 0 for x in rows) - 0.3) < 0.02
    for column, goals in target.items():
        shares = {x[column]: x["n"] / total for x in got.groupBy(column).agg(F.sum("n_words").alias("n")).collect()}
        assert all(abs(shares[v] - g) < 0.03 for v, g in goals.items()) and None not in shares
    again = mixing.mix_sources(df.repartition(3), targets=target, keep_share=0.3)
    assert got.exceptAll(again).count() == 0 and "tokens" in got.columns
    assert mixing.mix_sources(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, max_cells=3)


def test_topics_depend_on_the_text_alone(spark):
    df = frame(spark, texts(9, 30))
    a = {r["doc_id"]: (r["topic"], r["n_words"]) for r in mixing.with_topic(df).collect()}
    b = {r["doc_id"]: (r["topic"], r["n_words"]) for r in mixing.with_topic(df.repartition(3)).collect()}
    assert a == b and a[0] == ("none", 0) and len({t for t, _ in a.values()}) > 3
