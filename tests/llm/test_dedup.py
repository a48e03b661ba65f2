"""Substring, near, line and exact dedup against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import exact_dedup as exact
from cadenza.llm import line_dedup as lines_
from cadenza.llm import near_dedup as near
from cadenza.llm.components import components
from cadenza.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(seed=1, n=60):
    """Random texts with copies, edited copies, shared passages, short, empty and null texts, odd white space."""
    r = random.Random(seed)
    vocabulary = ["Wort%d" % i if i % 3 else "é%d" % i for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    texts = [None, None, "", " \t\n", "one", "two words", "three words here", "x y z"]
    for _ in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice((3, 20, 60, 120)))]
        sep = r.choice((" ", "  ", "\n"))
        text = sep.join(words)
        texts.append(text)
        if r.random() < 0.3:
            texts.append(text)
        for _ in range(r.choice((0, 0, 1, 5))):
            edited = list(words)
            for _ in range(r.choice((1, 2, 5))):
                edited[r.randrange(len(edited))] = "neu%d" % r.randrange(1000)
            texts.append(sep.join(edited))
        if r.random() < 0.2:
            texts.append(text[:50] + " " + passage + " " + text[50:])
    r.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("k1", "k2", "node", "n", "spans", "lines", "id", "digest", "kept", "bands")}) if extra else df


def test_substring_dedup_against_brute_force(spark):
    rows, width = corpus(3), 7
    seen, words = Counter(), {i: WORD.findall(t or "") for i, t in rows}
    for w in words.values():
        seen.update(tuple(w[s : s + width]) for s in range(len(w) - width + 1))
    got = {r["doc_id"]: r for r in substring_dedup(frame(spark, rows), width=width, with_text=True).collect()}
    assert len(got) == len(rows)
    for i, w in words.items():
        gone = {s + k for s in range(len(w) - width + 1) if seen[tuple(w[s : s + width])] > 1 for k in range(width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), len(gone), kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == len(gone)


def test_substring_dedup_finds_repeats_within_one_document(spark):
    block = " ".join(f"w{i}" for i in range(10))
    got = substring_dedup(frame(spark, [(1, f"{block} mid {block}")]), width=10).first()
    assert (got["n_words"], got["n_removed"]) == (21, 20)


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_dedup_against_brute_force(spark, width, percent):
    rows = corpus(5)
    got = {r["doc_id"]: r for r in near.near_dedup(frame(spark, rows), width=width, percent=percent).collect()}
    want = brute_components(rows, width, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_dedup_joins_a_chain_of_edits(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(30):
        words[(7 * k) % 100] = f"new{k}"
        rows.append((100 - k, " ".join(words)))
    got = near.near_dedup(frame(spark, rows), width=3, percent=85).collect()
    assert {r["component_id"] for r in got} == {c for _, c in brute_components(rows, 3, 85).values()}


def test_near_dedup_of_one_large_group_compares_few_pairs(spark):
    r, base = random.Random(2), [f"b{i}" for i in range(80)]
    rows = []
    for i in range(400):
        own = list(base)
        own[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = near.near_dedup(frame(spark, rows)).collect()
    assert {x["component_id"] for x in got} == {0}
    assert sum(x["n_links"] for x in got) < 400 * 20


@pytest.mark.parametrize("edges_per_task", [200_000, 60])
def test_components(spark, edges_per_task):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long"), edges_per_task).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent if find(x) != x}


def brute_lines(rows, percent, least):
    flat = []
    for i, t in sorted(rows, key=lambda x: x[0]):
        for k, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line)
            if len(w) >= least:
                flat.append((i, k, frozenset(w)))
    gone = defaultdict(set)
    for y, (i, k, s) in enumerate(flat):
        if any(100 * len(s & o) >= percent * len(s | o) for _, _, o in flat[:y]):
            gone[i].add(k)
    return gone


@pytest.mark.parametrize("percent", [80, 60])
def test_line_dedup_against_brute_force(spark, percent):
    r = random.Random(8)
    vocabulary = [f"v{int(r.paretovariate(0.6))}" for _ in range(500)]
    pool = [[r.choice(vocabulary) for _ in range(r.choice((2, 5, 8, 20, 40)))] for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a b\n\na b")]
    for i in range(4, 80):
        text = []
        for _ in range(r.randrange(1, 8)):
            line = list(r.choice(pool))
            for _ in range(r.choice((0, 0, 1, 2, 6))):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            text.append(" ".join(line))
        rows.append((i, "\n".join(text)))
    gone = brute_lines(rows, percent, 5)
    assert sum(map(len, gone.values())) > 50
    out = lines_.line_dedup(frame(spark, rows), percent=percent).collect()
    assert len(out) == len(rows)
    for x in out:
        i, text = x["doc_id"], dict(rows)[x["doc_id"]]
        kept = None if text is None else "\n".join(t for k, t in enumerate(text.split("\n")) if k not in gone[i])
        assert (x["text"], x["n_dropped"], x["k1"]) == (kept, len(gone[i]), 7)


@pytest.mark.parametrize("words, mask", [(1, 0x1111111111111111), (8, 3)])
def test_partners_of_a_word_are_found_among_few_pairs(monkeypatch, words, mask):
    r, looked, needed = np.random.default_rng(3), [], lines_._needed
    monkeypatch.setattr(lines_, "_needed", lambda percent, n, m: looked.append(len(n)) or needed(percent, n, m))
    size = np.array([1, 2, 40, 900])
    token = np.repeat(np.arange(4), size).astype(np.uint64)
    n = r.integers(4, 60, len(token))
    place = (r.random(len(token)) * (n - -(-80 * n // 100) + 1)).astype(np.int64)
    maps = r.integers(0, 2**63, (len(token), words)).astype(np.uint64) & r.integers(0, 2**63, (len(token), words)).astype(np.uint64) & np.uint64(mask)
    got = lines_._with_partner(80, token, n, place, maps)
    need, behind = needed(80, n[:, None], n), n - place
    differ = np.bitwise_count(maps[:, None] ^ maps).sum(2, dtype=np.int64)
    pair = (token[:, None] == token) & (np.minimum(behind[:, None], behind) >= need) & (n[:, None] + n - differ >= 2 * need)
    np.fill_diagonal(pair, False)
    assert got.tolist() == pair.any(1).tolist() and 0 < got.sum() < len(got)
    assert sum(looked) < 900 * 899 / 2 / 4


def test_exact_dedup_against_brute_force(spark):
    rows = corpus(6) + [(900, "x"), (901, "X"), (902, "x "), (903, "x")]
    got = {r["doc_id"]: r for r in exact.exact_dedup(frame(spark, rows)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for i, t in rows:
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    lowered = exact.exact_dedup(frame(spark, rows), normalise=lambda c: F.lower(F.trim(c))).where("doc_id >= 900").collect()
    assert {r["keep_id"] for r in lowered} == {903}


def test_cuckoo_index_inserts_deletes_and_grows():
    index, r = exact.CuckooIndex(16), random.Random(3)
    keys = [r.randbytes(32) for _ in range(5000)]
    for k, d in enumerate(keys):
        assert index.get(d) is None
        index.insert(d, k)
    assert index.resizes > 0
    assert [index.get(d) for d in keys] == list(range(5000))
    for d in keys[::2]:
        index.delete(d)
    assert all(index.get(d) is None for d in keys[::2])
    assert all(index.get(d) == 2 * k + 1 for k, d in enumerate(keys[1::2]))
    with pytest.raises(KeyError):
        index.insert(keys[1], 0)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "a b c d e f"), (None, "a b c d e f"), (1, None), (1, None), (1, "a b c d e f")], [(1, "a b c d e f g\na b c d e f g"), (1, "a b c d e f g\na b c d e f g"), (1, "other")]])
def test_nulls_repeats_and_empty_tables(spark, rows):
    df = frame(spark, rows)
    for out in (substring_dedup(df, width=3), near.near_dedup(df), lines_.line_dedup(df), exact.exact_dedup(df)):
        assert out.count() == len(rows)
    if len(rows) == 5:
        assert sorted(r["n_removed"] for r in substring_dedup(df, width=3).collect()) == [0, 0, 6, 6, 6]
        assert {r["keep_id"] for r in exact.exact_dedup(df).collect()} == {1}
        assert [r["component_id"] for r in near.near_dedup(df).where("n_shingles > 0").collect()] == [1, 1, 1]
        assert [r["text"] for r in lines_.line_dedup(df).where("doc_id = 1 AND text IS NOT NULL").collect()] == [""]


def test_a_very_long_text(spark):
    words = " ".join(f"w{i % 70000}" for i in range(200_000))
    df = frame(spark, [(1, words), (2, "short one")])
    got = substring_dedup(df, width=35).where("doc_id = 1").first()
    assert (got["n_words"], got["n_removed"]) == (200_000, 200_000)
    assert near.near_dedup(df).where("doc_id = 1").first()["n_shingles"] == 70_000
    assert lines_.line_dedup(df).where("doc_id = 1").first()["n_dropped"] == 0
