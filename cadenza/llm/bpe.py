"""BPE encoding and decoding with a pair occurrence index.

Texts are cut at ASCII white space, which the vocabulary's pre-tokenizer drops, and each distinct
chunk is encoded once (see ``chunks``). All new pieces of a block are encoded together: one index maps
each adjacent pair of symbols to all its positions, a heap holds the ranks of the pairs that occur,
and the least rank is applied at all its positions at once, which updates the lists of the
neighbouring pairs only. A pair's merge makes only pairs of higher rank, so this equals the usual
piece-by-piece loop.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CACHE_BYTES, ChunkEncoder, ids_per_document, word_cuts
from .common import binary, small_batches, text_blocks, trim


#: New chunks that one pair index takes, which bounds its memory.
CHUNKS_AT_ONCE = 50_000
#: Bytes of text cut at a time: the arrays of a block weigh about thirty times its text.
ENCODED_BYTES = 1 << 20


class PairIndexBPE:
    """A BPE vocabulary file of the tokenizers library: its normalizer and pre-tokenizer as they are, its merges applied here."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        model, tok = spec["model"], Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tok.normalizer, tok.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("this kind of vocabulary isn't supported")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.merges = np.array(merges, np.int64)
        order = np.argsort(self.merges[:, 0] << 32 | self.merges[:, 1], kind="stable")
        self.pair_keys, self.pair_ranks = (self.merges[:, 0] << 32 | self.merges[:, 1])[order], order
        self.tokens: list[bytes | None] = [None] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in (self.vocab | self.special).items():
            self.tokens[i] = t.encode()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, chunk: str) -> list[str | int]:
        """Pieces to merge within, and ids of special tokens."""
        out: list[str | int] = []
        for k, part in enumerate(self.split.split(chunk) if self.split else [chunk]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part) if self.normalizer else part)]
        return out

    def many_pieces(self, chunks: list[str]) -> list[list[str | int]]:
        """``pieces`` of each chunk. Chunks that surely hold no special token go through the library together, parted by spaces."""
        out: list = [None] * len(chunks)
        plain = []
        for i, c in enumerate(chunks):
            if "<" in c or "\x01" in c:
                out[i] = self.pieces(c)
            else:
                plain.append(i)
        joined = "\x01".join([chunks[i] for i in plain])
        clean = (self.normalizer.normalize_str(joined) if self.normalizer else joined).split("\x01")
        easy = []
        for i, c in zip(plain, clean, strict=True):
            if " " in c:
                out[i] = self.pieces(chunks[i])
            else:
                easy.append((i, c))
        at, pos = [], 0
        for i, c in easy:
            out[i] = []
            at.append(pos)
            pos += len(c) + 1
        k, bound = 0, at[1:] + [pos + 1]
        for p, (start, _) in self.pre_tokenizer.pre_tokenize_str(" ".join([c for _, c in easy])):
            while start >= bound[k]:
                k += 1
            out[easy[k][0]].append(p)
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece; all pieces share one pair occurrence index."""
        vocab, suffix = self.vocab, self.suffix
        symbols, lens = array("i"), []
        for p in pieces:
            own = [vocab.get(c) for c in p[:-1]]
            own.append(vocab.get(p[-1] + suffix))
            if None in own:  # without an unknown token, unknown symbols go
                own = [s for s in own if s is not None]
            symbols.extend(own)
            lens.append(len(own))
        n = len(symbols)
        symbol = np.append(np.frombuffer(symbols, np.int32), np.int32(-1))
        edges = np.concatenate(([0], np.cumsum(lens)))
        # neighbours within a piece; n stands for none
        right, left = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        right[edges[1:][edges[1:] > 0] - 1] = n
        left[edges[:-1]] = n
        right[n] = left[n] = n
        rank = self.ranks(symbol[:n], symbol[right[:n]])
        some = np.flatnonzero(rank >= 0).astype(np.int32)
        order = some[np.argsort(rank[some], kind="stable")]
        present, first = np.unique(rank[order], return_index=True)
        bounds = dict(zip(present.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))
        del rank, some
        active, later = sorted(bounds), {}
        while active:
            r = heapq.heappop(active)
            a, b, new = self.merges[r].tolist()
            at = order[slice(*bounds[r])] if r in bounds else None
            if r in later:
                more = np.array(later.pop(r))
                at = np.unique(more if at is None else np.concatenate((at, more)))
            i = at[(symbol[at] == a) & (symbol[right[at]] == b)]  # else one of the two went into another merge
            if a == b and len(i):  # of overlapping pairs, the left one merges first
                taken, chosen = -1, []
                for x in i.tolist():
                    if x != taken:
                        chosen.append(x)
                        taken = int(right[x])
                i = np.array(chosen)
            if not len(i):
                continue
            j = right[i]
            k = right[j]
            symbol[i], symbol[j] = new, -1
            right[i] = k
            left[k] = i
            left[n] = n
            h = left[i]
            starts = np.concatenate((i, h))
            found = self.ranks(symbol[starts], symbol[np.concatenate((k, i))])
            for x, where in zip(found.tolist(), starts.tolist(), strict=True):
                if x >= 0:
                    if x in later:
                        later[x].append(where)
                    else:
                        later[x] = [where]
                        if x not in bounds or x < r:
                            heapq.heappush(active, x)
        kept = symbol[:n] >= 0
        ids = symbol[:n][kept].tolist()
        cut = np.concatenate(([0], np.cumsum(kept)))[edges].tolist()
        return [ids[x:y] for x, y in zip(cut, cut[1:], strict=False)]

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(chunks), CHUNKS_AT_ONCE):
            out += self._encode(chunks[at : at + CHUNKS_AT_ONCE])
        return out

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        cut = self.many_pieces([c.decode() for c in chunks])
        place: dict[str, int] = {}
        for ps in cut:
            for p in ps:
                if p.__class__ is str:
                    place.setdefault(p, len(place))
        ids = self.merge(list(place))
        return [ids[place[ps[0]]] if len(ps) == 1 and ps[0].__class__ is str else [i for p in ps for i in ([p] if p.__class__ is int else ids[place[p]])] for ps in cut]

    def decode(self, ids: list[int]) -> bytes:
        """As the library without a decoder: tokens joined by a space, special ones included; unknown ids are left out."""
        try:
            return b" ".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError):
            return b" ".join([self.tokens[i] for i in ids if 0 <= i < len(self.tokens) and self.tokens[i] is not None])


_LOADED: dict[str, tuple[PairIndexBPE, ChunkEncoder]] = {}


def loaded(path: str) -> tuple[PairIndexBPE, ChunkEncoder]:
    if path not in _LOADED:
        bpe = PairIndexBPE(path)
        _LOADED[path] = bpe, ChunkEncoder(bpe.encode, CACHE_BYTES // 2)
        gc.collect()
        trim()  # the parsed file is larger than what is kept of it
    return _LOADED[path]


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """One row per input row, without a shuffle: the id column and those of ``keep``.

    ids: binary, little-endian u32. decoded: text of the decoded ids. Null text is empty and has no
    ids; ids may be null or repeated; other columns aren't read. ``tokenizer`` is a path on every node.
    """
    small_batches(docs.sparkSession)
    kinds = {"n_tokens": "bigint", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    decode = bool({"decoded", "decoded_sha256"} & set(keep))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = loaded(tokenizer)
        for batch, data, offs in text_blocks(batches, limit=ENCODED_BYTES):
            starts, ends = word_cuts(data, offs)
            ids, counts = encoder([(data, starts, ends)])[0]
            yield emit(bpe, batch, ids, ids_per_document(starts, counts, offs))

    def emit(bpe: PairIndexBPE, batch: pa.RecordBatch, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        columns: dict[str, list] = {c: [] for c in keep}
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = ids[a:b]
            raw = own.astype("<u4").tobytes()
            text = bpe.decode(np.frombuffer(raw, "<u4").tolist()) if decode else b""
            for c in keep:
                columns[c].append(b - a if c == "n_tokens" else raw if c == "ids" else hashlib.sha256(raw).hexdigest() if c == "ids_sha256" else text.decode() if c == "decoded" else hashlib.sha256(text).hexdigest())
        return pa.RecordBatch.from_arrays([batch["id"], *(binary(v) if c == "ids" else pa.array(v, pa.int64() if c == "n_tokens" else pa.string()) for c, v in columns.items())], ["id", *keep])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, " + ", ".join(f"{c} {kinds[c]}" for c in keep)).withColumnRenamed("id", id_col)
