"""Encoding of texts by way of their distinct chunks.

A tokenizer's work on a chunk doesn't depend on what stands around it when texts are cut only where
its pre-tokenizer must cut as well. Corpora repeat their chunks, so each distinct chunk of a block
is encoded once and the ids are gathered by numpy. A bounded cache carries chunks over to the next
blocks of the same Python worker.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from .common import SEPARATOR, distinct_spans, word_spans

#: Bytes that a worker's cache may take (its objects included).
CACHE_BYTES = 80 << 20
#: Bytes of the objects behind an entry besides what they hold.
_ENTRY = 190

#: First bytes of the non-ASCII characters among which Unicode has white space.
_MAYBE_SPACE_LEAD = np.zeros(256, bool)
_MAYBE_SPACE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Fixed: ASCII letters, and punctuation that starts neither a contraction nor a special token.
_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT[[ord(c) for c in '.,;:!?()[]{}"-/*#%&$=+~@^_']] = True


def before_points(data: np.ndarray) -> np.ndarray:
    """Positions of punctuation after an ASCII letter: each vocabulary here keeps letters and punctuation apart."""
    return np.flatnonzero(_POINT[data[1:]] & _LETTER[data[:-1]]) + 1


def space_cuts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that begin at a document or at a single space between two characters that surely aren't white space."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        solid = ~SEPARATOR[data]
        ascii_ = data < 0x80
        before = solid[:-2] & ascii_[:-2]
        two = np.zeros(n - 2, bool)  # the character before ends a pair with first byte C3..DF
        two[1:] = (data[1:-2] >= 0x80) & (data[1:-2] < 0xC0) & (data[:-3] >= 0xC3) & (data[:-3] <= 0xDF)
        # FS, GS, RS and US count as white space in some regular expression engines: no cut beside them
        after = solid[2:] & ~_MAYBE_SPACE_LEAD[data[2:]] & ((data[2:] < 0x1C) | (data[2:] > 0x1F))
        before &= (data[:-2] < 0x1C) | (data[:-2] > 0x1F)
        cut[1:-1] = (data[1:-1] == 32) & (before | two) & after
    heads = offs[:-1][offs[:-1] < offs[1:]]
    inner = offs[1:-1]
    for at in (inner, inner - 1):  # a space at the edge of a document isn't between two characters
        at = at[(at >= 0) & (at < n)]
        cut[at] = False
    cut[heads] = True
    cut[before_points(data)] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


class ChunkEncoder:
    """Ids of the chunks of some blocks; ``encode(list of chunk bytes)`` gives a list of id lists, or of their bytes (little-endian u32), and is called once for all blocks.

    Chunks are known by their bytes, not by a hash. The cache has two halves: what is met again moves to the new one,
    and when that is full, the old one goes.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]] | list[bytes]], limit: int = CACHE_BYTES):
        self.encode, self.limit, self.size = encode, limit, 0
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block (bytes, first byte and end of each chunk): all ids in order, and the number of ids of each chunk."""
        if self.size > self.limit // 2:
            self.old, self.cache, self.size = self.cache, {}, 0
        cache, old, plans, new = self.cache, self.old, [], {}
        for data, starts, ends in blocks:
            first, which = distinct_spans(data, starts, ends)
            raw = data.tobytes()
            keys = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            plans.append((keys, which))
            for k in keys:
                if k not in cache:
                    if k in old:
                        self._keep(k, old[k])
                    else:
                        new[k] = None
        if new:
            for key, ids in zip(new, self.encode(list(new)), strict=True):
                self._keep(key, ids if ids.__class__ is bytes else struct.pack(f"<{len(ids)}I", *ids))
        return [self._gather(*plan) for plan in plans]

    def _keep(self, key: bytes, value: bytes) -> None:
        self.cache[key] = value
        self.size += len(key) + len(value) + _ENTRY

    def _gather(self, keys: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.cache[k] for k in keys]
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, heads = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lens) - lens
        n = lens[which]
        if not len(flat):
            return np.zeros(0, np.uint32), n
        to = np.cumsum(n)
        return flat[np.repeat(heads[which] - (to - n), n) + np.arange(to[-1])], n


def word_cuts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the ASCII white space between them, cut once more before punctuation."""
    starts, ends, _ = word_spans(data, offs)
    inner = before_points(data)
    if len(inner):
        inner = inner[~np.isin(inner, offs)]  # the letter belongs to another document
        starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends


def ids_per_document(chunk_starts: np.ndarray, ids_per_chunk: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Offsets (n + 1) of each document's ids among the ids of a block."""
    before = np.concatenate(([0], np.cumsum(ids_per_chunk)))
    return before[np.searchsorted(chunk_starts, offs, "left")]
