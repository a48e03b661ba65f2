"""Substring dedup: every window of ``width`` words whose word sequence starts elsewhere too is removed.

1. Map tasks take blocks of documents and compute the Rabin-Karp hash of every window. Within a
   block equal hashes are folded at once: their windows are known to repeat, and only one of them is
   sent on, so a window that a third of all rows share costs one entry per block. Entries are packed
   by bucket: eight bytes of hash and a compressed ordinal.
2. Each bucket counts its hashes with numpy; an ordinal whose hash came from two blocks goes back to its block.
3. Each block turns ordinals into removal intervals per document, merged to maximal ones.
4. Intervals meet the documents again by row key, and the kept words are laid out.

Windows count as equal when two independent polynomial hashes are: one modulo the prime 2**61 - 1, and of
one modulo 2**64 the bits that choose the bucket and three more. Together these are 64 bits and the bits of the
bucket, whose number grows with the input: with 10**10 windows one pair of different windows in a thousand runs is
expected to collide, with 10**13 about one pair a run.
Texts are shuffled once, window hashes once. The input must give the same rows in the same order
when a partition is computed again (a scan or a written table; not an unordered shuffle).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, binary, rabin_karp, rolling, row_key, small_batches, span_hash, stored, text_blocks, word_spans

#: Windows that one bucket counts, on average, and the most buckets: beyond 2**20 (12 TB) buckets grow by some 40 bytes of a task's memory a window.
WINDOWS_PER_BUCKET, BUCKET_BITS = 2_000_000, 20
_HASHES, _TABLE, _HITS = 0, 1, 2
_PACKED = "bucket int, block bigint, kind int, size int, payload binary"


def _pack(values: np.ndarray) -> bytes:
    """Ascending 32-bit integers as differences, low bytes first, compressed."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _hashes(width: int, bits: int):
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch, data, offs in text_blocks(batches, limit=min(4, 1 << max(0, bits - 14)) * BLOCK_BYTES):  # more buckets: larger blocks, else each row holds few windows
            block += 1
            starts, ends, doc = word_spans(data, offs)
            if len(starts) < width:
                continue
            words = span_hash(data, starts, ends)
            at = np.flatnonzero(doc[: len(words) - width + 1] == doc[width - 1 :])
            if not len(at):
                continue
            h, other = rabin_karp(words, width)[at], rolling(words, width)[at]
            h |= other << np.uint64(61)
            order = np.argsort(h, kind="stable")
            same = (h[order[1:]] == h[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
            first = np.append(True, ~same)
            repeated = np.zeros(len(h), bool)
            repeated[order[1:][same]] = repeated[order[:-1][same]] = True
            chosen = np.zeros(len(h), bool)
            chosen[order[first]] = True
            once = at[chosen]
            h, other = h[chosen], other[chosen]
            bucket = (other >> shift).astype(np.int32)
            deal = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[deal], np.arange((1 << bits) + 1))
            raw = h[deal].astype("<u8")
            once = once[deal]
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                x, y = int(edges[b]), int(edges[b + 1])
                rows.append((b, _HASHES, y - x, raw[x:y].tobytes() + _pack(once[x:y])))
            own = block % (1 << bits)
            words = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype("<u4")
            table = np.concatenate([batch[k].to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8) for k in ("k1", "k2")] + [words.view(np.uint8)])
            rows.append((own, _TABLE, batch.num_rows, table.tobytes()))
            if repeated.any():
                hits = at[repeated]
                rows.append((own, _HITS, len(hits), _pack(hits)))
            b, kind, size, payload = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([block] * len(b), pa.int64()), pa.array(kind, pa.int32()), pa.array(size, pa.int32()), binary(payload)], ["bucket", "block", "kind", "size", "payload"])

    return run


def _count(group: pa.Table) -> pa.Table:
    """Hits of a bucket, by block; tables and earlier hits go through."""
    kind = group["kind"].to_numpy()
    through = group.filter(pa.array(kind != _HASHES)).select(["block", "kind", "size", "payload"])
    packed = group.filter(pa.array(kind == _HASHES))
    sizes, blocks = packed["size"].to_numpy(), packed["block"].to_numpy()
    total = int(sizes.sum())
    h, ordinal, at = np.zeros(total, np.uint64), np.zeros(total, np.uint32), 0
    for n, payload in zip(sizes.tolist(), packed["payload"], strict=True):
        payload = payload.as_buffer()
        h[at : at + n] = np.frombuffer(payload, "<u8", n)
        ordinal[at : at + n] = _unpack(memoryview(payload)[n * 8 :])
        at += n
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(total, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    rows = []
    edges = np.concatenate(([0], np.cumsum(sizes)))
    for k in range(len(sizes)):
        own = ordinal[edges[k] : edges[k + 1]][hit[edges[k] : edges[k + 1]]]
        if len(own):
            rows.append((int(blocks[k]), _HITS, len(own), _pack(own)))
    if rows:
        b, kind, size, payload = zip(*rows, strict=True)
        found = pa.table([pa.array(b, pa.int64()), pa.array(kind, pa.int32()), pa.array(size, pa.int32()), binary(payload)], names=through.column_names)
        through = pa.concat_tables([through, found.cast(through.schema)])
    return through


def _intervals(width: int):
    def run(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_pylist()
        hits, table, n = [], b"", 0
        for k, size, payload in zip(kind, group["size"].to_pylist(), group["payload"], strict=True):
            if k == _TABLE:
                table, n = payload.as_py(), size
            else:
                hits.append(_unpack(payload.as_py()))
        out: list[tuple] = []
        if hits:
            at = np.unique(np.concatenate(hits))
            k1, k2 = np.frombuffer(table, "<i8", n), np.frombuffer(table, "<i8", n, 8 * n)
            words = np.frombuffer(table, "<u4", n + 1, 16 * n).astype(np.int64)
            doc = np.searchsorted(words, at, "right") - 1
            new = np.append(True, (at[1:] > at[:-1] + width) | (doc[1:] != doc[:-1]))  # windows that touch or overlap make one interval
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(at)) - 1
            d = doc[head]
            pairs = np.stack((at[head] - words[d], at[tail] + width - words[d]), axis=1).astype("<u4")
            cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(d)).tolist(), strict=True):
                out.append((int(k1[d[x]]), int(k2[d[x]]), pairs[x:y].tobytes()))
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), binary(list(c))], names=["k1", "k2", "spans"])

    return run


def repeated_spans(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row keys k1, k2 and ``spans``: maximal removal intervals as u32 pairs [first word, end word), for rows that have any."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(BUCKET_BITS, max(6, (size // (5 * WINDOWS_PER_BUCKET)).bit_length()))
    packed = docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_hashes(width, bits), _PACKED)
    hits = packed.groupBy("bucket").applyInArrow(_count, "block bigint, kind int, size int, payload binary")
    spans = hits.groupBy("block").applyInArrow(_intervals(width), "k1 bigint, k2 bigint, spans binary")
    return spans.dropDuplicates(["k1", "k2"])  # rows that repeat id and text have equal spans


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``spans`` (array of start, end) and, if asked for, ``kept_text``.

    Removes each word that a window of ``width`` words covers whose word sequence also starts
    anywhere else, in the same document or another; windows are judged on the input. Kept words are
    joined by one space. Null and empty texts have no words; texts shorter than the window are kept
    whole; rows that repeat id and text are copies like any others. Columns but the two named aren't read.
    """
    spark = docs.sparkSession
    spans = stored(repeated_spans(docs, width, id_col, text_col), "spans")
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = keyed.join(spans, ["k1", "k2"], "left").select("id", "text", "spans")
    more = ", kept_text string" if with_text else ""
    small_batches(spark)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_blocks(batches):
            raw, n_words, n_removed, digests, where, texts = data.tobytes(), [], [], [], [], []
            for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                words = raw[a:b].split()
                n = len(words)
                pairs = np.frombuffer(s, "<u4").reshape(-1, 2).tolist() if (s := batch["spans"][k].as_py()) else []
                kept, at = [], 0
                for x, y in pairs:
                    kept += words[at:x]
                    at = y
                kept = kept + words[at:] if pairs else words
                text = b" ".join(kept)
                n_words.append(n)
                n_removed.append(n - len(kept))
                digests.append(hashlib.sha256(text).hexdigest())
                where.append([{"start": x, "end": y} for x, y in pairs])
                if with_text:
                    texts.append(text.decode())
            columns = [batch["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), ["id", "n_words", "n_removed", "kept_sha256", "spans"] + ["kept_text"] * with_text)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(lay_out, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>{more}").withColumnRenamed("id", id_col)
