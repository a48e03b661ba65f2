"""Helpers shared by the corpus operators: storage, Arrow blocks, vectorised word hashing.

A *word* is a maximal run of bytes other than space, TAB, LF, VT, FF and CR, that is
``[^\\x20\\x09-\\x0D]+``; UTF-8 continuation bytes never fall into that class, so words can be
found on raw bytes.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
_U64 = np.uint64


_OWN: list[str] = []


# ---------------------------------------------------------------- session and storage
def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests, notebooks) a local session gets a temporary folder, removed at
    exit; a cluster session without the setting uses the warehouse folder.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="cadenza-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage is cut, losing executors costs nothing."""
    return Tables(df.sparkSession).stored(df, name)


class Tables:
    """Tables in the shared folder that one operator writes on its way and deletes when what it returns no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        schema, path = df.schema, fresh_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        self._free()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        """Delete all tables so far. Only what has been written elsewhere may still be read."""
        if jvm := getattr(self.spark, "_jvm", None):
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            for p in self.paths:
                where = jvm.org.apache.hadoop.fs.Path(p)
                where.getFileSystem(conf).delete(where, True)
        self.paths = []

    def _free(self) -> None:
        """What was shuffled on the way is garbage now, but Spark deletes it only when the driver's JVM collects: ask it to, where there is one."""
        if jvm := getattr(self.spark, "_jvm", None):
            jvm.System.gc()


def trim() -> None:
    """Give freed memory of a Python worker back to the machine: workers are reused, and what one task frees isn't the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python by bytes, so that very long texts don't pile up.

    Session settings, since plans read them when they run; they suit other queries as well.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two longs that stand for a row, also where ids are null or repeated; rows with equal keys have equal ids and texts."""
    return [F.xxhash64(F.col(id_col), F.col(text_col), F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col)).alias("k2")]


# ---------------------------------------------------------------- Arrow blocks
def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes of text (a longer row alone), each with its bytes and offsets; freed memory is returned after the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            part = batch.slice(at, to - at)
            yield (part, *text_buffers(part.column(text)))
            at = to
    trim()


# ---------------------------------------------------------------- words and hashes
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first 0 .. 8 bytes of a little-endian lane.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GOLD = _U64(0x9E3779B97F4A7C15)
#: Lanes of a span that are chained; those behind are summed by position.
_CHAINED = 8
#: Spans hashed at a time, whose arrays stay in a core's cache.
_SPANS = 1 << 15
#: The modulus of Rabin-Karp hashes, a Mersenne prime, and a fixed random base below it.
PRIME = (1 << 61) - 1
BASE = 0x1C80F2B5F6A8E4D3 % PRIME


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> _U64(30))
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and document of each word; words don't cross documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = (data != 32) & ((data - np.uint8(9)) > 4)
    heads = offs[:-1][offs[:-1] < offs[1:]]
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    edge[heads] = word[heads]
    starts = np.flatnonzero(edge)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    tails = np.append(heads[1:], len(data)) - 1
    edge[tails] = word[tails]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as an integer; beyond the end they are zero."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans aren't empty. Different spans of up to eight bytes and equal length never collide.

    Lanes of eight bytes go through a non-linear bijection one after the other; those of spans of over 64
    bytes through one that depends on the position, and are summed: no structure of a text cancels out.
    """
    view, out = lanes(data), np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _SPANS):
        out[at : at + _SPANS] = _span_hash(view, starts[at : at + _SPANS], ends[at : at + _SPANS])
    return out


def _span_hash(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    h = mix((view[starts] & _LANE[np.minimum(lens, 8)]) ^ (lens.astype(np.uint64) * _GOLD))
    more, k = np.flatnonzero(lens > 8), 1
    while len(more) and k < _CHAINED:
        lane = view[starts[more] + 8 * k] & _LANE[np.minimum(lens[more] - 8 * k, 8)]
        h[more] = mix((h[more] ^ lane) + _GOLD)
        k += 1
        more = more[lens[more] > 8 * k]
    if len(more):
        count = -(-lens[more] // 8) - _CHAINED
        heads = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(heads, count) + _CHAINED
        at = np.repeat(starts[more], count) + 8 * place
        lane = view[at] & _LANE[np.minimum(np.repeat(ends[more], count) - at, 8)]
        h[more] = mix(h[more] ^ np.add.reduceat(mix(mix(lane ^ mix(place.astype(np.uint64) * _GOLD)) ^ place.astype(np.uint64)), heads))
    return h


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each class of equal spans, and the class of each span. Exact: hashes sort, bytes are compared."""
    h = span_hash(data, starts, ends)
    by = np.argsort(h)  # numpy.unique takes a slower sort where it gives indices
    new = np.append(True, h[by[1:]] != h[by[:-1]]) if len(h) else np.zeros(0, bool)
    which = np.empty(len(h), np.int64)
    which[by] = np.cumsum(new) - 1
    first = np.minimum.reduceat(by, np.flatnonzero(new)) if len(h) else by
    same = first[which]
    other = np.flatnonzero(same != np.arange(len(starts)))
    lens, view = ends - starts, lanes(data)
    equal, k = bool((lens[other] == lens[same[other]]).all()), 0
    while equal and len(other) and k < 4 * _CHAINED:
        mask = _LANE[np.minimum(lens[other] - 8 * k, 8)]
        equal = bool(((view[starts[other] + 8 * k] & mask) == (view[starts[same[other]] + 8 * k] & mask)).all())
        k += 1
        other = other[lens[other] > 8 * k]
    if equal and all(np.array_equal(data[starts[i] : ends[i]], data[starts[same[i]] : ends[same[i]]]) for i in other.tolist()):
        return first, which
    raw, seen = data.tobytes(), {}
    which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.unique(which, return_index=True)[1], which


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    low, high = _U64((1 << 31) - 1), _U64(31)
    a0, a1, b0, b1 = a & low, a >> high, _U64(b & ((1 << 31) - 1)), _U64(b >> 31)
    middle = a1 * b0 + a0 * b1
    total = _U64(2) * (a1 * b1) + (middle >> _U64(30)) + ((middle & _U64((1 << 30) - 1)) << high) + a0 * b0
    return _reduced(total)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U64(PRIME)) + (x >> _U64(61))
    return np.where(x >= _U64(PRIME), x - _U64(PRIME), x)


def rabin_karp(h: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash modulo a prime of 61 bits of each run of ``width`` values, runs of doubled width from those of half the width."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value, size, out, done = _reduced(h), 1, None, 0
    while True:
        if width & size:  # out covers the first ``done`` values of each run
            out = value[:n] if out is None else _reduced(_times(out, pow(BASE, size, PRIME)) + value[done : done + n])
            done += size
        if 2 * size > width:
            return out
        value = _reduced(_times(value[:-size], pow(BASE, size, PRIME)) + value[size:])
        size *= 2


def rolling(h: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Rabin-Karp: a polynomial hash modulo 2**64 of each run of ``width`` values, from prefix sums."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _U64((0x2545F4914F6CDD1D * (2 * seed + 1)) % 2**64 | 1)
    inverse = _U64(pow(int(base), -1, 2**64))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse, n))


#: Bits of a filter of keys, and of a chunk of it.
FILTER_BITS = 1 << 25
_CHUNK_BITS = 1 << 19


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of a task's keys, in chunks; those without a key are left out."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        at = _slot(batch["key"].to_numpy(zero_copy_only=False))
        np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
    chunks = bits.reshape(-1, _CHUNK_BITS // 8)
    held = np.flatnonzero(chunks.any(1)).tolist()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), binary([zstandard.compress(chunks[c].tobytes(), 1) for c in held])], ["chunk", "bits"])


def _filter_union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks that reach a task, united one after another."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, bits in zip(batch["chunk"].to_pylist(), batch["bits"], strict=True):
            own = np.frombuffer(zstandard.decompress(bits.as_buffer()), np.uint8)
            total[chunk] = total[chunk] | own if chunk in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), binary([zstandard.compress(c.tobytes(), 1) for c in total.values()])], ["chunk", "bits"])


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) & _U64(FILTER_BITS - 1)).astype(np.int64)


def key_filter(wanted: DataFrame, column: str):
    """A function for tasks: which of some 64-bit hashes may be in the column. It has no false negatives, and 4 MB are broadcast whatever the table."""
    # keys aren't shuffled: tasks' filters are united chunk by chunk, and 64 chunks of at most 64 KB reach the driver
    layout = "chunk int, bits binary"
    parts = wanted.select(F.col(column).alias("key")).mapInArrow(_filter_bits, layout).repartition("chunk").mapInArrow(_filter_union, layout).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for p in parts:
        at = p["chunk"] * (_CHUNK_BITS // 8)
        bits[at : at + _CHUNK_BITS // 8] = np.frombuffer(zstandard.decompress(p["bits"]), np.uint8)
    shared = wanted.sparkSession.sparkContext.broadcast(bits)

    def passes(keys: np.ndarray) -> np.ndarray:
        at = _slot(keys)
        return ((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)

    return passes


def binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())
