"""Exact dedup with a cuckoo-filter index over live digests.

Rows become (id, SHA-256 of the text). Each map task folds its own copies, so a text that a third of
all rows share costs one row per Arrow batch; digests are then dealt over partitions, and each
partition streams through a :class:`CuckooIndex`. The filter answers "new" without a look at the
stored keys; a hit is verified against them. A copy with a larger id takes over by deleting the live
entry and inserting its own. Texts aren't shuffled, only digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Digests that one partition's index holds, on average.
KEYS_PER_PARTITION = 100_000


class CuckooFilter:
    """Set of 64-bit keys in buckets of four 16-bit fingerprints; two candidate buckets per key (partial-key cuckoo hashing)."""

    SLOTS, KICKS, MASK = 4, 200, 0xFFFFFFFFFFFFFFFF

    def __init__(self, capacity: int = 1024):
        self.size = 1 << max(4, (max(1, capacity) * 5 // (4 * self.SLOTS)).bit_length())
        self.table: list[list[int]] = [[] for _ in range(self.size)]
        self.count, self._turn = 0, 0

    def _place(self, key: int) -> tuple[int, int, int]:
        tag = (key >> 48) or 1
        at = key & (self.size - 1)
        return tag, at, self._other(at, tag)

    def _other(self, at: int, tag: int) -> int:
        return (at ^ (tag * 0x5BD1E995 >> 3)) & (self.size - 1)

    def __contains__(self, key: int) -> bool:
        tag, a, b = self._place(key)
        return tag in self.table[a] or tag in self.table[b]

    def insert(self, key: int) -> bool:
        """False when no slot was found; the filter then has lost a fingerprint and must be rebuilt."""
        tag, a, b = self._place(key)
        for at in (a, b):
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(tag)
                self.count += 1
                return True
        at = a
        for _ in range(self.KICKS):
            self._turn = (self._turn + 1) % self.SLOTS
            bucket = self.table[at]
            bucket[self._turn], tag = tag, bucket[self._turn]
            at = self._other(at, tag)
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(tag)
                self.count += 1
                return True
        return False

    def delete(self, key: int) -> bool:
        tag, a, b = self._place(key)
        for at in (a, b):
            if tag in self.table[at]:
                self.table[at].remove(tag)
                self.count -= 1
                return True
        return False


class CuckooIndex:
    """Live digests with a value each. The filter spares most look-ups; its hits are verified by the whole digest."""

    def __init__(self, capacity: int = 1024):
        self.filter, self.live = CuckooFilter(capacity), {}
        self.resizes = self.false_hits = 0

    @staticmethod
    def _key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def get(self, digest: bytes):
        if self._key(digest) not in self.filter:
            return None
        found = self.live.get(digest)
        self.false_hits += found is None
        return found

    def insert(self, digest: bytes, value) -> None:
        if digest in self.live:
            raise KeyError("digest is live already")
        self.live[digest] = value
        if not self.filter.insert(self._key(digest)):
            self._resize()

    def delete(self, digest: bytes):
        value = self.live.pop(digest)
        self.filter.delete(self._key(digest))
        return value

    def _resize(self) -> None:
        """Rebuild from the stored keys at double capacity until all fit."""
        size = 2 * self.filter.size * CuckooFilter.SLOTS
        while True:
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(self._key(d)) for d in self.live):
                return
            size *= 2


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a batch become one row."""
    for batch in batches:
        out = pa.table({"digest": batch["digest"], "id": batch["id"]}).group_by("digest").aggregate([("id", "max"), ([], "count_all")])
        yield from pa.table({"digest": out["digest"], "keep_id": out["id_max"], "group_size": out["count_all"]}).combine_chunks().to_batches()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, schema = CuckooIndex(KEYS_PER_PARTITION // 8), None
    for batch in batches:
        schema = batch.schema
        for digest, keep, n in zip(*(batch[c].to_pylist() for c in ("digest", "keep_id", "group_size")), strict=True):
            if (old := index.get(digest)) is None:
                index.insert(digest, (keep, n))
                continue
            live, size = index.delete(digest)
            larger = live if keep is None or (live is not None and live >= keep) else keep
            index.insert(digest, (larger, size + n))
    if schema is not None and index.live:
        keys = list(index.live)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            keep, n = zip(*(index.live[k] for k in part), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, schema.field("digest").type), pa.array(keep, schema.field("keep_id").type), pa.array(n, schema.field("group_size").type)], schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after ``normalise`` (default: unchanged; null counts as empty).
    The largest id of a group stays. Null ids count as the smallest: a group of null ids only has a
    null ``keep_id`` and keeps its rows. Rows that repeat both id and text are all marked alike.
    Columns other than the two named aren't read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2((normalise(text) if normalise else text).cast("binary"), 256)).alias("digest")), "digests")
    kind = dict(rows.dtypes)["id"]
    n = max(1, -(-rows.count() // KEYS_PER_PARTITION), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = f"digest binary, keep_id {kind}, group_size bigint"
    keepers = rows.mapInArrow(_fold, schema).repartition(n, "digest").mapInArrow(_index, schema)
    return rows.join(keepers, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
