"""MinHash near-dedup by min-max hashing: links at a Jaccard similarity of word shingles, confirmed exactly.

Each permutation yields the least and the greatest value of a set, two nearly independent samples
for one hash evaluation; three permutations (six values) make a band. Sets with equal hashes are one
node. Nodes that share a band are candidates, but a band's members aren't paired with one another:

1. In a few rounds each member is compared with one pivot of the band, the confirmed links are joined to
   components, and only bands that still hold several components are looked at again.
2. What is left of a band goes, set by set, to tasks of bounded size: the members outside its largest component
   meet all others there. A task joins components as it confirms links, so two components are compared no further once
   one link is found, and returns the links that joined them: at most one a member, never a row a pair.

Before sets are compared, a pair must pass bounds that no linked pair fails: by sizes, and by a
1024-bit map of each set, in which the bits that differ can't outnumber the shingles that differ. A tight
group of m copies costs about m comparisons, and no link between different sets that share a band is lost. With 32
bands a pair at 0.85 shares none once in four million, at 0.8 once in 15,000 (more bands: fewer).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Tables, binary, key_filter, mix, rolling, row_key, small_batches, span_hash, text_blocks, word_spans
from .components import components

#: Permutations that make a band; each gives a least and a greatest value.
PER_BAND = 3
#: Rounds against one pivot of a band before what is left of a band is compared at once.
PIVOT_ROUNDS = 3
#: What one of the two parts of a band that meet in a task weighs: its shingles, and so many more for each set.
PART, SET = 1 << 20, 64
#: 64-bit words of the map of a set.
MAP = 16
#: Members of a pivot that one task compares.
MEMBERS_PER_TASK = 500
_U64 = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their offsets (n + 1).

    A-Z is lower-cased. A document with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offs)
    n = len(offs) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    h = span_hash(data, starts, ends)
    windows = rolling(h, width)
    out = []
    for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if y - x >= width:
            own = np.sort(windows[x : y - width + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif y > x:
            out.append(mix(rolling(h[x:y], y - x) + _U64(y - x)))
        else:
            out.append(h[:0])
    lens = np.fromiter(map(len, out), np.int64, n)
    return (np.concatenate(out) if out else h[:0]), np.concatenate(([0], np.cumsum(lens)))


def min_max_bands(sets: np.ndarray, offs: np.ndarray, bands: int) -> np.ndarray:
    """(documents, bands) 64-bit band hashes; every set must have an element."""
    rng = np.random.default_rng(77)
    heads, x = offs[:-1], (sets >> _U64(32)).astype(np.uint32)
    out = np.empty((len(heads), bands), np.int64)
    for band in range(bands):
        h = np.full(len(heads), band + 1, np.uint64)
        for _ in range(PER_BAND):
            a, b = (np.uint32(v | 1) for v in rng.integers(1, 2**32, 2, dtype=np.uint64).tolist())
            v = x * a
            v ^= v >> np.uint32(15)
            v *= b
            for extreme in (np.minimum.reduceat(v, heads), np.maximum.reduceat(v, heads)):
                h = mix(h ^ extreme.astype(np.uint64)) + _U64(0x9E3779B97F4A7C15)
        out[:, band] = h.view(np.int64)
    return out


def bit_maps(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, MAP) words: bit h mod 1024 is set for each hash h."""
    out = np.empty((len(offs) - 1, MAP), np.int64)
    at = (sets & _U64(64 * MAP - 1)).astype(np.int64)
    for x in range(0, len(out), 4096):
        heads = offs[x : x + 4097]
        bits = np.zeros((len(heads) - 1, 64 * MAP), bool)
        bits[np.repeat(np.arange(len(heads) - 1), np.diff(heads)), at[heads[0] : heads[-1]]] = True
        out[x : x + 4096] = np.packbits(bits, axis=1).view("<i8")
    return out


def _signatures(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_blocks(batches):
            sets, at = shingle_sets(data, offs, width)
            size = np.diff(at)
            full = np.flatnonzero(size)
            raw = sets.view(np.uint8).tobytes()
            node = [int.from_bytes(hashlib.blake2b(raw[8 * x : 8 * y], digest_size=8).digest(), "little", signed=True) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            values = min_max_bands(sets, np.append(at[:-1][full], at[-1]), bands) if len(full) else np.zeros((0, bands), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(size, bands, 0)))), pa.int32()), pa.array(values.ravel()))
            maps = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * MAP, pa.int32()), pa.array(bit_maps(sets, at).ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["k1"], batch["k2"], pa.array(size, pa.int64()), pa.array(node, pa.int64()), lists, maps], ["id", "k1", "k2", "n", "node", "bands", "map"])

    return run


def _sets(width: int, wanted):
    """Sets of the rows that a filter of keys lets through; six bytes of each hash are enough to count the common elements of two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(wanted(batch["k1"].to_numpy(zero_copy_only=False))))
            for part, data, offs in text_blocks(iter([some])):
                sets, at = shingle_sets(data, offs, width)
                raw = np.ascontiguousarray(sets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])
                yield pa.RecordBatch.from_arrays([part["k1"], part["k2"], binary([raw[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])], ["k1", "k2", "hashes"])

    return run


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.sort(out.view("<u8").ravel())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _compare(percent: int):
    """Rows of a pivot come together, its own set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in batches:
            links = []
            for c, node, hashes in zip(batch["pivot"].to_pylist(), batch["node"].to_pylist(), batch["hashes"], strict=True):
                values = _unpacked(hashes.as_buffer())
                if c == node:
                    pivot, own = c, values
                    continue
                if c != pivot:
                    raise ValueError("a pivot's set is missing")
                if _linked(own, values, percent):
                    links.append((c, node))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (pivot, node; distinct) that are linked, as a, b."""
    spark = pairs.sparkSession
    tasks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("tasks"))
    deal = F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int").alias("task")
    wants = pairs.join(tasks, "pivot").select("pivot", "node", deal, F.lit(1).alias("role")).union(tasks.select("pivot", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("role")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = wants.join(sets.select("node", "hashes"), "node").repartition(n, "pivot", "task").sortWithinPartitions("pivot", "task", "role").select("pivot", "node", "hashes")
    return rows.mapInArrow(_compare(percent), "a bigint, b bigint")


def _meet(percent: int):
    """Links that join components, of the pairs that meet in a task: part ``x`` of a band against part ``y``, and itself where the task is its last."""

    def run(group: pa.Table) -> pa.Table:
        first = group["part"].to_numpy() == group["x"][0].as_py()
        group = pa.concat_tables([group.filter(pa.array(first)), group.filter(pa.array(~first))]).combine_chunks()  # part x comes first
        own, node, size, root = int(first.sum()), group["node"].to_numpy(), group["n"].to_numpy(), group["label"].to_numpy().copy()
        maps = group["map"].combine_chunks().flatten().to_numpy().reshape(-1, MAP).view(np.uint64)
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(group), -1)
        place = int(np.argmax(bands[0] == group["band"][0].as_py()))
        raw, sets, links = group["hashes"].combine_chunks(), {}, []

        def values(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = _unpacked(raw[k].as_buffer())
            return sets[k]

        within = group["last"][0].as_py()
        for i in range(own):
            j = np.arange(i + 1 if within else own, len(node))
            j = j[(root[j] != root[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
            differ = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
            fits = differ * (100 + percent) <= (size[j] + size[i]) * (100 - percent)
            j, differ = j[fits], differ[fits]
            met = (bands[j, :place] == bands[i, :place]).any(1)  # in an earlier band, as both are of several components there
            j, differ = j[~met], differ[~met]
            for k in j[np.argsort(differ, kind="stable")].tolist():
                if root[k] != root[i] and _linked(values(i), values(k), percent):
                    links.append((int(node[i]), int(node[k])))
                    root[root == root[k]] = root[i]
            sets.pop(i, None)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _rest(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components (``label``) that share a band in ``now`` (band, node, label), enough to join all that are linked."""
    weighed = now.join(sets.select("node", "n"), "node")
    labels = weighed.groupBy("band", "label").agg(F.sum(F.col("n") + SET).alias("w"))
    split = labels.groupBy("band").agg(F.max(F.struct("w", "label")).alias("most"), F.sum("w").alias("all"))
    # parts 0 .. few - 1 are of the others, the rest of the largest component
    few, many = F.ceil((F.col("all") - F.col("most.w")) / PART).cast("int"), F.ceil(F.col("most.w") / PART).cast("int")
    rows = now.join(split.select("band", F.col("most.label").alias("large"), few.alias("few"), (few + many).alias("parts")), "band")
    large = F.col("label") == F.col("large")
    part = F.when(large, F.col("few") + F.pmod(F.xxhash64("node"), F.col("parts") - F.col("few"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int")
    rows = rows.withColumn("part", part)
    others = F.when(large, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part")))
    rows = rows.withColumn("other", F.explode(others)).select("band", "node", "label", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.greatest("part", "other") == F.col("parts") - 1).alias("last"))
    return rows.join(sets, "node").groupBy("band", "x", "y").applyInArrow(_meet(percent), "a bigint, b bigint")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``, ``n_links`` of the row's set to other sets found on the way.

    Sets of distinct ``width``-word shingles are linked when 100 * intersection >= percent * union.
    ``component_id`` is the least id reachable; a row stays if it has that id. Rows without words are
    linked with nothing. Null ids count as none: a component of null ids only has a null id and keeps its
    rows; so do all rows that repeat the least id. An empty table gives no rows. Columns but the two named aren't read.
    ``with_key`` adds ``k1``, ``k2``, the row's key (see ``row_key``), and ``leader``: true for one key of each component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    held, passing = Tables(spark), Tables(spark)  # what the result reads, and what it doesn't
    keyed = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = passing.stored(keyed.mapInArrow(_signatures(width, bands), f"id {kind}, k1 bigint, k2 bigint, n bigint, node bigint, bands array<bigint>, map array<bigint>"), "signatures")

    first = F.min(F.struct("id", "k1", "k2"))
    known = scanned.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least_id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "k1", "k2"))).alias("named"), first.alias("any"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("map").alias("map"))
    nodes = passing.stored(known.select("node", "least_id", F.coalesce("named", "any").alias("lead"), "n", "bands", "map"), "nodes")
    members = nodes.select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    open_ = passing.stored(members.join(shared.select("band"), "band"), "bands")
    # the leading row of a node carries its text
    carrier = passing.stored(nodes.join(open_.select("node").distinct(), "node", "left_semi").select("node", "lead.k1", "lead.k2", "n", "bands", "map"), "carriers")
    texts = keyed.select("k1", "k2", "text").mapInArrow(_sets(width, key_filter(carrier, "k1")), "k1 bigint, k2 bigint, hashes binary")
    sets = passing.stored(texts.join(carrier, ["k1", "k2"]).drop("k1", "k2").dropDuplicates(["node"]), "sets")
    maps = carrier.select("node", "n", *(F.col("map")[k].alias(f"w{k}") for k in range(MAP)))
    other = maps.select(F.col("node").alias("pivot"), F.col("n").alias("m"), *(F.col(f"w{k}").alias(f"v{k}") for k in range(MAP)))
    differ = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(1, MAP)), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))
    possible = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))

    now, links = open_.withColumn("label", F.col("node")), None
    for turn in range(PIVOT_ROUNDS + 1):
        if turn:
            labels = components(links, tables=passing)
            now = open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            mixed = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
            now = passing.stored(now.join(mixed.select("band"), "band"), "mixed")
        if turn < PIVOT_ROUNDS:
            order = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "label")
            pivots = now.groupBy("band").agg(F.min(order).alias("p")).select("band", F.col("p.node").alias("pivot"), F.col("p.label").alias("far"))
            found = now.join(pivots, "band").where("label <> far").select("pivot", "node").distinct().join(maps, "node").join(other, "pivot").where(possible).select("pivot", "node")
            confirmed = _confirmed(passing.stored(found, "pairs"), sets, percent)
        else:
            confirmed = _rest(now, sets, percent)
        confirmed = passing.stored(confirmed, "links")
        links = confirmed if links is None else links.union(confirmed)

    labels = components(links, tables=passing)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.select("node", "least_id", "lead").join(labels, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = passing.stored(named, "labels")
    best = F.coalesce(F.min(F.when(F.col("lead.id").isNotNull(), F.col("lead"))), F.min("lead"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"), best.alias("leader"))
    classes = held.stored(named.join(least, "label").select("node", "component_id", "leader", "n_links"), "classes")
    rows = held.stored(scanned.select("id", "k1", "k2", "n", "node"), "rows")
    passing.drop()
    full = rows.join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    key = ["k1", "k2", (F.col("node").isNull() | ((F.col("k1") == F.col("leader.k1")) & (F.col("k2") == F.col("leader.k2")))).alias("leader")] if with_key else []
    return full.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), *key
    )
