"""Line dedup by an exact set-similarity join on the words of lines.

A line is a set of distinct words. It goes when an earlier line of the corpus, kept or not, has a Jaccard
similarity of at least the threshold; earlier means a smaller document id, then a smaller line number.

1. Word counts over all documents, in a table of fixed size, give the order of words: rare ones first.
   This scan hashes words only; lines are looked at by the next two.
2. Each set's prefix in that order is posted to buckets of words; sets so small that only an equal one is
   similar enough (up to three words at 0.8) aren't, step 4 needs no more than their count. Within a word's group, pairs are
   filtered by length, by position (what may still match behind it) and by a 64-bit map of
   the words (bits that differ bound the overlap); members with no partner left drop out there. What
   is left is a small table of (word, set).
3. A last scan lists all lines, and the words of the sets concerned with a 512-bit map of them, by which the groups are
   filtered once more. Each set is compared with the earliest of all that lead its groups, on whole word sets. Sets that have
   found an earlier partner are done. The others are compared with every earlier member of their groups that passes the filters.
4. Lines that aren't the first of their set, and lines of sets with an earlier partner, leave the documents.

Comparing with the earliest first keeps a group of m near copies at about m comparisons; lines that
a third of the corpus shares are one set, counted by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Tables, binary, key_filter, mix, row_key, small_batches, span_hash, text_blocks, word_spans

#: Slots of the word count table (a byte each when it is broadcast).
SLOTS = 1 << 20
_CHUNK = 1 << 14
#: Bytes of text behind one bucket of words, at most, up to 2^22 buckets.
BUCKET_BYTES = 3 << 20
#: 64-bit words of the map of a set by which pairs are bounded before their words are read.
MAP = 8
#: A word's group above this size keeps all its members: pairs are filtered later, when the earliest has been tried.
GROUP = 4096
_U64 = np.uint64


# ---------------------------------------------------------------- lines of a block
class Lines:
    """Words of a block's lines. Per word: ``h``, ``line`` (ascending, gaps allowed). Per line with words: document and number."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, doc = word_spans(data, offs)
        self.h = span_hash(data, starts, ends)
        breaks = np.flatnonzero(data == 10)
        before = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(starts, breaks), prepend=0, append=len(starts)))
        line = before + doc  # a document starts a line as a line feed does
        self.heads = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        self.words = np.diff(np.append(self.heads, len(line)))
        self.doc = doc[self.heads]
        self.number = before[self.heads] - np.searchsorted(breaks, offs[self.doc])

    def sets(self, order: np.ndarray | None = None) -> None:
        """Distinct words of each line, by ``order`` (rank of a slot) and hash: ``token``, ``at`` (offsets), ``n``, ``sid``."""
        index = np.repeat(np.arange(len(self.heads), dtype=np.uint64), self.words)
        bits = max(20, len(self.heads).bit_length())  # of a line's index; six are the order's, the hash has the rest
        key = index << _U64(64 - bits)
        if order is not None:
            key |= order[(self.h & _U64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << _U64(58 - bits)
        key |= self.h >> _U64(6 + bits)
        h = self.h[np.argsort(key)]  # lines stay where they are
        new = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        new[self.heads] = True
        self.token = h[new]
        self.at = np.append(0, np.cumsum(np.add.reduceat(new, self.heads, dtype=np.int64) if len(h) else self.heads))
        self.n = np.diff(self.at)
        sums = np.add.reduceat(mix(self.token ^ _U64(0x5851F42D4C957F2D)), self.at[:-1]) if len(self.token) else self.token
        self.sid = mix(sums + self.n.astype(np.uint64)).view(np.int64)


# ---------------------------------------------------------------- word order
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word counts of a task, in chunks; one more chunk holds its bytes."""
    counts, size = np.zeros(SLOTS, np.int64), 0
    for _, data, offs in text_blocks(batches):
        size += len(data)
        starts, ends, _ = word_spans(data, offs)
        counts += np.bincount((span_hash(data, starts, ends) & _U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    if counts.any():
        parts = [*counts.reshape(-1, _CHUNK), np.array([size])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), binary([zstandard.compress(p.tobytes(), 1) for p in parts])], ["chunk", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks that reach a task, one after another."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"], strict=True):
            own = np.frombuffer(zstandard.decompress(counts.as_buffer()), np.int64)
            total[chunk] = total[chunk] + own if chunk in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), binary([zstandard.compress(c.tobytes(), 1) for c in total.values()])], ["chunk", "counts"])


def word_order(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Rank (0 rare .. 63 frequent) of each slot by the counts of all words, and the bytes of the texts (of tasks without a word: none). Tasks' counts are added up in two steps; a megabyte or so reaches the driver, whatever the corpus."""
    layout = "chunk int, counts binary"
    some = texts.mapInArrow(_count, layout).withColumn("salt", (F.rand(1) * 64).cast("int"))
    rows = some.repartition("chunk", "salt").select("chunk", "counts").mapInArrow(_add, layout).repartition("chunk").mapInArrow(_add, layout).collect()
    out, size = np.zeros(SLOTS, np.uint8), 0
    for r in rows:
        total = np.frombuffer(zstandard.decompress(r["counts"]), np.int64)
        if r["chunk"] == SLOTS // _CHUNK:
            size = int(total[0])
            continue
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.minimum(2 * np.log2(np.maximum(total, 1)), 63).astype(np.uint8)
    return out, size


# ---------------------------------------------------------------- candidates
def _needed(percent: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of sets of n and m words."""
    return -(-percent * (n + m) // (100 + percent))


def _post(order, percent: int, least_words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in text_blocks(batches):
            lines = Lines(data, offs)
            if not len(lines.heads):
                continue
            lines.sets(order.value)
            n = lines.n
            # a set that no other one can be similar enough to isn't posted: its repeats are counted by sid
            enough = np.flatnonzero((lines.words >= least_words) & (100 * n >= percent * (n + 1)))
            _, first = np.unique(lines.sid[enough], return_index=True)
            chosen = np.sort(enough[first])
            if not len(chosen):
                continue
            bitmap = np.bitwise_or.reduceat(_U64(1) << (lines.token >> _U64(58)), lines.at[:-1])
            length = n[chosen] - -(-percent * n[chosen] // 100) + 1
            line, ends = np.repeat(chosen, length), np.cumsum(length)
            post = np.arange(ends[-1]) - np.repeat(ends - length, length)  # place in the set
            token = lines.token[lines.at[line] + post]
            bucket = (token & _U64((1 << bits) - 1)).astype(np.int64)
            deal = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")  # 16 bits are sorted by digits
            post, line, token, bucket = post[deal], line[deal], token[deal], bucket[deal]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            rows = []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                small = np.stack((n[line[x:y]], post[x:y])).astype("<u4")
                planes = zstandard.compress(np.ascontiguousarray(small.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)).tobytes(), 1)
                name = np.ascontiguousarray(token[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])
                rows.append((int(bucket[x]), y - x, name.tobytes() + lines.sid[line[x:y]].tobytes() + bitmap[line[x:y]].tobytes() + planes))
            b, size, payload = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(size, pa.int32()), binary(payload)], ["bucket", "size", "payload"])

    return run


def _by_token(token: np.ndarray, sid: np.ndarray) -> np.ndarray:
    """An order in which equal tokens, and of those equal sids, stand together. One key of parts of both sorts faster; where parts don't tell, whole values do."""
    part = _U64((1 << 24) - 1)
    key = (token & ~part) | (sid.view(np.uint64) & part)
    by = np.argsort(key)
    key, a, b = key[by], token[by], sid[by]
    mixed = ((key[1:] ^ key[:-1]) <= part) & (a[1:] != a[:-1])
    mixed |= (key[1:] == key[:-1]) & (b[1:] != b[:-1])
    return np.lexsort((sid, token)) if mixed.any() else by


def _partners(percent: int):
    """Members of a bucket's words that have a possible partner, once per word and set."""

    def run(group: pa.Table) -> pa.Table:
        names, sids, maps, smalls = [], [], [], []
        for size, payload in zip(group["size"].to_pylist(), group["payload"], strict=True):
            raw = payload.as_buffer()
            name = np.zeros((size, 8), np.uint8)
            name[:, 2:] = np.frombuffer(raw, np.uint8, 6 * size).reshape(size, 6)
            names.append(name.view("<u8").ravel())
            sids.append(np.frombuffer(raw, "<i8", size, 6 * size))
            maps.append(np.frombuffer(raw, "<u8", size, 14 * size))
            planes = np.frombuffer(zstandard.decompress(memoryview(raw)[22 * size :]), np.uint8).reshape(2, 4, size)
            smalls.append(np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(2, size).astype(np.int64))
        token, sid, bitmap, (n, place) = np.concatenate(names), np.concatenate(sids), np.concatenate(maps), np.concatenate(smalls, axis=1)
        by = _by_token(token, sid)
        token, sid, bitmap, n, place = token[by], sid[by], bitmap[by], n[by], place[by]
        once = np.append(True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]))
        token, sid, bitmap, n, place = token[once], sid[once], bitmap[once], n[once], place[once]
        keep = _with_partner(percent, token, n, place, bitmap[:, None])
        return pa.table([pa.array(token[keep].view(np.int64)), pa.array(sid[keep]), pa.array(n[keep]), pa.array(place[keep])], names=["token", "sid", "n", "place"])

    return run


def _with_partner(percent: int, token: np.ndarray, n: np.ndarray, place: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Which members, in order of their words, may be similar to another one of their word's group: by length, position and map."""
    new = np.append(True, token[1:] != token[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(token)))
    keep = np.repeat(size > GROUP, size)
    own = np.flatnonzero(np.repeat((size > 1) & (size <= GROUP), size))
    if not len(own):
        return keep
    # by size within a word: what is behind a member's place bounds the size of its larger partners, which stand next to it
    key = np.cumsum(new)[own] << 32 | n[own]
    by = np.argsort(key)
    key, own = key[by], own[by]
    n, rest, maps = n[own], n[own] - place[own], maps[own]
    largest = np.minimum(rest * (100 + percent) // percent - n, (1 << 32) - 1)
    last = np.searchsorted(key, (key & ~np.int64((1 << 32) - 1)) | np.maximum(largest, 0), "right") - 1
    found, alive, step = np.zeros(len(own), bool), np.arange(len(own)), 1
    while len(alive := alive[alive + step <= last[alive]]):
        j = alive + step
        need = _needed(percent, n[alive], n[j])
        fits = rest[j] >= need
        i, j, need = alive[fits], j[fits], need[fits]
        fits = n[i] + n[j] - np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64) >= 2 * need
        found[i[fits]] = found[j[fits]] = True
        step += 1
    keep[own[found]] = True
    return keep


def _again(percent: int):
    """The members that still have a possible partner by the wider maps."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("token")
        maps = np.stack([group[f"m{w}"].to_numpy().view(np.uint64) for w in range(MAP)], axis=1)
        keep = _with_partner(percent, group["token"].to_numpy(), group["n"].to_numpy(), group["place"].to_numpy(), maps)
        return group.filter(pa.array(keep)).drop_columns(["bucket"])

    return run


# ---------------------------------------------------------------- comparison
def _packed(tokens: np.ndarray, each: np.ndarray) -> bytes:
    """Six bytes a word, in ascending order within each set; ``each`` is the set of a word, ascending."""
    names = tokens >> _U64(16)
    if ((each[1:] == each[:-1]) & (names[1:] < names[:-1])).any():
        names = names[np.lexsort((names, each))]
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(words: pa.BinaryScalar) -> np.ndarray:
    raw = np.frombuffer(words.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _scan(least_words: int, wanted, schema: pa.Schema):
    """A row for each line of enough words; with the first of a block's lines of a set that a filter lets through go its words and their map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_blocks(batches):
            lines = Lines(data, offs)
            if not len(lines.heads):
                continue
            lines.sets()
            use = np.flatnonzero(lines.words >= least_words)
            sid, at = lines.sid[use], lines.at
            hit = np.flatnonzero(wanted(sid))
            first = hit[np.unique(sid[hit], return_index=True)[1]]
            words, maps = np.full(len(use), None, object), np.zeros((len(use), MAP), np.uint64)
            if len(first):
                chosen = use[first]
                each = np.repeat(np.arange(len(first)), lines.n[chosen])
                token = lines.token[np.arange(len(each)) - np.repeat(np.cumsum(lines.n[chosen]) - lines.n[chosen], lines.n[chosen]) + np.repeat(at[chosen], lines.n[chosen])]
                bit = ((token >> _U64(16)) & _U64(64 * MAP - 1)).astype(np.int64)
                np.bitwise_or.at(maps.reshape(-1), first[each] * MAP + (bit >> 6), _U64(1) << (bit & 63).astype(np.uint64))
                ends = np.cumsum(lines.n[chosen])
                packed = _packed(token, each)
                words[first] = [packed[6 * x : 6 * y] for x, y in zip((ends - lines.n[chosen]).tolist(), ends.tolist(), strict=True)]
            rows = pa.array(lines.doc[use])
            columns = [pa.array(sid), *(batch[c].take(rows) for c in ("id", "k1", "k2")), pa.array(lines.number[use].astype(np.int32)), binary(words.tolist()), *(pa.array(maps[:, w].view(np.int64)) for w in range(MAP))]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch["words"], batch["other"], strict=True):
                a, b = _unpacked(x), _unpacked(y)
                common = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
                hit.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch["sid"].filter(pa.array(hit, pa.bool_()))], ["sid"])

    return run


def _beaten(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Sets of ``pairs`` (sid, rival; distinct) that are similar enough to a rival, by the words that stand in ``lines``."""
    wanted = key_filter(pairs.select("sid").union(pairs.select("rival")), "sid")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch["sid"].to_numpy(zero_copy_only=False))))

    sets = lines.where("words IS NOT NULL").select("sid", "words").mapInArrow(some, "sid bigint, words binary").dropDuplicates(["sid"])
    both = pairs.join(sets, "sid").join(sets.select(F.col("sid").alias("rival"), F.col("words").alias("other")), "rival").select("sid", "words", "other")
    return both.mapInArrow(_linked(percent), "sid bigint").distinct()


def dropped_lines(keyed: DataFrame, percent: int, least_words: int, tables: Tables) -> DataFrame:
    """(k1, k2, lines): numbers of the lines that go, for rows (id, k1, k2, text) that lose any. It reads what it has written to ``tables``."""
    spark, stored = keyed.sparkSession, tables.stored
    texts = keyed.select("text")
    kind = dict(keyed.dtypes)["id"]
    order, size = word_order(texts)
    order = spark.sparkContext.broadcast(order)
    bits = min(22, max(4, (size // BUCKET_BYTES).bit_length()))
    posted = texts.mapInArrow(_post(order, percent, least_words, bits), "bucket int, size int, payload binary")
    members = stored(posted.groupBy("bucket").applyInArrow(_partners(percent), "token bigint, sid bigint, n bigint, place bigint"), "members")
    maps = [f"m{w}" for w in range(MAP)]
    layout = T.StructType.fromDDL(f"sid bigint, id {kind}, k1 bigint, k2 bigint, line int, words binary, " + ", ".join(f"{m} bigint" for m in maps))
    lines = stored(keyed.mapInArrow(_scan(least_words, key_filter(members, "sid"), to_arrow_schema(layout)), layout), "lines")

    place = F.struct("id", "k1", "line")
    firsts = stored(lines.groupBy("sid").agg(F.min(place).alias("first"), F.count("*").alias("times")), "firsts")
    mapped = lines.where("words IS NOT NULL").groupBy("sid").agg(*(F.max(m).alias(m) for m in maps))  # equal for equal sets
    near = members.join(mapped, "sid").join(firsts.drop("times"), "sid").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(1 << bits)))
    layout = f"token bigint, sid bigint, n bigint, place bigint, first struct<id: {kind}, k1: bigint, line: int>, " + ", ".join(f"{m} bigint" for m in maps)
    known = stored(near.groupBy("bucket").applyInArrow(_again(percent), layout), "members")
    earliest = known.groupBy("token").agg(F.min(F.struct("first", "sid", "n", *maps)).alias("e"))
    theirs = [F.col(m).alias(f"o{m}") for m in maps]
    rivals = known.select("token", F.col("sid").alias("rival"), F.col("n").alias("m"), F.col("first").alias("before"), F.col("place").alias("at"), *theirs)
    need = F.floor((F.lit(percent) * (F.col("n") + F.col("m")) + F.lit(99 + percent)) / F.lit(100 + percent))
    # bounds that no similar pair fails: by sizes, and by the bits in which the maps differ
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"o{m}"))) for m in maps[1:]), F.bit_count(F.col("m0").bitwiseXOR(F.col("om0"))))
    possible = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("n") + F.col("m") - differ >= 2 * need)
    first = earliest.select("token", F.col("e.first").alias("before"), F.col("e.sid").alias("rival"), F.col("e.n").alias("m"), *(F.col(f"e.{m}").alias(f"o{m}") for m in maps))
    one = known.join(first, "token").where("sid <> rival").where(possible).groupBy("sid").agg(F.min(F.struct("before", "rival")).alias("r"))
    pairs = stored(one.select("sid", F.col("r.rival").alias("rival")), "pairs")
    beaten = stored(_beaten(pairs, lines, percent), "beaten")
    open_ = known.join(beaten, "sid", "left_anti")
    behind = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= need  # what may still match from the common word on
    more = open_.join(rivals, (open_["token"] == rivals["token"]) & (F.col("before") < F.col("first")) & possible & behind).select("sid", "rival").distinct()
    more = stored(more.join(pairs, ["sid", "rival"], "left_anti"), "pairs")
    beaten = stored(beaten.union(_beaten(more, lines, percent)), "beaten")

    # a set whose only line stays needs no look at its lines
    matter = firsts.join(beaten.withColumn("beaten", F.lit(True)), "sid", "left").where("beaten OR times > 1")
    gone = lines.join(matter.select("sid", "first", "beaten"), "sid").where(F.coalesce("beaten", F.lit(False)) | (place > F.col("first")))
    return gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("lines"))


def line_dedup(docs: DataFrame, percent: int = 80, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines``, ``n_dropped``; all rows and columns stay, columns of these two names are replaced.

    Lines end at LF. A line goes when an earlier one has 100 * common words >= percent * all words
    (distinct words, unchanged). Lines of fewer than ``least_words`` words always stay. Null texts stay null (no lines), empty ones
    empty (one line). Null ids come first, equal ids are ordered by a hash; rows that repeat id and text are
    one row here: their lines go or stay alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    passing = Tables(spark)
    gone = Tables(spark).stored(dropped_lines(keyed, percent, least_words, passing), "dropped")
    passing.drop()
    k1, k2 = row_key(id_col, text_col)
    # names that clash with no column of the input
    a, b, c, d = (next(n for n in (f"_{x}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("k1_", "k2_", "lines_", "parts_"))
    out = docs.withColumns({a: k1, b: k2}).join(gone.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("lines").alias(c)), [a, b], "left")
    out = out.withColumn(d, F.split(F.col(text_col), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(d) - 1), F.col(c))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col(d), i)), "\n")
    counts = {"n_lines": F.coalesce(F.size(d), F.lit(0)), "n_dropped": F.coalesce(F.size(c), F.lit(0))}
    extra = [v.cast("int").alias(k) for k, v in counts.items()]
    text = F.when(F.col(c).isNull(), F.col(text_col)).otherwise(left).alias(text_col)
    return out.select(*(text if n == text_col else F.col(n) for n in docs.columns if n not in counts), *extra)
