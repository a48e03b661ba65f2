"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

File format, all integers little-endian. A file is a run of frames:

    u64 length of the payload | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | LF

    payload: u8 bytes per id (2 or 4) | u8 1 if the document has an id, else 0 | i64 document id | ids

The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, so that checksums of data that
hold checksums stay useful. The LF is the record separator of Spark's text writer, which lays the
frames down: files are written and read by Spark alone and may live in any store it can reach.
Files are ``part-NNNNN...`` in ascending order of document ids (null ids first), and the index, a
table of its own, has part, record, doc_id, offset, frame bytes and ids of each frame.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import ChunkEncoder, ids_per_document, space_cuts
from .common import binary, fresh_path, small_batches, text_blocks

HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<IB")
BODY = struct.Struct("<BBq")
INDEX = "part int, record bigint, doc_id bigint, offset bigint, bytes bigint, n_tokens bigint"
#: Bytes of text behind one file, on average.
BYTES_PER_FILE = 8 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = BODY.pack(width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, TAIL.pack(masked_crc(payload), 10)))


def frames(content: bytes | memoryview, verify: bool = True) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, frame bytes, document id and ids of each frame; raises ValueError on damage."""
    content, at = memoryview(content), 0
    while at < len(content):
        if at + HEAD.size > len(content):
            raise ValueError(f"frame at {at} is cut off")
        length, crc = HEAD.unpack_from(content, at)
        if masked_crc(content[at : at + 8]) != crc:
            raise ValueError(f"the length at {at} is damaged")
        end = at + HEAD.size + length
        if end + TAIL.size > len(content):
            raise ValueError(f"frame at {at} is cut off")
        payload = content[at + HEAD.size : end]
        check, lf = TAIL.unpack_from(content, end)
        if lf != 10 or (verify and masked_crc(payload) != check):
            raise ValueError(f"the payload at {at} is damaged")
        width, known, doc_id = BODY.unpack_from(payload, 0)
        yield at, end + TAIL.size - at, doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=BODY.size)
        at = end + TAIL.size


#: Chunks that go through the library as one text.
JOINED = 200


def _encoded(tok, length: np.ndarray, chunks: list[bytes]) -> list[bytes]:
    """Ids (little-endian u32) of each chunk. A call costs more than a chunk's merges, so chunks go through the library together.

    They are joined where the pre-tokenizer cuts for sure, after `` a`` where they don't begin with a space. A chunk's
    ids are those that cover its bytes. Chunks without a sure cut before and behind them, or whose bytes ids don't cover, go alone.
    """
    padded = [c if c[0] == 32 else b" a" + c for c in chunks]
    data = np.frombuffer(b"".join(padded), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, padded), np.int64, len(padded)))
    starts = ends - np.fromiter(map(len, chunks), np.int64, len(chunks))
    cut = np.zeros(len(data) + 1, bool)
    cut[space_cuts(data, np.array([0, len(data)]))[0]] = cut[-1] = True
    texts = [b"".join(padded[at : at + JOINED]).decode() for at in range(0, len(padded), JOINED)]
    ids = np.concatenate([np.array(e.ids, "<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
    edges = np.concatenate(([0], np.cumsum(length[ids])))
    a, b = (np.minimum(np.searchsorted(edges, at), len(edges) - 1) for at in (starts, ends))
    sure = cut[starts] & cut[ends] & (edges[a] == starts) & (edges[b] == ends)
    raw = ids.tobytes()
    out = [raw[x:y] for x, y in zip((4 * a).tolist(), (4 * b).tolist(), strict=True)]
    alone = np.flatnonzero(~sure).tolist()
    for i, e in zip(alone, tok.encode_batch_fast([chunks[i].decode() for i in alone], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def library_encoder(path: str) -> ChunkEncoder:
    """The tokenizers library on distinct chunks, once per worker. Strings of special tokens in a text are special tokens, as the library has it."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        sizes = {i: len(t) for t, i in tok.get_vocab(with_added_tokens=False).items()}  # a byte-level vocabulary has a character a byte
        sizes |= {i: len(t.content.encode()) for i, t in tok.get_added_tokens_decoder().items()}
        length = np.zeros(max(sizes) + 1, np.int64)
        length[list(sizes)] = list(sizes.values())

        def encode(chunks: list[bytes]) -> list[bytes]:
            out: list[bytes] = []
            for at in range(0, len(chunks), 2_000):  # the library's results are large
                out += _encoded(tok, length, chunks[at : at + 2_000])
            return out

        _ENCODERS[path] = ChunkEncoder(encode)
    return _ENCODERS[path]


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty) and write them to ``path`` in ascending order of ids; ``end_id`` is appended to each.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library, present on every node. Ids must fit
    ``width`` bytes. Rows with equal ids are all written, ordered by a hash of the text. Texts are shuffled once, by range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-size // BYTES_PER_FILE))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch, data, offs in text_blocks(batches):
            starts, ends = space_cuts(data, offs)
            ids, counts = encoder([(data, starts, ends)])[0]
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"an id doesn't fit {width} bytes")
            at = ids_per_document(starts, counts, offs)
            rows = [frame(d, np.concatenate((ids[a:b], tail)), width)[:-1] for d, a, b in zip(batch["id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([binary(rows)], ["frame"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    # a cast keeps bytes as they are; the writer closes each frame with LF
    ordered.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "content")


def build_index(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Write the offset index of the files in ``path`` to ``to`` and return it."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch["part"].to_pylist(), batch["content"], strict=True):
                rows = [(part, k, d, at, size, len(ids)) for k, (at, size, d, ids) in enumerate(frames(memoryview(content.as_buffer()), verify=False))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)], ["part", "record", "doc_id", "offset", "bytes", "n_tokens"])

    small_batches(spark)
    _files(spark, path).mapInArrow(walk, INDEX).write.parquet(to)
    return spark.read.schema(INDEX).parquet(to)


def read_records(spark: SparkSession, path: str, index: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document as written, checksums verified: part, record, doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, u32)."""
    schema = "part int, record bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, content in zip(batch["part"].to_pylist(), batch["base"].to_pylist(), batch["content"], strict=True):
                rows, size = [], 0
                for k, (_, _, d, ids) in enumerate(frames(memoryview(content.as_buffer()))):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((part, k, d, base, len(ids), zlib.crc32(raw), *[raw] * with_ids))
                    base, size = base + len(ids), size + len(raw) * with_ids
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * with_ids]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "record", "doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    small_batches(spark)
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # file contents aren't shuffled: the table of files is small by construction (one row per 8 MB of text)
    return _files(spark, path).join(F.broadcast(before), "part").mapInArrow(parse, schema)


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """Documents in a random order that only ``seed`` decides: part, record, doc_id, n_tokens, ids."""
    docs = read_records(spark, path, index).select("part", "record", "doc_id", "n_tokens", "ids")
    return docs.orderBy(F.xxhash64(F.lit(seed), "part", "record"), "part", "record")


def token_records(docs: DataFrame, tokenizer: str, end_id: int | None, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write, index and read back: doc_id, start, n_tokens, ids_crc32 and where the record lies."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-records")
    write_records(docs, f"{path}/data", tokenizer, end_id, width, id_col, text_col)
    index = build_index(spark, f"{path}/data", f"{path}/index")
    return read_records(spark, f"{path}/data", index, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "record")
