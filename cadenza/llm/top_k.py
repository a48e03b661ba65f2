"""Exact top-k search by inner product with block-at-a-time pruning.

Components are terms and vectors documents. Candidates are dealt into groups of bounded size; a group
holds ranges of 64 vectors as blocks, each with the greatest and least value of every term and a
forward index (its vectors as rows). Every query meets every group: for it, blocks are ordered by the sum of
term maxima (maximum where the query is positive, minimum where it is negative, times the query),
scored through their forward index in that order, and left once the bound is below the k-th best score
so far. Equal bounds are scored, since ties go to the smaller id. What the groups return, k rows a
query at most, is ranked once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary, small_batches

#: Vectors of a block, of a group of blocks, and of a packed row of queries.
BLOCK, GROUP, PACK = 64, 1 << 15, 256
_GROUP_ROW = "part int, role int, ids binary, vectors binary, width int"


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to smaller ids, in order."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class BlockIndex:
    """Blocks of vectors with their term maxima and minima."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.heads = np.arange(0, len(ids), block)
        self.block, self.scored = block, 0
        if len(ids):
            self.high, self.low = np.maximum.reduceat(self.vectors, self.heads), np.minimum.reduceat(self.vectors, self.heads)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = self.ids[:0], np.zeros(0, self.vectors.dtype)
        if not len(self.ids):
            return ids, scores
        bounds = self.high @ np.maximum(query, 0) + self.low @ np.minimum(query, 0)
        order, at, step = np.argsort(-bounds, kind="stable"), 0, 4
        while at < len(order) and (len(ids) < k or bounds[order[at]] >= scores[-1]):
            chosen = order[at : at + step]
            if len(ids) == k:
                chosen = chosen[bounds[chosen] >= scores[-1]]
            rows = (self.heads[chosen][:, None] + np.arange(self.block)).ravel()
            rows = rows[rows < len(self.ids)]
            found = self.vectors[rows] @ query
            own = self.ids[rows]
            self.scored += len(rows)
            other = own != query_id
            ids, scores = _best(np.concatenate((ids, own[other])), np.concatenate((scores, found[other])), k)
            at, step = at + step, min(2 * step, 128)
        return ids, scores


def _pack(role: int, rows: int):
    """Rows of many vectors; the parts of queries are set later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                widths = part["values"].value_lengths().to_numpy(zero_copy_only=False)
                for width in np.unique(widths).tolist():
                    own = part.filter(pa.array(widths == width))
                    values = own["values"].flatten().to_numpy(zero_copy_only=False).astype("<i8")
                    parts = own["part"].to_numpy(zero_copy_only=False)
                    for p in np.unique(parts).tolist():
                        here = parts == p
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p], pa.int32()), pa.array([role], pa.int32()), binary([own["id"].to_numpy(zero_copy_only=False)[here].astype("<i8").tobytes()]), binary([values.reshape(len(parts), width)[here].tobytes()]), pa.array([width], pa.int32())],
                            ["part", "role", "ids", "vectors", "width"],
                        )

    return run


def _search(k: int):
    """Within a task: packed candidates of a group first, then packed queries, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, index, found = None, [], {}, []
        for batch in batches:
            for p, role, ids, vectors, width in zip(*(batch[c].to_pylist() for c in ("part", "role", "ids", "vectors", "width")), strict=True):
                if p != part:
                    part, held, index = p, [], {}
                ids = np.frombuffer(ids, "<i8")
                vectors = np.frombuffer(vectors, "<i8").reshape(len(ids), width)
                if role == 0:
                    held.append((width, ids, vectors))
                    continue
                if width not in index:
                    own = [x for x in held if x[0] == width]
                    if not own:
                        continue
                    all_ids, all_vectors = np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own])
                    index[width] = BlockIndex(all_ids, all_vectors), BlockIndex(all_ids, all_vectors.astype(np.float64)), int(np.abs(all_vectors).max(initial=0))
                exact, fast, most = index[width]
                # products in double precision are exact below 2**53 and use the machine's vector units
                doubles = most * max(1, width) * int(np.abs(vectors).max(initial=0)) < 1 << 53
                for q, v in zip(ids.tolist(), vectors, strict=True):
                    best, scores = (fast if doubles else exact).search(q, v.astype(np.float64) if doubles else v, k)
                    found += [(q, int(b), int(s)) for b, s in zip(best, scores, strict=True)]
                if len(found) > 5000:
                    yield _rows(found)
                    found = []
        if found:
            yield _rows(found)

    def _rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of every row for which ``queries`` holds.

    A component x becomes floor(scale * x); the score is the integer inner product; ties go to the smaller
    id. Vectors that are null, hold null or non-finite components or have a null id take no part; vectors are compared with
    those of equal length only. Rows that repeat a query's id count as the query's own and aren't
    returned; repeated rows are otherwise candidates each. Extra columns aren't read except by ``queries``.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    fine = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(fine)
    values = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("values")
    n = rows.count()
    groups = max(1, -(-n // GROUP), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 2048))
    docs = rows.select(F.col(id_col).alias("id"), values, F.pmod(F.xxhash64(F.floor(F.col(id_col) / (BLOCK * 4))), F.lit(groups)).cast("int").alias("part"))
    asked = rows.where(queries).select(F.col(id_col).alias("id"), values, F.lit(0).alias("part")).distinct()
    packed = docs.mapInArrow(_pack(0, 2048), _GROUP_ROW)
    wanted = asked.mapInArrow(_pack(1, PACK), _GROUP_ROW).drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*packed.columns)
    met = packed.union(wanted).repartition(groups, "part").sortWithinPartitions("part", "role")
    found = met.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
