"""Connected components of a graph held in DataFrames: union-find within tasks, alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Edges that one task joins by union-find. A graph of no more is done in one pass; larger ones go on in rounds.
EDGES_PER_TASK = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, replaced by one edge from each node to the least of its part."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
    if pairs:
        a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b. Large: each node's larger neighbours go to its least neighbour; small: its smaller ones and itself do."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK, tables: Tables | None = None) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b: longs, any direction, repeats allowed) that isn't the least of its component, which is the label.

    Each round is written to the shared folder; rounds grow with the logarithm of the diameter. Nothing but two totals a round reaches the driver.
    What it writes belongs to ``tables``, if given, and is dropped with them.
    """
    stored = (tables or Tables(edges.sparkSession)).stored
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tasks = -(-state[0] // edges_per_task)
        if state == seen or not tasks:
            break
        seen = state
        now = now.coalesce(tasks).mapInArrow(_forest, "a bigint, b bigint")
        if tasks == 1:
            now = stored(now, "edges")
            break
        now = stored(_star(_star(stored(now.distinct(), "edges"), True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
