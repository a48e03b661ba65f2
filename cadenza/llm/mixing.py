"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic); a factor per value of each margin is
raked in turn until the cells' weighted tokens meet the target shares of all three margins. The cells'
weights become sampling probabilities by raking once more with no probability above one: cells that reach
one stay whole and the others make up for them. Where the share to keep leaves a value too few tokens
for its target, the largest smaller share at which all targets are met is kept. A
document stays when a hash of its id, uniform in [0, 1), is below its cell's probability.

The cell table is bounded by the numbers of sources, languages and topics, not by documents; it is
raked on the driver and refused beyond ``max_cells``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, small_batches, span_hash, text_blocks, word_spans, LOWER

#: Random hyperplanes whose signs name the topic of a bag of words.
PLANES = 3
MARGINS = ("source", "lang", "topic")


def with_topic(docs: DataFrame, text_col: str = "text", name: str = "topic", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all) with ``topic`` (``t0`` .. ``t7``, ``none`` without words) and ``n_words``: the cell of random hyperplanes in which a document's bag of lower-cased words lies."""
    small_batches(docs.sparkSession)
    source = docs.select(F.struct(*(c for c in (keep or docs.columns) if c not in (name, "n_words"))).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_blocks(batches):
            data = LOWER[data]
            starts, ends, doc = word_spans(data, offs)
            h, n = mix(span_hash(data, starts, ends)), len(offs) - 1
            topic = np.zeros(n, np.int64)
            for p in range(PLANES):
                # each word votes by a mean-free value of its own
                vote = ((h >> np.uint64(8 * p)) & np.uint64(255)).astype(np.float64) - 127.5
                topic |= (np.bincount(doc, vote, n) > 0).astype(np.int64) << p
            words = np.bincount(doc, minlength=n)
            names = np.array([f"t{k}" for k in range(1 << PLANES)] + ["none"], object)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(names[np.where(words > 0, topic, 1 << PLANES)].tolist(), pa.string()), pa.array(words, pa.int64())], ["row", name, "n_words"])

    schema = T.StructType([source.schema["row"], T.StructField(name, T.StringType()), T.StructField("n_words", T.LongType())])
    return source.mapInArrow(run, schema).select("row.*", name, "n_words")


def rake(cells: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Factors of the cells whose products with ``cells`` have the target shares along every margin.

    ``margins``: the value's index of each cell. Targets of values without cells are dropped and the rest are scaled to one.
    Where targets contradict each other, the last margin is met.
    """
    weight = np.ones(len(cells))
    total = cells.sum()
    if total <= 0:
        return weight
    scaled = []
    for index, target in zip(margins, targets, strict=True):
        there = np.bincount(index, cells, len(target)) > 0
        t = np.where(there, target, 0.0)
        scaled.append(t / t.sum() if t.sum() > 0 else there / there.sum())
    for _ in range(rounds):
        worst = 0.0
        for index, target in zip(margins, scaled, strict=True):
            now = np.bincount(index, cells * weight, len(target)) / total
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, float(np.abs(target - now).max()))
            weight = weight * factor[index]
        if worst < tolerance:
            break
    return weight


def bounded(cells: np.ndarray, margins: list[np.ndarray], goals: list[np.ndarray], start: np.ndarray, rounds: int = 500, tolerance: float = 1e-3) -> tuple[np.ndarray, bool]:
    """Rates of at most one, ``start`` times a factor per value of each margin, and whether they bring every margin to ``goals`` (tokens) within ``tolerance`` of each goal."""
    weight = start.astype(float)
    for _ in range(rounds):
        for index, goal in zip(margins, goals, strict=True):
            factor = np.zeros(len(goal))
            full = np.zeros(len(cells), bool)
            while True:  # Newton from below on a concave, piecewise linear function: ends when no more cells fill up
                free = np.bincount(index, np.where(full, 0.0, cells * weight), len(goal))
                rest = goal - np.bincount(index, np.where(full, cells, 0.0), len(goal))
                factor = np.maximum(factor, np.divide(rest, free, out=np.zeros_like(free), where=free > 0))
                more = full | (weight * factor[index] >= 1)
                if (more == full).all():
                    break
                full = more
            weight = np.minimum(weight * factor[index], 1e100)
        kept = cells * np.minimum(1, weight)
        if all((np.abs(np.bincount(index, kept, len(goal)) - goal) <= tolerance * goal).all() for index, goal in zip(margins, goals, strict=True)):
            return np.minimum(1, weight), True
    return np.minimum(1, weight), False


def calibrated(cells: np.ndarray, margins: list[np.ndarray], weight: np.ndarray, keep_share: float) -> np.ndarray:
    """Rates of at most one that keep the shares that ``weight`` gives along every margin, and of all tokens ``keep_share`` or, where that can't be, the largest part at which it can."""
    total, used = cells.sum(), cells > 0
    weight = weight * (total / (cells * weight).sum())
    shares = [np.bincount(index, cells * weight) / total for index in margins]
    low = min(keep_share, 1 / weight[used].max())  # weights that are only scaled down
    rate = np.minimum(1, low * weight)
    high = min(keep_share, *((np.bincount(i, cells)[t > 0] / (t[t > 0] * total)).min() for i, t in zip(margins, shares, strict=True)))
    share = high
    while high - low > 1e-3 * high:
        tried, met = bounded(cells, margins, [t * share * total for t in shares], share * weight)
        low, high, rate = (share, high, tried) if met else (low, share, rate)
        share = (low + high) / 2
    return rate


def tempered(counts: np.ndarray, power: float) -> np.ndarray:
    """Shares in proportion to counts ** power: under one, large values are held back."""
    x = np.where(counts > 0, np.maximum(counts, 1e-300) ** power, 0.0)
    return x / max(x.sum(), 1e-300)


def sampling_rates(
    docs: DataFrame, columns: tuple[str, str, str], tokens: str, targets: dict[str, dict[str, float]] | None, power: float, keep_share: float, max_cells: int
) -> DataFrame:
    """A row per cell: the three columns (null is a value of its own), ``tokens``, ``rate``."""
    spark = docs.sparkSession
    found = docs.groupBy(*columns).agg(F.sum(F.col(tokens).cast("double")).alias("tokens")).limit(max_cells + 1).collect()
    if len(found) > max_cells:
        raise ValueError(f"more than {max_cells} cells: margins must have few values")
    found.sort(key=lambda r: [(r[c] is None, str(r[c])) for c in columns])  # sums in one order, whatever the partitions
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("tokens", T.DoubleType()), T.StructField("rate", T.DoubleType())])
    cells = np.array([r["tokens"] or 0.0 for r in found])
    margins, goals = [], []
    for c in columns:
        values = sorted({r[c] for r in found}, key=lambda v: (v is None, str(v)))
        index = np.array([values.index(r[c]) for r in found], np.int64)
        margins.append(index)
        own = (targets or {}).get(c)
        counts = np.bincount(index, cells, len(values)) if len(found) else np.zeros(0)
        goals.append(np.array([float(own.get(v, 0.0)) for v in values]) if own is not None else tempered(counts, power))
    weight = rake(cells, margins, goals) if len(found) else cells
    rate = np.zeros(len(found))
    if (cells * weight).sum() > 0:
        rate = calibrated(cells, margins, weight, keep_share)
    rows = [(*(r[c] for c in columns), float(n), float(p)) for r, n, p in zip(found, cells, rate, strict=True)]
    return spark.createDataFrame(rows, schema)


def uniform(*columns: Column, seed: int = 0) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def mix_sources(
    docs: DataFrame, columns: tuple[str, str, str] = MARGINS, tokens: str = "n_words", targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, keep_share: float = 0.5, seed: int = 0, max_cells: int = 100_000, id_col: str = "doc_id"
) -> DataFrame:
    """The sampled rows of ``docs`` with ``rate``, the probability with which a document of its cell stays.

    ``targets``: shares by column and value; a column without an entry aims at its token shares to the ``power``,
    values without an entry at zero. The expected shares meet the targets; ``keep_share`` of the tokens stays, or as much less as
    that takes. Documents stay or go by a hash of id and cell: the same in every run. Rows that
    repeat an id stay or go together within a cell. Null margins are a value of their own; null token counts are zero, and
    cells without tokens have rate zero when raked away, else their cell's.
    """
    rates = sampling_rates(docs, columns, tokens, targets, power, keep_share, max_cells)
    small = F.broadcast(rates.select(*(F.col(c).alias(f"_m{i}") for i, c in enumerate(columns)), F.col("rate").alias("_rate")))  # at most max_cells rows
    on = [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(columns)]
    out = docs.drop("rate").join(small, on)
    return out.where(uniform(F.col(id_col).cast("string"), seed=seed) < F.col("_rate")).select(*(c for c in docs.columns if c != "rate"), F.col("_rate").alias("rate"))
