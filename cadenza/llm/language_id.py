"""Language ID by error-correcting output codes over byte n-gram classifiers.

Each language has a codeword; for each bit a binary classifier, log-odds weights of hashed byte
trigrams, tells the languages with a 1 from those with a 0. A document's margin for a bit is the mean weight
of all its trigrams. Decoding sums a logistic loss of the margins against each codeword, weighted by how well the
bit's classifier does on the sample, and takes the codeword with the least sum; a small lead over
the second flags the document as ambiguous.

Only the fit is on a sample: ``sample_rows`` labelled documents of at most ``SAMPLE_BYTES``, as many of each label where there
are, chosen by a hash of id and text and read whole. Prediction reads every whole text, in numpy over Arrow blocks, without a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, small_batches, text_blocks

#: Hash slots of trigrams; one more slot, without weight, takes what crosses documents.
SLOTS = 1 << 16
#: Longer texts aren't learned from, which bounds the sample in bytes.
SAMPLE_BYTES = 1 << 16
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 letters; white space and digits count as one space each."""
    out = LOWER[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    out[upper] += 32
    out[(out < 33) | ((out >= 48) & (out < 58))] = 32
    return out


def trigram_slots(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A slot for each byte position: its trigram's hash, or SLOTS where no whole trigram starts."""
    out = np.full(len(data), SLOTS, np.int32)
    if len(data) > 2:
        x = _folded(data).astype(np.uint32)
        h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        out[:-2] = (h * np.uint32(2654435761)) >> np.uint32(16)
    heads = offs[1:][offs[1:] > offs[:-1]]
    for back in (1, 2):
        at = heads - back
        out[at[at >= 0]] = SLOTS
    return out


def codewords(k: int) -> np.ndarray:
    """(k, bits) of -1 and 1: all splits of up to five classes, else random columns that keep rows far apart."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    rng, bits, best = np.random.default_rng(9), max(15, 4 * int(np.ceil(np.log2(k)))), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        if (np.abs(code.sum(0)) == k).any():
            continue
        apart = min(int((code[a] != code[b]).sum()) for a, b in itertools.combinations(range(k), 2))
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


@dataclass(frozen=True)
class Model:
    labels: list[str]
    codes: np.ndarray
    weights: np.ndarray  # bits x (SLOTS + 1)
    centre: np.ndarray  # of each bit's margins
    spread: np.ndarray
    trust: np.ndarray  # of each bit

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(documents, bits), zero for texts without a trigram."""
        n = len(offs) - 1
        out = np.zeros((n, len(self.weights)))
        full = np.flatnonzero(np.diff(offs) > 2)
        if len(full):
            slots, heads = trigram_slots(data, offs), offs[:-1][np.diff(offs) > 0]
            own = np.diff(offs)[np.diff(offs) > 0] > 2
            for b, w in enumerate(self.weights):
                out[full, b] = np.add.reduceat(w[slots], heads, dtype=np.float64)[own] / (np.diff(offs)[full] - 2)
        return (out - self.centre) / self.spread

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of belief, and its lead over the second."""
        loss = (self.trust * np.logaddexp(0, -margins[:, None, :] * self.codes[None])).sum(2)
        belief = np.exp(loss.min(1, keepdims=True) - loss)
        belief /= belief.sum(1, keepdims=True)
        ranked = np.sort(belief, 1)
        lead = ranked[:, -1] - (ranked[:, -2] if belief.shape[1] > 1 else 0)
        return loss.argmin(1), ranked[:, -1], lead


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """None without a label to learn."""
    names = sorted(set(labels))
    if not names:
        return None
    counts = np.zeros((len(names), SLOTS + 1))
    raw = [t.encode() for t in texts]
    which = np.array([names.index(x) for x in labels])
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    for k in range(len(raw)):
        own = data[offs[k] : offs[k + 1]]
        if len(own) > 2:
            # a document counts once, however long: otherwise a few long ones would decide
            counts[which[k]] += np.bincount(trigram_slots(own, np.array([0, len(own)])), minlength=SLOTS + 1) / (len(own) - 2)
    counts[:, SLOTS] = 0
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1e-9)
    codes = codewords(len(names))
    smooth = 1e-6
    weights = np.zeros((codes.shape[1], SLOTS + 1), np.float32)
    for b, column in enumerate(codes.T):
        one, other = share[column > 0], share[column < 0]
        if len(one) and len(other):
            weights[b] = np.log(one.mean(0) + smooth) - np.log(other.mean(0) + smooth)
    weights[:, SLOTS] = 0
    plain = Model(names, codes, weights, np.zeros(len(weights)), np.ones(len(weights)), np.ones(len(weights)))
    steps = range(0, len(raw), 200)  # the driver's memory holds the temporaries of some documents only
    margins = np.concatenate([plain.margins(data[offs[k] : offs[min(k + 200, len(raw))]], offs[k : k + 201] - offs[k]) for k in steps])
    centre, spread, trust = np.zeros(len(weights)), np.ones(len(weights)), np.ones(len(weights))
    for b, column in enumerate(codes.T):
        truth = column[which]
        means = [margins[truth == s, b].mean() if (truth == s).any() else 0.0 for s in (1, -1)]
        centre[b] = sum(means) / 2
        spread[b] = max(abs(means[0] - means[1]) / 6, 1e-6)
        trust[b] = max(0.05, 2 * float(((margins[:, b] > centre[b]) == (truth > 0)).mean()) - 1)
    return Model(names, codes, weights, centre, spread, trust)


def language_id(docs: DataFrame, learn: Column, sample_rows: int = 4000, ambiguous_below: float = 0.2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", keep: list[Column] | None = None, with_text: bool = False) -> DataFrame:
    """One row per input row: id (or the columns of ``keep``), the text if asked for, ``lang_pred``, ``score`` (0 to 1), ``ambiguous``.

    Learns from rows where ``learn`` holds and text and label aren't null, at most ``sample_rows`` of them, the same number of
    each label at most (of more labels than that, the most frequent ones). An empty table gives no rows; rows that repeat an id each get their own.
    ``und`` with score 0, flagged ambiguous: null texts, texts without a letter, or nothing to learn from. Labels and ids aren't
    read in predictions. Texts of fewer than three bytes have no trigram and are decoded from zero margins.
    """
    spark = docs.sparkSession
    small_batches(spark)
    able = docs.where(learn & F.col(label_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES))
    able = able.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    counts = able.groupBy("label").count().orderBy(F.desc("count"), "label").limit(sample_rows).collect()
    sample = []
    if counts:
        each = max(1, sample_rows // len(counts))
        # hashes below a bound by label: half as many again as are taken, so that tasks send little more than the sample
        bounds = F.create_map(*(F.lit(x) for r in counts for x in (r["label"], min(1.0, 1.5 * each / r["count"] + 1e-12))))
        share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
        first = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
        sample = able.where(share < bounds[F.col("label")]).withColumn("_n", first).where(F.col("_n") <= each).orderBy("h", "label", "text").collect()
    model = spark.sparkContext.broadcast(fit([r["text"] for r in sample], [r["label"] for r in sample]))
    kept = keep if keep is not None else [F.col(id_col)]
    source = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, data, offs in text_blocks(batches):
            n = len(offs) - 1
            before = np.concatenate(([0], np.cumsum(_LETTER[data])))
            letters = before[offs[1:]] > before[offs[:-1]]
            for k in np.flatnonzero(~letters & (np.diff(offs) > 0)).tolist():
                letters[k] = any(map(str.isalpha, data[offs[k] : offs[k + 1]].tobytes().decode()))
            labels, score, unsure = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if m:
                best, belief, lead = m.decode(m.margins(data, offs))
                labels[letters] = np.array(m.labels, object)[best[letters]]
                score[letters] = belief[letters]
                unsure[letters] = lead[letters] < ambiguous_below
            yield pa.RecordBatch.from_arrays([batch["row"], *[batch["text"]] * with_text, pa.array(labels.tolist(), pa.string()), pa.array(score), pa.array(unsure)], ["row", *["text"] * with_text, "lang_pred", "score", "ambiguous"])

    out = source.mapInArrow(run, f"row {dict(source.dtypes)['row']}, {'text string, ' * with_text}lang_pred string, score double, ambiguous boolean")
    return out.select("row.*", *[F.col("text").alias(text_col)] * with_text, "lang_pred", "score", "ambiguous")
