"""A quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

Features come from the bytes and words of a text alone. Each is cut into bins
by quantiles; the model is a table of additions for each feature's bins and
one for each chosen pair of features. Training goes round the features, fits
a shallow tree to the gradients summed by bin and adds its leaves to the
table; pairs follow the same way. A score is the logistic of summed table
entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import batches, crc_mod, cut, fresh, quoted, slots, small_batches, text_bytes, word_hashes

NAMES = ("bytes", "words", "word_length", "upper", "digits", "symbols", "not_ascii", "blank", "lines", "line_ends", "distinct_words", "top_word", "repeated_triples", "stops", "symbol_ends")

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 0x41:0x5B] = True
_CLASS[1, 0x30:0x3A] = True
_CLASS[2, [c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-"]] = True
_CLASS[3, 0x80:] = True
_CLASS[4, [0x20, 0x09, 0x0B, 0x0C, 0x0D]] = True
_CLASS[5, 0x0A] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; a text without words has zeros but for its size."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1)

    def summed(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    kinds = [summed(_CLASS[k][data]) for k in range(6)]
    after = np.append(data[1:], 0x0A) if len(data) else data
    last = np.zeros(len(data), bool)
    last[offsets[1:][size > 0] - 1] = True
    ends = _CLASS[5][after] | last
    stop = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
    word_end = ends | _CLASS[4][after]
    words, rows = word_hashes(data, offsets)
    at = slots(rows, n)
    count = np.diff(at)
    out = np.zeros((n, len(NAMES)))
    with np.errstate(over="ignore"):
        triples = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7) if len(words) > 2 else words[:0]
    for i in np.flatnonzero(count):
        a, b = at[i], at[i + 1]
        own = np.sort(words[a:b])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        runs = np.diff(first)
        out[i, 10], out[i, 11] = len(runs) / (b - a), runs.max() / (b - a)
        if b - a > 2:
            three = np.sort(triples[a : b - 2])
            out[i, 12] = (three[1:] == three[:-1]).mean() if len(three) > 1 else 0
    letters = size - kinds[4] - kinds[5]
    lines = kinds[5] + 1
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    out[:, 2] = letters / np.maximum(count, 1)
    for j, k in ((3, 0), (4, 1), (5, 2), (6, 3)):
        out[:, j] = kinds[k] / np.maximum(letters, 1)
    out[:, 7] = kinds[4] / per
    out[:, 8] = lines / np.maximum(count, 1)
    out[:, 9] = summed(stop & ends) / lines
    out[:, 13] = summed(data == 0x2E) / np.maximum(count, 1)
    out[:, 14] = summed(_CLASS[2][data] & word_end) / np.maximum(count, 1)
    return out


@dataclass
class AdditiveModel:
    """Bin edges and additions of each feature, and of each pair of features."""

    base: float = 0.0
    edges: list = field(default_factory=list)
    single: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def margin(self, b: np.ndarray) -> np.ndarray:
        total = np.full(len(b), self.base)
        for j, table in enumerate(self.single):
            total += table[b[:, j]]
        for j, k, table in self.pairs:
            total += table[b[:, j], b[:, k]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of features."""
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def _gain(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return g * g / (h + penalty)


def _split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """The best cut of a run of bins: (gain, first bin of the right side)."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(a, b, penalty) + _gain(g.sum() - a, h.sum() - b, penalty) - _gain(g.sum(), h.sum(), penalty)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """Additions by bin of a tree of two levels."""
    out = np.zeros(len(g))
    _, at = _split(g, h, penalty)
    for a, b in ((0, at), (at, len(g))):
        if b > a:
            _, mid = _split(g[a:b], h[a:b], penalty)
            for x, y in ((a, a + mid), (a + mid, b)):
                if y > x:
                    out[x:y] = g[x:y].sum() / (h[x:y].sum() + penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and additions by cell of a tree that cuts one feature and then, on each side, the other."""
    best, out = -1.0, np.zeros(g.shape)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        _, at = _split(gg.sum(1), hh.sum(1), penalty)
        table, gain = np.zeros(gg.shape), 0.0
        for a, b in ((0, at), (at, len(gg))):
            if b > a:
                more, mid = _split(gg[a:b].sum(0), hh[a:b].sum(0), penalty)
                gain += more
                for x, y in ((0, mid), (mid, gg.shape[1])):
                    if y > x:
                        table[a:b, x:y] = gg[a:b, x:y].sum() / (hh[a:b, x:y].sum() + penalty)
        if gain > best:
            best, out = gain, table.T if turn else table
    return best, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, cycles: int = 150, pairs: int = 6, pair_cycles: int = 60, rate: float = 0.15, penalty: float = 1.0) -> AdditiveModel:
    """The model of features x and labels y in {0, 1}; without both labels it gives the smoothed share of label 1."""
    rate_of_1 = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(rate_of_1 / (1 - rate_of_1))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.edges]
    model.single = [np.zeros(s) for s in sizes]
    b = model.bins(x)
    margin = model.margin(b)
    for _ in range(cycles):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-margin))
            step = rate * _tree(np.bincount(b[:, j], y - p, sizes[j]), np.bincount(b[:, j], p * (1 - p), sizes[j]), penalty)
            model.single[j] += step
            margin += step[b[:, j]]

    def cells(j: int, k: int):
        p = 1 / (1 + np.exp(-margin))
        flat, shape = b[:, j] * sizes[k] + b[:, k], (sizes[j], sizes[k])
        return _pair_tree(*(np.bincount(flat, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p))), penalty)

    ranked = sorted(((cells(j, k)[0], j, k) for j in range(x.shape[1]) for k in range(j)), reverse=True)[:pairs]
    tables = {(j, k): np.zeros((sizes[j], sizes[k])) for _, j, k in ranked}
    for _ in range(pair_cycles):
        for (j, k), table in tables.items():
            step = rate * cells(j, k)[1]
            table += step
            margin += step[b[:, j], b[:, k]]
    model.pairs = [(j, k, t) for (j, k), t in tables.items()]
    return model


def _featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for batch in batches(whole, "text", 1 << 20):
            x = features(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{c: x[:, j] for j, c in enumerate(NAMES)}})


def train(docs: DataFrame, labels: DataFrame, hold_out: int = 3, rows: int = 20_000) -> AdditiveModel:
    """A model of the labelled rows whose crc32 of the id as text, modulo hold_out, is not 1.

    The model is fitted in the driver on at most `rows` of them, those least
    by a hash of the id, which bounds the sample at any size of the corpus.
    A document with several labels counts with the greatest, several texts of
    one id count each. labels: doc_id, quality; other columns aren't read.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_of"), F.col("quality").cast("int").alias("_label")).where("_of IS NOT NULL AND _label IN (0, 1)").groupBy("_of").agg(F.max("_label").alias("_label"))
    fold = F.pmod(F.crc32(F.col("_of").cast("string").cast("binary")), F.lit(hold_out))
    sample = cut(marks.where(fold != 1).orderBy(F.xxhash64("_of"), "_of").limit(rows))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = source.join(F.broadcast(sample.select("_of")), F.col("doc_id") == F.col("_of"), "left_semi")  # at most `rows` ids
    found = wanted.mapInArrow(_featured, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES))
    got = found.join(F.broadcast(sample), F.col("doc_id") == F.col("_of")).orderBy(F.xxhash64("doc_id"), "doc_id", *NAMES).limit(rows).toPandas()
    return fit(got[list(NAMES)].to_numpy(np.float64), got["_label"].to_numpy(np.int64))


def quality_scores(docs: DataFrame, model: AdditiveModel, *keep: str, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` of docs with score double and predicted int (or other names), row by row and without shuffle.

    score is 0 to 1, the chance of label 1; predicted is 1 from 0.5 on. Null
    texts are scored as empty ones. Only text is an input of the score.
    """
    own = "text" in keep and dict(docs.dtypes)["text"] == "string"
    plain = [f"c{i}" for i in range(len(keep))]  # a function over batches takes no names with dots or backticks
    source = small_batches(docs).select(*(c.alias(p) for c, p in zip(quoted(*keep), plain, strict=True)), *([] if own else [F.col("text").cast("string").alias("text")]))
    text = plain[keep.index("text")] if own else "text"
    schema = T.StructType([*(source.schema[p] for p in plain), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in batches(whole, text, 1 << 20):
                score = model.score(features(*text_bytes(batch.column(text))))
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in plain} | {"score": score, "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return source.mapInArrow(run, schema).toDF(*keep, *names)


def accepted(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of docs that the model gives label 1, with all their columns as they were, whatever the names.

    Null and blank texts are scored like others, repeated rows stay repeated,
    a null doc_id makes no difference; an empty table gives an empty one.
    """
    score, predicted = fresh(docs, "_score", "_predicted")
    return quality_scores(docs, model, *docs.columns, names=(score, predicted)).where(F.col(predicted) == 1).select(*quoted(*docs.columns))


def classify(docs: DataFrame, labels: DataFrame, hold_out: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id long, text string).

    held_out: crc32 of the id as text, modulo hold_out, is 1 (a null id counts
    as the empty text); labels of those rows are never read. Null and empty
    texts have a score too; repeated rows are kept. Without labels every score
    is 0.5 and predicted 1. An empty table gives an empty one.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = quality_scores(source, train(docs, labels, hold_out), "doc_id")
    return scored.select("doc_id", (crc_mod("doc_id", hold_out) == 1).alias("held_out"), "score", "predicted")
