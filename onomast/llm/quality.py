"""Quality classifier (operator 8): histogram gradient-boosted trees over statistics of a document.

Features are binned once; a tree grows level by level from histograms of gradients; the forest is flattened into
arrays, and a batch of documents walks all trees with a few numpy gathers per level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.base import prepare, trim
from onomast.llm.langid import held_out

#: Labelled rows that the trees are fitted on, about; they are chosen by a hash of doc_id.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digits", "punctuation", "symbols", "blank", "non_ascii",
    "distinct_words", "lines", "distinct_lines", "mean_line", "compression", "stops", "bars", "marks", "symbol_ends", "max_run",
)
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 6
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 3
_SYMBOL_END = tuple(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()!?")


def statistics(text: str | None) -> list[float]:
    """The features of a whole text; a null or empty text has zeros."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=by_byte, minlength=7) / n
    words = data.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = data.split(b"\n")
    ends = sum(map(data.count, (x + b" " for x in _SYMBOL_END)))
    distinct = len(set(words))
    return [
        np.log1p(n), np.log1p(w), sizes.sum() / w, (sizes > 15).sum() / w, (sizes <= 3).sum() / w, kind[1], kind[2], kind[3], kind[6], kind[4], kind[5],
        distinct / w, len(lines) / w, len(set(lines)) / len(lines), n / len(lines) / 1000, len(zlib.compress(data, 1)) / n,
        by_byte[46] / w, by_byte[124] / w, (by_byte[33] + by_byte[63]) / w, ends / w, (sizes.max() if len(sizes) else 0) / 100,
    ]


class BoostedTrees:
    """Binary logistic boosting; ``feature``, ``cut`` and ``leaf`` hold all trees flat, node k has children 2k+1 and 2k+2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, penalty: float = 1.0):
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        n, f = x.shape
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.depth = float(np.log(p / (1 - p))), depth
        inner, leaves = 2**depth - 1, 2**depth
        self.feature = np.zeros((trees, inner), dtype=np.int64)
        self.cut = np.full((trees, inner), np.inf)
        self.leaf = np.zeros((trees, leaves))
        score = np.full(n, self.start)
        for t in range(trees):
            chance = 1 / (1 + np.exp(-score))
            grad, hess = y - chance, chance * (1 - chance)
            node = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                base, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                own = node - base
                for k in range(f):
                    slot = own * bins + binned[:, k]
                    g = np.cumsum(np.bincount(slot, grad, width * bins).reshape(width, bins), axis=1)
                    h = np.cumsum(np.bincount(slot, hess, width * bins).reshape(width, bins), axis=1)
                    G, H = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + penalty) + (G - g) ** 2 / (H - h + penalty) - G**2 / (H + penalty)
                    gain[(h < 1) | (H - h < 1)] = 0
                    gain = gain[:, : len(self.edges[k])]
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    for m in np.flatnonzero(top > best):
                        best[m], self.feature[t, base + m], self.cut[t, base + m] = top[m], k, self.edges[k][at[m]]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            own = node - inner
            self.leaf[t] = rate * np.bincount(own, grad, leaves) / (np.bincount(own, hess, leaves) + penalty)
            score += self.leaf[t][own]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row: all trees walk together, a gather for each level."""
        x = np.asarray(x, dtype=np.float64)
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        total = self.start + self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BoostedTrees | None:
    """Learns labels.quality outside the held-out fold from about ``sample`` rows; None without rows.

    The sample's ids are at most about ``sample``, so they are broadcast. A doc_id with several labels counts for each.
    """
    own = labels.where(~held_out("doc_id", 4, 2) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = own.count()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(1_000_000))
    chosen = own.where(share < int(1_000_000 * min(1.0, sample / max(1, n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    got = rows.mapInArrow(run, rows.select("doc_id", "quality").withColumn("x", F.array(F.lit(0.0))).schema).collect()
    got = sorted((r[0], r[1], tuple(r[2])) for r in got)
    if not got:
        return None
    return BoostedTrees(np.array([r[2] for r in got]), np.array([r[1] for r in got]))


def predict(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document; 0.5 where nothing could be learned."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return predict(docs, fit(docs, labels))


def keep(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """The documents that are predicted 1, with all their columns; all where nothing could be learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))
        trim()

    return docs.mapInArrow(run, docs.schema) if model else docs
