"""Language identification (operator 6): language family first, then one-versus-one linear support vector machines.

Features are counts of letter n-grams (bytes of the lower-cased text, hashed), square-rooted and scaled to length
one.  One set of machines tells families apart; within a family each pair of languages has a machine of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.base import prepare, trim
from onomast.llm.word_cache import release

#: Documents of each language that the machines are fitted on, about: they are chosen by a hash of doc_id.
SAMPLE_PER_LANGUAGE = 600
WIDTH = 2048
#: Language families of ISO 639-1 codes; a code that is not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")
#: Everything in ASCII but letters becomes a blank; bytes of other characters stay.
_BLANKED = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_PIECE = 1 << 20


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def ngrams(texts: list[str | None]) -> np.ndarray:
    """A row of features for each text; long texts are counted in pieces, so memory is bounded."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    held, size = [], 0

    def count() -> None:
        nonlocal held, size
        if not held:
            return
        x = np.frombuffer(b"  ".join(d for _, d in held) + b"  ", dtype=np.uint8).astype(np.uint32)
        doc = np.repeat(np.arange(len(held)), [len(d) + 2 for _, d in held])
        two = x[:-1] << np.uint32(8) | x[1:]
        three = two[:-1] << np.uint32(8) | x[2:]
        codes = np.zeros(len(held) * WIDTH)
        for n, c in ((2, two), (3, three)):
            keep = c != (0x2020 if n == 2 else 0x202020)
            slot = ((c + np.uint32(n * 0x01000193)) * np.uint32(2654435761)) >> np.uint32(32 - 11)
            codes += np.bincount((doc[: len(c)] * WIDTH + slot)[keep], minlength=len(codes))
        np.add.at(out, [i for i, _ in held], codes.reshape(len(held), WIDTH).astype(np.float32))
        held, size = [], 0

    for i, text in enumerate(texts):
        data = (text or "").lower().encode().translate(_BLANKED)
        for at in range(0, len(data), _PIECE):
            held.append((i, data[max(0, at - 2) : at + _PIECE]))
            size += len(held[-1][1])
            if size >= _PIECE:
                count()
    count()
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge, classes weighted alike) by accelerated descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    step = 1.0 / (4.0 + penalty)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (penalty * v - 2 * x.T @ (weight * y * gap))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class LanguageModel:
    """Machines by family, then by language within a family."""

    def __init__(self, langs: list[str], x: np.ndarray, y: list[str]):
        self.langs = sorted(langs)
        y = np.array(y)
        fam = np.array([family(v) for v in y])
        self.families = {f: [v for v in self.langs if family(v) == f] for f in sorted(set(map(family, self.langs)))}
        self.top = self._fit(list(self.families), x, fam)
        self.inner = {f: self._fit(v, x, y) for f, v in self.families.items()}

    @staticmethod
    def _fit(classes: list[str], x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, np.ndarray, float]]:
        out = []
        for (i, a), (j, b) in combinations(enumerate(classes), 2):
            own = (y == a) | (y == b)
            out.append((i, j, *fit_machine(x[own], np.where(y[own] == a, 1, -1).astype(np.float32))))
        return out

    @staticmethod
    def _shares(n: int, machines: list, x: np.ndarray) -> np.ndarray:
        """Class shares from all pairs: the mean chance of winning a duel, scaled to one."""
        if n == 1:
            return np.ones((len(x), 1))
        won = np.zeros((len(x), n))
        for i, j, w, b in machines:
            p = 1 / (1 + np.exp(-np.clip(4 * (x @ w + b), -30, 30)))
            won[:, i] += p
            won[:, j] += 1 - p
        won = (won / (n - 1)) ** max(1, n - 1)
        return won / won.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = self._shares(len(self.families), self.top, x)
        best = top.argmax(axis=1)
        lang, score = np.empty(len(x), dtype=object), np.zeros(len(x))
        for k, (f, langs) in enumerate(self.families.items()):
            own = np.flatnonzero(best == k)
            if len(own):
                inner = self._shares(len(langs), self.inner[f], x[own])
                at = inner.argmax(axis=1)
                lang[own] = np.array(langs, dtype=object)[at]
                score[own] = top[own, k] * inner[np.arange(len(own)), at]
        return lang, score


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of doc_id as text leaves ``part`` when divided by ``parts``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Learns from text and lang of the rows outside the held-out fold; None if there is no such row.

    About ``per_language`` documents of each language are chosen by hash, so the sample is bounded by the number of
    languages, whatever the input's size.  Every value of lang is learned, were it that of one document; machines grow
    with the square of the languages of a family and of the families, so lang should hold codes and not free text.
    """
    rows = docs.where(~held_out("doc_id", 5, 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) / 1_000_000
    most = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    sample = rows.where(share < F.coalesce(most[F.col("lang")], F.lit(0.0))).select("doc_id", F.col("text").cast("string").alias("text"), "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = ngrams(batch.column(1).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    got = sorted(sample.mapInArrow(run, sample.select("doc_id", "lang").withColumn("x", F.lit(b"")).schema).collect(), key=lambda r: (r[1], r[0] is None, r[0] or 0, bytes(r[2])))
    x = np.stack([np.frombuffer(r[2], dtype=np.float16) for r in got]).astype(np.float32)
    return LanguageModel(sorted(set(r[1] for r in got)), x, [r[1] for r in got])


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per document.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score = (np.full(len(texts), "und", dtype=object), np.zeros(len(texts)))
            known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
            if known:
                lang[known], score[known] = model.predict(ngrams([texts[i] for i in known]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return predict(docs, fit(docs))


def tag(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents with their predicted language as ``lang`` (``und`` as in :func:`predict`); other columns stay.

    Rows go through Python with their columns, so nothing is joined.
    """
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "lang" else f for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lang = np.full(len(texts), "und", dtype=object)
            known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
            if known:
                lang[known] = model.predict(ngrams([texts[i] for i in known]))[0]
            yield batch.set_column(batch.schema.get_field_index("lang"), "lang", pa.array(lang.tolist(), pa.string()))
        trim()

    return docs.mapInArrow(run, schema)
