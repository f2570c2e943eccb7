"""String similarity: as Column expressions, and as a numpy kernel over distinct pairs for bulk scoring.

Edit distance is optimal string alignment: insert, delete, replace, and exchange of neighbours, with no part edited
twice.  Spark has plain Levenshtein only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions import keyboard
from onomast.functions.text import bigrams

# ------------------------------------------------------------------ Column expressions


def osa(a: str, b: str) -> Column:
    """The edit distance of two columns (by name), in the JVM: one cell of the table after another."""
    w = f"(length({b}) + 1)"
    at = lambda k: f"element_at(d, {k})"  # noqa: E731  1-based
    i, j = f"cast(floor(k / {w}) as int)", f"cast(k % {w} as int)"
    ca, cb = (lambda k: f"substring({a}, {i} - {k}, 1)"), (lambda k: f"substring({b}, {j} - {k}, 1)")
    cell = f"""case when {i} = 0 then {j} when {j} = 0 then {i} else least(
        {at(f'k - {w} + 1')} + 1, {at('k')} + 1, {at(f'k - {w}')} + if({ca(0)} = {cb(0)}, 0, 1),
        if({i} > 1 and {j} > 1 and {ca(0)} = {cb(1)} and {ca(1)} = {cb(0)}, element_at(d, greatest(k - 2 * {w} - 1, 1)), 1000000) + 1) end"""
    return F.expr(f"element_at(aggregate(sequence(0, (length({a}) + 1) * {w} - 1), cast(array() as array<int>), (d, k) -> array_append(d, cast({cell} as int))), -1)")


def dice(a: Column, b: Column) -> Column:
    """Overlap of bigram sets; two empty texts are alike, an empty and another are not."""
    x, y = bigrams(a, True), bigrams(b, True)
    return F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: a.substr(i, F.lit(1)) == b.substr(i, F.lit(1)))
    at = F.array_position(same, False)
    return F.when(n == 0, 0).when(at == 0, n).otherwise((at - 1).cast("int"))


def token_prefix(a: Column, b: Column) -> Column:
    """Token counts differ and the shorter list begins the longer."""
    x, y = tokens(a), tokens(b)
    n = F.least(F.size(x), F.size(y))
    begins = F.when(n == 0, True).otherwise(F.slice(x, 1, F.greatest(n, F.lit(1))) == F.slice(y, 1, F.greatest(n, F.lit(1))))
    return (F.size(x) != F.size(y)) & begins


def transposed(a: Column, b: Column, distance: Column) -> Column:
    """One exchange of neighbours apart: of equal length, at distance 1, and at 2 without exchanges."""
    return (F.length(a) == F.length(b)) & (distance == 1) & (F.levenshtein(a, b) == 2)


# ------------------------------------------------------------------ numpy kernel


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.zeros((len(texts), int(n.max(initial=0)) + 1), dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(texts)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out, n


def osa_many(first: list[str], second: list[str], block: int = 4096) -> np.ndarray:
    """Edit distances of many pairs: the table is filled cell by cell for a block of pairs of about equal length."""
    out = np.zeros(len(first), dtype=np.int64)
    order = sorted(range(len(first)), key=lambda k: (len(first[k]), len(second[k])))
    for at in range(0, len(order), block):
        own = order[at : at + block]
        a, na = _codes([first[k] for k in own])
        b, nb = _codes([second[k] for k in own])
        la, lb = int(na.max(initial=0)), int(nb.max(initial=0))
        d = np.zeros((la + 1, lb + 1, len(own)), dtype=np.int32)
        d[:, 0] = np.arange(la + 1)[:, None]
        d[0, :] = np.arange(lb + 1)[:, None]
        for i in range(1, la + 1):
            for j in range(1, lb + 1):
                x = a[:, i - 1]
                y = b[:, j - 1]
                cell = np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]) + 1, d[i - 1, j - 1] + (x != y))
                if i > 1 and j > 1:
                    swap = (x == b[:, j - 2]) & (a[:, i - 2] == y)
                    if swap.any():
                        cell = np.where(swap, np.minimum(cell, d[i - 2, j - 2] + 1), cell)
                d[i, j] = cell
        out[own] = d[na, nb, np.arange(len(own))]
    return out


def _grams(text: str) -> set[str]:
    return {text[k : k + 2] for k in range(len(text) - 1)} if len(text) > 1 else {text} if text else set()


#: What a comparison reports of a pair.
SIGNALS = (
    "score double, input_length int, candidate_length int, edit_distance int, edit_similarity double, is_transposition boolean, ngram_similarity double, "
    "token_similarity double, length_difference int, common_prefix_length int, prefix_consistency double, input_tokens int, candidate_tokens int, "
    "is_prefix_variant boolean, is_character_prefix boolean, is_token_prefix boolean, implausible boolean, partial boolean"
)


def compare_many(first: list[str], second: list[str]) -> list[tuple]:
    """The signals of pairs (proposed, existing), rows in the order of SIGNALS."""
    split: dict[str, tuple[list[str], list[str]]] = {}
    for text in {*first, *second}:
        words = [w for w in text.split(" ") if w]
        split[text] = words, list(dict.fromkeys(words))
    grams = {t: _grams(t) for t in split}
    # edit distances of the texts and of all their tokens, each distinct pair once
    pairs = dict.fromkeys(zip(first, second, strict=True))
    for a, b in list(pairs):
        for s in split[a][1]:
            for t in split[b][1]:
                pairs[(s, t)] = None
    distance = dict(zip(pairs, osa_many([a for a, _ in pairs], [b for _, b in pairs]).tolist(), strict=True))

    def alike(s: str, t: str) -> float:
        return 1 - distance[(s, t)] / max(len(s), len(t))

    def by_tokens(x: list[str], y: list[str]) -> float:
        if not x or not y:
            return 1.0 if not x and not y else 0.0
        total = 0.0
        for s in x:
            total += max(0.0, *(alike(s, t) for t in y))
        back = 0.0
        for t in y:
            back += max(0.0, *(alike(s, t) for s in x))
        return (total + back) / (len(x) + len(y))

    known: dict[tuple[str, str], tuple] = {}
    out = []
    for a, b in zip(first, second, strict=True):
        row = known.get((a, b))
        if row is None:
            (wa, ta), (wb, tb), ga, gb = split[a], split[b], grams[a], grams[b]
            la, lb, d = len(a), len(b), distance[(a, b)]
            most, least = max(la, lb), min(la, lb)
            edit = 1 - d / most if most else 1.0
            gram = 2 * len(ga & gb) / (len(ga) + len(gb)) if ga and gb else float(not ga and not gb)
            token = by_tokens(ta, tb)
            prefix = next((k for k in range(least) if a[k] != b[k]), least)
            consistency = prefix / least if least else 0.0
            size = 1 - (most - least) / most if most else 1.0
            score = edit * 0.5 + gram * 0.3 + token * 0.1 + size * 0.05 + consistency * 0.05
            unlike = [k for k in range(least) if a[k] != b[k]] if la == lb else []
            swapped = d == 1 and len(unlike) == 2
            chars = a != b and (a.startswith(b) or b.startswith(a))
            n = min(len(wa), len(wb))
            words = len(wa) != len(wb) and wa[:n] == wb[:n]
            far = d == 1 and len(unlike) == 1 and not keyboard.plausible(a[unlike[0]], b[unlike[0]])
            if len(wa) > len(wb):
                partial = d > len(wa) - len(wb) + 1
            elif len(wa) < 2 or len(wa) != len(wb):
                partial = False
            else:
                partial = any(x != y and distance[(x, y)] > (2 if min(len(x), len(y)) >= 5 else 1) for x, y in zip(wa, wb, strict=True))
            row = known[(a, b)] = (score, la, lb, d, edit, swapped, gram, token, most - least, prefix, consistency, len(wa), len(wb), chars or words, chars, words, far, partial)
        out.append(row)
    return out


def score_bounds(first: list[str], second: list[str], block: int = 8192) -> np.ndarray:
    """No score of :func:`compare_many` is above these: exact but for edits, which are at least the letters without a partner, and for the token and prefix signals, which count as 1."""
    texts = list(dict.fromkeys([*first, *second]))
    at = {t: k for k, t in enumerate(texts)}
    a, b = (np.fromiter((at[t] for t in side), dtype=np.int64, count=len(side)) for side in (first, second))
    letters = {c: k for k, c in enumerate(dict.fromkeys("".join(texts)))}
    counts = np.zeros((len(texts), max(1, len(letters))), dtype=np.int16)
    grams = [_grams(t) for t in texts]
    places = {g: k for k, g in enumerate(dict.fromkeys(g for own in grams for g in own))}
    bits = np.zeros((len(texts), len(places) // 64 + 1), dtype=np.uint64)
    for k, t in enumerate(texts):
        for c in t:
            counts[k, letters[c]] += 1
        for g in grams[k]:
            bits[k, places[g] // 64] |= np.uint64(1 << places[g] % 64)
    length, size = np.fromiter(map(len, texts), np.int64, len(texts)), np.fromiter(map(len, grams), np.int64, len(texts))
    out = np.empty(len(first))
    for k in range(0, len(first), block):
        x, y = a[k : k + block], b[k : k + block]
        over = counts[x] - counts[y]
        edits = np.maximum(np.maximum(over, 0).sum(axis=1), np.maximum(-over, 0).sum(axis=1))
        most, least = np.maximum(np.maximum(length[x], length[y]), 1), np.minimum(length[x], length[y])
        shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        gram = np.where(size[x] + size[y] > 0, 2 * shared / np.maximum(size[x] + size[y], 1), 1.0)
        out[k : k + block] = 0.5 * (1 - edits / most) + 0.3 * gram + 0.1 + 0.05 * np.where(length[x] + length[y] > 0, least / most, 1.0) + 0.05
    return out + 1e-9


_TYPES = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def signal_array(rows: list[tuple]) -> pa.StructArray:
    """Rows of :func:`compare_many` as Arrow structs."""
    fields = [x.split() for x in SIGNALS.split(", ")]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], _TYPES[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def compared(pairs: DataFrame, a: str, b: str, to: str = "signals") -> DataFrame:
    """Adds the signals of two text columns as a struct; other columns pass through."""
    schema = pairs.withColumn(to, F.lit(None).cast(f"struct<{SIGNALS.replace(' ', ':').replace(',:', ',')}>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            yield pa.RecordBatch.from_arrays([*batch.columns, signal_array(compare_many(x, y))], names=[*batch.schema.names, to])

    return pairs.mapInArrow(run, schema)
