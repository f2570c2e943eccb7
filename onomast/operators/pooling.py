"""The best entries of each name by the weights of the keys that they share: a numpy kernel over blocks of a catalogue.

A join of lookups with postings makes a row for every pair of a name and an entry that share any key, so a key that all
entries have squares the work.  Here a task holds a block of entries as posting lists and scores names against it in an
array.  Common keys are left for last: entries that share nothing but these are skipped once ``size`` others are known
to be above all that the common keys could add up to.  The outcome is exact; nothing is cut but what cannot be in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: A key of more than 1/COMMON of a block's entries is common; so many keys at most times the postings of an entry are.
COMMON = 4
_NEVER = np.iinfo(np.int64).max


def _greatest(values: np.ndarray, k: int) -> int:
    """The ``k``-th greatest of whole numbers from 0, most of which are small and equal to others."""
    most = 4095
    atleast = np.cumsum(np.bincount(np.minimum(values, most), minlength=most + 1)[::-1])
    if atleast[0] >= k:
        return np.partition(values, len(values) - k)[len(values) - k]
    return most - np.searchsorted(atleast, k)


class Block:
    """Posting lists of some entries: ``ords`` ascending, ``codes`` and ``rows`` of one posting each."""

    def __init__(self, ords: np.ndarray, codes: np.ndarray, rows: np.ndarray, keys: int):
        self.ords, self.n = ords, len(ords)
        pairs, times = np.unique(codes.astype(np.int64) * max(1, self.n) + rows, return_counts=True)
        code, self.rows = np.divmod(pairs, max(1, self.n))
        self.edge = np.searchsorted(code, np.arange(keys + 1))
        #: How often a posting is there; None if each is there once.
        self.times = times if times.max(initial=1) > 1 else None
        self.full = {}
        for k in np.flatnonzero(np.diff(self.edge) * COMMON > self.n).tolist():
            own = slice(self.edge[k], self.edge[k + 1])
            full = np.zeros(self.n, dtype=bool if self.times is None else np.int64)
            full[self.rows[own]] = True if self.times is None else self.times[own]
            self.full[k] = None if full.min() == full.max() == 1 else full  # None: every entry has the key
        self.score, self.seq = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)

    def best(self, codes: list[int], weights: list[int], seqs: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, scores and first lookups of the ``size`` best entries: by score, then first lookup, then entry.

        ``codes`` are distinct and come in descending order of ``seqs``, the places of the lookups.
        """
        score, seq = self.score, self.seq
        score.fill(0)
        common, base, met = [], 0, _NEVER
        for c, w, s in zip(codes, weights, seqs, strict=True):
            if c in self.full:
                if (full := self.full[c]) is None:
                    base, met = base + w, s
                else:
                    common.append((full, w, s))
                continue
            own = slice(self.edge[c], self.edge[c + 1])
            at = self.rows[own]
            score[at] += w if self.times is None else w * self.times[own]
            seq[at] = s
        rows = np.flatnonzero(score != 0)
        if common or base:
            rows = self._worthy(rows, common, size)
        got = score[rows]
        first = np.where(got > 0, np.minimum(seq[rows], met), met)
        got += base
        for full, w, s in common:
            has = full[rows]
            got += w * has
            np.minimum(first, s, out=first, where=has > 0)
        if not base and len(rows) == self.n:
            hit = np.flatnonzero(got)
            rows, got, first = rows[hit], got[hit], first[hit]
        if len(rows) > size:
            least = _greatest(got, size)
            above, level = np.flatnonzero(got > least), np.flatnonzero(got == least)
            if len(above) + len(level) > size:
                turn = first[level] * self.n + rows[level]
                level = level[turn <= np.partition(turn, size - len(above) - 1)[size - len(above) - 1]]
            kept = np.concatenate([above, level])
            rows, got, first = rows[kept], got[kept], first[kept]
        return rows, got, first

    def _worthy(self, rows: np.ndarray, common: list, size: int) -> np.ndarray:
        """Those of ``rows`` that may be among the best, or all rows if entries with common keys only may be."""
        if len(rows) >= size:
            rest = sum(w * int(full.max()) for full, w, _ in common)
            part = self.score[rows]
            top = np.flatnonzero(part >= _greatest(part, size))
            whole = part[top]
            for full, w, _ in common:
                whole += w * full[rows[top]]
            least = int(_greatest(whole, size))  # ``size`` entries have at least this
            if least > rest:
                return rows[part + rest >= least]
        return np.arange(self.n)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def pooled(names: pa.Table, entries: pa.Table, size: int) -> pa.Table:
    """query_id, entry_ord, retrieval_score, first of the ``size`` best entries of each name.

    ``names``: query_id, asked (structs of key, weight, lookup_seq; distinct keys); ``entries``: entry_ord, keys.
    """
    entries = entries.sort_by("entry_ord")
    row, keys = _lists(entries["keys"])
    keys = keys.dictionary_encode()
    block = Block(entries["entry_ord"].to_numpy(), keys.indices.to_numpy(), row, len(keys.dictionary))
    name, asked = _lists(names["asked"])
    code = pa.compute.index_in(asked.field("key"), keys.dictionary)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    name, code = name[known], code.drop_null().to_numpy()
    weight, seq = (asked.field(x).to_numpy(zero_copy_only=False)[known] for x in ("weight", "lookup_seq"))
    order = np.lexsort((-seq, name))
    code, weight, seq = (x[order].tolist() for x in (code, weight, seq))
    edge = np.searchsorted(name[order], np.arange(names.num_rows + 1)).tolist()
    held, out = {}, []
    for a, b in zip(edge, edge[1:], strict=False):
        like = (*code[a:b], *weight[a:b], *seq[a:b])
        if like not in held:
            held[like] = block.best(code[a:b], weight[a:b], seq[a:b], size)
        out.append(held[like])
    of = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
    rows, score, first = (np.concatenate([x[k] for x in out] or [np.zeros(0, dtype=np.int64)]).astype(np.int64) for k in range(3))
    made = [names["query_id"].take(pa.array(of, pa.int64())), entries["entry_ord"].take(pa.array(rows)), pa.array(score), pa.array(first)]
    return pa.table(made, names=["query_id", "entry_ord", "retrieval_score", "first"])
