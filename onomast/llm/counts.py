"""Edit-aware token counts (operator 4).

A document's units (runs of pre-tokens between the blanks at which texts may be cut, see ``word_cache``) are gathered
into leaves of a segment tree that holds characters and tokens of each subtree.  A cut depends on its blank and the
character after it alone.  So an edit re-encodes the leaves that it touches, and the leaf before them if the first
leaf's cut is touched; their new text is cut into leaves again, and the sums above them are updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.base import prepare
from onomast.llm.word_cache import CachedEncoder, encoder

UNITS_PER_LEAF = 32


class CountTree:
    """Token counts of one text under edits; ``tokens`` and ``chars`` are the root's sums.

    A text that the encoder must not cut (it may hold a special string) is one leaf.
    """

    def __init__(self, text: str, code: CachedEncoder):
        self.code = code
        self._build(*self._cut(text, True))

    def _cut(self, text: str, first: bool) -> tuple[list[str], list[tuple[int, int]]]:
        """The leaves of consecutive text, each with its characters and tokens; ``first`` if the text starts with it."""
        if self.code.uncut(text):
            return [text], [(len(text), len(self.code.ids(text)))]
        units = self.code.units(text if first else text[1:])
        tokens = [len(x) >> 2 for x in self.code.unit_ids(units, first)]
        leaves, sums = [], []
        for k in range(0, len(units), UNITS_PER_LEAF):
            leaf = " ".join(units[k : k + UNITS_PER_LEAF])
            if k or not first:
                leaf = " " + leaf
            leaves.append(leaf)
            sums.append((len(leaf), sum(tokens[k : k + UNITS_PER_LEAF])))
        return leaves, sums

    def _build(self, leaves: list[str], sums: list) -> None:
        self.leaves = leaves
        self.width = 1 << (len(leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width : self.width + len(leaves)] = sums
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place (the last with text for the text's end), and the characters before it."""
        node, before = 1, 0
        place = min(place, max(0, self.chars - 1))
        while node < self.width:
            node *= 2
            if place >= before + self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.width, before

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces characters start..end by ``new``; gives the characters that were encoded again."""
        if not 0 <= start <= end <= self.chars:
            raise ValueError("the edit is outside the text")
        first, before = self._leaf_at(start)
        last = self._leaf_at(max(start, end - 1))[0]
        if before and start < before + 2:  # its blank or the character after it
            first, before = self._leaf_at(before - 1)
        old = "".join(self.leaves[first : last + 1])
        text = old[: start - before] + new + old[end - before :]
        if self.code.uncut(text) and text != (whole := "".join(self.leaves[:first]) + text + "".join(self.leaves[last + 1 :])):
            self._build(*self._cut(whole, True))
            return len(whole)
        leaves, sums = self._cut(text, not before) if text else ([], [])
        room = last + 1 - first
        if len(leaves) > room:  # more leaves than before: new places for all, as yet without encoding any other
            kept = self.sums[self.width : self.width + len(self.leaves)]
            self._build(*self._live(self.leaves[:first] + leaves + self.leaves[last + 1 :], [*kept[:first], *sums, *kept[last + 1 :]]))
        else:
            self.leaves[first : last + 1] = leaves + [""] * (room - len(leaves))
            at, to = self.width + first, self.width + last + 1
            self.sums[at:to] = 0
            self.sums[at : at + len(leaves)] = np.array(sums, dtype=np.int64).reshape(-1, 2)
            while at > 1:
                at, to = at // 2, (to + 1) // 2
                self.sums[at:to] = self.sums[2 * at : 2 * to : 2] + self.sums[2 * at + 1 : 2 * to : 2]
        return len(text)

    @staticmethod
    def _live(leaves: list[str], sums: list) -> tuple[list[str], list]:
        """Without the leaves that edits have emptied."""
        live = [k for k, x in enumerate(leaves) if x]
        return [leaves[k] for k in live], [sums[k] for k in live]

    def text(self) -> str:
        return "".join(self.leaves)


def count_tokens(docs: DataFrame, tokenizer: str, edits: int = 2, span: int = 16) -> DataFrame:
    """doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_chars, one row per document.

    The edits of a text of n characters: for k in 1..edits, the characters from floor(n*k/(edits+1)), ``span`` at most,
    give way to the text's first ``span`` characters reversed.  n_tokens counts the text as it is, edited_tokens the
    text after all edits, encoded_chars what the edits encoded again.  Null counts as empty; empty texts have no token.
    Rows are counted each by itself, so null and repeated doc_ids are reported as they come; other columns do not matter.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tree = CountTree(text or "", code)
                head, n, tokens, again = (text or "")[:span][::-1], tree.chars, tree.tokens, 0
                for k in range(1, edits + 1):
                    at = n * k // (edits + 1)
                    again += tree.edit(at, min(n, at + span), head)
                rows.append((n, tokens, tree.chars, tree.tokens, again))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, ", ".join(f"{x} long" for x in names))
