"""Exact, fast encoding of whole texts with a ``tokenizers`` file.

In both public vocabularies no pre-token reaches over a blank that is followed by something other than white space,
whatever stands before it.  So a text may be cut at those blanks, into units, and encoded unit by unit; as most units
of a corpus repeat, each worker keeps a bounded table from unit to the bytes of its ids.  The table is a dict whose
``__missing__`` asks the library, so a lookup always answers: emptying it, at any time, costs time only.  Texts that
may hold a special string, and files whose rules are not those of the two vocabularies, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Units of a worker's table, and the longest unit that it holds; together they bound its bytes (about 100 MB).
MAX_UNITS = 400_000
MAX_UNIT_CHARS = 48
#: A run of these after an ASCII letter is a pre-token of its own in both vocabularies.
_TAIL = ",.!?;:"
#: Blanks that end a unit.  Python's white space covers the library's, so no cut is made that the library would not make.
_CUT = re.compile(r" (?=\S)")
#: The printable letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the others from U+0100.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class _Irregular(Exception):
    """A chunk between blanks that is not a unit: it is empty or starts with white space."""


class _Table(dict):
    """unit -> ids (little-endian uint32); ``lead`` is what stands before the unit in its text."""

    def __init__(self, code: CachedEncoder, lead: str):
        super().__init__()
        self.code, self.lead, self.most = code, lead, MAX_UNITS

    def __missing__(self, unit: str) -> bytes:
        ids = self.code._unit(unit, self)
        if len(unit) <= MAX_UNIT_CHARS and "\n" not in unit:  # line joints are rarely seen twice
            if len(self) >= self.most:
                self.clear()
            self[unit] = ids
        return ids


class CachedEncoder:
    """``ids(text)`` equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    With ``special_as_text`` the special strings in a text are ordinary text, as by ``encode_special_tokens``.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        way = rules["pre_tokenizer"] or {"type": ""}
        #: How words reach the model: as they are, in lower case, or (empty) unknown here, so that texts go whole.
        self.kind = ""
        if rules["model"]["type"] == "BPE":
            if way["type"] == "ByteLevel" and not way["add_prefix_space"] and way["use_regex"] and not rules["normalizer"]:
                self.kind = "plain"
            elif steps == ["NFC", "Replace", "Lowercase"] and way["type"] == "Sequence":
                self.kind = "lower"
        special = [x["content"] for x in rules["added_tokens"]]
        if any(x[:2].isalnum() or x[:2].isspace() for x in special):
            self.kind = ""
        #: A text without any of these holds no special string.
        self._marks = () if special_as_text else tuple({x[:2] for x in special})
        self._model, self._line = self.tokenizer.model, self._whole("\n")
        self._after = _Table(self, " " if self.kind == "plain" else "")
        self._heads = _Table(self, "") if self.kind == "plain" else self._after  # white space is dropped, so there is no lead

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def uncut(self, text: str) -> bool:
        """Whether a text goes to the library whole."""
        return not self.kind or any(x in text for x in self._marks)

    def _unit(self, unit: str, table: _Table) -> bytes:
        """The ids of a unit that the table lacks."""
        if unit.isalpha():
            # a run of Latin-1 letters is one pre-token in both vocabularies, is in NFC and has a plain lower case
            word = unit.lower() if self.kind == "lower" else unit
            if not unit.isascii():
                if max(unit) > "\xff":
                    return self._whole(table.lead + unit)
                word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            if self.kind == "plain" and table.lead:
                word = "Ġ" + word
            return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()
        if not unit or unit[0].isspace():
            if table.lead:
                raise _Irregular
            return self._whole(unit) if unit else b""
        core = unit.rstrip(_TAIL)
        if core and len(core) < len(unit) and core[-1].isascii() and core[-1].isalpha():
            return table[core] + self._heads[unit[len(core) :]]
        if "\n" in unit:
            lines = unit.split("\n")
            if not any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
                break_ids = self._line
                return table[lines[0]] + b"".join([break_ids + self._heads[x] for x in lines[1:]])
        return self._whole(table.lead + unit)

    def units(self, text: str) -> list[str]:
        """The text's units; each but the first is preceded by the blank at which the text was cut."""
        return [text] if self.uncut(text) else _CUT.split(text)

    def unit_ids(self, units: list[str], first: bool = True) -> list[bytes]:
        """The ids of consecutive units of a text that is not uncut; ``first`` if the text starts with them."""
        if not first:
            return list(map(self._after.__getitem__, units))
        return [self._heads[units[0]], *map(self._after.__getitem__, units[1:])]

    def parts(self, text: str | None) -> list[bytes]:
        """The ids of a text in consecutive pieces, little-endian uint32; null counts as empty."""
        if not text:
            return []
        if self.uncut(text):
            return [self._whole(text)]
        try:
            return self.unit_ids(text.split(" "))
        except _Irregular:
            return self.unit_ids(_CUT.split(text))

    def raw(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian uint32; null counts as empty."""
        for text in texts:
            yield b"".join(self.parts(text))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(text)), dtype="<u4")


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str, most: int | None = None) -> CachedEncoder:
    """The worker's encoder for a file, with tables of ``most`` units; they outlive a task, as workers are reused."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    code = _ENCODERS[path]
    code._after.most = code._heads.most = MAX_UNITS if most is None else most  # a fuller table is emptied by its next unit
    return code


def release() -> None:
    """Empties this worker's tables; other operators call it, as workers are reused."""
    _ENCODERS.clear()
