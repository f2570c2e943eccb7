"""Whether one letter for another is a likely slip of typing or spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys in rows, the Hebrew letters on them (SI 1452; a blank where a key has none), and letters of one sound.
ROWS = ("qwertyuiop", "asdfghjkl;", "zxcvbnm,.")
HEBREW_ROWS = ("  קראטוןםפ", "שדגכעיחלךף", "זסבהנמצתץ")
SOUND_ALIKE = ("טת", "כקך", "סש", "אעה", "בו", "חכך", "מם", "נן", "פף", "צץ", "ckq", "cs", "sz", "iy", "vw", "aeiouy")

#: Letter -> (row, column).
PLACES = {c: (r, k) for rows in (ROWS, HEBREW_ROWS) for r, keys in enumerate(rows) for k, c in enumerate(keys) if c != " "}


def plausible(a: str, b: str) -> bool:
    """Equal, of one sound, off the letter keys, or on neighbouring keys (rows are staggered to the left)."""
    if a == b or any(a in g and b in g for g in SOUND_ALIKE) or a not in PLACES or b not in PLACES:
        return True
    (r, c), (s, d) = sorted((PLACES[a], PLACES[b]))
    return abs(c - d) == 1 if r == s else s - r == 1 and d in (c, c - 1)


def plausible_column(a: Column, b: Column) -> Column:
    """:func:`plausible` over literal maps, in the JVM."""
    rows = F.create_map(*[F.lit(x) for c, (r, _) in PLACES.items() for x in (c, r)])
    cols = F.create_map(*[F.lit(x) for c, (_, k) in PLACES.items() for x in (c, k)])
    alike = F.exists(F.array(*map(F.lit, SOUND_ALIKE)), lambda g: F.contains(g, a) & F.contains(g, b))
    r, s, c, d = rows[a], rows[b], cols[a], cols[b]
    beside = F.when(r == s, F.abs(c - d) == 1).when(r + 1 == s, (d == c) | (d == c - 1)).when(s + 1 == r, (c == d) | (c == d - 1)).otherwise(False)
    return F.when((a == b) | alike | r.isNull() | s.isNull(), True).otherwise(beside)


def single_substitution(a: Column, b: Column) -> Column:
    """struct(l, r) of the one place in which two texts of equal length differ; null otherwise."""
    at = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("l"), y.alias("r"))), lambda x: x["l"] != x["r"])
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0) & (F.size(at) == 1), at[0])
