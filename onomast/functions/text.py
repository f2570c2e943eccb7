"""Normal forms and script classes of names, as Column expressions.

Lengths and positions count code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The character classes of the normal form, in the order in which they apply.
INVISIBLE = r"[\u061C\u200B-\u200F\uFEFF]"
APOSTROPHES = r"['\u2018-\u201B\u2032\u2035`\u05F3]"
QUOTES = r"[\u201C-\u201F\u2033\u2036\u05F4]"
SEPARATORS = r"[-\u058A\u05BE\u2010-\u2015\u2212_\uFE58\uFE63\uFF0D]+"
AMPERSANDS = r"[&\uFF06]+"
PUNCTUATION = r"[.,;:!?()\[\]{}/\\]+"
SPACES = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
HEBREW = r"[\u0590-\u05FF]"
LATIN = r"[A-Za-z\u00C0-\u024F]"
_ASCII = r"^[\x00-\x7F]*$"


def folded(c: Column) -> Column:
    """The normal form of a text that is in NFKC already; null gives the empty text."""
    c = F.coalesce(c, F.lit(""))
    for pattern, to in ((INVISIBLE, ""), (APOSTROPHES, "'"), (QUOTES, '"'), (f"{SEPARATORS}|{AMPERSANDS}|{PUNCTUATION}|{SPACES}+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return trimmed(F.regexp_replace(F.lower(c), f"{SPACES}+", " "))


def trimmed(c: Column) -> Column:
    """Without white space at the ends, in the Unicode sense (Spark's trim knows the blank only)."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def compacted(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACES}+", "")


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalized(df: DataFrame, name: str, to: str = "normalized", compact: str | None = "compact") -> DataFrame:
    """Adds the normal form of column ``name`` and its compact form.

    ASCII rows stay in the JVM; only the others, which NFKC can change, go through Arrow.  The rows are split and not
    chosen by CASE, as Python runs for every row that reaches its operator.
    """
    plain = F.coalesce(F.col(name).rlike(_ASCII), F.lit(True))
    out = df.where(plain).withColumn(to, folded(F.col(name))).unionByName(df.where(~plain).withColumn(to, folded(nfkc(F.col(name)))))
    return out.withColumn(compact, compacted(F.col(to))) if compact else out


def script(c: Column) -> Column:
    """HEBREW, LATIN, MIXED, NUMERIC_OR_SYMBOL or OTHER, of the raw name."""
    c = F.coalesce(c, F.lit(""))
    hebrew, latin = c.rlike(HEBREW), c.rlike(LATIN)
    return (
        F.when(trimmed(c) == "", "OTHER").when(hebrew & latin, "MIXED").when(hebrew, "HEBREW").when(latin, "LATIN").otherwise("NUMERIC_OR_SYMBOL")
    )


def cross_script(query: Column, entry: Column) -> Column:
    """Whether the scripts of a name and an entry call for comparison across scripts."""
    return (query.isin("HEBREW", "MIXED") & (entry == "LATIN")) | ((query == "LATIN") & entry.isin("HEBREW", "MIXED"))


def comparable_latin(normal: Column) -> Column:
    """The form in which romanized spellings are compared: the normal form without apostrophes."""
    return F.replace(normal, F.lit("'"), F.lit(""))


#: The steps of a Latin consonant skeleton.
LATIN_SKELETON = (("ph", "p"), ("f", "p"), ("x", "ks"), ("ch", "k"), ("[cq]", "k"), ("[aeiouwyv]", ""), ("h(?![a-z])", ""), (r"(.)\1+", "$1"), ("[^a-z0-9]", ""))
#: The steps of a Hebrew consonant skeleton, after final letters take their medial form.
FINAL_LETTERS, MEDIAL_LETTERS = "ךםןףץ", "כמנפצ"
HEBREW_SKELETON = ((r"[אויעה]", ""), (r"(.)\1+", "$1"), (r"[^א-ת]", ""))


def latin_skeleton(c: Column) -> Column:
    c = F.lower(c)
    for pattern, to in LATIN_SKELETON:
        c = F.regexp_replace(c, pattern, to)
    return c


def hebrew_skeleton(c: Column) -> Column:
    c = F.translate(c, FINAL_LETTERS, MEDIAL_LETTERS)
    for pattern, to in HEBREW_SKELETON:
        c = F.regexp_replace(c, pattern, to)
    return c


def single_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+", " ")


def bigrams(c: Column, alone: bool) -> Column:
    """The distinct bigrams of a text in order; ``alone``: a text of one character is its own."""
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: c.substr(i, F.lit(2))))
    none = F.array().cast("array<string>")
    return F.when(F.length(c) >= 2, pairs).when((F.length(c) == 1) & F.lit(alone), F.array(c)).otherwise(none)


# Plain Python twins, for kernels that normalize what they generate.
import re as _re  # noqa: E402

_PY = [(_re.compile(p), to) for p, to in ((INVISIBLE, ""), (APOSTROPHES, "'"), (QUOTES, '"'), (f"{SEPARATORS}|{AMPERSANDS}|{PUNCTUATION}|{SPACES}+", " "))]
_PY_SPACES = _re.compile(f"{SPACES}+")


def normalize(text: str | None) -> str:
    text = unicodedata.normalize("NFKC", text or "")
    for pattern, to in _PY:
        text = pattern.sub(to, text)
    return _PY_SPACES.sub(" ", text.lower()).strip(" ")


def _steps(text: str, steps) -> str:
    for pattern, to in steps:
        text = _re.sub(pattern, to.replace("$1", r"\1"), text)
    return text


def latin_skeleton_of(text: str) -> str:
    return _steps(text.lower(), LATIN_SKELETON)


def hebrew_skeleton_of(text: str) -> str:
    return _steps(text.translate(str.maketrans(FINAL_LETTERS, MEDIAL_LETTERS)), HEBREW_SKELETON)
