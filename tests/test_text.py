from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from onomast.functions import text

CASES = [
    ("  Velora ", "velora", "velora"), ("VEL-ORA", "vel ora", "velora"), ("Vel_ora–Home", "vel ora home", "velorahome"), ("L’Alba", "l'alba", "l'alba"), ("A & R", "a r", "ar"),
    ("Brio.Co", "brio co", "brioco"), ("ｖｅｌ", "vel", "vel"), ("Žluta", "žluta", "žluta"), ("a b", "a b", "ab"), ("ג׳וליה", "ג'וליה", "ג'וליה"), ("x​y", "xy", "xy"), (None, "", ""), (" . ", "", ""), ("“q”", '"q"', '"q"'),
]


def test_normal_forms(spark):
    rows = text.normalized(spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, raw string"), "raw").collect()
    got = {r["k"]: (r["normalized"], r["compact"]) for r in rows}
    assert got == {k: c[1:] for k, c in enumerate(CASES)}
    assert [text.normalize(c[0]) for c in CASES] == [c[1] for c in CASES]


@given(st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_normal_form_is_stable(x):
    assert text.normalize(text.normalize(x)) == text.normalize(x)


def test_scripts(spark):
    cases = {"Velora": "LATIN", "ולורה": "HEBREW", "Velora ולורה": "MIXED", "12 %": "NUMERIC_OR_SYMBOL", "  ": "OTHER", "ベロラ": "NUMERIC_OR_SYMBOL"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", text.script(F.col("raw")).alias("s")).collect()
    assert {r["raw"]: r["s"] for r in rows} == cases


def test_skeletons(spark):
    latin = {"euphoria": "pr", "phoenix": "pnks", "mississippi": "msp", "quick hh": "kh", "": ""}
    rows = spark.createDataFrame([(k,) for k in latin], "x string").select("x", text.latin_skeleton(F.col("x")).alias("s")).collect()
    assert {r["x"]: r["s"] for r in rows} == latin == {k: text.latin_skeleton_of(k) for k in latin}
    assert text.hebrew_skeleton_of("שלוםם") == "שלמ"


def test_bigrams_and_lines(spark):
    d = spark.createDataFrame([("abab", "a\r\nb"), ("a", "x"), ("", "")], "x string, y string")
    rows = d.select(text.bigrams(F.col("x"), True).alias("i"), text.bigrams(F.col("x"), False).alias("q"), text.single_line(F.col("y")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [(["ab", "ba"], ["ab", "ba"], "a b"), (["a"], [], "x"), ([], [], "")]
