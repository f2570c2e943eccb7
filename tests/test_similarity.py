import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from onomast.functions import keyboard, similarity, spelling, text
from onomast.operators import scoring

words = st.text("abc ", max_size=9)


def model(a: str, b: str) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@given(st.lists(st.tuples(words, words), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_edit_distances(pairs):
    assert similarity.osa_many(*map(list, zip(*pairs, strict=True))).tolist() == [model(a, b) for a, b in pairs]


def test_columns_agree_with_the_kernel(spark):
    names = ["", "a", "ab", "ba", "ca", "abc", "vel ora", "velora", "velroa", "vel ora home", "😀a", "home velora"]
    rows = [(a, b) for a in names for b in names]
    d = similarity.compared(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    a, b, s = F.col("a"), F.col("b"), F.col("signals")
    osa = similarity.osa("a", "b")
    bad = d.where(
        (osa != s["edit_distance"]) | (F.abs(similarity.dice(a, b) - s["ngram_similarity"]) > 1e-12) | (similarity.common_prefix(a, b) != s["common_prefix_length"])
        | (similarity.token_prefix(a, b) != s["is_token_prefix"]) | (similarity.transposed(a, b, osa) != s["is_transposition"])
    )
    assert bad.select("a", "b").collect() == []


@pytest.mark.parametrize("a, b, score", [("addidas", "adidas", 0.8465), ("adida", "adidas", 0.8583), ("aiddas", "adidas", 0.7383), ("velmora", "selmor", 0.6896)])
def test_composite(a, b, score):
    assert round(similarity.compare_many([a], [b])[0][0], 4) == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("a, b, partial", [("velora men", "velora", True), ("velora x", "velora", False), ("clear deya", "clear day", True), ("benefit care", "renew care", True), ("velora", "velora home", False), ("klein care", "kline care", False)])
def test_partial(a, b, partial):
    assert similarity.compare_many([a], [b])[0][-1] is partial


def test_keyboard(spark):
    cases = [("f", "r", True), ("f", "v", True), ("f", "p", False), ("c", "k", True), ("ט", "ת", True), ("פ", "י", False), ("1", "q", True), ("a", "u", True)]
    assert [keyboard.plausible(a, b) for a, b, _ in cases] == [c for *_, c in cases]
    d = spark.createDataFrame(cases, "a string, b string, ok boolean").where(keyboard.plausible_column(F.col("a"), F.col("b")) != F.col("ok"))
    assert d.isEmpty()
    one = spark.createDataFrame([("abc", "abd"), ("abc", "xbd"), ("abc", "ab")], "a string, b string").select(keyboard.single_substitution(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in one] == [("c", "d"), None, None]


def test_normal_twin(spark):
    x = "A–b & C  d"
    assert spark.createDataFrame([(x,)], "x string").select(text.folded(F.col("x"))).first()[0] == text.normalize(x)


def test_bounds_are_above_scores():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcde ", k=rng.randint(0, 9))) for _ in range(60)] + ["", "a", "ab", "ba", "אבגד", "אבדג"]
    a, b = zip(*[(x, y) for x in words for y in words], strict=True)
    bounds = similarity.score_bounds(list(a), list(b), block=97)
    scores = [r[0] for r in similarity.compare_many(list(a), list(b))]
    assert all(s <= u for s, u in zip(scores, bounds, strict=True))
    assert similarity.score_bounds([], []).tolist() == []


def test_best_spellings_equal_brute_force():
    """Of every spelling the best comparison of all, and none below the floor, as if nothing were left out."""
    rng = random.Random(6)
    one = lambda letters, skeleton: (lambda t: {"text": t, "source": rng.choice(["ORIGINAL", "GENERATED", "CURATED"]), "confidence": rng.choice([0.2, 0.59, 0.75, 1.0]), "skeleton": skeleton(t)})("".join(rng.choices(letters, k=rng.randint(0, 7))))
    latin, hebrew = lambda: one("abkln", text.latin_skeleton_of), lambda: one("אבכלנ", text.hebrew_skeleton_of)
    pairs = []
    for k in range(40):
        normal = hebrew()
        pairs.append({"variants": [latin() for _ in range(k % 7)], "own": [latin() for _ in range(k % 5)] or None, "hebrew": [hebrew() for _ in range(k % 6)] or None, "normalized": normal["text"] or "א", "written": text.hebrew_skeleton_of(normal["text"] or "א")})
    for floor in (0.0, 0.3, 0.55):
        at, rows, _ = scoring._best_spellings(pairs, spelling.curated_from({}), floor)
        want = {}
        for k, p in enumerate(pairs):
            sides = [(0, v, w) for v in enumerate(p["variants"]) for w in p["own"] or () if w["text"]]
            sides += [(1000, v, {"text": p["normalized"], "skeleton": p["written"], "confidence": 1.0}) for v in enumerate(p["hebrew"] or ())]
            for start, (seq, v), w in sides:
                c = min(v["confidence"], w["confidence"])
                score = 0.8 + 0.19 * c if v["text"] == w["text"] else similarity.compare_many([v["text"]], [w["text"]])[0][0] * (0.7 + 0.3 * c)
                if v["text"] != w["text"] and v["skeleton"] == w["skeleton"] and len(v["skeleton"]) >= 4:
                    score = max(score, 0.78 * c)
                if score >= floor and score > want.get((k, start + seq), (-1,))[0]:
                    want[k, start + seq] = score, v["text"], w["text"]
        assert {(k, r[0]): (r[6], r[1], r[2]) for k, r in zip(at, rows, strict=True)} == want
