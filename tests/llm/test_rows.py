"""Stages of the pipeline on rows without a doc_id and on repeated rows, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from onomast.llm import minhash, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(11)
POOL = [f"{a}{b}" for a in ("ba", "ko", "ri", "lu", "te", "mo") for b in ("n", "rd", "st", "l", "sk", "p", "ng")]


def made(n):
    return [random.choice(POOL) for _ in range(n)]


def altered(words, places):
    return [f"other{k}" if k in places else w for k, w in enumerate(words)]


def rows_of():
    """doc_id, text: documents, near and exact copies, no doc_ids (a third), repeated rows, empty and null texts."""
    base = [made(random.randint(5, 120)) for _ in range(20)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    rows += [(100 + k, " ".join(altered(w, {len(w) // 2}))) for k, w in enumerate(base)]  # similar by 0.8 if long
    rows += [(200 + k, " ".join(base[k]).upper()) for k in range(5)]
    rows += [(None, " ".join(w)) for w in base[:15]] + [(None, " ".join(made(40))) for _ in range(10)]
    return rows + [(300, None), (301, ""), (None, None), (302, "one"), (303, "one")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{len(t or '') % 3}", len(t or "")) for i, t in rows], DOCS)


def of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def brute_kept(rows, words=5, percent=80):
    """doc_ids of the rows that near-dedup keeps: the smallest of each group of linked documents."""
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        n = min(words, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()))
    least = {i: i for i, _ in sets if i is not None}
    links = [(a, b) for a, s in sets for b, t in sets if a is not None and b is not None and s and 100 * len(s & t) >= percent * len(s | t)]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i for i, c in least.items() if i == c}


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "mixture", "packed"])
def test_rows_without_doc_id(spark, stage):
    rows = rows_of()
    docs = frame(spark, rows)
    none = Counter(t for i, t in rows if i is None)
    got = getattr(corpus_pipeline, stage)(spark, docs, "/root/testdata/sf0.001")
    if stage == "packed":
        assert got.where("doc_id is null and piece = 0").count() == sum(none.values())
        return
    got = of(got)
    held = Counter({t: n for (i, t), n in got.items() if i is None})
    if stage == "language":
        assert held == Counter({t: n for t, n in none.items() if t})
    if stage == "near_duplicates":
        keep = brute_kept(rows)
        assert set(held) == set(none) and got == Counter({r for r in rows if r[0] is None or r[0] in keep})
    if stage == "mixture":
        taken = mixing.mix(docs).where("doc_id is null").agg(F.sum("taken")).first()[0]
        assert taken > 0 and sum(len(t.split()) * n for t, n in held.items()) == taken


def test_quality_keeps_rows_without_doc_id(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.where("doc_id % 3 = 0").withColumn("doc_id", F.lit(None).cast("long"))
    got = of(corpus_pipeline.good(spark, docs.unionByName(extra), folder))
    want = {(r["doc_id"], r["text"]) for r in docs.where("doc_id % 3 = 0").collect()}
    assert {t for i, t in got if i is None} == {t for i, t in want if (i, t) in got}


def test_repeated_rows(spark):
    rows = rows_of()
    many = rows * 3 + [(0, rows[0][1])] * 40 + [(None, rows[0][1])] * 40
    docs = frame(spark, many)
    keep = brute_kept(rows)
    assert of(corpus_pipeline.near_duplicates(spark, docs, "")) == Counter({r for r in rows if r[0] is None or r[0] in keep})
    # the mix takes of each doc_id, source and size the words that it decided, each time a whole row or a part of one
    decided = mixing.mix(docs)
    want = Counter()
    for r in decided.where("taken > 0").collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    got, parts = Counter(), 0
    known = {(i, t) for i, t in rows}
    for r in mixing.apply_mix(docs, decided).collect():
        got[r["doc_id"], r["source"]] += len(r["text"].split())
        parts += (r["doc_id"], r["text"]) not in known
    assert got == want and parts <= 2 * 3  # a source's target ends on one document


def test_repeated_rows_are_taken_like_a_queue(spark):
    """Copies, and different texts of one doc_id and size, are taken row by row: n rows are not n x n."""
    rows = [(7, "a b c d")] * 5 + [(7, "e f g h")] * 5 + [(8, "i j")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    decided = mixing.mix(docs).collect()
    got = of(mixing.apply_mix(docs, mixing.mix(docs)))
    assert sum(n * len(t.split()) for (i, t), n in got.items()) == sum(r["taken"] for r in decided) == 63
    assert got[7, "a b c d"] + got[7, "e f g h"] == sum(-(-r["taken"] // 4) for r in decided if r["doc_id"] == 7 and r["taken"] % 4 == 0) + sum(r["taken"] // 4 for r in decided if r["doc_id"] == 7 and r["taken"] % 4)


def test_mixture_comes_in_order_of_position(spark):
    docs = frame(spark, [(i, t) for i, t in rows_of() if i is not None])
    decided = mixing.mix(docs).where("taken > 0").collect()
    want = [(r["first_position"], r["doc_id"]) for r in decided] + [(r["last_position"], r["doc_id"]) for r in decided if r["taken"] > r["size"]]
    got = [r["doc_id"] for r in mixing.apply_mix(docs, mixing.mix(docs)).collect()]
    at = {}
    for p, i in sorted(want):
        at.setdefault(i, []).append(p)
    places = [at[i].pop(0) for i in got]
    assert places == sorted(p for p, _ in want) and len(set(places)) > 20


def test_components_at_the_pipelines_setting(spark):
    rows = [r for r in rows_of() if r[0] is not None] * 2
    got = minhash.near_duplicates(frame(spark, rows), words=5, percent=80).collect()
    keep = brute_kept(rows)
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["kept"]} == keep
    assert 5 < len({i for i, _ in rows} - keep) and any(100 <= i < 200 for i in {i for i, _ in rows} - keep) and any(100 <= i < 200 for i in keep)
