"""Every opN_ query on a whole table of testdata: against its SQL, brute force or held-out truth."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest

from onomast.llm import digest, langid, queries

FOLDER = "/root/testdata/sf0.001"


def rows_of(table, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{table}.parquet'").fetchall()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name, folder):
    con, at = duckdb.connect(), f"/root/testdata/{folder}"
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
    df = queries.QUERIES[name](spark, at)
    want = con.sql(queries.ORACLES[name])
    key = lambda r: tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v) for v in r)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(key, df.collect())) == sorted(key([r[k] for k in order]) for r in want.fetchall())


def test_language_query(spark):
    docs = {i: (t, lang) for i, t, lang in rows_of("documents", "doc_id, text, lang")}
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, FOLDER).collect()}
    assert set(got) == set(docs) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and docs[i][1] and docs[i][0]]
    assert np.mean([got[i]["lang_pred"] == docs[i][1] for i in held]) > 0.9
    # the machines' votes once more, pair by pair
    model = langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    for i in sorted(docs)[:60]:
        text = docs[i][0]
        if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        x = langid.ngrams([text])[0]

        def best(classes, machines, x=x):
            share = {c: 0.0 for c in classes}
            for a, b, w, bias in machines:
                p = 1 / (1 + np.exp(-4 * (float(x @ w) + bias)))
                share[classes[a]] += p
                share[classes[b]] += 1 - p
            return max(classes, key=lambda c: (share[c], -classes.index(c)))

        family = best(list(model.families), model.top)
        assert got[i]["lang_pred"] == best(model.families[family], model.inner[family])


def test_quality_query(spark):
    labels = dict(rows_of("labels", "doc_id, quality"))
    got = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, FOLDER).collect()}
    assert set(got) == {i for i, in rows_of("documents", "doc_id")}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    good, bad = ([got[i]["score"] for i, q in labels.items() if q == k and i in got and got[i]["held_out"]] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_warc_query(spark):
    pages = {i: (h or "").encode() for i, h in rows_of("pages", "page_id, html")}
    least = {}
    for i, h in pages.items():
        least[h] = min(i, least.get(h, i))
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op9_warc_archives(spark, FOLDER).collect()}
    want = {}
    for i, h in pages.items():
        sha = base64.b32encode(hashlib.sha1(h).digest()).decode()
        want[i] = (len(h), sha, "response", None) if least[h] == i else (len(h), sha, "revisit", least[h])
    assert got == want


def test_fingerprint_query(spark):
    docs = sorted(((i, t or "") for i, t in rows_of("documents", "doc_id, text")), reverse=True)
    got = {r["doc_id"]: r for r in queries.op10_document_fingerprints(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for k, (i, own) in enumerate(docs):
        following, r = docs[(k + 1) % len(docs)][1], got[i]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (digest.digest(own), digest.digest(edited))
        assert (r["near_edited"], r["near_next"]) == tuple(float(digest.canonical(own) == digest.canonical(x)) for x in (edited, following))
