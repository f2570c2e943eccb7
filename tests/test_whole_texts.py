"""Queries over documents take whole texts: fixtures whose outcome lies behind the openings of the texts."""

from __future__ import annotations

import unicodedata

import duckdb
import pytest

from onomast.functions import text
from onomast.plans import oracles
from onomast.plans.queries import QUERIES

LONG = "lorem ipsum dolor sit amet " * 20
TEXTS = [None, "", "12 %", "Überall steht Rose-Anvil, blue anvl!", LONG + "anvil ולורה", LONG + "Plain end", "Cafe\u0301 " * 30 + "naïve bleu", "one blue", "one blue"]
NAMES = ["blue anvil", "rose", "cafe noir"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(x,) for x in NAMES], "p_name string").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([("Supplier 1",)], "s_name string").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([("Customer 1",)], "c_name string").write.parquet(f"{path}/customer.parquet")
    return path


def words_of(whole):
    """Runs of letters, with the marks that follow a letter."""
    out, run = [], ""
    for c in whole or "":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and run):
            run += c
        else:
            out, run = out + [run], ""
    return [w.lower() for w in out + [run] if w]


def test_every_word_is_screened(spark, folder):
    got = sorted(QUERIES["check_names_docs"](spark, folder).collect())
    words = sorted({w for t in TEXTS for w in words_of(t)}, key=str.encode)
    assert [(r["query_id"], r["input"]) for r in got] == list(enumerate(words, 1))
    assert {"überall", "anvl", "ולורה", "end", "cafe\u0301", "naïve"} <= set(words)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    con.execute("CREATE TABLE words (query_id BIGINT, raw VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?, ?)", [(k, unicodedata.normalize("NFKC", w)) for k, w in enumerate(words, 1)])  # DuckDB has no NFKC
    want = con.sql(oracles._with(oracles._decisions("SELECT query_id, raw FROM words"), "SELECT dec.query_id, decision, round(confidence, 6), coalesce(code, '') FROM dec LEFT JOIN top5 ON top5.query_id = dec.query_id AND top5.rank = 1")).fetchall()
    assert [(r[0], *r[2:]) for r in got] == [(*r[:2], pytest.approx(r[2]), r[3]) for r in sorted(want)]
    assert next(r for r in got if r["input"] == "rose")["decision"] == "BLOCK"


def test_script_is_that_of_the_whole_text(spark, folder):
    got = {r["raw"]: r["script"] for r in QUERIES["detect_script"](spark, folder).collect()}
    assert set(TEXTS) <= set(got)
    assert got[LONG + "anvil ולורה"] == "MIXED" and got[LONG + "Plain end"] == "LATIN" and got["12 %"] == "NUMERIC_OR_SYMBOL"
    con = duckdb.connect()
    con.execute("CREATE TABLE t (raw VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [[t] for t in dict.fromkeys(TEXTS)])
    assert dict(con.sql(f"SELECT raw, {oracles._SCRIPT} FROM t").fetchall()).items() <= got.items()


def test_whole_texts_are_normalized(spark, folder):
    got = {r["raw"]: (r["normalized"], r["compact"]) for r in QUERIES["normalize_names"](spark, folder).collect()}
    assert set(got) == {*TEXTS, *NAMES, "Supplier 1", "Customer 1"}
    assert all(got[t] == (text.normalize(t), text.normalize(t).replace(" ", "")) for t in TEXTS)
    assert got[LONG + "Plain end"][0].endswith("amet plain end") and got[TEXTS[6]][0].startswith("café café")
