import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from onomast.operators import exports
from onomast.plans import samples
from onomast.plans.check import Catalogue, check
from onomast.sources import cache, catalogue, names, sinks
from onomast.streaming.stream import screen

AT = dt.datetime(2024, 5, 6, 7, 8)


def test_payloads_are_strict(spark):
    rows = catalogue.adapt(spark.sql(samples.PAYLOADS)).orderBy("brand_ord").collect()
    assert [(r["code"], r["label"], r["translations"] and [tuple(t) for t in r["translations"]]) for r in rows] == [("b_1mp", "Alba", [("he", "אלבה")]), ("b_3mp", "Brio", None)]


@pytest.mark.parametrize("token, status, body, says", [(" ", 200, "{}", "token"), ("t", 500, "", "HTTP 500"), ("t", 200, "<", "JSON"), ("t", 200, "{}", "usable")])
def test_fetch_failures(spark, token, status, body, says):
    with pytest.raises(catalogue.CatalogueError, match=says):
        catalogue.load(spark, "u", token, lambda u, h: (status, body))


def test_data_source(spark):
    class Fixed(catalogue.CatalogueSource):
        get = staticmethod(lambda url, headers: (200, json.dumps({"values_lists": [{"values": [{"code": headers["Authorization"], "label": url}]}]})))

    spark.dataSource.register(Fixed)
    r = catalogue.adapt(spark.read.format("catalogue").option("url", "x").option("token", " t ").load()).first()
    assert (r["code"], r["label"]) == ("Bearer t", "x")


def test_lists_and_arguments(spark, tmp_path):
    (tmp_path / "n.txt").write_bytes("﻿Alba\r\n\r\n  Brio \nAlba".encode())
    assert [r["raw"] for r in names.read_list(spark, str(tmp_path / "n.txt")).orderBy("query_id").collect()] == ["Alba", "Brio", "Alba"]
    a = names.parse_arguments(["x", "-o", "r.TXT", "--", "-i"])
    assert (a.names, a.out, a.input, a.help) == (["x", "-i"], "r", None, False)
    assert names.parse_arguments(["-", "-h"]).names == ["-"]
    for bad in (["--what"], ["-i"]):
        with pytest.raises(ValueError):
            names.parse_arguments(bad)
    assert [r["raw"] for r in names.names_of(spark, names.parse_arguments([]), ["a\n", " \n", "b"]).orderBy("query_id").collect()] == ["a", "b"]


@pytest.fixture(scope="module")
def checked(spark):
    c = Catalogue.of(spark.sql(samples.BRANDS), across=False)
    q = spark.createDataFrame([(0, 've "x"'), (1, "veloria"), (2, "NIMRA\nHOME"), (3, "zzz")], "query_id long, raw string")
    return check(q, c).persist()


def test_reports(spark, checked, tmp_path):
    paths = sinks.write_reports(sinks.report_rows(checked), str(tmp_path / "r" / "out"), AT, {"total": 61_000.0, "build": 100.0, "check": -1.0}, 11)
    text, csv = (Path(paths[k]).read_bytes().decode() for k in ("txt", "csv"))
    assert text.startswith("﻿Brand check results - 2024-05-06 07:08\n4 checked | 2 ALLOW | 2 REVIEW | 1m 1s (build 0.1s, check 0.0s)\n\n[1] ve \"x\"\n")
    assert "[3] NIMRA HOME\n    Result: REVIEW\n    Existing brands to compare:\n      - NIMRA HOME (b_8mp)" in text
    assert csv.startswith('﻿"brand","result","candidates"\r\n"ve ""x""","ALLOW",""\r\n"veloria","REVIEW","VELORIA (b_0mp)')
    assert json.loads(Path(paths["timing"]).read_text())["counts"] == {"catalogueBrands": 11, "namesChecked": 4}
    none = sinks.write_reports(sinks.report_rows(checked.where("false")), str(tmp_path / "e"), AT, {"total": 0.0, "build": 0.0, "check": 0.0}, 0)
    assert list(none) == ["timing"]
    shown = {r["query_id"]: r["text"] for r in sinks.terminal(checked).collect()}
    assert "Margin below a match" in shown[3] and "  Decision: BLOCK\n  Confidence: 100%" in shown[1]
    assert sinks.duration(3_723_000) == "1h 2m 3s"


def test_review_and_exports(spark, checked, tmp_path, monkeypatch):
    items = sinks.review_batch(checked)
    assert {r["id"]: r["selected"] for r in items.collect()} == {0: True, 1: False, 2: False, 3: True}
    with pytest.raises(ValueError, match="unknown"):
        sinks.selection(items, spark.createDataFrame([(99,)], "id long"))
    chosen = sinks.selection(items, spark.createDataFrame([(3,), (0,), (3,)], "id long"))
    (tmp_path / "SP_brands_200001010000.csv").write_text("old")
    (tmp_path / "other.csv").write_text("mine")
    brands, relations = sinks.export(chosen, spark.sql(samples.CODES), str(tmp_path), AT)
    assert Path(brands).read_bytes() == b'brand_number;brand_name \r\n;b_12345678901234567891mp;"ve ""x"""\r\n;b_12345678901234567892mp;zzz\r\n'
    assert Path(relations).read_bytes() == b"brand_number;parent_number \r\n;b_12345678901234567891mp;brand\r\n;b_12345678901234567892mp;brand\r\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["SP_brand_relations_202405060708.csv", "SP_brands_202405060708.csv", "other.csv"]
    real, calls = sinks.os.rename, []

    def failing(a, b):
        calls.append(b)
        if "209901010000" in str(b) and "relations" in str(b):
            raise OSError("full")
        real(a, b)

    monkeypatch.setattr(sinks.os, "rename", failing)
    with pytest.raises(OSError):
        sinks.export(chosen, spark.sql(samples.CODES), str(tmp_path), dt.datetime(2099, 1, 1))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["SP_brand_relations_202405060708.csv", "SP_brands_202405060708.csv", "other.csv"]
    with pytest.raises(ValueError):
        exports.allocate(chosen, spark.createDataFrame([("x",)], "code string"))


def test_cache(spark, tmp_path):
    n = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    first = cache.cached_variants(n("ולורה", "Velora", "נימרה"), "{}", str(tmp_path))
    assert {r["name"] for r in first.collect()} == {"ולורה", "נימרה"}
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    assert cache.cached_variants(n("ולורה", "נימרה"), "{}", str(tmp_path)).inputFiles() == first.inputFiles()
    assert {r["name"] for r in cache.cached_variants(n("ולורה", "גלורה"), "{}", str(tmp_path)).collect()} == {"ולורה", "גלורה"}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest | {"checksum": "forged"}))
    assert {r["name"] for r in cache.cached_variants(n("נימרה"), "{}", str(tmp_path)).collect()} == {"נימרה"}


def test_catalogue_from_cache(spark, tmp_path):
    brands = spark.sql(samples.BRANDS)
    rows = [sorted((r["code"], str(r["variants"])) for r in Catalogue.of(brands, samples.RULES, cache=c).entries.collect()) for c in (None, str(tmp_path), str(tmp_path))]
    assert rows[0] == rows[1] == rows[2]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("veloria\n\nzzz\n")
    c, got = Catalogue.of(spark.sql(samples.BRANDS), across=False), []
    q = screen(spark.readStream.text(str(tmp_path / "in")), c, lambda df, k: got.extend((r["input"], r["decision"]) for r in df.collect()), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    assert sorted(got) == [("veloria", "BLOCK"), ("zzz", "ALLOW")]


def test_curated_pairs(spark):
    pairs, excluded = names.curated_pairs(spark.sql(samples.RECORDS))
    assert {r["record_id"] for r in excluded.collect()} == {2, 3}
    assert {(r["latin"], r["hebrew"]) for r in pairs.where(F.col("record_id") == 1).collect()} == {("lalba", "לאלבה"), ("lalba", "אלבה"), ("alba", "לאלבה"), ("alba", "אלבה")}
