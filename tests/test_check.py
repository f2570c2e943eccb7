import pytest
from pyspark.sql import functions as F

from onomast.config import CALIBRATED
from onomast.functions import text
from onomast.operators import decide
from onomast.plans import samples
from onomast.plans.check import Catalogue, check


@pytest.fixture(scope="module")
def catalogue(spark):
    return Catalogue.of(spark.sql(samples.BRANDS), samples.RULES, keep=True)


def run(spark, catalogue, names, **more):
    rows = check(spark.createDataFrame(list(enumerate(names)), "query_id long, raw string"), catalogue, **more).collect()
    return {r["input"]: r for r in rows}


def test_decisions(spark, catalogue):
    names = ["veloria", "Velorria", "Velorai", "ve loria", "nimra", "Nimra Home Deluxe", "אלבה", "קליניק", "Materna", "הילפיגר", "דיאור הום", "קואץ", "zenvora", "", "ｇｕｃｃｉ", "veloriaq"]
    got = run(spark, catalogue, names)
    says = {k: r["decision"] for k, r in got.items()}
    assert says == {
        "veloria": "BLOCK", "Velorria": "BLOCK", "Velorai": "HUMAN_REVIEW", "ve loria": "HUMAN_REVIEW", "nimra": "HUMAN_REVIEW", "Nimra Home Deluxe": "ALLOW", "אלבה": "BLOCK", "קליניק": "HUMAN_REVIEW",
        "Materna": "HUMAN_REVIEW", "הילפיגר": "HUMAN_REVIEW", "דיאור הום": "ALLOW", "קואץ": "HUMAN_REVIEW", "zenvora": "ALLOW", "": "ALLOW", "ｇｕｃｃｉ": "BLOCK", "veloriaq": "HUMAN_REVIEW",
    }
    assert got["דיאור הום"]["candidates"][0]["partial_match"] and got["קליניק"]["candidates"][0]["label"] == "CLINIQUE"
    assert all(len(r["candidates"]) <= 5 and len(r["candidates"]) <= len(r["display_candidates"]) for r in got.values())


def test_profiles(spark):
    c = Catalogue.of(spark.createDataFrame([(0, "b_1mp", "ADIDAS"), (1, "b_2mp", "NIKE")], "brand_ord long, code string, label string"))
    assert run(spark, c, ["AIDdas"])["AIDdas"]["decision"] == "ALLOW"
    assert run(spark, c, ["AIDdas"], config=CALIBRATED)["AIDdas"]["decision"] == "HUMAN_REVIEW"


def test_aliases(spark, catalogue):
    defs = spark.createDataFrame([(1, "b_5mp", "One", "Old Name"), (2, "b_6mp", "Two", "old-name")], "ord int, code string, label string, alias string")
    r = run(spark, catalogue, ["OLD NAME"], aliases=decide.aliases(text.normalized(defs, "alias")))["OLD NAME"]
    assert r["decision"] == "BLOCK" and r["candidates"][0]["code"] == "b_6mp" and r["candidates"][0]["match_type"] == "APPROVED_ALIAS"


def test_repeats_translations_and_codes(spark):
    b = spark.createDataFrame([(0, "c1", "Velora", [("he", "ולורה")]), (1, "c2", "VELORA", None), (2, "c1", "velora", None)], "brand_ord long, code string, label string, translations array<struct<locale:string,value:string>>")
    c = Catalogue.of(b, across=False)
    assert sorted((r["code"], r["normalized"], r["entry_ord"]) for r in c.entries.collect()) == [("c1", "velora", 0), ("c1", "ולורה", 1), ("c2", "velora", 4096)]
    r = run(spark, c, ["Velora"])["Velora"]
    assert [x["code"] for x in r["candidates"]] == ["c1", "c2"]


def test_order_of_rows_does_not_matter(spark):
    brands, names = spark.sql(samples.BRANDS), spark.sql(samples.NAMES)
    a = check(names, Catalogue.of(brands, samples.RULES)).select("query_id", "decision", "confidence", F.to_json("candidates").alias("c"))
    b = check(names.orderBy(F.desc("raw")), Catalogue.of(brands.orderBy(F.desc("label")).repartition(3), samples.RULES)).select("query_id", "decision", "confidence", F.to_json("candidates").alias("c"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_empty_tables(spark, catalogue):
    none = spark.createDataFrame([], "query_id long, raw string")
    assert check(none, catalogue).count() == 0
    bare = Catalogue.of(spark.createDataFrame([], "brand_ord long, code string, label string"))
    assert run(spark, bare, ["x"])["x"]["decision"] == "ALLOW"
