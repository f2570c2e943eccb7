"""The pipeline's stages and the SQL of the operator that has one."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from onomast.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = queries.op2_source_mixing(spark, FOLDER)
    want = con.sql(queries.ORACLES["op2_source_mixing"])
    key = lambda r: tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v) for v in r)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(key, df.collect())) == sorted(key([r[k] for k in at]) for r in want.fetchall())


def test_stages(spark, tmp_path):
    docs, rows = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert rows[0] > 0.95 * 200 and rows[1] > 0.7 * rows[0] and rows[2] > 0.8 * rows[1]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m or m > 2048").isEmpty()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    kept = spark.read.parquet(str(tmp_path / "1")).select("doc_id")
    assert labels.join(kept, "doc_id", "left_anti").count() <= 0.02 * labels.count()
