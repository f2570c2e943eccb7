"""A pipeline over ``documents``: language, quality, near-duplicates, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); it is written as Parquet and read again as the next stage's
documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import langid, minhash, mixing, packing, quality
from onomast.llm.base import own_session, prepare, scratch, short_batches
from onomast.llm.queries import tokenizer


def _ready(docs: DataFrame) -> None:
    """Whole texts go to Python in short batches, in the session of ``docs``: that of :func:`run` is its own."""
    prepare(docs.sparkSession)
    short_batches(docs.sparkSession)


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and those without a doc_id, which link with nothing."""
    known = docs.where("doc_id is not null").join(ids.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return known.unionByName(docs.where("doc_id is null"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay: rejected are those without a letter (und). lang becomes the predicted one."""
    _ready(docs)
    return langid.tag(docs, langid.fit(docs)).where("lang <> 'und'").select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1 stay."""
    _ready(docs)
    model = quality.fit(docs, docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id (five words, similarity 0.8).

    Rows that agree in doc_id and text, nulls included, stay once, with the least of their other columns.
    """
    _ready(docs)
    found = minhash.near_duplicates(docs, words=5, percent=80)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = _keep(docs, found.where("kept")).groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest"))
    return once.select("doc_id", "text", "_rest.*").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; one that it takes in part is cut to those words."""
    _ready(docs)
    return mixing.apply_mix(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture with their places in sequences of 2048 tokens."""
    _ready(docs)
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language id", language),
    ("quality classifier", good),
    ("minhash near-dedup", near_duplicates),
    ("source mixing", mixture),
    ("best-fit packing", packed),
]

#: Models and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = own_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
