"""The operators' queries over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import capfilters, counts, digest, langid, minhash, mixing, packing, quality, tokenbin, warc
from onomast.llm.base import own_session, scratch


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, read in a session of its own, whose settings the operators follow."""
    return own_session(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(spark, sf_dir, "documents"), scratch(spark, "tokens")
    tokenbin.write(docs, folder, tokenizer("byte_bpe_50k.json"), vocabulary=50_257)
    return tokenbin.read(docs.sparkSession, folder)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = _table(spark, sf_dir, "pages"), scratch(spark, "warc")
    warc.write(pages, folder).agg(F.sum("records")).first()  # writes the archives
    return warc.read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_source_mixing, op3_minhash_near_dedup, op4_token_counts, op5_embedding_near_dedup, op6_language_id, op7_token_files, op8_quality_classifier, op9_warc_archives, op10_document_fingerprints, pipeline)}

#: op2 by plain windows.  Positions: 0.25 of training time for each entry of a schedule.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS queue
  FROM documents),
q AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY queue, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS cls FROM d GROUP BY source),
w AS (SELECT *, CASE cls WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
              - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_words,
            sum(weight) OVER ()
              - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM w),
c AS (SELECT *, most * rest_weight <= rest_words * weight AS capped FROM l),
t AS (
  SELECT source, source_size, cls, CASE WHEN capped THEN most ELSE least(most, max(CASE WHEN NOT capped THEN rest_words / rest_weight END) OVER () * weight) END AS target FROM c),
j AS (
  SELECT q.doc_id, q.size, q.source, t.source_size, t.target, t.cls, q.before,
         greatest(least(round(t.target) - q.before, q.size), 0) AS once,
         greatest(least(round(t.target) - t.source_size - q.before, q.size), 0) AS twice
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, CASE WHEN once > 0 THEN before / target END AS f, CASE WHEN twice > 0 THEN (before + source_size) / target WHEN once > 0 THEN before / target END AS g FROM j),
k AS (SELECT 0 AS cls, [0.0, 0.3125, 0.625, 0.8125, 1.0] AS r UNION ALL SELECT 1, [0.0, 0.25, 0.5, 0.75, 1.0] UNION ALL SELECT 2, [0.0, 0.125, 0.3125, 0.625, 1.0])
SELECT doc_id, size, source, source_size::BIGINT AS source_size, round(target, 6) AS target, (once + twice)::BIGINT AS taken,
  round(CASE WHEN f < r[2] THEN (f - r[1]) / (r[2] - r[1]) / 4 WHEN f < r[3] THEN 0.25 + (f - r[2]) / (r[3] - r[2]) / 4 WHEN f < r[4] THEN 0.5 + (f - r[3]) / (r[4] - r[3]) / 4 ELSE 0.75 + (f - r[4]) / (r[5] - r[4]) / 4 END, 9) AS first_position,
  round(CASE WHEN g < r[2] THEN (g - r[1]) / (r[2] - r[1]) / 4 WHEN g < r[3] THEN 0.25 + (g - r[2]) / (r[3] - r[2]) / 4 WHEN g < r[4] THEN 0.5 + (g - r[3]) / (r[4] - r[3]) / 4 ELSE 0.75 + (g - r[4]) / (r[5] - r[4]) / 4 END, 9) AS last_position
FROM p JOIN k USING (cls)
"""

#: Links on whole sets of shingles, then what they reach.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
                                lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM g),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.reached FROM r JOIN l ON l.a = r.node)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, min(reached) AS component_id, min(reached) = g.doc_id AS kept
FROM g JOIN r ON r.node = g.doc_id GROUP BY g.doc_id, s
"""

#: Cosines of all pairs of a label.
CAP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(node, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.reached FROM r JOIN l ON l.a = r.node)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links,
       (SELECT min(reached) FROM r WHERE r.node = e.vec_id) AS component_id,
       (SELECT min(reached) FROM r WHERE r.node = e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""

ORACLES = {"op2_source_mixing": MIX_SQL, "op3_minhash_near_dedup": NEAR_SQL, "op5_embedding_near_dedup": CAP_SQL}
