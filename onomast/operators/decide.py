"""The short list of a name and the decision on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.config import DEFAULT, MatchConfig
from onomast.operators.scoring import COLUMNS, CROSS, SIGNALS

CANDIDATE = ("code", "label", "score", "match_type", "reason", "partial_match", "signals", "cross")


def ranked(rows: DataFrame, to: str = "rank") -> DataFrame:
    """Numbers each name's candidates: whole before partial, better before worse, then by position."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("partial_match").cast("int"), F.desc("score"), "position")))


def aliases(definitions: DataFrame) -> DataFrame:
    """(normalized, code, label, alias) of alias definitions (ord, code, label, alias, normalized); the last wins."""
    w = Window.partitionBy("normalized").orderBy(F.desc("ord"))
    return definitions.where("normalized <> ''").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("normalized", "code", "label", "alias")


def alias_candidates(q: DataFrame, known: DataFrame) -> DataFrame:
    """A candidate of score 1 for names that are an approved alias."""
    rows = q.select("query_id", "normalized").join(known, "normalized")
    none = F.lit(None)
    return rows.select(
        "query_id", "code", "label", F.lit(1.0).alias("score"), F.lit("APPROVED_ALIAS").alias("match_type"), F.format_string("Approved alias of %s: %s", "label", "alias").alias("reason"),
        F.lit(False).alias("partial_match"), none.cast(SIGNALS).alias("signals"), none.cast(CROSS).alias("cross"), F.lit(0).cast("long").alias("position"),
    )


def united(groups: list[DataFrame]) -> DataFrame:
    """The best candidate of each code over ranked groups; a code stands where it came first, earlier groups first."""
    rows = None
    for k, g in enumerate(groups):
        g = g.withColumn("position", F.lit(k * 10**6).cast("long") + F.col("rank")).select(*COLUMNS)
        rows = g if rows is None else rows.unionByName(g)
    w = Window.partitionBy("query_id", "code")
    r = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "position"))).withColumn("_p", F.min("position").over(w))
    return ranked(r.where("_r = 1").withColumn("position", F.col("_p")).drop("_r", "_p"))


def short_list(rows: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    """The ``candidates`` best of ranked rows, with places held for the best across scripts."""
    held = max(0, min(config.reserved_slots, config.candidates - 1))
    across = F.col("cross").isNotNull()
    nth = F.sum(across.cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
    r = rows.withColumn("_held", across & (nth <= held))
    r = r.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_held"), "rank"))).where(F.col("_r") <= config.candidates)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("_held", "_r")


def listed(rows: DataFrame, to: str) -> DataFrame:
    """query_id and its candidates as an array in rank order."""
    c = F.array_sort(F.collect_list(F.struct("rank", *CANDIDATE)))
    return rows.groupBy("query_id").agg(F.transform(c, lambda x: F.struct(*[x[k].alias(k) for k in CANDIDATE])).alias(to))


def _first(cs: Column, test) -> Column:
    return F.get(F.filter(cs, test), F.lit(0))


def convincing(x: Column, config: MatchConfig) -> Column:
    """Evidence across scripts: exact, a long shared skeleton, or a likeness that sound confirms."""
    c = x["cross"]
    long = F.coalesce(c["skeleton_match"], F.lit(False)) & (F.length(F.coalesce(c["skeleton"], F.lit(""))) >= config.skeleton_evidence_length)
    return c.isNotNull() & (F.coalesce(c["exact"], F.lit(False)) | long | (c["sound_similarity"].isNotNull() & (c["similarity"] >= config.cross_evidence)))


def decision(cs: Column, config: MatchConfig = DEFAULT) -> Column:
    """struct(decision, confidence) of an array of candidates in rank order.

    The confidence of ALLOW is a margin, 1 less the best score; of other decisions it is a score.
    """
    exact = _first(cs, lambda x: x["match_type"] == "NORMALIZED_EXACT")
    compact = _first(cs, lambda x: x["match_type"] == "COMPACT_EXACT")
    translit = _first(cs, lambda x: (x["match_type"] == "TRANSLITERATION_EXACT") & x["cross"]["exact"] & (x["cross"]["source"] == "CURATED"))
    alias = _first(cs, lambda x: x["match_type"] == "APPROVED_ALIAS")
    guess = lambda x: x["cross"].isNotNull() & ~F.coalesce(x["cross"]["exact"], F.lit(False)) & x["cross"]["sound_similarity"].isNull() & ~F.coalesce(x["cross"]["skeleton_match"], F.lit(False))
    whole = F.filter(cs, lambda x: ~x["partial_match"] & ~guess(x))
    top = F.get(whole, F.lit(0))
    evidence = _first(whole, lambda x: convincing(x, config))
    s = top["signals"]
    least = F.least(s["input_length"], s["candidate_length"])
    bar = F.when(least <= config.short_length, config.short_fuzzy_block).otherwise(config.fuzzy_block)
    typo = (
        (top["match_type"] == "HIGH_FUZZY") & (top["score"] >= bar) & (s["edit_distance"] == 1) & (s["input_tokens"] == s["candidate_tokens"]) & ~s["is_prefix_variant"]
        & (s["input_tokens"] != 0) & (least > config.short_length) & (least >= config.fuzzy_min_length)
    )
    review = top["match_type"].isin("COMPACT_EXACT", "RELATED_NAME") | evidence.isNotNull() | (top["score"] >= config.review)
    out = lambda d, c: F.struct(F.lit(d).alias("decision"), c.alias("confidence"))
    return (
        F.when(exact["score"] >= config.exact_block, out("BLOCK", exact["score"]))
        .when(compact["score"] >= config.compact_block, out("BLOCK", compact["score"]))
        .when(translit["score"] >= config.transliteration_block, out("BLOCK", translit["score"]))
        .when(alias.isNotNull(), out("BLOCK", alias["score"]))
        .when(top.isNull(), out("ALLOW", F.lit(1.0)))
        .when(F.coalesce(typo, F.lit(False)), out("BLOCK", top["score"]))
        .when(review, out("HUMAN_REVIEW", F.greatest(top["score"], F.coalesce(evidence["score"], F.lit(0.0)))))
        .otherwise(out("ALLOW", 1.0 - top["score"]))
    )
