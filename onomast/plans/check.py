"""Screening a table of names against a catalogue, all names at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.config import DEFAULT, MatchConfig
from onomast.functions import sound, spelling
from onomast.functions.text import normalized, script
from onomast.operators import decide, index, retrieval, scoring


@dataclass(frozen=True)
class Catalogue:
    """A prepared catalogue: entries and postings, made once and used for many tables of names."""

    entries: DataFrame
    postings: DataFrame
    rules: str = "{}"
    across: bool = True

    @classmethod
    def of(cls, brands: DataFrame, rules: str = "{}", across: bool = True, keep: bool = False, cache: str | None = None) -> Catalogue:
        """From brands (brand_ord, code, label[, translations]); ``keep`` persists it for repeated use, ``cache`` is a folder of spellings."""
        e = index.entries(brands, rules, across, cache)
        e = e.persist() if keep else e
        p = index.postings(e)
        return cls(e, p.persist() if keep else p, rules, across)


def prepared(names: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Names (query_id, raw) with normal forms, script and, across scripts, spellings and sound keys."""
    q = normalized(names.select("query_id", F.coalesce("raw", F.lit("")).alias("raw")), "raw").withColumn("script", script(F.col("raw")))
    if not catalogue.across:
        return q
    q = spelling.with_variants(q, "raw", catalogue.rules)
    q = spelling.with_variants(q, "raw", catalogue.rules, hebrew=True, to="hebrew")
    return sound.with_keys(q, "normalized")


def same_script_candidates(q: DataFrame, catalogue: Catalogue, config: MatchConfig = DEFAULT) -> DataFrame:
    pooled = retrieval.pool(retrieval.same_script_lookups(q), catalogue.postings, config.pool)
    return decide.ranked(scoring.same_script(q, catalogue.entries, pooled))


def cross_script_candidates(q: DataFrame, catalogue: Catalogue, config: MatchConfig = DEFAULT) -> DataFrame:
    q = q.where("size(variants) + size(hebrew) > 0")
    pooled = retrieval.pool(retrieval.cross_script_lookups(q), catalogue.postings, config.pool)
    by_spelling = scoring.spelled(q, catalogue.entries, pooled, catalogue.rules, config)
    heard = retrieval.sound_pool(q, catalogue.postings, catalogue.entries, pooled, config.phonetic_pool)
    by_sound = scoring.sounded(q, catalogue.entries, heard, config)
    return decide.ranked(scoring.merged_evidence(by_spelling, by_sound))


def check(names: DataFrame, catalogue: Catalogue, config: MatchConfig = DEFAULT, aliases: DataFrame | None = None) -> DataFrame:
    """One row per name: query_id, input, normalized, decision, confidence, candidates, display_candidates.

    ``names``: query_id (unique), raw.  ``aliases``: the outcome of ``decide.aliases``.  Names that are empty in normal
    form are allowed.  Across scripts, names with their spellings and the candidates are persisted on first use, as
    several branches of the plan read them; :func:`release` frees them.
    """
    q = prepared(names, catalogue)
    held = []
    if catalogue.across:
        q = q.persist()
        groups = [same_script_candidates(q, catalogue, config), cross_script_candidates(q, catalogue, config).persist()]
        held = [q, groups[1]]
    else:
        groups = [same_script_candidates(q, catalogue, config)]
    if aliases is not None:
        groups.insert(0, decide.ranked(decide.alias_candidates(q, aliases)))
    short = decide.short_list(decide.united([g.where(F.col("rank") <= config.candidates) for g in groups]), config)
    out = q.select("query_id", F.col("raw").alias("input"), "normalized")
    out = out.join(decide.listed(short, "candidates"), "query_id", "left").join(decide.listed(decide.united(groups), "display_candidates"), "query_id", "left")
    empty = F.array().cast(out.schema["candidates"].dataType)
    out = out.withColumn("candidates", F.coalesce("candidates", empty)).withColumn("display_candidates", F.coalesce("display_candidates", empty))
    out = out.withColumn("_d", decide.decision(F.col("candidates"), config))
    out = out.select("query_id", "input", "normalized", F.col("_d.decision").alias("decision"), F.col("_d.confidence").alias("confidence"), "candidates", "display_candidates")
    out._held = held
    return out


def release(checked: DataFrame) -> None:
    """Frees what :func:`check` has persisted for its result."""
    for part in checked.__dict__.pop("_held", []):
        part.unpersist()
