"""The catalogue as entries and one long table of postings (channel, key, entry_ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions import sound, spelling
from onomast.functions.text import bigrams, comparable_latin, latin_skeleton, normalized, script
from onomast.sources.cache import cached_variants

#: Names that one brand may have: entry_ord is brand_ord * NAMES + the name's place.
NAMES = 1 << 12
SKELETON_LEAST = 3


def entries(brands: DataFrame, rules: str = "{}", across: bool = True, cache: str | None = None) -> DataFrame:
    """One row per distinct (code, normal form); the first occurrence wins.

    ``brands``: brand_ord, code, label and, if there are any, translations.  ``entry_ord`` follows the catalogue, label
    before translations.  With ``across`` entries carry romanizations and sound keys for comparison across scripts; romanizations of Hebrew names come from the folder ``cache`` if there is one.
    """
    names = F.array(F.col("label"))
    if "translations" in brands.columns:
        values = F.transform(F.coalesce("translations", F.array().cast(brands.schema["translations"].dataType)), lambda t: t["value"])
        names = F.concat(names, values)
    named = brands.select("brand_ord", "code", "label", F.posexplode(names).alias("place", "name"))
    e = normalized(named, "name").where("normalized <> ''").withColumn("entry_ord", F.col("brand_ord") * NAMES + F.col("place"))
    e = e.groupBy("code", "normalized").agg(F.min_by(F.struct("label", "name", "compact"), "entry_ord").alias("x"), F.min("entry_ord").alias("entry_ord"))
    e = e.select("entry_ord", "code", "x.label", "x.name", "normalized", "x.compact").withColumn("script", script(F.col("name")))
    if not across:
        return e
    made = lambda d: spelling.with_variants(d, "name", rules, spelling.INDEX_BUDGET, spelling.INDEX_MAX_COST)
    if cache is None:
        return sound.with_keys(made(e), "normalized")
    known = cached_variants(e, rules, cache)
    e = made(e.join(known, "name", "left_anti")).unionByName(e.join(known, "name"))
    return sound.with_keys(e, "normalized")


def _key(channel: str, key: Column) -> Column:
    return F.array(F.struct(F.lit(channel).alias("channel"), key.alias("key")))


def _keys(channel: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key")))


def postings(e: DataFrame) -> DataFrame:
    """All channels of :func:`entries` in one table; a posting is unique, so nothing is shuffled to make it so.

    Channels: norm, compact, prefix2, first1, bigram; with romanizations tr_exact, tr_prefix2, tr_bigram, tr_skel; with
    sounds ph_key and ph_del.
    """
    c = F.col("compact")
    parts = [_key("norm", F.col("normalized")), _key("compact", c), _key("prefix2", c.substr(1, 2)), _key("first1", c.substr(1, 1)), _keys("bigram", bigrams(c, True))]
    if "variants" in e.columns:
        e = e.withColumn("latin", F.filter(F.array_distinct(F.transform("variants", lambda v: comparable_latin(v["value"]))), lambda x: x != ""))
        latin = F.col("latin")
        skeletons = F.filter(F.array_distinct(F.transform(latin, latin_skeleton)), lambda s: F.length(s) >= SKELETON_LEAST)
        parts += [_keys("tr_exact", latin), _keys("tr_prefix2", F.array_distinct(F.transform(latin, lambda x: x.substr(1, 2))))]
        parts += [_keys("tr_bigram", F.array_distinct(F.flatten(F.transform(latin, lambda x: bigrams(x, True))))), _keys("tr_skel", skeletons)]
    if "sound_keys" in e.columns:
        parts += [_keys("ph_key", F.col("sound_keys")), _keys("ph_del", F.col("sound_deletions"))]
    return e.select("entry_ord", F.inline(F.concat(*parts))).where("key <> ''").select("channel", "key", "entry_ord")


def find(posted: DataFrame, channel: str, key: str) -> DataFrame:
    """The entries filed under a key."""
    return posted.where((F.col("channel") == channel) & (F.col("key") == key)).select("entry_ord")
