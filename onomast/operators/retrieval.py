"""Lookups against postings: a sum of the weights of shared keys, and a cut to the best of each name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions.text import bigrams, comparable_latin, compacted, cross_script, latin_skeleton
from onomast.operators import pooling

#: Spellings of a name that take part in the bigram sweep of the native channels, and their greatest length.
SWEPT, SWEPT_LENGTH = 8, 10
#: Lookups of the names, and postings of the entries, that meet in one call of the pool's kernel, about.
CHUNK_LOOKUPS, BLOCK_POSTINGS = 40_000, 2_000_000
LOOKUP = "struct<channel:string,key:string,weight:int>"


def _one(channel: str, key: Column, weight: int) -> Column:
    return F.array(F.struct(F.lit(channel).alias("channel"), key.alias("key"), F.lit(weight).alias("weight")))


def _each(channel: str, keys: Column, weight: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key"), F.lit(weight).alias("weight")))


def _native(normal: Column, compact: Column, sweep: Column | None = None) -> Column:
    exact = F.concat(_one("norm", normal, 1000), _one("compact", compact, 900))
    swept = F.concat(_one("prefix2", compact.substr(1, 2), 5), _each("bigram", bigrams(compact, False), 1))
    return F.concat(exact, swept) if sweep is None else F.when(sweep, F.concat(exact, swept)).otherwise(exact)


def _lookups(q: DataFrame, made: Column) -> DataFrame:
    return q.select("query_id", F.posexplode(made).alias("lookup_seq", "l")).select("query_id", "lookup_seq", "l.channel", "l.key", "l.weight").where("key <> ''")


def same_script_lookups(q: DataFrame) -> DataFrame:
    """Lookups of names (query_id, normalized, compact), in the order in which they are issued."""
    c = F.col("compact")
    made = F.concat(
        _one("norm", F.col("normalized"), 1000), _one("compact", c, 900), _one("prefix2", c.substr(1, 2), 5), _one("first1", c.substr(1, 1), 2), _each("bigram", bigrams(c, False), 1)
    )
    return _lookups(q.where("normalized <> ''"), made)


def cross_script_lookups(q: DataFrame) -> DataFrame:
    """Lookups of romanizations (``variants``) and Hebrew spellings (``hebrew``), spelling by spelling.

    Weights add for each spelling, so a posting that many reach counts many times.
    """

    def latin(v: Column) -> Column:
        k = comparable_latin(v["value"])
        skeleton = latin_skeleton(k)
        skeleton = F.when(F.length(skeleton) >= 3, skeleton).otherwise("")
        got = F.concat(_one("tr_exact", k, 1000), _one("tr_skel", skeleton, 800), _one("tr_prefix2", k.substr(1, 2), 5), _each("tr_bigram", bigrams(k, False), 1))
        return F.when(k == "", F.array().cast(f"array<{LOOKUP}>")).otherwise(got)

    def hebrew(v: Column, i: Column) -> Column:
        c = compacted(v["value"])
        return _native(v["value"], c, (i < SWEPT) & (F.length(c) <= SWEPT_LENGTH))

    made = F.flatten(F.transform("variants", latin))
    if "hebrew" in q.columns:
        made = F.concat(made, F.flatten(F.transform("hebrew", hebrew)))
    return _lookups(q, made)


def pool(lookups: DataFrame, posted: DataFrame, size: int = 100) -> DataFrame:
    """The ``size`` entries of each name with the greatest weight: query_id, entry_ord, retrieval_score, pool_rank.

    Ties go to the entry that was met first, in the order of lookups and then of the catalogue.  Equal lookups of a
    name are summed first.  Names, in chunks, meet the catalogue, in blocks, inside :func:`pooling.pooled`; the best of
    each block are ranked together.  How many chunks and blocks there are follows from counts inside the plan.
    """
    key = F.concat_ws(":", "channel", "key").alias("key")
    one = lookups.groupBy("query_id", key).agg(F.sum("weight").alias("weight"), F.min("lookup_seq").cast("long").alias("lookup_seq"))
    asked = one.groupBy("query_id").agg(F.collect_list(F.struct("key", "weight", "lookup_seq")).alias("asked"))
    # sound has a pool of its own
    filed = posted.where(~F.col("channel").startswith("ph_")).groupBy("entry_ord").agg(F.collect_list(key).alias("keys"))
    parts = lambda d, lists, each, name: d.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size(lists)) / each)).cast("int").alias(name))
    counts = F.broadcast(parts(asked, "asked", CHUNK_LOOKUPS, "chunks").crossJoin(F.broadcast(parts(filed, "keys", BLOCK_POSTINGS, "blocks"))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = asked.crossJoin(counts).select("query_id", "asked", part("query_id", "chunks").alias("chunk"), every("blocks").alias("block"))
    right = filed.crossJoin(counts).select("entry_ord", "keys", part("entry_ord", "blocks").alias("block"), every("chunks").alias("chunk"))

    def run(names: pa.Table, entries: pa.Table) -> pa.Table:
        return pooling.pooled(names, entries, size)

    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((lookups, "query_id"), (posted, "entry_ord"))]
    # the work is in the kernel, not in the bytes: by number, so that few bytes are not put into few tasks
    spark = lookups.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left, right = (d.repartition(tasks, "chunk", "block").groupBy("chunk", "block") for d in (left, right))
    scored = left.cogroup(right).applyInArrow(run, ", ".join([*kinds, "retrieval_score long", "first long"]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("retrieval_score"), "first", "entry_ord"))
    return scored.withColumn("pool_rank", rank).where(F.col("pool_rank") <= size).drop("first")


def sound_pool(q: DataFrame, posted: DataFrame, e: DataFrame, pooled: DataFrame, size: int = 300) -> DataFrame:
    """Entries to compare by sound: query_id, entry_ord, sound_rank.

    ``q``: query_id, script, sound_keys, sound_deletions.  In order: equal keys, the name's keys against deletions, its
    deletions against keys, ``size`` at most of the other script; then every pooled entry of the other script.
    """

    def side(keys: str, channel: str, stage: int) -> DataFrame:
        looked = q.select("query_id", F.col("script").alias("q_script"), F.posexplode(keys).alias("k", "key"))
        return looked.join(posted.where(F.col("channel") == channel), "key").select("query_id", "q_script", "entry_ord", F.struct(F.lit(stage).alias("s"), F.col("k"), F.col("entry_ord").alias("e")).alias("at"))

    met = side("sound_keys", "ph_key", 0).union(side("sound_keys", "ph_del", 1)).union(side("sound_deletions", "ph_key", 2))
    scripts = e.select("entry_ord", F.col("script").alias("e_script"))
    met = met.groupBy("query_id", "q_script", "entry_ord").agg(F.min("at").alias("at")).join(scripts, "entry_ord").where(cross_script(F.col("q_script"), F.col("e_script")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    kept = met.withColumn("r", rank).where(F.col("r") <= size).select("query_id", "entry_ord", "r")
    both = kept.union(pooled.select("query_id", "entry_ord", (F.col("pool_rank") + size).alias("r")))
    return both.groupBy("query_id", "entry_ord").agg(F.min("r").alias("sound_rank"))
