"""Mixing sources to target weights (operator 2), by DataFrame functions alone.

A time-varying curriculum: every source has a weight schedule over the training time 0..1.  The integral of
the schedule, scaled to the source's target, is its cumulative token demand; the inverse of that function at
a document's place in its source is the document's training position, and the mixture is range-sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.base import WORD, prepare, staged

#: Weights of the sources in code-point order, null last, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight in each quarter of the training time, for each of WEIGHTS; each row's mean is 1.
SCHEDULES = ((1.25, 1.25, 0.75, 0.75), (1.0, 1.0, 1.0, 1.0), (0.5, 0.75, 1.25, 1.5))
SHARE, CAP = 1.5, 2.0
#: Rows that meet in one task's running sum, on average.
BUCKET_ROWS = 48


def _key(c: str = "doc_id") -> Column:
    return F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> + target and class; one row per source, so windows here are small.

    Targets share ``share`` times all sizes by weight; a target stops at ``cap`` times its source's size and the
    excess goes to the others by weight until none is above.  That is one level L with target = min(cap*size, L*weight),
    found by sorting sources by cap*size/weight: exact, without rounds.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("cls", ((F.row_number().over(w) - 1) % len(weights)).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("cls") + 1))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    every = Window.partitionBy()
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("capped", F.col("most") * F.col("rest") <= F.col("left") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("left") / F.col("rest"))).over(every)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", level * F.col("weight"))))
    return s.select("source", "source_size", "target", "cls")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null text: 0) and the hash by which documents queue."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _key().alias("queue"))


def running(sizes: DataFrame) -> DataFrame:
    """Adds ``before``: the words that precede a document in its source's queue, and source_size.

    Three levels, by prefixes of the queue hash: rows in a bucket, buckets in a coarse bucket, coarse buckets in a
    source.  So a source that holds a third of all rows is summed by many tasks, and no window outgrows the square
    root of the rows.  Rows that agree in doc_id (or have none), source and size are one row of the sums and follow
    each other in the queue, so many rows of one doc_id meet as no more rows than they have sizes.
    """
    sizes = sizes.groupBy("doc_id", "source", "size", "queue").agg(F.count("*").alias("copies")).withColumn("each", F.col("size")).withColumn("size", F.col("size") * F.col("copies"))
    sizes = staged(sizes, "queues")
    n = max(1, sizes.count() // BUCKET_ROWS)
    digits = max(1, (n.bit_length() + 3) // 4)
    half = (digits + 1) // 2
    coarse, fine = F.substring("queue", 1, half), F.substring("queue", 1, digits)
    s = sizes.withColumn("coarse", coarse).withColumn("fine", fine)
    f = s.groupBy("source", "coarse", "fine").agg(F.sum("size").alias("words"))
    f = f.withColumn("fine_before", F.sum("words").over(Window.partitionBy("source", "coarse").orderBy("fine")) - F.col("words"))
    f = staged(f, "fine")
    c = f.groupBy("source", "coarse").agg(F.sum("words").alias("coarse_words"))
    by = Window.partitionBy("source")
    c = c.withColumn("source_size", F.sum("coarse_words").over(by))
    c = c.withColumn("coarse_before", F.sum("coarse_words").over(by.orderBy("coarse")) - F.col("coarse_words"))
    f = f.join(c.withColumnRenamed("source", "c_source").withColumnRenamed("coarse", "c_coarse"), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("coarse") == F.col("c_coarse")))
    f = f.select(F.col("source").alias("f_source"), F.col("fine").alias("f_fine"), (F.col("fine_before") + F.col("coarse_before")).alias("bucket_before"), "source_size")
    s = s.join(f, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("fine") == F.col("f_fine")))
    in_bucket = Window.partitionBy("f_source", "f_fine").orderBy("queue", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    s = s.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("size", F.col("each")).withColumn("before", F.col("before") + F.col("copy") * F.col("each"))
    return s.drop("coarse", "fine", "f_source", "f_fine", "bucket_before", "copies", "copy", "each")


def _position(place: Column, target: Column, cls: Column, schedules) -> Column:
    """The training time at which a source's cumulative demand reaches ``place``: the inverse of a piecewise linear integral."""
    out = F.lit(None).cast("double")
    for k, parts in enumerate(schedules):
        total, reached, steps = float(sum(parts)), 0.0, F.lit(1.0)
        for i, x in reversed(list(enumerate(parts))):
            reached = sum(parts[:i]) / total
            share = x / total
            inside = F.lit(i / len(parts)) + (place / target - F.lit(reached)) / F.lit(share) / F.lit(float(len(parts))) if share else F.lit(i / len(parts))
            steps = F.when(place < target * F.lit(reached + share), inside).otherwise(steps)
        out = F.when(cls == k, steps).otherwise(out)
    return F.when(target > 0, out)


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, first_position, last_position.

    A source's queue is walked, again from the start while its target lasts (twice at most with cap 2); the
    document on which the target ends is taken in part, so taken words sum to the target, rounded.  ``taken`` counts
    repeats.  Positions are null for documents that the mix leaves out.  Null sources are one source; documents of
    no words take nothing.  Repeated rows queue one after another.  Rows come range-sorted by first position.
    """
    if len(weights) != len(schedules) or cap > 2:
        raise ValueError("a schedule for each weight, and a cap of 2 at most")
    prepare(docs.sparkSession)
    sizes = staged(sizes_of(docs), "sizes")
    queued = running(sizes)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source; AQE broadcasts it when it is small and splits a hot source when it is not
    targets = source_targets(totals, weights, share, cap).select(F.col("source").alias("t_source"), "target", "cls")
    d = queued.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    words, size, total = F.round("target").cast("long"), F.col("size"), F.col("source_size")
    once = F.greatest(F.least(words - F.col("before"), size), F.lit(0))
    twice = F.greatest(F.least(words - total - F.col("before"), size), F.lit(0))
    first = F.when(once > 0, _position(F.col("before").cast("double"), F.col("target"), F.col("cls"), schedules))
    last = F.when(twice > 0, _position((F.col("before") + total).cast("double"), F.col("target"), F.col("cls"), schedules)).otherwise(first)
    out = d.select("doc_id", "size", "source", "source_size", F.round("target", 6).alias("target"), (once + twice).cast("long").alias("taken"), F.round(first, 9).alias("first_position"), F.round(last, 9).alias("last_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixture as documents: a row for each time a document is taken, cut where it is taken in part.

    Documents that are not taken go; columns stay.  Null doc_ids are equal here.  Rows that agree in doc_id, source and
    size share the takes that ``mixed`` lists for them, the earliest going to the rows of the least digest.  Rows come
    range-sorted by the position of their take: a document's first at first_position, its second at last_position.
    """
    same = ["doc_id", "source", "_size"]
    take = F.struct("first_position", (-F.col("taken")).alias("less"), "last_position")
    takes = mixed.where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words")).agg(F.array_sort(F.collect_list(take)).alias("_takes"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("_size", size).where("_size > 0").withColumn("_row", F.sha2(F.to_json(F.struct(*docs.columns)).cast("binary"), 256))
    # only digests are grouped and numbered; a text moves once, whatever the number of its copies
    lean = rows.groupBy(*same, "_row").agg(F.count("*").cast("int").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*same).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    lean = lean.withColumn("_before", F.coalesce(before, F.lit(0)).cast("int"))
    lean = lean.join(takes, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words")))
    lean = lean.select("_row", "_size", F.explode(F.slice("_takes", F.col("_before") + 1, F.col("_n"))).alias("_take")).withColumn("_taken", -F.col("_take.less"))
    parts = F.expr("transform(sequence(1, cast(ceil(_taken / _size) as int)), k -> struct(least(_size, _taken - (k - 1) * _size) as part, if(k = 1, _take.first_position, _take.last_position) as at))")
    lean = lean.select("_row", "_size", F.explode(parts).alias("_p")).select("_row", "_size", F.col("_p.part").alias("_part"), F.col("_p.at").alias("_at"))
    d = rows.drop("_size").dropDuplicates(["_row"]).join(lean, "_row")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    text = F.when(F.col("_part") == F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("_part").cast("int")), " "))
    return d.orderBy("_at", "_row").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
