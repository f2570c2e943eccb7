"""Document fingerprints (operator 10): a canonical exact digest.

The canonical form of a text is NFKC, case-folded, with runs of white space folded to one blank.  Documents are
grouped by its 128-bit xxhash, and inside equal buckets the canonical bytes are compared: a second text in a bucket
has its ordinal in its fingerprint.  The likeness of two such digests is 1 or 0.  Should very many unlike texts share
128 bits, all digests are widened by another seed.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.base import prepare, staged

#: Digests of repeated texts that are broadcast at most (about 50 MB).
MOST_DIGESTS = 500_000
#: Unlike texts in equal buckets that tasks are told of; with more, digests are widened, up to MOST_WIDTH times.
MOST_UNLIKE, MOST_WIDTH = 1000, 4


def canonical(text: str | None) -> str:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def _hash(canonical_text: str, width: int = 1, hasher: Callable[[bytes, int], str] = xxhash.xxh3_128_hexdigest) -> str:
    data = canonical_text.encode()
    return "".join([hasher(data, seed) for seed in range(width)])


def digest(text: str | None) -> str:
    return _hash(canonical(text))


def buckets(docs: DataFrame, width: int = 1, hasher: Callable[[bytes, int], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """Bytes compared inside equal buckets: (digest, canonical, ordinal) of the texts beyond a bucket's first.

    The result is empty unless two unlike texts share 128 bits.  Only texts of buckets with several rows are moved,
    and copies are merged before they are: Spark's grouping compares the bytes of equal keys.  Digests of repeated
    texts are broadcast up to MOST_DIGESTS, beyond which both sides are shuffled.  Up to that number workers know the
    checksums of those digests, so other texts do not leave them, and copies within a batch leave them once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_hash(canonical(t), width, hasher) for t in batch.column(0).to_pylist()], pa.string())], names=["digest"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [canonical(t) for t in batch.column(0).to_pylist()]
            h = [_hash(x, width, hasher) for x in c]
            maybe = range(len(h)) if sums is None else np.flatnonzero(np.isin([zlib.crc32(x.encode()) for x in h], sums))
            once = list(dict.fromkeys((h[i], c[i]) for i in maybe))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in once], pa.string()), pa.array([x for _, x in once], pa.string())], names=["digest", "canonical"])

    text = docs.select(F.col("text").cast("string").alias("text"))
    twice = staged(text.mapInArrow(run, "digest string").groupBy("digest").count().where("count > 1").select("digest"), "buckets")
    known = twice.count() <= MOST_DIGESTS
    few = F.broadcast(twice) if known else twice
    sums = twice.select(F.crc32("digest").alias("sum")).toArrow()["sum"].to_numpy() if known else None
    texts = text.mapInArrow(both, "digest string, canonical string").join(few, "digest", "left_semi").distinct()
    first = texts.withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("canonical")) - 1)
    return staged(first.where("ordinal > 0").select("digest", "canonical", "ordinal"), "collisions")


def fingerprints(docs: DataFrame, ranges: int | None = None, hasher: Callable[[bytes, int], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row per document.

    Texts are whole; null counts as empty.  A text is edited by the document next in descending doc_id (after the last
    the first; rows of one doc_id by text; null doc_ids last): its last floor(n/3) code points give way to as many of
    that document's first, or all it has.  One document is its own next.  Documents are dealt once, to ranges of
    doc_id; the bounds are doc_ids of the table, and a bound's document also goes to the range before it.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, known = d.agg(F.count("*"), F.count("doc_id")).first()
    if not n:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    for width in range(1, MOST_WIDTH + 1):
        unlike = {(r[0], r[1]): r[2] for r in buckets(docs, width, hasher).limit(MOST_UNLIKE + 1).collect()}  # none in practice
        if len(unlike) <= MOST_UNLIKE:
            break
    else:
        raise RuntimeError(f"over {MOST_UNLIKE} unlike texts share digests of {128 * MOST_WIDTH} bits")
    # ranges are streamed, so their number follows the shuffle partitions and not the rows
    k = max(1, min(n // 8, ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ids = d.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 10_000) if k > 1 else F.array(), F.max("doc_id")).first()
    # ascending bounds, each the greatest doc_id of its range; the last range of the descending order is number 0
    bounds = np.array(sorted({*(ids[0] or []), *([ids[1]] if ids[1] is not None else [])}), dtype=np.int64)
    last = len(bounds)  # ranges are numbered from 0, the greatest doc_ids; nulls have the last number
    end = last if n > known else last - 1  # the range whose last document is followed by the first of all

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idc = batch.column(0)
            null = idc.is_null().to_numpy(zero_copy_only=False)
            x = idc.fill_null(0).to_numpy()
            at = np.where(null, last, last - 1 - np.searchsorted(bounds, x, side="left"))
            head = np.flatnonzero(null | np.isin(x, bounds))  # may be the first of its range
            rows = np.concatenate([np.arange(len(x)), head])
            to = np.concatenate([at, np.where(at[head] > 0, at[head] - 1, end)])
            look = np.concatenate([np.zeros(len(x), bool), np.ones(len(head), bool)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(look), batch.column(0).take(take), batch.column(1).take(take)], names=["range", "look", "doc_id", "text"])

    def sign(c: str) -> str:
        out = _hash(c, width, hasher)
        extra = unlike.get((out, c)) if unlike else None
        return out if extra is None else f"{out}-{extra}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None  # the row that waits for its next
        for batch in batches:
            out = []
            for at, look, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = mark = None
                if not look or before is not None:
                    c = canonical(text)
                    mark = sign(c)
                if before is not None and before[0] == at:
                    _, own_id, own, own_c, own_mark = before
                    cut = len(own) // 3
                    edited = own[: len(own) - cut] + text[:cut]
                    edited_c = canonical(edited)
                    other, same = sign(edited_c), edited_c == own_c  # bytes are compared, whatever the digests say
                    if other == own_mark and not same:
                        other += "-edited"
                    out.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_mark, other, float(same), float(own_mark == mark)))
                before = None if look else (at, doc_id, text, c, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    # a range that holds no document of its own sends none; look rows follow the range's own rows, the first is the next
    dealt = d.mapInArrow(deal, "range int, look boolean, doc_id long, text string")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "look", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
