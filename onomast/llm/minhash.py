"""MinHash near-duplicate detection with b-bit signatures (operator 3).

Each text's minima give band keys, from which candidates come, and their low four bits, packed into a short
signature from whose bit counts a collision-corrected similarity is estimated.  Links are confirmed on the
full shingle sets.  Equal texts are one class, so copies are never paired.  Within a bucket of a band a first pass
compares each class with a leader; a second pass compares only classes that
are still in different components, block by block, by the low bits of more minima.  So no link between components is
lost and the links inside a group are not listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.base import Forest, components, groups, join_values, prepare, staged, tasks, trim
from onomast.llm.word_cache import release

HASHES, BITS = 256, 4
#: Hashes and bits of the signatures that the second pass compares: few pairs short of the threshold pass their estimate.
FINE, FINE_BITS = 2048, 2
#: A pair at similarity 0.85 shares no band with a chance of 2e-6, one at 0.8 with 2e-4.
BANDS, BAND_ROWS = 28, 6
#: Standard deviations by which an estimate may fall short of the threshold before its pair is dropped.
SLACK = 4.5
#: Rows of a bucket that one leader is compared with, about, and rows of a block.
LEADER_ROWS, BLOCK = 128, 512
#: Ids (16 MB) and classes of copies (about 50 MB) that are broadcast at most.
MOST_IDS, MOST_CLASSES = 2_000_000, 500_000


def least_estimate(threshold: float, hashes: int = HASHES, bits: int = BITS) -> float:
    """The estimate under which a pair at ``threshold`` falls by SLACK standard deviations."""
    c = 2.0**-bits
    p = threshold + (1 - threshold) * c
    return threshold - SLACK * (p * (1 - p) / hashes) ** 0.5 / (1 - c)


@lru_cache(2)
def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607 + hashes)
    return rng.integers(0, 2**32, (hashes, 1), dtype=np.uint32), rng.integers(0, 2**32, (hashes, 1), dtype=np.uint32) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes; word hashes are kept in a bounded table."""

    def __init__(self, words: int):
        self.words, self._kept = words, {}

    @staticmethod
    def tokens(text: str | None) -> list[bytes]:
        """bytes.lower and bytes.split know ASCII letters and ASCII white space only, as is wanted."""
        return (text or "").encode().lower().split()

    def hashes(self, tokens: list[bytes]) -> np.ndarray:
        kept = self._kept
        if len(kept) > 250_000:
            kept.clear()
        got = list(map(kept.get, tokens))
        if None in got:
            for i, (t, h) in enumerate(zip(tokens, got, strict=True)):
                if h is None:
                    got[i] = kept[t] = xxhash.xxh3_64_intdigest(t)
        return np.array(got, dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The set; with fewer words than a shingle has, the whole sequence is the one shingle."""
        n = min(self.words, len(hashes))
        if not n:
            return hashes
        out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(out) + k] + np.uint64(n))
        return np.unique(out)

    def set(self, text: str | None) -> np.ndarray:
        return self.of(self.hashes(self.tokens(text)))


def minima(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The least value of each of ``hashes`` functions over a set."""
    flip, factor = _family(hashes)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(hashes, 2**32 - 1, dtype=np.uint32)
    step = max(32, 131_072 // hashes)
    for at in range(0, len(x), step):
        np.minimum(least, ((x[at : at + step] ^ flip) * factor).min(axis=1), out=least)
    return least


def pack_bits(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` (1, 2 or 4) bits of each minimum, packed into 64-bit integers."""
    low = (least & np.uint32(2**bits - 1)).astype(np.uint8)
    while bits < 8:
        low, bits = low[0::2] | (low[1::2] << bits), 2 * bits
    return low.view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Corrected similarity of signatures (rows of uint64): equal groups of bits by bit counts, less the chance ones."""
    x, shift = a ^ b, bits
    while shift > 1:
        shift //= 2
        x |= x >> np.uint64(shift)
    one_each = np.uint64((2**64 - 1) // (2**bits - 1))
    unequal = np.bitwise_count(x & one_each).sum(axis=-1, dtype=np.int64)
    c = 2.0**-bits
    return ((1 - unequal / (64 // bits * a.shape[-1])) - c) / (1 - c)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, cls (hash of the word sequence; null without words), sig, bands."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shingler = Shingler(words)
        for batch in batches:
            n, cls, sig, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingler.hashes(shingler.tokens(text))
                s = shingler.of(h)
                n.append(len(s))
                if not len(s):
                    cls.append(None), sig.append(None), bands.append(None)
                    continue
                cls.append(xxhash.xxh3_128_digest(h.tobytes()))
                least = minima(s)
                sig.append(pack_bits(least))
                rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
                bands.append([xxhash.xxh3_64_intdigest(r.tobytes(), k) - 2**63 for k, r in enumerate(rows)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "cls", "sig", "bands"])
        del shingler
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, cls binary, sig array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, most: int | None = None) -> DataFrame:
    """(rep, set) of the documents named in ``ids`` (column rep), the set as sorted little-endian 64-bit hashes.

    Up to MOST_IDS ids are broadcast, so only the named texts are moved; beyond that the two sides are shuffled.
    ``most`` is a bound of their number, if one is known.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    ids = F.broadcast(ids) if (ids.count() if most is None else most) <= MOST_IDS else ids

    return _of_sets(texts.join(ids, "rep", "left_semi"), words, "set binary", lambda x: x.tobytes())


def _of_sets(texts: DataFrame, words: int, column: str, of: Callable[[np.ndarray], object]) -> DataFrame:
    """rep and what ``of`` makes of the shingle set, in one pass of one Python worker a task."""
    name, _, kind = column.partition(" ")
    arrow = pa.binary() if kind == "binary" else pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            made = [of(shingler.set(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, arrow)], names=["rep", name])
        del shingler
        trim()

    return texts.mapInArrow(run, f"rep long, {column}")


def fine_signatures(docs: DataFrame, ids: DataFrame, words: int, most: int) -> DataFrame:
    """(rep, sig) of the documents named in ``ids`` (``most`` at most), of FINE hashes; see :func:`shingle_sets`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if most <= MOST_IDS else ids, "rep", "left_semi")
    return _of_sets(texts, words, "sig array<long>", lambda x: pack_bits(minima(x, FINE), FINE_BITS))


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A spanning forest, task by task, of the pairs (a, b; a staged table) whose full sets reach the threshold.

    The sets of ``a`` are moved once for each pair, those of ``b`` once: put the id that stands in fewer pairs first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            a, b, x, y = batch.columns
            ids, good = list(zip(a.to_pylist(), b.to_pylist(), strict=True)), []
            for i, (s, t) in enumerate(zip(x, y, strict=True)):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)  # not copied
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both) and forest.joins(*ids[i]):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(good, pa.int64())), b.take(pa.array(good, pa.int64()))], names=["a", "b"])

    n = pairs.count()
    first = shingle_sets(docs, pairs.select(F.col("a").alias("rep")).distinct(), words, n)
    near = F.broadcast(pairs) if n <= MOST_IDS else pairs
    first = first.withColumnRenamed("set", "x").join(near, F.col("rep") == F.col("a")).select("a", "b", "x")
    second = shingle_sets(docs, pairs.select(F.col("b").alias("rep")).distinct(), words, n)
    return first.join(second.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similarity(a: str, b: str) -> Column:
    """The estimate of :func:`estimates` as a Column over two signature columns."""
    c = 2.0**-BITS
    fold = "x | shiftrightunsigned(x, 2)", "x | shiftrightunsigned(x, 1)"
    unequal = F.expr(f"aggregate(transform(transform(transform(zip_with({a}, {b}, (p, q) -> p ^ q), x -> {fold[0]}), x -> {fold[1]}), x -> bit_count(x & 1229782938247303441L)), 0, (s, x) -> s + x)")
    return ((1 - unequal / HASHES) - F.lit(c)) / F.lit(1 - c)


def _blocks(members: DataFrame) -> DataFrame:
    """Adds ``block``: rows of a bucket (band) in blocks of about BLOCK; a large component has blocks of its own."""
    m = members.withColumn("bc", F.xxhash64("band", "comp"))
    counts = staged(m.groupBy("bc").agg(F.count("*").alias("n"), F.count("*").alias("in_comp")), "counts")
    m = join_values(m, counts, "bc", "n")
    own = F.concat_ws(".", F.hex("comp"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("in_comp") / BLOCK)).cast("string"))
    rest = F.pmod(F.xxhash64("comp"), F.ceil(F.col("size") / BLOCK)).cast("string")
    return m.withColumn("block", F.when(F.col("in_comp") >= BLOCK // 2, own).otherwise(rest)).drop("bc", "in_comp")


def cross_pairs(members: DataFrame, fine: DataFrame, least: float) -> DataFrame:
    """Pairs of a bucket whose classes are in different components and whose estimate reaches ``least``.

    ``members``: band, size, rep, comp; ``fine``: rep, sig, bands.  Two blocks of a bucket meet in one group unless one
    component fills both; a group is two blocks, whatever the size of its bucket.  A pair that meets in several
    buckets is reported by that of its first common band.
    """
    rows = staged(_blocks(members), "blocks")
    blocks = staged(rows.groupBy("band", "block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")), "blocks")
    x = blocks.select("band", F.col("block").alias("x"), F.col("c0").alias("x0"), F.col("c1").alias("x1"))
    y = blocks.select("band", F.col("block").alias("y"), F.col("c0").alias("y0"), F.col("c1").alias("y1"))
    meet = staged(x.join(y, "band").where("x <= y and not (x0 = x1 and y0 = y1 and x0 = y0)").select("band", "x", "y"), "meet")
    who = meet.select("band", F.col("x").alias("block"), "x", "y").union(meet.where("x <> y").select("band", F.col("y").alias("block"), "x", "y"))
    # groups are small, so many are handed to Python together: sorted, and cut where the group changes
    rows = rows.join(who, ["band", "block"]).join(fine, "rep").select("band", "x", "y", "block", "rep", "comp", "sig", "bands")
    n = tasks(rows.sparkSession, meet.count(), 2000)
    dealt = rows.repartition(n, "band", "x", "y").sortWithinPartitions("band", "x", "y")

    def pairs(t: pa.Table) -> tuple[list, list]:
        rep, comp = t["rep"].to_numpy(), t["comp"].to_numpy()
        sig = pc.list_flatten(t["sig"]).to_numpy().view(np.uint64).reshape(len(rep), -1)
        bands, band = pc.list_flatten(t["bands"]).to_numpy().reshape(len(rep), -1), t["band"][0].as_py()
        left = pc.equal(t["block"], t["x"]).to_numpy()
        r = np.flatnonzero(pc.equal(t["block"], t["y"]).to_numpy())
        out_a, out_b = [], []
        for i in np.flatnonzero(left):
            j = r[comp[r] != comp[i]]
            if len(j) and len(j := j[estimates(sig[j], sig[i], FINE_BITS) >= least]):
                j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == band]
                out_a.append(np.minimum(rep[j], rep[i]))
                out_b.append(np.maximum(rep[j], rep[i]))
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["band", "x", "y"]):
            a, b = pairs(t)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space, A-Z lower-cased.  Two documents are linked when
    100 * |intersection| >= percent * |union| of their distinct ``words``-word shingles.  component_id is the smallest
    doc_id that links reach, itself included.  Null and empty texts have no shingles and link with nothing; rows with
    a null doc_id are reported, link with nothing and have a null component.  Rows that share a doc_id are one node,
    which is linked by any of its texts.
    """
    if percent < 80:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    least = least_estimate(percent / 100)
    # each class of equal texts is its first row, so only the classes that have copies are looked up
    sig = staged(signatures(docs, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    usable = "cls is not null and doc_id is not null"
    classes = sig.where(usable).groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("m"), F.count("*").alias("n"))
    classes = staged(classes.select("cls", F.col("m.doc_id").alias("rep"), F.col("m.row").alias("first"), "n"), "classes")
    copied = classes.where("n > 1").select("cls", "first", "n")
    rows = sig.where(usable).select("cls", F.col("doc_id").alias("rep"), "row", "sig", "bands")
    rows = rows.join(F.broadcast(copied.drop("n")), "cls", "left") if copied.count() <= MOST_CLASSES else join_values(rows, copied, "cls", "n", "left")
    rows = rows.where("first is null or first = row")
    members = rows.select("rep", F.explode("bands").alias("band"))
    counts = staged(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "counts")
    shared = join_values(members, counts, "band", "n").withColumn("salt", F.pmod(F.xxhash64("rep", "band"), F.ceil(F.col("size") / LEADER_ROWS)))
    # first pass: everyone with the leader of its salt (about LEADER_ROWS rows), leaders with the leader of the bucket
    leader = F.min(F.struct(F.xxhash64("band", "rep").alias("o"), F.col("rep").alias("leader"))).over(Window.partitionBy("band", "salt"))
    shared = staged(shared.withColumn("lead", leader).select("band", "rep", "size", "lead.o", "lead.leader"), "shared")
    lead = shared.where(f"rep = leader and size > {LEADER_ROWS}").select("band", "o", "rep")
    top = lead.groupBy("band").agg(F.min(F.struct("o", "rep")).alias("l")).select("band", F.col("l.rep").alias("leader"))
    star = shared.select("rep", "leader").union(lead.join(top, "band").select("rep", "leader")).where("rep <> leader").distinct()
    star = staged(star, "star")
    ids = staged(star.select("rep").union(star.select("leader")).distinct(), "ids")
    short = rows.select("rep", "sig").join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "rep", "left_semi")
    star = star.join(short.withColumnRenamed("sig", "sa"), "rep").join(short.select(F.col("rep").alias("leader"), F.col("sig").alias("sb")), "leader")
    star = staged(star.where(similarity("sa", "sb") >= least).select(F.col("rep").alias("a"), F.col("leader").alias("b")), "star")
    first = staged(confirm(star, docs, words, percent), "links")
    comp = staged(components(first), "components")
    # second pass: buckets in which components still differ
    at = shared.select("band", "rep", "size").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    at = staged(at, "at")
    mixed = staged(at.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 < c1").select("band", "n"), "mixed")
    at = staged(join_values(at, mixed, "band", "n"), "mixed")
    ids = staged(at.select("rep").distinct(), "ids")
    n = ids.count()
    keys = rows.select("rep", "bands").join(F.broadcast(ids) if n <= MOST_IDS else ids, "rep", "left_semi")
    fine = staged(fine_signatures(docs, ids, words, n).join(keys, "rep"), "fine")
    pairs = cross_pairs(at, fine, least_estimate(percent / 100, FINE, FINE_BITS))
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = staged(confirm(staged(pairs.join(done, ["a", "b"], "left_anti"), "pairs"), docs, words, percent), "links")
    if not second.isEmpty():
        comp = staged(components(first.union(second)), "components")
    small = staged(classes.select("cls", F.col("rep").alias("node"), "n").join(comp, "node", "left").select("cls", "n", F.coalesce("component", "node").alias("component_id")), "small")
    linked = join_values(sig.where(usable).select("doc_id", "n_shingles", "cls"), small, "cls", "n").drop("cls")
    alone = sig.where(f"not ({usable})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
