"""Embedding near-duplicates by spherical-cap filters (operator 5).

Filter directions are the products of two random codebooks, one for each half of a randomly rotated vector, so a
vector's inner product with a direction is the sum of two block scores.  List decoding finds all directions whose
score exceeds a bound without scoring each: block scores are sorted, and a first half is dropped when even the best
second half cannot reach the bound.  Vectors of one label that share a direction meet, and each pair is verified by
its cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.base import components, groups, join_values, prepare, staged, tasks

#: Directions that a vector exceeds, on average.  Of these a pair at cosine 0.98 shares about three in four, and it
#: is missed when it shares none: exp(-12) or so.
PER_VECTOR = 24
#: Vectors of a label that exceed a direction, on average; the codebooks grow with the data to hold this.
PER_FILTER = 16
BLOCK = 512


class CapFilters:
    """The directions for vectors of ``dim`` components when a label has ``rows`` of them."""

    def __init__(self, dim: int, rows: int, per_vector: float = PER_VECTOR, per_filter: float = PER_FILTER, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = max(16, math.ceil(math.sqrt(max(1, rows) * per_vector / per_filter)))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half = dim // 2
        self.left, self.right = rng.standard_normal((size, self.half)), rng.standard_normal((size, dim - self.half))
        # codewords lie on spheres, so a direction is a unit vector times sqrt(dim)
        self.left *= (math.sqrt(self.half) / np.linalg.norm(self.left, axis=1))[:, None]
        self.right *= (math.sqrt(dim - self.half) / np.linalg.norm(self.right, axis=1))[:, None]
        self.size = size
        self.least = NormalDist().inv_cdf(1 - min(0.5, per_vector / size**2))

    def decode(self, unit: np.ndarray, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions that the rows of ``unit`` exceed.

        A row that exceeds fewer than half of the mean is decoded again at a lower bound, as its near ones will be.
        """
        least = self.least if least is None else least
        if not len(unit):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        x = unit @ self.rotation
        a, b = x[:, : self.half] @ self.left.T, x[:, self.half :] @ self.right.T
        order = np.argsort(-b, axis=1)
        b = np.take_along_axis(b, order, axis=1)
        row, first = np.nonzero(a + b[:, :1] >= least)
        need = least - a[row, first]
        ends = np.array([np.searchsorted(-b[r], -n, side="right") for r, n in zip(row, need, strict=True)], dtype=np.int64)
        row, first = np.repeat(row, ends), np.repeat(first, ends)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(ends) - ends, ends)
        direction = first * self.size + order[row, rank]
        few = np.flatnonzero(np.bincount(row, minlength=len(unit)) < PER_VECTOR * 0.6)
        if len(few) and least > -3:
            more_row, more = self.decode(unit[few], least - 0.2)
            keep = ~np.isin(row, few)
            row, direction = np.concatenate([row[keep], few[more_row]]), np.concatenate([direction[keep], more])
        return row, direction


def links(vectors: DataFrame, threshold: float, per_vector: float = PER_VECTOR, per_filter: float = PER_FILTER) -> DataFrame:
    """Pairs (a, b), a < b, of classes of one label at cosine >= threshold.  ``vectors``: label, rep, unit (array<double>), dim."""
    shape = vectors.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    sizes = {r["dim"]: r["rows"] for r in shape.groupBy("dim").agg(F.max("rows").alias("rows")).collect()}  # a few dimensions

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CapFilters] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = pc.list_flatten(part.column("unit")).to_numpy().reshape(-1, dim)
                if int(dim) not in made:
                    made[int(dim)] = CapFilters(int(dim), sizes[int(dim)], per_vector, per_filter)
                filters = made[int(dim)]
                for at in range(0, len(unit), 256):
                    row, direction = filters.decode(unit[at : at + 256])
                    yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(row + at)) for k in ("label", "dim", "rep", "unit")] + [pa.array(direction)], names=["label", "dim", "rep", "unit", "filter"])

    hits = staged(vectors.select("label", "dim", "rep", "unit").mapInArrow(decode, "label int, dim int, rep long, unit array<double>, filter long"), "hits")
    hits = hits.withColumn("key", F.xxhash64("label", "dim", "filter"))
    counts = staged(hits.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("size")).where("n > 1"), "counts")
    hits = join_values(hits, counts, "key", "n")
    # a large bucket is cut into blocks, and pairs of blocks are compared: a group is two blocks at most
    k = F.ceil(F.col("size") / BLOCK).cast("int")
    hits = hits.withColumn("block", F.pmod(F.xxhash64("rep"), k).cast("int")).withColumn("other", F.explode(F.expr(f"sequence(0, cast(ceil(size / {BLOCK}) as int) - 1)")))
    hits = hits.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    n = tasks(hits.sparkSession, counts.agg(F.sum("n")).first()[0] or 0, 100_000)
    keys = ["label", "dim", "filter", "x", "y"]
    hits = hits.select(*keys, "block", "rep", "unit").repartition(n, *keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys):
            if t.num_rows < 2:
                continue
            rep = t["rep"].to_numpy()
            unit = pc.list_flatten(t["unit"]).to_numpy().reshape(len(rep), -1)
            left = pc.equal(t["block"], t["x"]).to_numpy()
            right = pc.equal(t["block"], t["y"]).to_numpy()
            cos = unit[left] @ unit[right].T
            i, j = np.nonzero(cos >= threshold)
            a, b = rep[left][i], rep[right][j]
            keep = a != b
            if keep.any():
                lo, hi = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
                both = np.unique(np.stack([lo, hi], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return hits.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for (vec_id, embedding, label).

    Vectors are compared within a label that is not null.  Null, empty and zero vectors, and those with a null or
    non-finite component, link with nothing, as do rows with a null vec_id.  Equal vectors are one class: its members
    are all linked and counted, never paired.  Vectors of different lengths are not compared.  Repeated vec_ids are
    separate vectors with one id; the component is by id.
    """
    prepare(rows.sparkSession)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for v in batch.column(1).to_pylist():
                x = None if not v or any(c is None for c in v) else np.asarray(v, dtype=np.float64)
                if x is not None and np.isfinite(x).all() and (most := np.abs(x).max()) > 0:
                    x = x / most  # no overflow
                    out.append(x / np.linalg.norm(x))
                    dims.append(len(x))
                else:
                    out.append(None)
                    dims.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.float64())), pa.array(dims, pa.int32())], names=["vec_id", "label", "unit", "dim"])

    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    v = v.mapInArrow(unit, "vec_id long, label int, unit array<double>, dim int")
    usable = "unit is not null and label is not null and vec_id is not null"
    v = v.withColumn("cls", F.when(F.expr(usable), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("unit").cast("array<string>")), 256)))
    v = staged(v, "vectors")
    classes = v.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("unit").alias("unit"), F.first("dim").alias("dim"), F.count("*").alias("n"))
    classes = staged(classes, "classes")
    pairs = staged(links(classes, threshold), "links")
    comp = staged(components(pairs), "components")
    size = classes.select("rep", "n")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("o")).union(pairs.select("b", "a"))
    far = both.join(size.select(F.col("rep").alias("o"), F.col("n").alias("m")), "o").groupBy("rep").agg(F.sum("m").alias("m"))
    known = classes.select("cls", "rep", "n").join(far, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = staged(known.select("cls", "n", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    linked = join_values(v.where("cls is not null").select("vec_id", "cls"), known, "cls", "n").drop("cls")
    alone = v.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
