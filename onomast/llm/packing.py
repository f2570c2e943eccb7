"""Best-fit packing of token sequences (operator 1).

Bounded-space online best fit: a fixed number of open bins, found through a bitset keyed by free space;
when no place is left for a new bin, the fullest open bin closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.base import prepare, staged
from onomast.llm.word_cache import encoder

CAPACITY = 2048
#: Open bins of a task.
OPEN_BINS = 4096
#: Pieces that a task packs at least; the loss at a task's end (its half-filled last bins) falls as this grows.
PIECES_PER_TASK = 40_000
#: Tasks at most, as a multiple of the shuffle partitions: a task streams, so beyond that tasks take more pieces each.
MOST_TASKS = 4


class BestFit:
    """Packs a stream of lengths; ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self._free = 0  # bit f is set while an open bin has f free places
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._open = self._made = 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece has 1 to {self.capacity} ids, not {length}")
        above = self._free >> length
        if above:
            free = length + (above & -above).bit_length() - 1  # the fullest bin that has room
            number = self._take(free)
        else:
            if self._open >= self.open_bins:
                self._take((self._free & -self._free).bit_length() - 1)  # the fullest closes
            number, free = self._made, self.capacity
            self._made += 1
        left = free - length
        if left:
            self._bins[left].append(number)
            self._free |= 1 << left
            self._open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self._bins[free].pop()
        if not self._bins[free]:
            self._free &= ~(1 << free)
        self._open -= 1
        return number


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cuts documents (doc_id, text) into pieces of at most ``capacity`` ids; an end id closes each document.

    Null and empty texts are the end id alone.  Only longer documents are cut; repeated rows are packed each.
    Gives doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids (binary, uint32).
    """
    prepare(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), code.raw(batch.column(1).to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, length; others pass through).

    Full pieces are sequences of their own.  The others are dealt by a hash that mixes all sizes into every
    task, put into a fixed order (so a repeated task gives the same sequences) and packed as a stream.  The hash takes
    all columns and a number of the row, so that many rows of one doc_id, or none, and repeated rows are spread.
    ``parts`` is read twice (a count, the packing), so stage it.  Empty input gives an empty result.
    """
    most = MOST_TASKS * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(most, -(-parts.where(F.col("length") < capacity).count() // per_task)))
    order = F.xxhash64(*parts.columns, F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    full = parts.where(F.col("length") == capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    keyed = parts.where(F.col("length") < capacity).withColumn("_order", order)
    # dealt by value, not by turn: a task that runs again gets the same rows
    dealt = keyed.repartition(n, "_order").sortWithinPartitions("_order", *parts.columns)
    schema = dealt.drop("_order").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for frame in frames:
            got = [bins.place(x) for x in frame["length"].tolist()]
            yield frame.drop(columns="_order").assign(sequence_id=[base + x for x, _ in got], offset=[x for _, x in got])

    return dealt.mapInPandas(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs documents: one row per piece with its place."""
    return pack(staged(pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves from pieces with ids: (sequence_id, ids binary); at most ``capacity`` ids each."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids")
    )
