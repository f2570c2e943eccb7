"""Binary token files (operator 7): flat unsigned ids, 64-bit document offsets, memory maps.

A folder holds for each part ``N.ids`` (flat ids, uint16 or uint32, little-endian), ``N.idx`` (uint64 offsets of its
documents within the part and, last, its length) and ``N.doc`` (int64 doc_ids; the least int64 is null), and
``manifest.json`` with the parts' bases, which are prefix sums of their lengths.  Parts are in ascending doc_id order.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm.base import local_path, prepare
from onomast.llm.word_cache import encoder

END_ID = 2
_NULL = -(2**63)
#: Documents that one task reads back at a time.
READ_DOCS = 20_000
#: Units of a worker's table while it writes: nothing else here holds memory, and what the table lacks is most of the time.
UNITS = 800_000


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = END_ID) -> dict:
    """Writes documents (doc_id, text) as token files in a folder that all executors mount; gives the manifest.

    Null and empty texts are the end id alone; null doc_ids come first; rows of one doc_id follow each other by text.
    A task writes under a name of its own and renames, so one that runs twice leaves one whole file of the same bytes.
    """
    prepare(docs.sparkSession)
    to = local_path(folder)
    os.makedirs(to, exist_ok=True)
    end = np.asarray([end_id], dtype="<u4").tobytes()
    kind = "<u2" if max(vocabulary, end_id + 1) <= 2**16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(tokenizer, UNITS)
        mine = {x: f"{to}/.{part:06d}-{uuid.uuid4().hex}.{x}" for x in ("ids", "idx", "doc")}
        at = docs_n = 0
        out = {x: open(p, "wb") for x, p in mine.items()}
        try:
            for batch in batches:
                ids, lengths = batch.column(0).fill_null(_NULL).to_numpy(), []
                for raw in code.raw(batch.column(1).to_pylist()):
                    out["ids"].write(np.frombuffer(raw + end, dtype="<u4").astype(kind).data)
                    lengths.append(len(raw) // 4 + 1)
                ends = at + np.cumsum(np.array(lengths, dtype=np.int64))
                out["idx"].write(np.concatenate([[at], ends[:-1]]).astype("<u8").tobytes() if lengths else b"")
                out["doc"].write(ids.astype("<i8").tobytes())
                at, docs_n = int(ends[-1]) if lengths else at, docs_n + len(lengths)
            out["idx"].write(np.array([at], dtype="<u8").tobytes())
        finally:
            for f in out.values():
                f.close()
        if docs_n:
            for x, p in mine.items():
                os.replace(p, f"{to}/{part:06d}.{x}")
        else:
            for p in mine.values():
                os.remove(p)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([docs_n], pa.int64()), pa.array([at], pa.int64())], names=["part", "docs", "ids"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts = sorted(r for r in d.mapInArrow(run, "part long, docs long, ids long").collect() if r["docs"])  # a row for each part
    manifest, base = {"type": kind, "end_id": end_id, "parts": []}, 0
    for r in parts:
        manifest["parts"].append({"part": r["part"], "base": base, "docs": r["docs"], "ids": r["ids"]})
        base += r["ids"]
    with open(f"{to}/manifest.json.tmp", "w") as f:
        json.dump(manifest, f)
    os.replace(f"{to}/manifest.json.tmp", f"{to}/manifest.json")
    return manifest


def document(folder: str, manifest: dict, part: int, row: int) -> np.ndarray:
    """The ids of one document, through memory maps."""
    to = local_path(folder)
    idx = np.memmap(f"{to}/{part:06d}.idx", dtype="<u8", mode="r")
    return np.asarray(np.memmap(f"{to}/{part:06d}.ids", dtype=manifest["type"], mode="r")[int(idx[row]) : int(idx[row + 1])])


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as uint32) of every document, and with ``with_ids`` its ids."""
    prepare(spark)
    to = local_path(folder)
    with open(f"{to}/manifest.json") as f:
        manifest = json.load(f)
    kind = manifest["type"]
    pieces = [(p["part"], p["base"], a, min(p["docs"], a + READ_DOCS)) for p in manifest["parts"] for a in range(0, p["docs"], READ_DOCS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.memmap(f"{to}/{part:06d}.ids", dtype=kind, mode="r")
                idx = np.memmap(f"{to}/{part:06d}.idx", dtype="<u8", mode="r")
                doc = np.memmap(f"{to}/{part:06d}.doc", dtype="<i8", mode="r")
                for at in range(a, b, 500):
                    to_row = min(b, at + 500)
                    edge = np.asarray(idx[at : to_row + 1]).astype(np.int64)
                    flat = np.asarray(ids[edge[0] : edge[-1]])
                    own = [flat[x:y].astype("<u4") for x, y in zip((edge - edge[0]).tolist(), (edge[1:] - edge[0]).tolist(), strict=False)]
                    d = np.asarray(doc[at:to_row])
                    cols = [pa.array(d, pa.int64(), mask=d == _NULL), pa.array(edge[:-1] + base), pa.array(np.diff(edge)), pa.array([zlib.crc32(x.data) for x in own], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = spark.createDataFrame(pieces, "part long, base long, a long, b long")
    return rows.repartition(max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, out)
