"""What the operators share: the shared folder, joins that withstand hot keys, connected components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of a batch that goes to Python, at most (a longer row is a batch); texts may be long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Keys that hold more than a 1/HEAVY_KEYS share of the rows count as heavy, so there are at most so many ...
HEAVY_KEYS = 1000
#: ... and, of larger inputs, keys with more rows than one task should join; MOST_HEAVY bounds their number and broadcast.
TASK_ROWS, MOST_HEAVY = 100_000, 100_000
_SHIPPED: set[str] = set()
_MADE: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        to = os.path.join(tempfile.mkdtemp(prefix="ship"), f"{root.name}.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(to)
        _SHIPPED.add(app)


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and short batches for Python, so that the caller's stays as it is."""
    prepare(spark)
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    short_batches(own)
    return own


def short_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of a batch that goes to Python, in this session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all tasks run in the driver."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        base = getattr(context, "_onomast_dir", None)
        if not base:
            base = context._onomast_dir = tempfile.mkdtemp(prefix="onomast")
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this process has put in the shared folder; call it once results are written."""
    jvm = spark.sparkContext._jvm
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """The mounted place of a file URI; executors reach the shared folder by it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" and rest:
        return "/" + rest.lstrip("/")
    if "://" in path:
        raise ValueError(f"the shared folder must be mounted on the executors for memory maps: {path}")
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows: as many as the data needs, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def join_values(rows: DataFrame, values: DataFrame, key: str, count: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Joins rows with one value row per key, where a key may hold a third of all rows.

    ``values`` is the staged outcome of an aggregation by ``key`` over those rows, with their number in ``count``.
    Heavy keys are at most MOST_HEAVY many, so they are broadcast; a key that is not heavy has at most TASK_ROWS rows
    (or, beyond TASK_ROWS * MOST_HEAVY rows in all, the same share of them), and these meet in a shuffle.  ``count`` is
    dropped.  A null key finds no value.  ``total`` is the number of rows, if it is known.
    """
    total = values.agg(F.sum(count)).first()[0] or 0 if total is None else total
    least = max(64, total // MOST_HEAVY, min(total // HEAVY_KEYS, TASK_ROWS))
    heavy = values.where(F.col(count) > least)
    keys = [r[0] for r in heavy.select(key).limit(HEAVY_KEYS + 1).collect()]
    light = values.where(F.col(count) <= least).drop(count)
    if not keys:
        return rows.join(light, key, how)
    hot = F.coalesce(F.col(key).isin(keys), F.lit(False)) if len(keys) <= HEAVY_KEYS else None
    heavy = heavy.drop(count)
    if hot is None:
        flag = f"_hot_{uuid.uuid4().hex[:8]}"
        marked = rows.join(F.broadcast(heavy.select(key).withColumn(flag, F.lit(True))), key, "left")
        a, b = marked.where(F.col(flag)).drop(flag), marked.where(F.col(flag).isNull()).drop(flag)
    else:
        a, b = rows.where(hot), rows.where(~hot)
    return a.join(F.broadcast(heavy), key, how).unionByName(b.join(light, key, how))


def trim() -> None:
    """Gives the memory that this worker has freed back to the machine: idle workers wait for other operators' tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := getattr(ctypes.CDLL(None), "malloc_trim", None):
        libc(0)


def groups(batches, keys: list[str]):
    """Tables of the rows that agree in ``keys``, from batches that are sorted by them; one group is held at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """A spanning forest of the links that a task sees: links inside a tree say nothing new about components."""

    #: Nodes that are remembered; beyond them the forest starts anew, which lets more links through and loses none.
    MOST = 1_000_000

    def __init__(self):
        self._root: dict[int, int] = {}

    def _find(self, x: int) -> int:
        root, top = self._root, x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def joins(self, a: int, b: int) -> bool:
        """Whether a link joins two trees; from now on they are one."""
        if len(self._root) > self.MOST:
            self._root.clear()
        a, b = self._find(a), self._find(b)
        if a == b:
            return False
        self._root[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge list; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) on staged tables: each is one
    pre-aggregated minimum per node and one join back that withstands hubs; rounds grow with the
    logarithm of the nodes.  Nothing is gathered on the driver but counts and a few hubs.
    """
    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    nodes = staged(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "nodes")
    for _ in range(60):
        n = e.count()
        both = e.union(e.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        large = join_values(both, least.withColumn("m", F.least("u", "m")), "u", "n", total=2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(large.where("u <> v").distinct(), "large")
        least = staged(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_values(e, least, "u", "n", total=n)
        e = staged(
            small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct(),
            "small",
        )
        # settled once every node either is the centre of a star or has one edge, to such a centre
        sides = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
        if sides.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
