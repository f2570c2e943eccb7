"""The cache of the index's spellings, which are dear to make and rarely change."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions import spelling, tables
from onomast.functions.text import HEBREW


def fingerprint(rules: str) -> str:
    """Of the spelling code, its fixed values and the rules: a cache made by others is not used."""
    h = hashlib.sha256(rules.encode())
    for module in (spelling, tables):
        h.update(Path(module.__file__).read_bytes())
    return h.hexdigest()


def cached_variants(names: DataFrame, rules: str, folder: str) -> DataFrame:
    """(name, variants) for the distinct Hebrew names of a catalogue, from a Parquet cache where it has them.

    Misses are the anti join; only they are expanded.  What is no longer used goes.  The cache is written beside the old
    one and the manifest is replaced last, so a reader sees the one or the other; a cache with another fingerprint or
    another checksum is ignored.
    """
    spark: SparkSession = names.sparkSession
    wanted = names.select("name").where(F.col("name").rlike(HEBREW)).distinct()
    manifest, mark = Path(folder) / "manifest.json", fingerprint(rules)
    old = None
    if manifest.exists():
        try:
            m = json.loads(manifest.read_text())
            found = spark.read.parquet(m["path"])
            if m["version"] == 1 and m["fingerprint"] == mark and m["checksum"] == _checksum(found):
                old = found
        except Exception:  # a cache that cannot be read is made anew
            old = None
    missing = wanted if old is None else wanted.join(old, "name", "left_anti")
    made = spelling.with_variants(missing, "name", rules, spelling.INDEX_BUDGET, spelling.INDEX_MAX_COST)
    if old is not None:
        if missing.isEmpty() and old.join(wanted, "name", "left_anti").isEmpty():
            return old
        made = made.unionByName(old.join(wanted, "name", "left_semi"))
    to = str(Path(folder) / f"variants-{hashlib.sha256(os.urandom(16)).hexdigest()[:16]}")
    made.write.parquet(to)
    new = spark.read.parquet(to)
    body = {"version": 1, "fingerprint": mark, "checksum": _checksum(new), "path": to}
    (Path(folder) / ".manifest.tmp").write_text(json.dumps(body))
    os.replace(Path(folder) / ".manifest.tmp", manifest)
    return new


def _checksum(d: DataFrame) -> str:
    return str(d.agg(F.sum(F.xxhash64("name", F.to_json("variants")).cast("decimal(38,0)")), F.count("*")).first())
