"""Names to screen: lists, arguments, curated rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions.spelling import curated_from, excluded_spellings
from onomast.functions.text import SPACES, normalized, trimmed

#: Lines that one file may hold: query_id is file * LINES + line.
LINES = 1 << 40


def parse_list(contents: DataFrame, column: str = "value") -> DataFrame:
    """(file, line, raw) of whole texts: one byte-order mark goes, lines are trimmed, blank ones dropped, repeats kept."""
    text = F.regexp_replace(F.col(column), "^\\uFEFF", "")
    lines = contents.select("file", F.posexplode(F.split(text, "\r?\n")).alias("line", "raw"))
    return lines.select("file", "line", trimmed(F.col("raw")).alias("raw")).where("raw <> ''")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Names (query_id, raw) of a file, or of a folder's files in the order of their paths.

    Files are split by lines in the reader, so a list of any size is read in parallel; query_id keeps the order of
    partitions and lines.
    """
    text = spark.read.option("lineSep", "\n").text(path).withColumn("query_id", F.monotonically_increasing_id())
    raw = trimmed(F.regexp_replace("value", "^\\uFEFF|\r$", ""))
    return text.select("query_id", raw.alias("raw")).where("raw <> ''")


@dataclass
class Arguments:
    names: list[str] = field(default_factory=list)
    input: str | None = None
    out: str | None = None
    catalogue: str | None = None
    rules: str | None = None
    cache: str | None = None
    help: bool = False


#: Options with a value, by the field that takes it.
OPTIONS = {"-i": "input", "--input": "input", "-o": "out", "--out": "out", "-c": "catalogue", "--catalogue": "catalogue", "-r": "rules", "--rules": "rules", "--cache": "cache"}


def parse_arguments(argv: list[str]) -> Arguments:
    """Names and options (OPTIONS, -h/--help); after ``--`` all are names, and ``-`` alone is one."""
    got, rest = Arguments(), list(argv)
    while rest:
        arg = rest.pop(0)
        if arg == "--":
            got.names += rest
            break
        if arg in ("-h", "--help"):
            got.help = True
        elif arg in OPTIONS:
            if not rest:
                raise ValueError(f"{arg} needs a value.")
            value = rest.pop(0)
            if OPTIONS[arg] == "out" and value.lower().endswith((".txt", ".csv")):
                value = value[:-4]
            setattr(got, OPTIONS[arg], value)
        elif arg.startswith("-") and len(arg) > 1:
            raise ValueError(f"Unknown option: {arg}")
        else:
            got.names.append(arg)
    return got


def names_of(spark: SparkSession, args: Arguments, stdin=None) -> DataFrame:
    """Names from arguments, else the input file, else standard input."""
    if not args.names and args.input:
        return read_list(spark, args.input)
    lines = args.names or [x.rstrip("\r\n") for x in stdin or ()]
    rows = [(k, x) for k, x in enumerate(lines) if x.strip()]
    return spark.createDataFrame(rows, "query_id long, raw string")


def read_rules(path: str) -> str:
    """The curated rules as JSON text, checked; spelling kernels take this text."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    curated_from(json.loads(text))
    return text


RECORD = "latin string, hebrew string, latin_alternatives array<string>, hebrew_alternatives array<string>"


def curated_pairs(records: DataFrame, id_column: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(pairs, excluded) of curated records in relational form.

    pairs: record_id, latin, hebrew in normal form without apostrophes.  A record is excluded whole when any of its
    Latin spellings is too common: an anti join at the grain of records, with the fixed list broadcast.
    """
    spark = records.sparkSession
    none = F.array().cast("array<string>")
    both = records.select(
        F.col(id_column).alias("record_id"), F.concat(F.array("latin"), F.coalesce("latin_alternatives", none)).alias("latins"), F.concat(F.array("hebrew"), F.coalesce("hebrew_alternatives", none)).alias("hebrews")
    )
    latin = normalized(both.select("record_id", F.explode("latins").alias("raw")), "raw", "spelling", None)
    hebrew = normalized(both.select("record_id", F.explode("hebrews").alias("raw")), "raw", "spelling", None)
    common = spark.createDataFrame([(x,) for x in sorted(excluded_spellings())], "spelling string")
    excluded = latin.join(F.broadcast(common), "spelling", "left_semi").select("record_id").distinct()
    bare = lambda d, to: d.select("record_id", F.replace("spelling", F.lit("'"), F.lit("")).alias(to)).where(f"{to} <> ''").distinct()
    pairs = bare(latin, "latin").join(bare(hebrew, "hebrew"), "record_id").join(excluded, "record_id", "left_anti")
    return pairs, excluded


__all__ = ["SPACES", "Arguments", "curated_pairs", "names_of", "parse_arguments", "parse_list", "read_list", "read_rules"]
