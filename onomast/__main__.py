"""``python -m onomast``: names screened against a catalogue, and the three report files of the run."""

from __future__ import annotations

import datetime as dt
import os
import signal
import sys
import time
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import SparkSession

from onomast.plans.check import Catalogue, check, release
from onomast.sources import catalogue as catalogues
from onomast.sources import names as lists
from onomast.sources import sinks

USAGE = """Screens proposed names against a catalogue.

  python -m onomast [options] NAME ...
  python -m onomast [options] --input FILE
  python -m onomast [options]               one name a line from standard input

  -c, --catalogue PLACE  a JSON file or folder, or a URL whose token is in CATALOGUE_TOKEN
  -r, --rules FILE       curated rules (JSON)
      --cache FOLDER     keeps the spellings of the catalogue between runs
  -i, --input FILE       one name a line
  -o, --out BASE         writes BASE.txt, BASE.csv and BASE.timing.json
  -h, --help             shows this text
"""


def run(spark: SparkSession, args: lists.Arguments, stdin: Iterable[str] = (), out: TextIO = sys.stderr, at: dt.datetime | None = None, get=catalogues.http_get) -> dict[str, str]:
    """One run; returns the paths of its reports.

    Names of arguments, of the input file or of a pipe are one table and one plan.  A terminal's lines are screened as
    they are typed, and what is done by an interrupt is reported.  Diagnostics go to ``out``, but for an input file,
    which may be of any size.
    """
    if not args.catalogue:
        raise ValueError("--catalogue needs a value.")
    start, at = time.monotonic(), at or dt.datetime.now()
    far = args.catalogue.startswith(("http://", "https://"))
    brands = catalogues.load(spark, args.catalogue, os.environ.get("CATALOGUE_TOKEN"), get) if far else catalogues.read(spark, args.catalogue)
    held = Catalogue.of(brands, lists.read_rules(args.rules) if args.rules else "{}", keep=True, cache=args.cache)
    size = brands.count()
    held.postings.count()
    built = time.monotonic()
    typed = not args.names and not args.input and getattr(stdin, "isatty", lambda: False)()
    if typed:
        rows, spent = _typed(spark, stdin, held, out)
    else:
        checked, began = check(lists.names_of(spark, args, stdin), held), time.monotonic()
        kept = checked.persist()
        kept.count()
        rows, spent = sinks.report_rows(kept), time.monotonic() - began
        if not args.input:
            for r in sinks.terminal(kept).orderBy("query_id").toLocalIterator():
                out.write(r["text"] + "\n")
        release(checked)
    ms = lambda x: round(1000 * x, 3)
    timings = {"build": ms(built - start), "check": ms(spent), "total": ms(time.monotonic() - start)}
    paths = sinks.write_reports(rows, args.out or f"check-{at:%Y%m%d-%H%M%S}", at, timings, size)
    out.write("".join(f"Wrote {os.path.abspath(p)}\n" for p in paths.values()))
    for part in (held.postings, held.entries, *([] if typed else [kept])):
        part.unpersist()
    return paths


def _typed(spark: SparkSession, lines: Iterable[str], held: Catalogue, out: TextIO):
    """Report rows of lines that a person types, and the seconds of screening without those of waiting."""
    rows, spent = [], 0.0
    schema = sinks.report_rows(check(spark.createDataFrame([], "query_id long, raw string"), held)).schema
    try:
        for line in lines:
            if line.strip():
                began = time.monotonic()
                checked = check(spark.createDataFrame([(len(rows), line.rstrip("\r\n"))], "query_id long, raw string"), held)
                kept = checked.persist()
                done = sinks.report_rows(kept).first()
                out.write(sinks.terminal(kept).first()["text"] + "\n")
                release(checked)
                kept.unpersist()
                rows.append(done)
                spent += time.monotonic() - began
    except KeyboardInterrupt:
        out.write(f"Interrupted after {len(rows)} names.\n")
    return spark.createDataFrame(rows, schema), spent


def _stop(*_) -> None:
    raise KeyboardInterrupt


def main(argv: list[str] | None = None) -> int:
    try:
        args = lists.parse_arguments(sys.argv[1:] if argv is None else argv)
    except ValueError as e:
        sys.stderr.write(f"{e}\n{USAGE}")
        return 2
    if args.help:
        sys.stderr.write(USAGE)
        return 0
    signal.signal(signal.SIGTERM, _stop)
    spark = SparkSession.builder.appName("onomast").getOrCreate()
    try:
        run(spark, args, sys.stdin)
    except (ValueError, OSError, catalogues.CatalogueError) as e:
        sys.stderr.write(f"{e}\n")
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
