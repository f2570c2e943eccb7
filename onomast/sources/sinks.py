"""Reports of a run: text, CSV, timing, terminal; exports of chosen names."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.config import DEFAULT
from onomast.functions.text import single_line
from onomast.operators import exports

BOM, SHOWN = "﻿", 5


def outcome(decision: Column) -> Column:
    """ALLOW or REVIEW; an unknown decision is an error."""
    return F.when(decision == "ALLOW", "ALLOW").when(decision.isin("BLOCK", "HUMAN_REVIEW"), "REVIEW").otherwise(F.raise_error(F.concat(F.lit("Unhandled decision: "), decision)))


def report_rows(checked: DataFrame) -> DataFrame:
    """query_id, brand, outcome and up to five candidates (label, code); none for ALLOW."""
    shown = F.transform(F.slice("candidates", 1, SHOWN), lambda c: F.struct(single_line(c["label"]).alias("label"), single_line(c["code"]).alias("code")))
    rows = checked.select("query_id", single_line(F.col("input")).alias("brand"), outcome(F.col("decision")).alias("outcome"), shown.alias("shown"))
    return rows.select("query_id", "brand", "outcome", F.when(F.col("outcome") == "ALLOW", F.slice("shown", 1, 0)).otherwise(F.col("shown")).alias("candidates"))


def named(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: F.format_string("%s (%s)", c["label"], c["code"]))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(rows: DataFrame) -> DataFrame:
    """query_id and a CSV line of every report row; every field is quoted."""
    fields = [quoted(F.col("brand")), quoted(F.col("outcome")), quoted(F.array_join(named(F.col("candidates")), "; "))]
    return rows.select("query_id", F.concat_ws(",", *fields).alias("line"))


def text_blocks(rows: DataFrame) -> DataFrame:
    """query_id and a block of lines of every report row, yet without its number."""
    compare = F.when(F.size("candidates") > 0, F.concat_ws("\n", F.transform(named(F.col("candidates")), lambda x: F.concat(F.lit("      - "), x)))).otherwise("      (none)")
    review = F.when(F.col("outcome") == "REVIEW", F.concat(F.lit("\n    Existing brands to compare:\n"), compare)).otherwise("")
    return rows.select("query_id", F.concat("brand", F.lit("\n    Result: "), "outcome", review).alias("block"))


def tally(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col("outcome") == "ALLOW").alias("allowed"), F.count_if(F.col("outcome") == "REVIEW").alias("review"))


def duration(ms: float) -> str:
    """0.1s under a minute, else minutes and seconds, else hours too; negative times are 0."""
    ms = max(0.0, ms)
    seconds = int(ms / 1000 + 0.5)
    if seconds < 60:
        return f"{ms / 1000:.1f}s"
    h, m, s = seconds // 3600, seconds % 3600 // 60, seconds % 60
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s"


def header(counts, at: dt.datetime, timing: dict[str, float] | None = None) -> str:
    parts = [f"{counts['checked']} checked", f"{counts['allowed']} ALLOW", f"{counts['review']} REVIEW"]
    if timing:
        parts.append(f"{duration(timing['total'])} (build {duration(timing['build'])}, check {duration(timing['check'])})")
    return f"Brand check results - {at:%Y-%m-%d %H:%M}\n" + " | ".join(parts)


def write_reports(rows: DataFrame, base: str, at: dt.datetime, timings: dict[str, float], catalogue_size: int) -> dict[str, str]:
    """Writes BASE.txt, BASE.csv and BASE.timing.json; the first two only if there are rows.

    Lines are made by the plan; the driver streams them partition by partition into the files, in order.
    """
    Path(base).parent.mkdir(parents=True, exist_ok=True)
    rows = rows.persist()
    try:
        counts, paths = tally(rows).first(), {}
        if counts["checked"]:
            paths["txt"], paths["csv"] = f"{base}.txt", f"{base}.csv"
            with open(paths["txt"], "w", encoding="utf-8", newline="") as f:
                f.write(BOM + header(counts, at, timings) + "\n")
                for k, r in enumerate(text_blocks(rows).orderBy("query_id").toLocalIterator(), 1):
                    f.write(f"\n[{k}] {r['block']}\n")
            with open(paths["csv"], "w", encoding="utf-8", newline="") as f:
                f.write(BOM + '"brand","result","candidates"\r\n')
                for r in csv_lines(rows).orderBy("query_id").toLocalIterator():
                    f.write(r["line"] + "\r\n")
        paths["timing"] = f"{base}.timing.json"
        body = {"generatedAt": at.isoformat(), "counts": {"catalogueBrands": catalogue_size, "namesChecked": counts["checked"]}, "timingsMs": timings}
        Path(paths["timing"]).write_text(json.dumps(body, indent=2) + "\n", encoding="utf-8")
        return paths
    finally:
        rows.unpersist()


def percent(c: Column) -> Column:
    return F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))


def terminal(checked: DataFrame) -> DataFrame:
    """query_id and the diagnostics of each name; ALLOW shows a margin and not a confidence."""
    one = lambda c, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), single_line(c["label"]), F.lit(" ("), single_line(c["code"]), F.lit(")\n     Score: "), percent(c["score"]), F.lit(" | Match: "), c["match_type"],
        F.lit("\n     Reason: "), single_line(c["reason"]),
    )
    listed = F.when(F.size("candidates") > 0, F.concat_ws("\n", F.transform(F.slice("candidates", 1, SHOWN), one))).otherwise("    (none)")
    says = F.when(F.col("decision") == "ALLOW", "  Margin below a match: ").otherwise("  Confidence: ")
    action = F.when(F.col("decision") == "HUMAN_REVIEW", "\n  Action: a person must confirm or reject this name.").otherwise("")
    head = F.concat(F.lit("Brand check\n  Input: "), single_line(F.col("input")), F.lit("\n  Normalized: "), single_line(F.col("normalized")), F.lit("\n  Decision: "), "decision", F.lit("\n"), says, percent(F.col("confidence")), action)
    return checked.select("query_id", F.concat(head, F.lit("\n  Candidates:\n"), listed, F.lit("\n")).alias("text"))


# ------------------------------------------------------------------ review and exports


def review_batch(checked: DataFrame, threshold: float = DEFAULT.display) -> DataFrame:
    """id, brand, outcome, candidates to show (score at the threshold or above, uncapped; none for ALLOW) and selected."""
    shown = F.transform(F.filter("display_candidates", lambda c: c["score"] >= threshold), lambda c: F.struct(single_line(c["label"]).alias("label"), single_line(c["code"]).alias("code"), c["score"].alias("score")))
    rows = checked.select(F.col("query_id").alias("id"), single_line(F.col("input")).alias("brand"), outcome(F.col("decision")).alias("outcome"), shown.alias("shown"))
    return rows.select("id", "brand", "outcome", F.when(F.col("outcome") == "ALLOW", F.slice("shown", 1, 0)).otherwise(F.col("shown")).alias("candidates"), (F.col("outcome") == "ALLOW").alias("selected"))


def selection(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The chosen items by id; an id that no item has is an error."""
    chosen = ids.select(F.col("id").cast("long").alias("id")).distinct()
    if not chosen.join(items, "id", "left_anti").isEmpty():
        raise ValueError("Selection contains an unknown row.")
    return items.join(chosen, "id", "left_semi").orderBy("id")


def delimited(c: Column) -> Column:
    return F.when(c.rlike('[;"\r\n]'), quoted(c)).otherwise(c)


_EXPORT = re.compile(r"^SP_brands_\d{12}\.csv$|^SP_brand_relations_\d{12}\.csv$")


def export(chosen: DataFrame, brands: DataFrame, folder: str, at: dt.datetime) -> tuple[str, str]:
    """Writes the new codes of chosen names and their relations, in place of earlier exports.

    Files are staged, earlier exports set aside, and put back if a rename fails.
    """
    rows = exports.allocate(chosen.select("id", "brand"), brands).persist()
    try:
        if rows.isEmpty():
            raise ValueError("Select at least one name before creating output.")
        stamp = f"{at:%Y%m%d%H%M}"
        files = {f"SP_brands_{stamp}.csv": ("brand_number;brand_name ", F.concat_ws(";", F.lit(""), delimited(F.col("code")), delimited(F.col("brand")))), f"SP_brand_relations_{stamp}.csv": ("brand_number;parent_number ", F.concat_ws(";", F.lit(""), delimited(F.col("code")), F.lit("brand")))}
        os.makedirs(folder, exist_ok=True)
        stage = tempfile.mkdtemp(prefix=".export-", dir=folder)
        aside, placed = os.path.join(stage, "previous"), []
        os.mkdir(aside)
        try:
            for name, (head, line) in files.items():
                with open(os.path.join(stage, name), "w", encoding="utf-8", newline="") as f:
                    f.write(head + "\r\n")
                    for r in rows.orderBy("id").select(line.alias("line")).toLocalIterator():
                        f.write(r["line"] + "\r\n")
            for name in filter(_EXPORT.match, os.listdir(folder)):
                os.rename(os.path.join(folder, name), os.path.join(aside, name))
            for name in files:
                os.rename(os.path.join(stage, name), os.path.join(folder, name))
                placed.append(name)
        except BaseException:
            for name in placed:
                os.remove(os.path.join(folder, name))
            for name in os.listdir(aside):
                os.rename(os.path.join(aside, name), os.path.join(folder, name))
            raise
        finally:
            shutil.rmtree(stage, ignore_errors=True)
        return tuple(os.path.join(folder, name) for name in files)
    finally:
        rows.unpersist()
