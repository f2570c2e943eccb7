"""Candidates from pooled entries: same script, spelling across scripts, and sound.

A candidate row is query_id, group position, code, label, score, match_type, reason, partial_match, signals, cross.
Retrieval has decided what is compared; each distinct pair of texts is compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.config import DEFAULT, MatchConfig
from onomast.functions import similarity, sound, spelling
from onomast.functions.text import cross_script, hebrew_skeleton, latin_skeleton

COMPACT_SCORE, TOKEN_PREFIX_BONUS, IMPLAUSIBLE = 0.97, 0.22, 0.5
SKELETON_FLOOR, SKELETON_LENGTH = 0.78, 4
SOUND_SCALE, SUBSET_FACTOR, SOUND_FUZZY = 0.95, 0.85, 0.9
FUZZY_SIMILARITY, SHORT_HEBREW, SHORT_SIMILARITY, EXACT_CONFIDENCE, SCORED_SPELLINGS = 0.72, 7, 0.95, 0.5, 32
SIGNALS = f"struct<{similarity.SIGNALS.replace(' ', ':').replace(',:', ',')}>"
CROSS = (
    "struct<input_script:string,candidate_script:string,variant:string,candidate_variant:string,similarity:double,exact:boolean,source:string,"
    "confidence:double,skeleton_match:boolean,skeleton:string,sound_similarity:double,sound_reading:string,sound_relation:string>"
)
ORTHOGRAPHIES = {"EN": "English", "FR": "French", "IT": "Italian", "DE": "German", "LITERAL": "letter by letter"}
COLUMNS = ("query_id", "code", "label", "score", "match_type", "reason", "partial_match", "signals", "cross", "position")


def fuzzy_class(s: Column) -> Column:
    """The match type of a comparison that is not exact."""
    alike = s["input_tokens"] == s["candidate_tokens"]
    return (
        F.when(s["implausible"], "WEAK_SIMILARITY")
        .when(s["is_token_prefix"], "RELATED_NAME")
        .when((s["edit_distance"] <= 1) & alike, F.when(s["score"] >= 0.82, "HIGH_FUZZY").otherwise("POSSIBLE_TYPO"))
        .when((s["token_similarity"] >= 0.5) & alike, "TOKEN_VARIANT")
        .when(s["score"] >= 0.6, "POSSIBLE_TYPO")
        .otherwise("WEAK_SIMILARITY")
    )


def fuzzy_score(s: Column) -> Column:
    """The score of a comparison: half an edit less for an unlikely letter, a bonus for a token prefix."""
    base = F.when(s["implausible"], s["score"] - F.lit(IMPLAUSIBLE) / F.greatest(s["input_length"], s["candidate_length"])).otherwise(s["score"])
    return F.when(s["is_token_prefix"], F.least(F.lit(1.0), base + F.lit(TOKEN_PREFIX_BONUS))).otherwise(base)


def fuzzy_reason(kind: Column, s: Column) -> Column:
    one = (
        F.when(s["is_transposition"], "Adjacent character transposition compared with the existing normalized brand")
        .when(s["length_difference"] == 1, "One-character insertion or deletion compared with the existing normalized brand")
        .otherwise("One-character character replacement compared with the existing normalized brand")
    )
    return (
        F.when(s["implausible"], "One letter replaced by a letter far from it on the keyboard; not a likely typo")
        .when(kind == "RELATED_NAME", "One normalized brand is a token prefix of the other; the added token may identify a distinct product line")
        .when(s["edit_distance"] == 1, one)
        .when(s["edit_distance"] == 2, "2-character edit distance with overlapping character and token signals")
        .when(kind == "TOKEN_VARIANT", "Shared tokens with a different token; the names may represent related values")
        .otherwise("Moderate character similarity without a deterministic exact match")
    )


def best_by_code(rows: DataFrame) -> DataFrame:
    """The best row of each (query_id, code), first on ties; ``position`` becomes that of the code's first row."""
    w = Window.partitionBy("query_id", "code")
    rank = F.row_number().over(w.orderBy(F.desc("score"), "position"))
    return rows.withColumn("_r", rank).withColumn("_p", F.min("position").over(w)).where("_r = 1").withColumn("position", F.col("_p")).drop("_r", "_p")


def same_script(q: DataFrame, e: DataFrame, pooled: DataFrame) -> DataFrame:
    """Candidates of one script, a row for each code."""
    names = q.select("query_id", F.col("normalized").alias("input"), F.col("compact").alias("input_compact"))
    texts = e.select("entry_ord", "code", "label", F.col("normalized").alias("existing"), F.col("compact").alias("existing_compact"))
    pairs = pooled.join(texts, "entry_ord").join(names, "query_id")
    exact = F.when(F.col("input") == F.col("existing"), "NORMALIZED_EXACT").when(F.col("input_compact") == F.col("existing_compact"), "COMPACT_EXACT")
    pairs = pairs.withColumn("exact", exact)
    known = pairs.where("exact is not null").withColumn("signals", F.lit(None).cast(SIGNALS))
    # pairs arrive by name, whose entries differ; the kernel compares equal pairs of a batch once
    fuzzy = similarity.compared(pairs.where("exact is null"), "input", "existing")
    s = F.col("signals")
    rows = known.unionByName(fuzzy).withColumn("match_type", F.coalesce("exact", fuzzy_class(s)))
    score = F.when(F.col("exact") == "NORMALIZED_EXACT", 1.0).when(F.col("exact") == "COMPACT_EXACT", COMPACT_SCORE).otherwise(fuzzy_score(s))
    reason = F.when(F.col("exact") == "NORMALIZED_EXACT", "Normalized exact match").when(F.col("exact") == "COMPACT_EXACT", "Compact normalized match; word boundaries differ").otherwise(fuzzy_reason(F.col("match_type"), s))
    rows = rows.withColumn("score", score).withColumn("reason", reason).withColumn("partial_match", F.coalesce(s["partial"], F.lit(False)))
    rows = rows.withColumn("cross", F.lit(None).cast(CROSS)).withColumn("position", F.col("pool_rank").cast("long"))
    return best_by_code(rows.select(*COLUMNS))


#: Comparisons of spellings that a worker makes at once.
COMPARISONS = 50_000
_SPELLED = (
    "seq long, a string, b string, source string, confidence double, native boolean, score double, exact boolean, skeleton string, skeleton_match boolean, "
    f"signals {SIGNALS}"
)


def _spellings(variants: Column, text: Callable[[Column], Column], skeleton: Callable[[Column], Column]) -> Column:
    """Variants with the text that is compared and its skeleton, which is made once for a spelling and not for each pair."""
    return F.transform(variants, lambda v: F.struct(text(v["value"]).alias("text"), v["source"].alias("source"), v["confidence"].alias("confidence"), skeleton(text(v["value"])).alias("skeleton")))


def _source(a: str, b: str) -> str:
    return next((s for s in ("CURATED", "GENERATED") if s in (a, b)), "ORIGINAL")


def _best_spellings(pairs: list[dict], curated: spelling.Curated, floor: float) -> tuple[list[int], list[tuple], list[tuple]]:
    """Of each of a pair's spellings the best comparison, if its score reaches ``floor``: (pair, row, signals).

    Comparisons that cannot reach the floor are left out before edit distances are made; those that are exact or share
    a long skeleton always take part.
    """
    tried = []  # pair, seq, native, own spelling, the other's, source, confidence, exact, skeletons match
    for k, p in enumerate(pairs):
        written = [{"text": p["normalized"], "skeleton": p["written"]}]
        for native, mine, others in ((False, p["variants"] or (), p["own"] or ()), (True, p["hebrew"] or (), written)):
            for seq, x in enumerate(mine, 1000 if native else 0):
                for y in others:
                    if y["text"]:
                        source, confidence = (x["source"], x["confidence"]) if native else (_source(x["source"], y["source"]), min(x["confidence"], y["confidence"]))
                        tried.append((k, seq, native, x, y, source, confidence, x["text"] == y["text"], x["skeleton"] != "" and x["skeleton"] == y["skeleton"]))
    distinct = list(dict.fromkeys((t[3]["text"], t[4]["text"]) for t in tried))
    bound = dict(zip(distinct, similarity.score_bounds([a for a, _ in distinct], [b for _, b in distinct]).tolist(), strict=True))
    tried = [t for t in tried if t[7] or t[8] or bound[t[3]["text"], t[4]["text"]] * (0.7 + 0.3 * t[6]) >= floor]
    distinct = list(dict.fromkeys((t[3]["text"], t[4]["text"]) for t in tried))
    signals = dict(zip(distinct, similarity.compare_many([a for a, _ in distinct], [b for _, b in distinct]), strict=True))
    best: dict[tuple[int, int], tuple] = {}
    for k, seq, native, x, y, source, confidence, exact, match in tried:
        a, b = x["text"], y["text"]
        score = 0.8 + 0.19 * confidence if exact else signals[a, b][0] * (0.7 + 0.3 * confidence)
        if not exact and match and len(x["skeleton"]) >= SKELETON_LENGTH:
            score = max(score, SKELETON_FLOOR * confidence)
        if score >= floor and ((k, seq) not in best or score > best[k, seq][6]):
            best[k, seq] = (seq, a, b, source, confidence, native, score, exact, x["skeleton"], match)
    # the skeleton of a Hebrew spelling that matches is shown by its first romanization
    shown = {r[1]: spelling.romanized_skeleton(r[1], curated) for r in best.values() if r[5] and r[9]}
    rows = [(*r[:8], shown[r[1]] if r[5] and r[9] else r[8], r[9]) for r in best.values()]
    return [k for k, _ in best], rows, [signals[r[1], r[2]] for r in rows]


def _spelling_rows(pairs: DataFrame, keep: list[str], rules: str, floor: float) -> DataFrame:
    """``keep`` and the best comparisons of every pair's spellings, made in one kernel: no comparison is a row of the plan."""
    taken = ["variants", "hebrew", "own", "normalized", "written"]
    kept = pairs.select(*keep).schema
    names = [x.split()[0] for x in _SPELLED.split(f", signals {SIGNALS}")[0].split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.float64(), pa.bool_(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curated = spelling._curated_of(rules)
        for batch in batches:
            sizes = [pa.compute.fill_null(pa.compute.list_value_length(batch.column(batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in taken[:3]]
            part = np.cumsum(sizes[0] * sizes[2] + sizes[1] + 1) // COMPARISONS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(i, j - i)
                at, rows, signals = _best_spellings(piece.select(taken).to_pylist(), curated, floor)
                if rows:
                    made = [pa.array([r[n] for r in rows], t) for n, t in enumerate(types)]
                    own = piece.select(keep).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*own.columns, *made, similarity.signal_array(signals)], names=[*keep, *names, "signals"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), _SPELLED])
    p = pairs.select(*keep, *taken).mapInArrow(run, schema)
    s, exact = F.col("signals"), F.col("exact")
    kind = F.when(exact, "TRANSLITERATION_EXACT").when(s["score"] >= FUZZY_SIMILARITY, "TRANSLITERATION_FUZZY").otherwise("CROSS_LANGUAGE_POSSIBLE_MATCH")
    return p.withColumn("match_type", kind).withColumn("similarity", F.when(exact, 1.0).otherwise(s["score"])).withColumn("partial_match", ~exact & s["partial"])


def credible(similarity_: Column, exact: Column, confidence: Column, skeleton_match: Column, skeleton: Column, variant: Column) -> Column:
    """Whether a pairing found through a generated Hebrew spelling may be kept."""
    short = F.length(F.regexp_replace(variant, r"\s", "")) < SHORT_HEBREW
    return (
        F.when(exact, confidence >= EXACT_CONFIDENCE)
        .when(skeleton_match & (F.length(F.coalesce(skeleton, F.lit(""))) >= SKELETON_LENGTH), True)
        .otherwise(similarity_ >= F.when(short, SHORT_SIMILARITY).otherwise(FUZZY_SIMILARITY))
    )


def spelled(q: DataFrame, e: DataFrame, pooled: DataFrame, rules: str = "{}", config: MatchConfig = DEFAULT) -> DataFrame:
    """Candidates across scripts by spelling, a row for each code.

    The script filter comes after the pool's cut, as entries of the name's own script use its places too.  Filters
    come before the best is chosen: the best spelling is often too speculative to keep.
    """
    bare = lambda x: F.replace(x, F.lit("'"), F.lit(""))
    names = q.select("query_id", F.col("script").alias("q_script"), _spellings(F.col("variants"), bare, latin_skeleton).alias("variants"), _spellings(F.slice("hebrew", 1, SCORED_SPELLINGS), lambda x: x, hebrew_skeleton).alias("hebrew"))
    own = _spellings(F.col("variants"), bare, latin_skeleton).alias("own")
    entries = e.select("entry_ord", "code", "label", F.col("script").alias("e_script"), "normalized", hebrew_skeleton(F.col("normalized")).alias("written"), own)
    pairs = pooled.join(entries, "entry_ord").join(names, "query_id").where(cross_script(F.col("q_script"), F.col("e_script")))
    rows = _spelling_rows(pairs, ["query_id", "entry_ord", "pool_rank", "code", "label", "q_script", "e_script"], rules, config.cross_floor)
    hebrew = F.col("a").rlike("[\\u0590-\\u05FF]")
    rows = rows.where(~hebrew | credible(F.col("similarity"), F.col("exact"), F.col("confidence"), F.col("skeleton_match"), F.col("skeleton"), F.col("a")))
    reason = (
        F.when(F.col("match_type") == "TRANSLITERATION_EXACT", F.format_string("%s input transliterates to the normalized %s brand name (%s)", "q_script", "e_script", "a"))
        .when(F.col("match_type") == "TRANSLITERATION_FUZZY", F.format_string("Generated %s-to-%s transliteration is highly similar to the existing brand", "q_script", "e_script"))
        .otherwise(F.format_string("Generated %s-to-%s transliteration is a possible match and requires review", "q_script", "e_script"))
    )
    none = F.lit(None)
    cross = F.struct(
        F.col("q_script").alias("input_script"), F.col("e_script").alias("candidate_script"), F.col("a").alias("variant"), F.col("b").alias("candidate_variant"), "similarity", "exact",
        "source", "confidence", "skeleton_match", F.when(F.col("skeleton_match"), F.col("skeleton")).alias("skeleton"),
        none.cast("double").alias("sound_similarity"), none.cast("string").alias("sound_reading"), none.cast("string").alias("sound_relation"),
    )
    rows = rows.withColumn("reason", reason).withColumn("cross", cross.cast(CROSS)).withColumn("position", F.col("pool_rank").cast("long") * 100_000 + F.col("seq"))
    return best_by_code(rows.select(*COLUMNS))


def sounded(q: DataFrame, e: DataFrame, pooled: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    """Pairings by sound, a row for each entry (``position`` is its sound_rank); they are never exact."""
    names = q.select("query_id", F.col("script").alias("q_script"), F.col("normalized").alias("input"))
    entries = e.select("entry_ord", "code", "label", F.col("script").alias("e_script"), F.col("normalized").alias("existing"))
    p = pooled.join(entries, "entry_ord").join(names, "query_id").where(cross_script(F.col("q_script"), F.col("e_script")))
    p = sound.with_match(p, "input", "existing").where("sound is not null")
    m = F.col("sound")
    same, adds = m["relation"] == "SAME", (m["relation"] != "SAME") & (m["longer"] == "INPUT")
    score = F.lit(SOUND_SCALE) * m["similarity"] * F.when(same, 1.0).otherwise(SUBSET_FACTOR)
    reading = F.create_map(*[F.lit(x) for kv in ORTHOGRAPHIES.items() for x in kv])[m["orthography"]]
    reason = (
        F.when(same, F.format_string("%s input is pronounced like the %s brand name (%s, read as %s)", "q_script", "e_script", m["rendered"], reading))
        .when(adds, F.format_string("%s input adds words to a word pronounced like the %s brand name", "q_script", "e_script"))
        .otherwise(F.format_string("%s input shares a word pronounced like the %s brand name and omits the others; it may be the same brand written shorter", "q_script", "e_script"))
    )
    none = F.lit(None)
    cross = F.struct(
        F.col("q_script").alias("input_script"), F.col("e_script").alias("candidate_script"), m["rendered"].alias("variant"), F.col("existing").alias("candidate_variant"),
        m["similarity"].alias("similarity"), F.lit(False).alias("exact"), F.lit("GENERATED").alias("source"), m["similarity"].alias("confidence"),
        none.cast("boolean").alias("skeleton_match"), none.cast("string").alias("skeleton"), m["similarity"].alias("sound_similarity"), m["orthography"].alias("sound_reading"), m["relation"].alias("sound_relation"),
    )
    rows = p.select(
        "query_id", "code", "label", score.alias("score"),
        F.when(same & (m["similarity"] >= SOUND_FUZZY), "TRANSLITERATION_FUZZY").otherwise("CROSS_LANGUAGE_POSSIBLE_MATCH").alias("match_type"),
        reason.alias("reason"), F.coalesce(adds, F.lit(False)).alias("partial_match"), none.cast(SIGNALS).alias("signals"), cross.cast(CROSS).alias("cross"), F.col("sound_rank").cast("long").alias("position"),
    )
    return rows.where(F.col("score") >= config.cross_floor)


_ROW = f"struct<score:double,match_type:string,reason:string,label:string,partial_match:boolean,signals:{SIGNALS},cross:{CROSS},position:bigint>"


def merged_evidence(by_spelling: DataFrame, by_sound: DataFrame) -> DataFrame:
    """Spelling and sound of each (query_id, code) as one candidate.

    A code's pairings by sound are folded in order into its pairing by spelling: an exact spelling keeps its type and
    takes the greater score; a spelling that is no worse takes the sound's confirmation if the names are the same, and
    is whole then; else the sound wins and keeps a shared skeleton.
    """
    pack = lambda d, name: d.groupBy("query_id", "code").agg(F.array_sort(F.collect_list(F.struct("position", *[c for c in ("score", "match_type", "reason", "label", "partial_match", "signals", "cross")]))).alias(name))  # noqa: E731,C416
    both = pack(by_spelling, "s").join(pack(by_sound, "p"), ["query_id", "code"], "full")
    row = lambda x: F.struct(*[x[k].alias(k) for k in ("score", "match_type", "reason", "label", "partial_match", "signals", "cross", "position")]).cast(_ROW)

    def with_cross(x: Column, **new: Column) -> Column:
        c = x["cross"]
        for k, v in new.items():
            c = c.withField(k, v)
        return x.withField("cross", c)

    def fold(a: Column, p: Column) -> Column:
        c = p["cross"]
        exact = F.when(p["score"] > a["score"], a.withField("score", p["score"])).otherwise(a)
        confirmed = with_cross(a.withField("partial_match", F.lit(False)), sound_similarity=c["sound_similarity"], sound_reading=c["sound_reading"], sound_relation=c["sound_relation"])
        kept = F.when(a["cross"].isNotNull() & (c["sound_relation"] == "SAME"), confirmed).otherwise(a)
        carried = with_cross(p, skeleton_match=a["cross"]["skeleton_match"], skeleton=a["cross"]["skeleton"]).withField("position", a["position"])
        replaced = F.when(F.coalesce(a["cross"]["skeleton_match"], F.lit(False)), carried).otherwise(p.withField("position", a["position"]))
        return F.when(a["match_type"] == "TRANSLITERATION_EXACT", exact).when(a["score"] >= p["score"], kept).otherwise(replaced)

    sounds = F.coalesce(F.transform("p", lambda x: row(x).withField("position", x["position"] + 10**12)), F.array().cast(f"array<{_ROW}>"))
    start = F.when(F.col("s").isNull(), sounds[0]).otherwise(row(F.col("s")[0]))
    rest = F.when(F.col("s").isNull(), F.slice(sounds, 2, F.greatest(F.size(sounds) - 1, F.lit(0)))).otherwise(sounds)
    out = both.select("query_id", "code", F.aggregate(rest, start, fold).alias("c"))
    return out.select("query_id", "code", "c.label", "c.score", "c.match_type", "c.reason", "c.partial_match", "c.signals", "c.cross", "c.position").select(*COLUMNS)
