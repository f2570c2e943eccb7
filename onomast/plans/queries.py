"""The engine's queries over the tables of a folder: one for each operator, and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.config import CALIBRATED, DEFAULT
from onomast.functions import keyboard, similarity, sound, spelling, text
from onomast.operators import decide, exports, index, retrieval, scoring
from onomast.plans import samples
from onomast.plans.check import Catalogue, check, prepared, same_script_candidates
from onomast.sources import catalogue as catalogues
from onomast.sources import names as lists
from onomast.sources import sinks


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """i, name: the distinct part names, some dozens whatever the scale, numbered in order."""
    names = _table(spark, folder, "part").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("i", F.row_number().over(Window.orderBy("name")))


def _brands(spark: SparkSession, folder: str) -> DataFrame:
    return _vocabulary(spark, folder).select(F.col("i").cast("long").alias("brand_ord"), F.concat(F.lit("b_"), F.col("i"), F.lit("mp")).alias("code"), F.col("name").alias("label"))


def _catalogue(spark: SparkSession, folder: str) -> Catalogue:
    return Catalogue.of(_brands(spark, folder), across=False)


def _slips(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, raw, name: eight slips of every part name."""
    v = _vocabulary(spark, folder).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return v.select((F.col("i") * 8 + F.col("k")).cast("long").alias("query_id"), F.expr(samples.SLIP).alias("raw"), "name")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """a, b: all pairs of the vocabulary, which is small and of fixed size."""
    v = _vocabulary(spark, folder).agg(F.collect_list("name").alias("all"))
    return v.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))


def _slip_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """a, b: normal forms of each slip and its name."""
    return _slips(spark, folder).select(text.folded(F.col("raw")).alias("a"), F.col("name").alias("b")).distinct()


def _values(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(values)


def normalize_names(spark, folder):
    raw = None
    for t, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name")):
        d = _table(spark, folder, t).select(F.col(c).alias("raw"))
        raw = d if raw is None else raw.union(d)
    raw = raw.union(_table(spark, folder, "documents").select("text")).distinct()
    return text.normalized(raw, "raw").select("raw", "normalized", "compact")


def detect_script(spark, folder):
    raw = _values(spark, samples.SCRIPTS).union(_table(spark, folder, "documents").select("text"))
    return raw.distinct().select("raw", text.script(F.col("raw")).alias("script"))


def cross_script_pairs(spark, folder):
    s = _values(spark, samples.SCRIPTS).select(text.script(F.col("raw")).alias("s")).distinct().agg(F.collect_list("s").alias("all"))
    p = s.select(F.explode("all").alias("query_script"), "all").select("query_script", F.explode("all").alias("entry_script"))
    return p.withColumn("compared", text.cross_script(F.col("query_script"), F.col("entry_script")))


def parse_name_list(spark, folder):
    return lists.parse_list(_values(spark, samples.LISTS)).select(F.col("file"), F.row_number().over(Window.partitionBy("file").orderBy("line")).alias("place"), "raw")


def adapt_catalogue_json(spark, folder):
    b = catalogues.adapt(_values(spark, samples.PAYLOADS))
    return b.select("code", "label", F.coalesce(F.to_json("translations"), F.lit("")).alias("translations"))


def bigram_postings(spark, folder):
    return _catalogue(spark, folder).postings.where("channel = 'bigram'").select("key", "entry_ord")


def posting_stats(spark, folder):
    """Channels of spelling; those of sound come from readings, which SQL does not know."""
    posted = Catalogue.of(_brands(spark, folder)).postings.where("channel not like 'ph%'")
    return posted.groupBy("channel").agg(F.count("*").alias("postings"), F.countDistinct("key").alias("keys"))


def osa_pairs(spark, folder):
    return _pairs(spark, folder).select("a", "b", similarity.osa("a", "b").alias("osa"))


def osa_kernel(spark, folder):
    return similarity.compared(_pairs(spark, folder), "a", "b").select("a", "b", F.col("signals.edit_distance").alias("osa"))


def dice_pairs(spark, folder):
    return _pairs(spark, folder).select("a", "b", F.round(similarity.dice(F.col("a"), F.col("b")), 6).alias("dice"))


def token_similarity_pairs(spark, folder):
    return similarity.compared(_pairs(spark, folder), "a", "b").select("a", "b", F.round("signals.token_similarity", 6).alias("token_similarity"))


def prefix_signals(spark, folder):
    a, b = F.col("a"), F.col("b")
    p = _pairs(spark, folder).union(_slip_pairs(spark, folder)).distinct()
    return p.select("a", "b", similarity.common_prefix(a, b).cast("int").alias("common_prefix"), similarity.token_prefix(a, b).alias("token_prefix"))


def transposition_pairs(spark, folder):
    p = _slip_pairs(spark, folder).withColumn("d", similarity.osa("a", "b"))
    return p.select("a", "b", similarity.transposed(F.col("a"), F.col("b"), F.col("d")).alias("transposed"))


def composite_similarity(spark, folder):
    p = similarity.compared(_slip_pairs(spark, folder), "a", "b")
    return p.select("a", "b", F.round("signals.score", 6).alias("score"), "signals.edit_distance", F.round("signals.ngram_similarity", 6).alias("ngram_similarity"), F.col("signals.is_prefix_variant").alias("is_prefix_variant"))


def fuzzy_class(spark, folder):
    p = similarity.compared(_slip_pairs(spark, folder).where("a <> b"), "a", "b")
    s = F.col("signals")
    kind = scoring.fuzzy_class(s)
    return p.select("a", "b", kind.alias("match_type"), F.round(scoring.fuzzy_score(s), 6).alias("score"), scoring.fuzzy_reason(kind, s).alias("reason"))


def partial_match(spark, folder):
    p = similarity.compared(_pairs(spark, folder).union(_slip_pairs(spark, folder)).distinct(), "a", "b")
    return p.select("a", "b", F.col("signals.partial").alias("partial"))


def single_substitution(spark, folder):
    s = keyboard.single_substitution(F.col("a"), F.col("b"))
    return _slip_pairs(spark, folder).select("a", "b", s.alias("s")).where("s is not null").select("a", "b", "s.l", "s.r")


def keyboard_plausible(spark, folder):
    letters = F.explode(F.split(F.lit(samples.LETTERS), ""))
    p = spark.range(1).select(letters.alias("l")).select("l", letters.alias("r"))
    return p.select("l", "r", keyboard.plausible_column(F.col("l"), F.col("r")).alias("plausible"))


def _prepared(spark, folder) -> tuple[DataFrame, Catalogue]:
    c = _catalogue(spark, folder)
    return prepared(_slips(spark, folder), c), c


def retrieve_same_script(spark, folder):
    q, c = _prepared(spark, folder)
    return retrieval.pool(retrieval.same_script_lookups(q), c.postings)


def candidates_top5(spark, folder):
    q, c = _prepared(spark, folder)
    top = same_script_candidates(q, c).where(F.col("rank") <= DEFAULT.candidates)
    return top.select("query_id", "rank", "code", F.round("score", 6).alias("score"), "match_type", "partial_match")


def _decided(spark, folder, config=DEFAULT) -> DataFrame:
    return check(_slips(spark, folder).select("query_id", "raw"), _catalogue(spark, folder), config)


def check_names(spark, folder):
    r = _decided(spark, folder)
    return r.select("query_id", "input", "decision", F.round("confidence", 6).alias("confidence"), F.size("candidates").alias("candidates"), F.coalesce(F.get("candidates", F.lit(0))["code"], F.lit("")).alias("best"))


def check_names_calibrated(spark, folder):
    return _decided(spark, folder, CALIBRATED).select("query_id", "decision", F.round("confidence", 6).alias("confidence"))


def _words(spark, folder) -> DataFrame:
    """query_id, raw: the distinct words (runs of letters of any script, in lower case) of all whole texts, numbered in order."""
    words = _table(spark, folder, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))).alias("raw"))
    words = words.select(F.lower("raw").alias("raw")).distinct().withColumn("start", F.substring("raw", 1, 3))
    # words grow with the texts, their starts do not: only the starts are counted in one task
    starts = words.groupBy("start").agg(F.count("*").alias("n"))
    starts = starts.select("start", (F.sum("n").over(Window.orderBy("start")) - F.col("n")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("start").orderBy("raw"))
    return words.join(starts, "start").select(number.cast("long").alias("query_id"), "raw")


def check_names_docs(spark, folder):
    r = check(_words(spark, folder), _catalogue(spark, folder))
    return r.select("query_id", "input", "decision", F.round("confidence", 6).alias("confidence"), F.coalesce(F.get("candidates", F.lit(0))["code"], F.lit("")).alias("best"))


def reserved_slots(spark, folder):
    rows = _values(spark, samples.RANKED)
    none = F.lit(None)
    rows = rows.select("query_id", "rank", "code", F.lit("x").alias("label"), "score", F.lit("HIGH_FUZZY").alias("match_type"), F.lit("").alias("reason"), F.lit(False).alias("partial_match"), none.cast(scoring.SIGNALS).alias("signals"), F.when(F.col("across"), F.from_json(F.lit('{"exact":false}'), scoring.CROSS.removeprefix("struct<").removesuffix(">").replace(":", " "))).alias("cross"), F.col("rank").cast("long").alias("position"))
    return decide.short_list(rows).select("query_id", "rank", "code", "score")


def decide_rules(spark, folder):
    rows = _values(spark, samples.CANDIDATES)
    signals = F.struct(*[(F.col(n) if n in rows.columns else F.lit(None)).alias(n) for n in (x.split()[0] for x in similarity.SIGNALS.split(", "))]).cast(scoring.SIGNALS)
    cross = F.struct(*[(F.col(n) if n in rows.columns else F.lit(None)).alias(n) for n in (x.split(":")[0] for x in scoring.CROSS.removeprefix("struct<").removesuffix(">").split(","))]).cast(scoring.CROSS)
    c = rows.select("query_id", "rank", "code", F.lit("x").alias("label"), "score", "match_type", F.lit("").alias("reason"), "partial_match", F.when(~F.col("across"), signals).alias("signals"), F.when(F.col("across"), cross).alias("cross"))
    d = decide.listed(c, "candidates").withColumn("d", decide.decision(F.col("candidates")))
    return d.select("query_id", "d.decision", F.round("d.confidence", 6).alias("confidence"))


def alias_lookup(spark, folder):
    known = decide.aliases(text.normalized(_values(spark, samples.ALIASES), "alias"))
    q = text.normalized(_slips(spark, folder), "raw")
    return decide.alias_candidates(q, known).select("query_id", "code", "label", "reason")


def curated_explode(spark, folder):
    return lists.curated_pairs(_values(spark, samples.RECORDS))[0]


def curated_excluded(spark, folder):
    return lists.curated_pairs(_values(spark, samples.RECORDS))[1]


def latin_skeleton(spark, folder):
    names = _vocabulary(spark, folder).select("name").union(_values(spark, samples.LATIN))
    return names.distinct().select("name", text.latin_skeleton(F.col("name")).alias("skeleton"))


def hebrew_skeleton(spark, folder):
    return _values(spark, samples.HEBREW).distinct().select("name", text.hebrew_skeleton(F.col("name")).alias("skeleton"))


def _romanized_lookups(spark, folder) -> tuple[DataFrame, Catalogue]:
    c = Catalogue.of(_brands(spark, folder))
    return retrieval.cross_script_lookups(prepared(_slips(spark, folder), c)), c


def skeleton_retrieval(spark, folder):
    looked, c = _romanized_lookups(spark, folder)
    return retrieval.pool(looked.where("channel = 'tr_skel'"), c.postings).select("query_id", "entry_ord", "retrieval_score")


def retrieve_romanized(spark, folder):
    looked, c = _romanized_lookups(spark, folder)
    return retrieval.pool(looked, c.postings).select("query_id", "entry_ord", "retrieval_score")


def retrieve_pool_cut(spark, folder):
    """A catalogue that grows with the tables, of names so alike that the pool's cut decides: all suppliers and parts."""
    brands = _brands(spark, folder).union(_table(spark, folder, "supplier").select(F.col("s_suppkey") + 1000, F.concat(F.lit("s_"), "s_suppkey"), "s_name"))
    names = _table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("query_id"), F.col("s_name").alias("raw"))
    c = Catalogue.of(brands, across=False)
    return retrieval.pool(retrieval.same_script_lookups(prepared(names, c)), c.postings)


def deletion_neighbourhood(spark, folder):
    """Entries whose sound keys, or those with a consonant left out, meet the names'; the spelling's pool adds none here."""
    c = Catalogue.of(_values(spark, samples.BRANDS), samples.RULES)
    q = prepared(_values(spark, samples.NAMES), c)
    none = spark.createDataFrame([], "query_id long, entry_ord long, pool_rank int")
    return retrieval.sound_pool(q, c.postings, c.entries, none).select("query_id", "entry_ord", "sound_rank")


def variant_best_confidence(spark, folder):
    v = _values(spark, samples.VARIANTS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "value", "source", "confidence"))).alias("made"))
    best = spelling.with_best(v, "made").select("query_id", F.posexplode("best").alias("place", "b"))
    return best.select("query_id", "b.value", "b.source", "b.confidence", "place")


def hebrew_variants(spark, folder):
    return spelling.with_variants(_values(spark, samples.HEBREW).distinct(), "name", samples.RULES).select("name", F.posexplode("variants").alias("place", "v")).select("name", "place", "v.value", "v.source", F.round("v.confidence", 6).alias("confidence"))


def latin_variants(spark, folder):
    names = _vocabulary(spark, folder).select("name").union(_values(spark, samples.LATIN)).distinct()
    v = spelling.with_variants(names, "name", samples.RULES, hebrew=True)
    return v.select("name", F.posexplode("variants").alias("place", "v")).select("name", "place", "v.value", "v.source", F.round("v.confidence", 6).alias("confidence"))


def phonetic_match(spark, folder):
    p = sound.with_match(_values(spark, samples.SOUND_PAIRS), "a", "b")
    m = F.col("sound")
    return p.select("a", "b", F.coalesce(m["relation"], F.lit("")).alias("relation"), F.round(m["similarity"], 6).alias("similarity"), m["orthography"].alias("orthography"))


def phonetic_keys(spark, folder):
    names = _vocabulary(spark, folder).select("name").union(_values(spark, samples.HEBREW)).distinct()
    return sound.with_keys(names, "name").select("name", F.explode("sound_keys").alias("key"))


def credible_filter(spark, folder):
    c = _values(spark, samples.CREDIBLE)
    ok = scoring.credible(F.col("similarity"), F.col("exact"), F.col("confidence"), F.col("skeleton_match"), F.col("skeleton"), F.col("variant"))
    return c.select("id", ok.alias("credible"))


def evidence_merge(spark, folder):
    rows = _values(spark, samples.EVIDENCE)
    cross = F.from_json(F.to_json(F.struct("similarity", "skeleton_match", F.when(F.col("skeleton_match"), "klnk").alias("skeleton"), F.when(F.col("kind") == "sound", F.col("similarity")).alias("sound_similarity"), F.when(F.col("kind") == "sound", F.col("relation")).alias("sound_relation"))), scoring.CROSS.removeprefix("struct<").removesuffix(">").replace(":", " "))
    rows = rows.withColumn("cross", cross).withColumn("signals", F.lit(None).cast(scoring.SIGNALS)).withColumn("label", F.lit("x")).withColumn("reason", F.lit(""))
    m = scoring.merged_evidence(rows.where("kind = 'spelling'").select(*scoring.COLUMNS), rows.where("kind = 'sound'").select(*scoring.COLUMNS))
    return m.select("query_id", "code", "score", "match_type", "partial_match", F.coalesce("cross.skeleton", F.lit("")).alias("skeleton"), F.coalesce("cross.sound_relation", F.lit("")).alias("relation"))


def report_rows(spark, folder):
    r = sinks.report_rows(_decided(spark, folder))
    return r.select("query_id", "brand", "outcome", F.array_join(sinks.named(F.col("candidates")), "; ").alias("candidates"))


def report_csv(spark, folder):
    return sinks.csv_lines(sinks.report_rows(_decided(spark, folder)))


def report_tally(spark, folder):
    return sinks.tally(sinks.report_rows(_decided(spark, folder)))


def report_text(spark, folder):
    return sinks.text_blocks(sinks.report_rows(_decided(spark, folder)))


def terminal_text(spark, folder):
    return sinks.terminal(_decided(spark, folder))


def review_selection(spark, folder):
    r = sinks.review_batch(_decided(spark, folder))
    return sinks.selection(r, r.where("selected").select("id")).select("id", "brand", "outcome")


def review_display(spark, folder):
    r = sinks.review_batch(_decided(spark, folder))
    return r.select("id", F.size("candidates").alias("shown"), F.round(F.coalesce(F.array_max(F.transform("candidates", lambda c: c["score"])), F.lit(0.0)), 6).alias("best"))


def allocate_codes(spark, folder):
    return exports.allocate(_values(spark, samples.CHOSEN), _values(spark, samples.CODES))


def check_cross_script(spark, folder):
    """Both scripts, with curated pairs, aliases and sound, over an inline catalogue."""
    c = Catalogue.of(_values(spark, samples.BRANDS), samples.RULES)
    known = decide.aliases(text.normalized(_values(spark, samples.ALIASES), "alias"))
    r = check(_values(spark, samples.NAMES), c, aliases=known)
    return r.select("query_id", "input", "decision", F.round("confidence", 6).alias("confidence"), F.transform("candidates", lambda x: F.concat_ws("|", x["code"], x["match_type"], F.round(x["score"], 6).cast("string"))).alias("candidates"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_names, detect_script, cross_script_pairs, parse_name_list, adapt_catalogue_json, bigram_postings, posting_stats, osa_pairs, osa_kernel, dice_pairs, token_similarity_pairs,
        prefix_signals, transposition_pairs, composite_similarity, fuzzy_class, partial_match, single_substitution, keyboard_plausible, retrieve_same_script, candidates_top5, reserved_slots,
        decide_rules, alias_lookup, curated_explode, curated_excluded, latin_skeleton, hebrew_skeleton, skeleton_retrieval, retrieve_romanized, retrieve_pool_cut, deletion_neighbourhood, variant_best_confidence, hebrew_variants,
        latin_variants, phonetic_match, phonetic_keys, credible_filter, evidence_merge, report_rows, report_csv, report_tally, report_text, terminal_text, review_selection, review_display,
        allocate_codes, check_names, check_names_calibrated, check_names_docs, check_cross_script,
    )
}
