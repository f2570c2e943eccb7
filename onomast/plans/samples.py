"""Small inline inputs that queries and their SQL share; each text runs in Spark and in DuckDB."""

from __future__ import annotations

import json

#: Slip k of a name.
SLIP = """CASE k WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, ' ', '') WHEN 2 THEN substr(name, 1, 2) || substr(name, 4)
  WHEN 3 THEN substr(name, 1, 1) || substr(name, 3, 1) || substr(name, 2, 1) || substr(name, 4) WHEN 4 THEN substr(name, 1, 3) || 'q' || substr(name, 5)
  WHEN 5 THEN name || ' home' WHEN 6 THEN split_part(name, ' ', 1) ELSE substr(name, 1, 2) || substr(name, 2) END"""

LETTERS = "qazwsxplm;,1קראטושדגכזסבהנםץ"


def _rows(columns: str, rows: list[tuple]) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, (list, tuple)):
            return f"array({', '.join(map(lit, v))})" if v else "CAST(NULL AS ARRAY<STRING>)"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"

    return f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)} AS t({columns})"


def duck(columns: str, rows: list[tuple]) -> str:
    """The same rows for DuckDB."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, (list, tuple)):
            return f"[{', '.join(map(lit, v))}]" if v else "CAST(NULL AS VARCHAR[])"
        return "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


_SCRIPTS = [("Velora",), ("ולורה",), ("Velora ולורה",), ("123 %",), ("  ",), ("",), ("Žluta",), ("ベロラ",), (None,), ("\u00a0",)]
SCRIPTS, SCRIPTS_SQL = _rows("raw", _SCRIPTS), duck("raw", _SCRIPTS)

_LISTS = [(1, "\ufeff Alba \r\nBrio\n\n  \nAlba\r\n\u00a0Cora\u00a0"), (2, ""), (3, "one\n\ttwo\t\nthree")]
LISTS, LISTS_SQL = _rows("file, value", _LISTS), duck("file, value", _LISTS)

_PAYLOADS = [
    (json.dumps({"values_lists": [{"values": [{"code": "b_1mp", "label": "Alba", "label_translations": [{"locale": "he", "value": "אלבה"}, {"locale": 7, "value": "x"}]}, {"code": 5, "label": "No"}, {"code": "b_2mp", "label": 9}, None, "text", {"code": "b_3mp", "label": "Brio", "label_translations": "none"}]}, {"values": "none"}, 3]}, ensure_ascii=False),),
    (json.dumps({"values_lists": "none"}),),
    ("not json",),
]
PAYLOADS = _rows("value", _PAYLOADS)
PAYLOADS_SQL = duck("value", _PAYLOADS)

_LATIN = [("Phoenix",), ("Bach & Co",), ("xylophone",), ("Chloris",), ("quick hh",), ("",), ("Mississippi",), ("KX",), ("Selected Ones",), ("Materna",)]
LATIN, LATIN_SQL = _rows("name", _LATIN), duck("name", _LATIN)
_HEBREW = [("מטרנה",), ("גרנייה",), ("קליניק",), ("שלוםם",), ("דאון טאון",), ("ג'וליה",), ("אופוריה",), ("אי בי",), ("",)]
HEBREW, HEBREW_SQL = _rows("name", _HEBREW), duck("name", _HEBREW)

_RANKED = [(1, r, f"c{r}", 1.0 - r / 100, r in (6, 7, 9)) for r in range(1, 10)] + [(2, r, f"c{r}", 1.0 - r / 50, r == 1) for r in range(1, 8)] + [(3, r, f"c{r}", 0.5, False) for r in range(1, 4)]
RANKED, RANKED_SQL = _rows("query_id, rank, code, score, across", _RANKED), duck("query_id, rank, code, score, across", _RANKED)

_CANDIDATE = "query_id, rank, code, score, match_type, partial_match, across, input_length, candidate_length, edit_distance, input_tokens, candidate_tokens, is_prefix_variant, exact, source, skeleton_match, skeleton, sound_similarity, similarity"


def _same(q, r, score, kind, partial=False, n=8, m=8, d=1, t=1, u=1, prefix=False):
    return (q, r, f"c{r}", score, kind, partial, False, n, m, d, t, u, prefix, False, "", False, "", 0.0, 0.0)


def _across(q, r, score, kind, exact=False, source="GENERATED", match=False, skeleton="", heard=0.0, alike=0.7, partial=False):
    return (q, r, f"c{r}", score, kind, partial, True, 0, 0, 0, 0, 0, False, exact, source, match, skeleton, heard, alike)


_CANDIDATES = [
    _same(1, 1, 1.0, "NORMALIZED_EXACT"), _same(2, 1, 0.97, "COMPACT_EXACT"), _same(3, 1, 0.9, "HIGH_FUZZY"), _same(4, 1, 0.9, "HIGH_FUZZY", n=5, m=5), _same(5, 1, 0.9, "HIGH_FUZZY", prefix=True),
    _same(6, 1, 0.7, "POSSIBLE_TYPO"), _same(7, 1, 0.75, "POSSIBLE_TYPO"), _same(8, 1, 0.9, "RELATED_NAME", partial=True), _same(9, 1, 0.5, "RELATED_NAME"), _same(10, 1, 0.3, "WEAK_SIMILARITY"),
    _across(10, 2, 0.6, "CROSS_LANGUAGE_POSSIBLE_MATCH", match=True, skeleton="prtnm"), _across(11, 1, 0.99, "TRANSLITERATION_EXACT", exact=True, source="CURATED"), _across(12, 1, 0.94, "TRANSLITERATION_EXACT", exact=True),
    _across(13, 1, 0.9, "TRANSLITERATION_FUZZY", alike=0.9), _across(14, 1, 0.7, "CROSS_LANGUAGE_POSSIBLE_MATCH", heard=0.73, alike=0.73), _across(15, 1, 0.7, "CROSS_LANGUAGE_POSSIBLE_MATCH", match=True, skeleton="prt"),
    _same(16, 1, 0.6, "POSSIBLE_TYPO"), _same(16, 2, 1.0, "APPROVED_ALIAS"),
]
_C = [tuple(None if k == 17 and v == 0.0 else v for k, v in enumerate(r)) for r in _CANDIDATES]
CANDIDATES, CANDIDATES_SQL = _rows(_CANDIDATE, _C), duck(_CANDIDATE, _C)

_ALIASES = [(1, "b_900mp", "Old Anvil", "BLUE ANVIL"), (2, "b_901mp", "New Anvil", "blue-anvil"), (3, "b_902mp", "Tomy", "טומי"), (4, "b_903mp", "Nobody", " . ")]
ALIASES, ALIASES_SQL = _rows("ord, code, label, alias", _ALIASES), duck("ord, code, label, alias", _ALIASES)

_RECORDS = [(1, "L'Alba", "ל'אלבה", ["LAlba", "Alba"], ["אלבה"]), (2, "Rose", "רוז", [], []), (3, "Veloria", "ולוריה", ["Gold"], []), (4, "Nimra", "נמרה", [], ["נימרה"])]
RECORDS = _rows("record_id, latin, hebrew, latin_alternatives, hebrew_alternatives", _RECORDS)
RECORDS_SQL = duck("record_id, latin, hebrew, latin_alternatives, hebrew_alternatives", _RECORDS)

_VARIANTS = [(1, 0, "alba", "GENERATED", 0.75), (1, 1, "elba", "GENERATED", 0.59), (1, 2, "alba", "CURATED", 1.0), (2, 0, "x", "ORIGINAL", 1.0), (2, 1, "x", "CURATED", 1.0)]
VARIANTS, VARIANTS_SQL = _rows("query_id, seq, value, source, confidence", _VARIANTS), duck("query_id, seq, value, source, confidence", _VARIANTS)

_SOUNDS = [
    ("גרנייה", "garnier"), ("קליניק", "clinique"), ("פאיו", "payot"), ("קשרל", "cacharel"), ("זייס", "zeiss"), ("טומי", "tommy"), ("קונברס", "converse"), ("קסרגוף", "xerjoff"), ("materna", "מטרנה"),
    ("isostar", "איזוסטאר"), ("always", "אולוויז"), ("tresemme", "טרזמה"), ("zenvora", "קנור"), ("quorali", "קורס"), ("orvexa", "אורפיקס"), ("quorali", "קרלי"), ("זילורה", "silver"), ("zylora", "סיילור"),
    ("לואבה", "love"), ("לואבה", "loewe"), ("tommy", "טעמי"), ("דאון טאון", "downtown"), ("דיאור הום", "dior"), ("הילפיגר", "tommy hilfiger"), ("קלואה", "cloud"), ("alba", "alba"),
]
SOUND_PAIRS = _rows("a, b", _SOUNDS)

_CREDIBLE = [(1, 0.5, True, 0.59, False, "", "אלבה"), (2, 0.5, True, 0.43, False, "", "אלבה"), (3, 0.5, False, 0.75, True, "klnk", "קליניק"), (4, 0.9, False, 0.75, False, "", "קליניק"), (5, 0.96, False, 0.75, False, "", "קליניק"), (6, 0.73, False, 0.75, False, "", "קליניקה טובה"), (7, 0.71, False, 0.75, True, "kln", "קליניקה טובה")]
CREDIBLE, CREDIBLE_SQL = _rows("id, similarity, exact, confidence, skeleton_match, skeleton, variant", _CREDIBLE), duck("id, similarity, exact, confidence, skeleton_match, skeleton, variant", _CREDIBLE)

_EVIDENCE = [
    (1, "a", "spelling", 0.9, "TRANSLITERATION_EXACT", False, False, "", 0.9, 1), (1, "a", "sound", 0.95, "TRANSLITERATION_FUZZY", False, False, "SAME", 1.0, 1),
    (2, "a", "spelling", 0.9, "TRANSLITERATION_FUZZY", True, False, "", 0.9, 1), (2, "a", "sound", 0.8, "CROSS_LANGUAGE_POSSIBLE_MATCH", False, False, "SAME", 0.85, 1),
    (3, "a", "spelling", 0.9, "TRANSLITERATION_FUZZY", True, False, "", 0.9, 1), (3, "a", "sound", 0.8, "CROSS_LANGUAGE_POSSIBLE_MATCH", True, False, "SUBSET", 0.85, 1),
    (4, "a", "spelling", 0.7, "CROSS_LANGUAGE_POSSIBLE_MATCH", False, True, "", 0.7, 1), (4, "a", "sound", 0.8, "CROSS_LANGUAGE_POSSIBLE_MATCH", False, False, "SAME", 0.85, 1),
    (5, "a", "spelling", 0.7, "CROSS_LANGUAGE_POSSIBLE_MATCH", False, False, "", 0.7, 1), (5, "a", "sound", 0.8, "CROSS_LANGUAGE_POSSIBLE_MATCH", False, False, "SAME", 0.85, 1),
    (6, "a", "spelling", 0.7, "CROSS_LANGUAGE_POSSIBLE_MATCH", False, False, "", 0.7, 1), (7, "b", "sound", 0.8, "CROSS_LANGUAGE_POSSIBLE_MATCH", False, False, "SAME", 0.85, 1),
]
_EVIDENCE_COLUMNS = "query_id, code, kind, score, match_type, partial_match, skeleton_match, relation, similarity, position"
EVIDENCE, EVIDENCE_SQL = _rows(_EVIDENCE_COLUMNS, _EVIDENCE), duck(_EVIDENCE_COLUMNS, _EVIDENCE)

_CODES = [("b_7mp",), ("b_12345678901234567890mp",), ("b_99",), ("x_100mp",), ("b_012mp",)]
CODES, CODES_SQL = _rows("code", _CODES), duck("code", _CODES)
_CHOSEN = [(4, "Alba"), (2, "Brio"), (9, "Cora")]
CHOSEN, CHOSEN_SQL = _rows("id, brand", _CHOSEN), duck("id, brand", _CHOSEN)

RULES = json.dumps(
    {
        "existing_project_brand_overrides": [{"latin": "L'Alba", "hebrew": "ל'אלבה", "hebrew_alternatives": ["אלבה"]}, {"latin": "Rose", "hebrew": "רוז"}],
        "english_to_hebrew": {"latin_letter_names_for_acronyms": {"A": "איי", "B": "בי", "C": "סי", "E": "אי", "H": "אייץ'", "I": "איי", "K": "קיי", "Q": "קיו", "X": "אקס"}},
    },
    ensure_ascii=False,
)
_LABELS = ["VELORIA", "CLINIQUE", "מטרנה", "TOMMY HILFIGER", "L'ALBA", "אופוריה", "GUCCI", "DIOR", "NIMRA HOME", "ברברי", "COACH"]
BRANDS = _rows("brand_ord, code, label", [(k, f"b_{k}mp", x) for k, x in enumerate(_LABELS)])
_NAMES = ["veloria", "Velorai", "Velorria", "ve loria", "קליניק", "Materna", "הילפיגר", "Euphoria", "גוצ'י", "דיאור הום", "nimra", "Nimra Home Deluxe", "אלבה", "Burberry", "קואץ", "CK", "zenvora", "", "ｇｕｃｃｉ", "טומי"]
NAMES = _rows("query_id, raw", [(k, x) for k, x in enumerate(_NAMES)])
