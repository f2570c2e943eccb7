"""DuckDB SQL for the queries that SQL can express, written apart from the plans that it checks."""

from __future__ import annotations

from onomast.plans import samples as s

_V = "v AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (SELECT DISTINCT p_name AS name FROM part))"
_SLIPS = f"{_V}, slips AS (SELECT i * 8 + k AS query_id, {s.SLIP} AS raw, name FROM v, (SELECT unnest(range(8)) AS k))"
_SPACES = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACES}+', ''), '{_SPACES}+$', '')"


def _normal(x: str) -> str:
    x = f"coalesce({x}, '')"
    for pattern, to in (
        (r"[\x{061C}\x{200B}-\x{200F}\x{FEFF}]", ""), (r"[''\x{2018}-\x{201B}\x{2032}\x{2035}`\x{05F3}]", "''"), (r"[\x{201C}-\x{201F}\x{2033}\x{2036}\x{05F4}]", '"'),
        (r"[-\x{058A}\x{05BE}\x{2010}-\x{2015}\x{2212}_\x{FE58}\x{FE63}\x{FF0D}]+", " "), (r"[&\x{FF06}]+", " "), (r"[.,;:!?()\[\]{}/\\]+", " "), (f"{_SPACES}+", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return _trim(f"regexp_replace(lower({x}), '{_SPACES}+', ' ', 'g')")


def _compact(x: str) -> str:
    return f"regexp_replace({x}, '{_SPACES}+', '', 'g')"


def _osa(source: str, name: str = "osa") -> str:
    """CTEs: the edit distance of the distinct pairs (a, b) of ``source``."""
    return f"""{name}_s AS (
  SELECT a, b, length(b) + 1 AS w, (length(a) + 1) * (length(b) + 1) AS n, CAST([] AS INTEGER[]) AS d, 0 AS k FROM (SELECT DISTINCT a, b FROM {source})
  UNION ALL
  SELECT a, b, w, n, list_append(d, CAST(CASE WHEN k // w = 0 THEN k % w WHEN k % w = 0 THEN k // w ELSE least(d[k - w + 1] + 1, d[k] + 1,
      d[k - w] + CASE WHEN substr(a, k // w, 1) = substr(b, k % w, 1) THEN 0 ELSE 1 END,
      CASE WHEN k // w > 1 AND k % w > 1 AND substr(a, k // w, 1) = substr(b, k % w - 1, 1) AND substr(a, k // w - 1, 1) = substr(b, k % w, 1) THEN d[k - 2 * w - 1] + 1 ELSE 9999 END) END AS INTEGER)), k + 1
  FROM {name}_s WHERE k < n),
{name} AS (SELECT a, b, d[n] AS d FROM {name}_s WHERE k = n)"""


def _tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _grams(x: str) -> str:
    return f"CASE WHEN length({x}) > 1 THEN list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))) WHEN length({x}) = 1 THEN [{x}] ELSE CAST([] AS VARCHAR[]) END"


def _signals(source: str) -> str:
    """CTEs down to ``sig``: the signals of the distinct pairs (a, b) of ``source``."""
    return f"""pt AS (SELECT DISTINCT a, b FROM {source}),
tok0 AS (SELECT t, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT t, {_tokens('t')} AS ws FROM (SELECT a AS t FROM pt UNION SELECT b FROM pt))),
tok AS (SELECT t, ws[i] AS w, min(i) AS pos FROM tok0 GROUP BY t, ws[i]),
tp AS (SELECT pt.a, pt.b, x.w AS x, y.w AS y, x.pos AS xp, y.pos AS yp FROM pt JOIN tok x ON x.t = pt.a JOIN tok y ON y.t = pt.b),
allp AS (SELECT a, b FROM pt UNION SELECT x, y FROM tp),
{_osa('allp')},
ts AS (SELECT tp.a, tp.b, tp.x, tp.y, tp.xp, tp.yp, 1 - osa.d / greatest(length(tp.x), length(tp.y)) AS sim FROM tp JOIN osa ON osa.a = tp.x AND osa.b = tp.y),
there AS (SELECT a, b, sum(best ORDER BY xp) AS total, count(*) AS n FROM (SELECT a, b, xp, max(sim) AS best FROM ts GROUP BY a, b, xp) GROUP BY a, b),
back AS (SELECT a, b, sum(best ORDER BY yp) AS total, count(*) AS n FROM (SELECT a, b, yp, max(sim) AS best FROM ts GROUP BY a, b, yp) GROUP BY a, b),
tsim AS (SELECT there.a, there.b, (there.total + back.total) / (there.n + back.n) AS token_similarity FROM there JOIN back ON back.a = there.a AND back.b = there.b),
sig0 AS (
  SELECT pt.a, pt.b, osa.d, length(pt.a) AS la, length(pt.b) AS lb, greatest(length(pt.a), length(pt.b)) AS most, least(length(pt.a), length(pt.b)) AS least_,
    {_tokens('pt.a')} AS wa, {_tokens('pt.b')} AS wb, {_grams('pt.a')} AS ga, {_grams('pt.b')} AS gb,
    coalesce(list_min(list_filter(range(1, least(length(pt.a), length(pt.b)) + 1), lambda i: substr(pt.a, i, 1) <> substr(pt.b, i, 1))) - 1, least(length(pt.a), length(pt.b))) AS prefix,
    coalesce(tsim.token_similarity, CASE WHEN trim(pt.a) = '' AND trim(pt.b) = '' THEN 1.0 ELSE 0.0 END) AS token_similarity
  FROM pt JOIN osa ON osa.a = pt.a AND osa.b = pt.b LEFT JOIN tsim ON tsim.a = pt.a AND tsim.b = pt.b),
sig1 AS (
  SELECT *, CASE WHEN most = 0 THEN 1.0 ELSE 1 - d / most END AS edit,
    CASE WHEN la = 0 AND lb = 0 THEN 1.0 WHEN la = 0 OR lb = 0 THEN 0.0 ELSE 2 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) END AS gram,
    CASE WHEN least_ = 0 THEN 0.0 ELSE prefix / least_ END AS consistency, CASE WHEN most = 0 THEN 1.0 ELSE 1 - (most - least_) / most END AS size,
    la = lb AND d = 1 AND levenshtein(a, b) = 2 AS swapped, a <> b AND (starts_with(a, b) OR starts_with(b, a)) AS chars,
    len(wa) <> len(wb) AND wa[1:least(len(wa), len(wb))] = wb[1:least(len(wa), len(wb))] AS words,
    list_filter(range(1, la + 1), lambda i: la = lb AND substr(a, i, 1) <> substr(b, i, 1)) AS unlike
  FROM sig0),
wordpairs AS (
  SELECT DISTINCT pt.a, pt.b, wa[i] AS x, wb[i] AS y FROM (SELECT a, b, wa, wb, unnest(range(1, len(wa) + 1)) AS i FROM sig0 WHERE len(wa) = len(wb) AND len(wa) > 1) pt),
differ AS (
  SELECT p.a, p.b, bool_or(x <> y AND o.d > CASE WHEN least(length(x), length(y)) >= 5 THEN 2 ELSE 1 END) AS differ FROM wordpairs p JOIN osa o ON o.a = p.x AND o.b = p.y GROUP BY p.a, p.b),
{_KEYS},
sig AS (
  SELECT s.*, edit * 0.5::DOUBLE + gram * 0.3::DOUBLE + token_similarity * 0.1::DOUBLE + size * 0.05::DOUBLE + consistency * 0.05::DOUBLE AS score,
    CASE WHEN len(wa) > len(wb) THEN s.d > len(wa) - len(wb) + 1 WHEN len(wa) < 2 OR len(wa) <> len(wb) THEN false ELSE coalesce(differ.differ, false) END AS partial,
    CASE WHEN s.d = 1 AND len(unlike) = 1 THEN NOT {_plausible('substr(s.a, unlike[1], 1)', 'substr(s.b, unlike[1], 1)')} ELSE false END AS far
  FROM sig1 s LEFT JOIN differ ON differ.a = s.a AND differ.b = s.b
  LEFT JOIN keys p ON p.c = substr(s.a, unlike[1], 1) LEFT JOIN keys q ON q.c = substr(s.b, unlike[1], 1))"""


#: Keys as text, written out again for the check.
_KEYS = """keys AS (
  SELECT substr(k, i::BIGINT, 1) AS c, r, i FROM (VALUES ('qwertyuiop', 0), ('asdfghjkl;', 1), ('zxcvbnm,.', 2), ('  קראטוןםפ', 0), ('שדגכעיחלךף', 1), ('זסבהנמצתץ', 2)) t(k, r), (SELECT unnest(range(1, 11)) AS i)
  WHERE substr(k, i::BIGINT, 1) NOT IN ('', ' '))"""
_ALIKE = "['טת', 'כקך', 'סש', 'אעה', 'בו', 'חכך', 'מם', 'נן', 'פף', 'צץ', 'ckq', 'cs', 'sz', 'iy', 'vw', 'aeiouy']"


def _plausible(a: str, b: str) -> str:
    """Over joined keys p and q of the two letters."""
    return f"""({a} = {b} OR len(list_filter({_ALIKE}, lambda g: contains(g, {a}) AND contains(g, {b}))) > 0 OR p.r IS NULL OR q.r IS NULL
      OR (p.r = q.r AND abs(p.i - q.i) = 1) OR (q.r = p.r + 1 AND (q.i = p.i OR q.i = p.i - 1)) OR (p.r = q.r + 1 AND (p.i = q.i OR p.i = q.i - 1)))"""


_KIND = """CASE WHEN far THEN 'WEAK_SIMILARITY' WHEN words THEN 'RELATED_NAME' WHEN d <= 1 AND len(wa) = len(wb) THEN CASE WHEN score >= 0.82 THEN 'HIGH_FUZZY' ELSE 'POSSIBLE_TYPO' END
  WHEN token_similarity >= 0.5 AND len(wa) = len(wb) THEN 'TOKEN_VARIANT' WHEN score >= 0.6 THEN 'POSSIBLE_TYPO' ELSE 'WEAK_SIMILARITY' END"""
_SCORE = "CASE WHEN words THEN least(1.0, CASE WHEN far THEN score - 0.5 / most ELSE score END + 0.22) WHEN far THEN score - 0.5 / most ELSE score END"
_REASON = f"""CASE WHEN far THEN 'One letter replaced by a letter far from it on the keyboard; not a likely typo'
  WHEN words THEN 'One normalized brand is a token prefix of the other; the added token may identify a distinct product line'
  WHEN d = 1 AND swapped THEN 'Adjacent character transposition compared with the existing normalized brand'
  WHEN d = 1 AND most - least_ = 1 THEN 'One-character insertion or deletion compared with the existing normalized brand'
  WHEN d = 1 THEN 'One-character character replacement compared with the existing normalized brand'
  WHEN d = 2 THEN '2-character edit distance with overlapping character and token signals'
  WHEN ({_KIND}) = 'TOKEN_VARIANT' THEN 'Shared tokens with a different token; the names may represent related values'
  ELSE 'Moderate character similarity without a deterministic exact match' END"""

_SLIP_PAIRS = f"{_SLIPS}, pairs AS (SELECT DISTINCT {_normal('raw')} AS a, name AS b FROM slips)"
_ALL_PAIRS = f"{_V}, pairs AS (SELECT x.name AS a, y.name AS b FROM v x, v y)"


def _entries() -> str:
    return "e AS (SELECT i * 4096 AS entry_ord, 'b_' || i || 'mp' AS code, name AS label, " + f"{_normal('name')} AS normalized, {_compact(_normal('name'))} AS compact FROM v)"


def _repeats(x: str, drop: str) -> str:
    kept = f"array_to_string(list_filter(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN substr({x}, i, 1) = substr({x}, i - 1, 1) AND i > 1 THEN '' ELSE substr({x}, i, 1) END), lambda c: c <> ''), '')"
    return f"coalesce(regexp_replace({kept}, '{drop}', '', 'g'), '')"


def _skeleton(x: str) -> str:
    x = f"lower({x})"
    for p, to in (("ph", "p"), ("f", "p"), ("x", "ks"), ("ch", "k"), ("[cq]", "k"), ("[aeiouwyv]", "")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    # RE2 has neither lookahead nor back references: letters are judged one by one
    x = f"coalesce(array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN substr({x}, i, 1) = 'h' AND NOT regexp_matches(substr({x}, i + 1, 1), '[a-z]') THEN '' ELSE substr({x}, i, 1) END), ''), '')"
    return _repeats(x, "[^a-z0-9]")


def _posted(entries: str) -> str:
    return f"""{_V}, {entries},
posted AS (
  SELECT 'norm' AS channel, normalized AS key, entry_ord FROM e UNION ALL SELECT 'compact', compact, entry_ord FROM e UNION ALL SELECT 'prefix2', substr(compact, 1, 2), entry_ord FROM e
  UNION ALL SELECT 'first1', substr(compact, 1, 1), entry_ord FROM e UNION ALL SELECT 'bigram', unnest({_grams('compact')}), entry_ord FROM e)"""


_POSTINGS = _posted(_entries())
# names in Latin letters are their own romanization
_ROMANIZED = f"""romanized AS (
  SELECT 'tr_exact' AS channel, normalized AS key, entry_ord FROM e UNION ALL SELECT 'tr_prefix2', substr(normalized, 1, 2), entry_ord FROM e
  UNION ALL SELECT 'tr_bigram', unnest({_grams('normalized')}), entry_ord FROM e
  UNION ALL SELECT 'tr_skel', key, entry_ord FROM (SELECT {_skeleton('normalized')} AS key, entry_ord FROM e) WHERE length(key) >= 3)"""


def _pool(queries: str, posted: str = _POSTINGS) -> str:
    """CTEs down to ``pool`` for ``queries`` (query_id, raw)."""
    return f"""{posted},
q AS (SELECT query_id, raw, {_normal('raw')} AS normalized, {_compact(_normal('raw'))} AS compact FROM ({queries})),
look AS (
  SELECT query_id, 0 AS seq, 'norm' AS channel, normalized AS key, 1000 AS weight FROM q UNION ALL SELECT query_id, 1, 'compact', compact, 900 FROM q
  UNION ALL SELECT query_id, 2, 'prefix2', substr(compact, 1, 2), 5 FROM q UNION ALL SELECT query_id, 3, 'first1', substr(compact, 1, 1), 2 FROM q
  UNION ALL SELECT query_id, 3 + min(i), 'bigram', g, 1 FROM (SELECT query_id, i, substr(compact, i, 2) AS g FROM (SELECT query_id, compact, unnest(range(1, length(compact))) AS i FROM q)) GROUP BY query_id, g),
hits AS (SELECT query_id, entry_ord, weight, seq FROM look JOIN posted USING (channel, key) WHERE key <> ''),
pool AS (
  SELECT query_id, entry_ord, retrieval_score, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, first, entry_ord) AS pool_rank
  FROM (SELECT query_id, entry_ord, sum(weight)::BIGINT AS retrieval_score, min(seq) AS first FROM hits GROUP BY query_id, entry_ord) QUALIFY pool_rank <= 100)"""


def _candidates(queries: str) -> str:
    """CTEs down to ``cand``: the ranked candidates of one script."""
    return f"""{_pool(queries)},
comp AS (SELECT pool.query_id, pool_rank, code, label, q.normalized AS a, e.normalized AS b, q.compact AS ca, e.compact AS cb FROM pool JOIN q USING (query_id) JOIN e USING (entry_ord)),
fuzzy AS (SELECT a, b FROM comp WHERE a <> b AND ca <> cb),
{_signals('fuzzy')},
scored AS (
  SELECT query_id, pool_rank, code, label, CASE WHEN comp.a = comp.b THEN 1.0 WHEN ca = cb THEN 0.97 ELSE {_SCORE} END::DOUBLE AS score,
    CASE WHEN comp.a = comp.b THEN 'NORMALIZED_EXACT' WHEN ca = cb THEN 'COMPACT_EXACT' ELSE {_KIND} END AS match_type,
    coalesce(partial, false) AS partial_match, d, la, lb, len(wa) AS ta, len(wb) AS tb, chars OR words AS prefixed
  FROM comp LEFT JOIN sig ON sig.a = comp.a AND sig.b = comp.b),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY partial_match, score DESC, pool_rank) AS rank FROM scored)"""


def _decisions(queries: str, review: float = 0.75) -> str:
    """CTEs down to ``dec``."""
    return f"""{_candidates(queries)},
top5 AS (SELECT * FROM cand WHERE rank <= 5),
best AS (SELECT * FROM top5 WHERE NOT partial_match QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1),
dec AS (
  SELECT q.query_id, q.raw, q.normalized, CASE WHEN x.n > 0 THEN 'BLOCK' WHEN b.score IS NULL THEN 'ALLOW' WHEN b.typo THEN 'BLOCK' WHEN b.review THEN 'HUMAN_REVIEW' ELSE 'ALLOW' END AS decision,
    CASE WHEN x.n > 0 THEN 1.0 WHEN b.score IS NULL THEN 1.0 WHEN b.typo OR b.review THEN b.score ELSE 1 - b.score END AS confidence
  FROM q LEFT JOIN (SELECT query_id, count(*) FILTER (match_type = 'NORMALIZED_EXACT') AS n FROM top5 GROUP BY query_id) x USING (query_id)
  LEFT JOIN (SELECT query_id, score, match_type = 'HIGH_FUZZY' AND score >= 0.8 AND d = 1 AND ta = tb AND NOT prefixed AND least(la, lb) >= 6 AS typo,
      match_type IN ('COMPACT_EXACT', 'RELATED_NAME') OR score >= {review} AS review FROM best) b USING (query_id))"""


_ALIKE_NAMES = "SELECT i AS k, name FROM v UNION ALL SELECT s_suppkey + 1000, s_name FROM supplier"
_SUPPLIER_POOL = _pool("SELECT s_suppkey AS query_id, s_name AS raw FROM supplier", _posted(f"e AS (SELECT k * 4096 AS entry_ord, {_normal('name')} AS normalized, {_compact(_normal('name'))} AS compact FROM ({_ALIKE_NAMES}))"))
_SLIP_QUERIES = f"WITH {_SLIPS} SELECT query_id, raw FROM slips"


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_REPORT = f"""{_decisions(_SLIP_QUERIES)},
rep AS (SELECT query_id, regexp_replace(raw, '[\\r\\n]+', ' ', 'g') AS brand, CASE decision WHEN 'ALLOW' THEN 'ALLOW' ELSE 'REVIEW' END AS outcome FROM dec),
names AS (SELECT query_id, list(label || ' (' || code || ')' ORDER BY rank) AS names FROM top5 GROUP BY query_id)"""
_NAMES = "CASE WHEN outcome = 'ALLOW' THEN '' ELSE coalesce(array_to_string(names, '; '), '') END"


def _quote(x: str) -> str:
    return f"'\"' || replace({x}, '\"', '\"\"') || '\"'"


def _hebrew_skeleton(x: str) -> str:
    return _repeats(f"regexp_replace(translate({x}, 'ךםןףץ', 'כמנפצ'), '[אויעה]', '', 'g')", r"[^\x{05D0}-\x{05EA}]")


_SCRIPT = f"""CASE WHEN {_trim("coalesce(raw, '')")} = '' THEN 'OTHER' WHEN regexp_matches(raw, '[\\x{{0590}}-\\x{{05FF}}]') AND regexp_matches(raw, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]') THEN 'MIXED'
  WHEN regexp_matches(raw, '[\\x{{0590}}-\\x{{05FF}}]') THEN 'HEBREW' WHEN regexp_matches(raw, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]') THEN 'LATIN' ELSE 'NUMERIC_OR_SYMBOL' END"""
_EXCLUDED = "('rose'), ('gold')"

ORACLES = {
    "normalize_names": f"""SELECT raw, {_normal('nfc_normalize(raw)')} AS normalized, {_compact(_normal('nfc_normalize(raw)'))} AS compact FROM (
      SELECT p_name AS raw FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer UNION SELECT text FROM documents)""",
    "detect_script": f"SELECT raw, {_SCRIPT} AS script FROM ({s.SCRIPTS_SQL} UNION SELECT text FROM documents)",
    "cross_script_pairs": f"""WITH x AS (SELECT DISTINCT {_SCRIPT} AS s FROM ({s.SCRIPTS_SQL}))
      SELECT a.s AS query_script, b.s AS entry_script, (a.s IN ('HEBREW', 'MIXED') AND b.s = 'LATIN') OR (a.s = 'LATIN' AND b.s IN ('HEBREW', 'MIXED')) AS compared FROM x a, x b""",
    "parse_name_list": f"""SELECT file, (row_number() OVER (PARTITION BY file ORDER BY i))::INT AS place, raw FROM (
      SELECT file, i, {_trim('parts[i]')} AS raw FROM (SELECT file, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
        SELECT file, string_split_regex(regexp_replace(value, '^\\x{{FEFF}}', ''), '\\r?\\n') AS parts FROM ({s.LISTS_SQL})))) WHERE raw <> ''""",
    "adapt_catalogue_json": f"""WITH p AS (SELECT value::JSON AS v FROM ({s.PAYLOADS_SQL}) WHERE json_valid(value)),
      l AS (SELECT unnest(CASE WHEN json_type(v, '$.values_lists') = 'ARRAY' THEN CAST(v -> '$.values_lists' AS JSON[]) ELSE CAST([] AS JSON[]) END) AS l FROM p),
      b AS (SELECT unnest(CASE WHEN json_type(l, '$.values') = 'ARRAY' THEN CAST(l -> '$.values' AS JSON[]) ELSE CAST([] AS JSON[]) END) AS b FROM l)
      SELECT b ->> '$.code' AS code, b ->> '$.label' AS label, CASE WHEN json_type(b, '$.label_translations') <> 'ARRAY' OR json_type(b, '$.label_translations') IS NULL THEN '' ELSE
        coalesce('[' || nullif(array_to_string(list_transform(list_filter(CAST(b -> '$.label_translations' AS JSON[]), lambda t: json_type(t, '$.locale') = 'VARCHAR' AND json_type(t, '$.value') = 'VARCHAR'),
          lambda t: '{{"locale":"' || (t ->> '$.locale') || '","value":"' || (t ->> '$.value') || '"}}'), ','), '') || ']', '') END AS translations
      FROM b WHERE json_type(b, '$.code') = 'VARCHAR' AND json_type(b, '$.label') = 'VARCHAR'""",
    "bigram_postings": f"WITH {_POSTINGS} SELECT key, entry_ord FROM posted WHERE channel = 'bigram'",
    "posting_stats": f"""WITH {_POSTINGS}, {_ROMANIZED}
      SELECT channel, count(*) AS postings, count(DISTINCT key) AS keys FROM (FROM posted UNION ALL FROM romanized) GROUP BY channel""",
    "osa_pairs": _with(f"{_ALL_PAIRS}, {_osa('pairs')}", "SELECT a, b, d AS osa FROM osa"),
    "osa_kernel": _with(f"{_ALL_PAIRS}, {_osa('pairs')}", "SELECT a, b, d AS osa FROM osa"),
    "dice_pairs": f"WITH {_ALL_PAIRS} SELECT a, b, round(2 * len(list_intersect({_grams('a')}, {_grams('b')})) / (len({_grams('a')}) + len({_grams('b')})), 6) AS dice FROM pairs",
    "token_similarity_pairs": _with(f"{_ALL_PAIRS}, {_signals('pairs')}", "SELECT a, b, round(token_similarity, 6) AS token_similarity FROM sig"),
    "prefix_signals": _with(f"{_SLIP_PAIRS}, every AS (SELECT a, b FROM pairs UNION SELECT x.name, y.name FROM v x, v y), {_signals('every')}", "SELECT a, b, prefix::INT AS common_prefix, words AS token_prefix FROM sig"),
    "transposition_pairs": f"""WITH {_SLIP_PAIRS} SELECT a, b, coalesce(length(a) = length(b) AND a <> b AND i < length(a) AND substr(a, i, 1) = substr(b, i + 1, 1) AND substr(a, i + 1, 1) = substr(b, i, 1) AND substr(a, i + 2) = substr(b, i + 2), false) AS transposed
      FROM (SELECT a, b, list_min(list_filter(range(1, length(a) + 1), lambda k: substr(a, k, 1) <> substr(b, k, 1))) AS i FROM pairs)""",
    "composite_similarity": _with(f"{_SLIP_PAIRS}, {_signals('pairs')}", "SELECT a, b, round(score, 6) AS score, d AS edit_distance, round(gram, 6) AS ngram_similarity, chars OR words AS is_prefix_variant FROM sig"),
    "fuzzy_class": _with(f"{_SLIP_PAIRS}, {_signals('pairs')}", f"SELECT a, b, {_KIND} AS match_type, round({_SCORE}, 6) AS score, {_REASON} AS reason FROM sig WHERE a <> b"),
    "partial_match": _with(f"{_SLIP_PAIRS}, every AS (SELECT a, b FROM pairs UNION SELECT x.name, y.name FROM v x, v y), {_signals('every')}", "SELECT a, b, partial FROM sig"),
    "single_substitution": f"""WITH {_SLIP_PAIRS} SELECT a, b, substr(a, u[1], 1) AS l, substr(b, u[1], 1) AS r FROM (
      SELECT a, b, list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)) AS u FROM pairs WHERE length(a) = length(b)) WHERE len(u) = 1""",
    "keyboard_plausible": f"WITH {_KEYS}, l AS (SELECT unnest(string_split('{s.LETTERS}', '')) AS l) SELECT a.l, b.l AS r, {_plausible('a.l', 'b.l')} AS plausible FROM l a CROSS JOIN l b LEFT JOIN keys p ON p.c = a.l LEFT JOIN keys q ON q.c = b.l",
    "retrieve_same_script": f"WITH {_pool(_SLIP_QUERIES)} SELECT query_id, entry_ord, retrieval_score, pool_rank::INT AS pool_rank FROM pool",
    "candidates_top5": _with(_candidates(_SLIP_QUERIES), "SELECT query_id, rank::INT AS rank, code, round(score, 6) AS score, match_type, partial_match FROM cand WHERE rank <= 5"),
    "check_names": _with(_decisions(_SLIP_QUERIES), """SELECT dec.query_id, raw AS input, decision, round(confidence, 6) AS confidence, count(top5.rank)::INT AS candidates, coalesce(min(code) FILTER (top5.rank = 1), '') AS best
      FROM dec LEFT JOIN top5 USING (query_id) GROUP BY ALL"""),
    "check_names_calibrated": _with(_decisions(_SLIP_QUERIES, 0.68), "SELECT query_id, decision, round(confidence, 6) AS confidence FROM dec"),
    "reserved_slots": f"""WITH r AS ({s.RANKED_SQL}), g AS (SELECT *, across AND sum(across::INT) OVER (PARTITION BY query_id ORDER BY rank) <= 2 AS held FROM r),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id, held ORDER BY rank) AS k, count(*) FILTER (held) OVER (PARTITION BY query_id) AS n FROM g)
      SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank, code, score FROM t WHERE held OR k <= 5 - n""",
    "decide_rules": f"""WITH c AS ({s.CANDIDATES_SQL}),
      w AS (SELECT *, across AND (exact OR (skeleton_match AND length(skeleton) >= 5) OR (sound_similarity IS NOT NULL AND similarity >= 0.72)) AS evidence FROM c
            WHERE NOT partial_match AND NOT (across AND NOT exact AND sound_similarity IS NULL AND NOT skeleton_match)),
      t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1), v AS (SELECT query_id, arg_min(score, rank) AS score FROM w WHERE evidence GROUP BY query_id),
      b AS (SELECT query_id, min(CASE WHEN match_type = 'NORMALIZED_EXACT' AND score >= 1 THEN 1 WHEN match_type = 'TRANSLITERATION_EXACT' AND exact AND source = 'CURATED' AND score >= 0.98 THEN 3 WHEN match_type = 'APPROVED_ALIAS' THEN 4 END) AS rule,
            arg_min(score, CASE WHEN match_type = 'NORMALIZED_EXACT' AND score >= 1 THEN 1 WHEN match_type = 'TRANSLITERATION_EXACT' AND exact AND source = 'CURATED' AND score >= 0.98 THEN 3 WHEN match_type = 'APPROVED_ALIAS' THEN 4 END) AS score FROM c GROUP BY query_id),
      j AS (SELECT b.query_id, b.rule, b.score AS block, t.score AS top, v.score AS ev, t.query_id IS NULL AS none,
              NOT t.across AND t.match_type = 'HIGH_FUZZY' AND t.score >= 0.8 AND edit_distance = 1 AND input_tokens = candidate_tokens AND NOT is_prefix_variant AND least(input_length, candidate_length) >= 6 AS typo,
              t.match_type IN ('COMPACT_EXACT', 'RELATED_NAME') OR v.score IS NOT NULL OR t.score >= 0.75 AS review
            FROM b LEFT JOIN t USING (query_id) LEFT JOIN v USING (query_id))
      SELECT query_id, CASE WHEN rule IS NOT NULL THEN 'BLOCK' WHEN none THEN 'ALLOW' WHEN typo THEN 'BLOCK' WHEN review THEN 'HUMAN_REVIEW' ELSE 'ALLOW' END AS decision,
        round(CASE WHEN rule IS NOT NULL THEN block WHEN none THEN 1.0 WHEN typo THEN top WHEN review THEN greatest(top, coalesce(ev, 0)) ELSE 1 - top END, 6) AS confidence FROM j""",
    "alias_lookup": f"""WITH {_SLIPS}, a AS (SELECT *, {_normal('alias')} AS n FROM ({s.ALIASES_SQL}) QUALIFY row_number() OVER (PARTITION BY n ORDER BY ord DESC) = 1)
      SELECT query_id, code, label, 'Approved alias of ' || label || ': ' || alias AS reason FROM slips JOIN a ON a.n = {_normal('raw')} WHERE a.n <> ''""",
    "curated_explode": f"""WITH r AS ({s.RECORDS_SQL}), l AS (SELECT record_id, unnest(list_concat([latin], coalesce(latin_alternatives, CAST([] AS VARCHAR[])))) AS x FROM r), h AS (SELECT record_id, unnest(list_concat([hebrew], coalesce(hebrew_alternatives, CAST([] AS VARCHAR[])))) AS x FROM r),
      bad AS (SELECT record_id FROM l JOIN (VALUES {_EXCLUDED}) t(w) ON w = {_normal('x')})
      SELECT DISTINCT l.record_id, replace({_normal('l.x')}, '''', '') AS latin, replace({_normal('h.x')}, '''', '') AS hebrew FROM l JOIN h USING (record_id) WHERE record_id NOT IN (SELECT record_id FROM bad)""",
    "curated_excluded": f"""WITH r AS ({s.RECORDS_SQL}) SELECT DISTINCT record_id FROM (SELECT record_id, unnest(list_concat([latin], coalesce(latin_alternatives, CAST([] AS VARCHAR[])))) AS x FROM r) JOIN (VALUES {_EXCLUDED}) t(w) ON w = {_normal('x')}""",
    "latin_skeleton": f"WITH {_V}, n AS (SELECT name FROM v UNION {s.LATIN_SQL}) SELECT name, {_skeleton('name')} AS skeleton FROM n",
    "hebrew_skeleton": f"SELECT name, {_hebrew_skeleton('name')} AS skeleton FROM (SELECT DISTINCT name FROM ({s.HEBREW_SQL}))",
    "skeleton_retrieval": f"""WITH {_SLIPS}, {_entries()}, {_ROMANIZED}, a AS (SELECT query_id, {_skeleton(_normal('raw'))} AS key FROM slips)
      SELECT query_id, entry_ord, 800::BIGINT AS retrieval_score FROM a JOIN romanized USING (key) WHERE channel = 'tr_skel'""",
    "retrieve_romanized": f"""WITH {_SLIPS}, {_entries()}, {_ROMANIZED}, n AS (SELECT query_id, {_normal('raw')} AS name FROM slips),
      a AS (SELECT query_id, 'tr_exact' AS channel, name AS key, 1000 AS weight FROM n UNION ALL SELECT query_id, 'tr_skel', {_skeleton('name')}, 800 FROM n
        UNION ALL SELECT query_id, 'tr_prefix2', substr(name, 1, 2), 5 FROM n UNION ALL SELECT query_id, 'tr_bigram', unnest({_grams('name')}), 1 FROM n WHERE length(name) > 1)
      SELECT query_id, entry_ord, sum(weight)::BIGINT AS retrieval_score FROM a JOIN romanized USING (channel, key) GROUP BY ALL""",
    "retrieve_pool_cut": f"WITH {_SUPPLIER_POOL} SELECT query_id, entry_ord, retrieval_score, pool_rank::INT AS pool_rank FROM pool",
    "variant_best_confidence": f"""SELECT query_id, value, source, confidence, place FROM (SELECT *, min(seq) OVER (PARTITION BY query_id, value) AS place, row_number() OVER (PARTITION BY query_id, value ORDER BY confidence DESC, seq) AS r FROM ({s.VARIANTS_SQL})) WHERE r = 1""",
    "credible_filter": f"""SELECT id, CASE WHEN exact THEN confidence >= 0.5 WHEN skeleton_match AND length(skeleton) >= 4 THEN true WHEN length(regexp_replace(variant, '\\s', '', 'g')) < 7 THEN similarity >= 0.95 ELSE similarity >= 0.72 END AS credible FROM ({s.CREDIBLE_SQL})""",
    "evidence_merge": f"""WITH e AS ({s.EVIDENCE_SQL}), a AS (SELECT * FROM e WHERE kind = 'spelling'), p AS (SELECT * FROM e WHERE kind = 'sound'),
      j AS (SELECT coalesce(a.query_id, p.query_id) AS query_id, coalesce(a.code, p.code) AS code, a, p, CASE WHEN p.code IS NULL THEN 'a' WHEN a.code IS NULL THEN 'p' WHEN a.match_type = 'TRANSLITERATION_EXACT' THEN 'x' WHEN a.score >= p.score THEN 'c' ELSE 'r' END AS how
            FROM a FULL JOIN p ON a.query_id = p.query_id AND a.code = p.code)
      SELECT query_id, code, CASE how WHEN 'x' THEN greatest(a.score, p.score) WHEN 'a' THEN a.score WHEN 'c' THEN a.score ELSE p.score END AS score, CASE WHEN how IN ('x', 'a', 'c') THEN a.match_type ELSE p.match_type END AS match_type,
        CASE how WHEN 'x' THEN a.partial_match WHEN 'a' THEN a.partial_match WHEN 'c' THEN CASE WHEN p.relation = 'SAME' THEN false ELSE a.partial_match END ELSE p.partial_match END AS partial_match,
        CASE WHEN a.skeleton_match THEN 'klnk' ELSE '' END AS skeleton, CASE WHEN how IN ('p', 'r') OR (how = 'c' AND p.relation = 'SAME') THEN p.relation ELSE '' END AS relation FROM j""",
    "report_rows": _with(_REPORT, f"SELECT query_id, brand, outcome, {_NAMES} AS candidates FROM rep LEFT JOIN names USING (query_id)"),
    "report_csv": _with(_REPORT, f"SELECT query_id, {_quote('brand')} || ',' || {_quote('outcome')} || ',' || {_quote(_NAMES)} AS line FROM rep LEFT JOIN names USING (query_id)"),
    "report_tally": _with(_REPORT, "SELECT count(*) AS checked, count(*) FILTER (outcome = 'ALLOW') AS allowed, count(*) FILTER (outcome = 'REVIEW') AS review FROM rep"),
    "report_text": _with(_REPORT, """SELECT query_id, brand || chr(10) || '    Result: ' || outcome || CASE WHEN outcome = 'ALLOW' THEN '' ELSE chr(10) || '    Existing brands to compare:' || chr(10) ||
      CASE WHEN names IS NULL THEN '      (none)' ELSE '      - ' || array_to_string(names, chr(10) || '      - ') END END AS block FROM rep LEFT JOIN names USING (query_id)"""),
    "review_selection": _with(_REPORT, "SELECT query_id AS id, brand, outcome FROM rep WHERE outcome = 'ALLOW'"),
    "review_display": _with(_REPORT, """SELECT rep.query_id AS id, (CASE WHEN outcome = 'ALLOW' THEN 0 ELSE count(cand.score) END)::INT AS shown, round(CASE WHEN outcome = 'ALLOW' THEN 0.0 ELSE coalesce(max(cand.score), 0.0) END, 6) AS best
      FROM rep LEFT JOIN cand ON cand.query_id = rep.query_id AND cand.score >= 0.75 GROUP BY rep.query_id, outcome"""),
    "allocate_codes": f"""SELECT id, brand, 'b_' || ((SELECT max(regexp_extract(code, '^b_(\\d+)mp$', 1)::HUGEINT) FROM ({s.CODES_SQL}) WHERE regexp_matches(code, '^b_\\d+mp$')) + row_number() OVER (ORDER BY id))::VARCHAR || 'mp' AS code FROM ({s.CHOSEN_SQL})""",
}
