"""DuckDB SQL that computes the merchant cascade: parsing, exact names, both similarities, families.

Only the fixed values (catalogue, families, bank operations, vocabularies) are shared with the Spark
expressions; they stand here as literals and VALUES.
"""

from __future__ import annotations

from collections.abc import Sequence

from tallyspark.plans import domain
from tallyspark.sources.merchants import AGGREGATORS, BANK_OPERATIONS, CATALOGUE, FAMILIES, NOISE


def lit(x: object) -> str:
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(lit, x)) + "]"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: Sequence[Sequence]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _strip(x: str) -> str:
    words = f"string_split_regex(regexp_replace(upper({x}), '[^A-Z0-9 ]', ' ', 'g'), ' +')"
    return f"array_to_string(list_filter({words}, lambda w: w <> '' AND w NOT IN ({lit(NOISE)[1:-1]}) AND NOT regexp_full_match(w, '[0-9]{{4,}}')), ' ')"


def _first_match(x: str, cases: Sequence[tuple[str, object]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {lit(pattern)}) THEN {lit(value)}" for pattern, value in cases) + " END"


def jaro(pairs: str) -> str:
    """CTEs after ``pairs(a, b)``; the last, jaro, holds a, b, jaro and jaro_winkler."""
    hit = """list_filter(range(greatest(1, i - reach), least(length(b), i + reach) + 1), lambda p: substr(b, p, 1) = substr(a, i, 1) AND NOT list_contains(used, p))[1]"""
    return f"""walk(a, b, reach, i, used) AS (
      SELECT a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1), CAST(1 AS BIGINT), CAST([] AS BIGINT[]) FROM {pairs}
      UNION ALL
      SELECT a, b, reach, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (SELECT *, {hit} AS hit FROM walk WHERE i <= length(a))),
    walked AS (SELECT a, b, used, list_sort(used) AS placed, CAST(len(used) AS DOUBLE) AS m FROM walk WHERE i = length(a) + 1),
    turned AS (SELECT *, len(list_filter(range(1, len(used) + 1), lambda q: substr(b, used[q], 1) <> substr(b, placed[q], 1))) AS off FROM walked),
    plain AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN m = 0 THEN 0.0 ELSE (m / length(a) + m / length(b) + (m - off / 2) / m) / 3 END AS jaro FROM turned),
    jaro AS (SELECT *, jaro + len(list_filter(range(1, 5), lambda q: q <= length(a) AND q <= length(b) AND left(a, q) = left(b, q))) * 0.1::DOUBLE * (1 - jaro) AS jaro_winkler FROM plain)"""


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 2), lambda q: substr('  ' || {x} || ' ', q, 3)))"


_NAMES = _values([(k, j, name) for k, (_, display, _, aliases, _) in enumerate(CATALOGUE) for j, name in enumerate((display, *aliases))])
_KEYS = _values([(k, name.upper()) for k, (merchant, display, _, aliases, _) in enumerate(CATALOGUE) for name in (display, merchant, *aliases)])
_SHELF = _values([(k, merchant, display, mcc, ",".join(tags)) for k, (merchant, display, mcc, _, tags) in enumerate(CATALOGUE)])
_FAMILIES = _values([(k, pattern, mcc, ",".join(tags)) for k, (pattern, mcc, tags) in enumerate(FAMILIES)])


def cascade(source: str, aliases: str = "SELECT '', '', 0 WHERE false") -> str:
    """CTEs after ``source(id, raw)``, to follow WITH RECURSIVE; the last, solved, has a row an id.
    ``aliases``: SQL of candidate, merchant_id, learnt_ord."""
    return f"""
    cut AS (SELECT id, raw, text, list_transform(string_split_regex(text, '[/-]'), lambda p: trim(p)) AS parts, {_first_match('upper(text)', BANK_OPERATIONS)} AS bank,
        regexp_matches(upper(text), '^UPI[/-]') AS is_upi, strpos(text, '*') AS star FROM (SELECT id, raw, trim(raw) AS text FROM {source})),
    body AS (SELECT *, list_filter(parts[2:], lambda p: p <> '' AND upper(p) NOT IN ('DR', 'CR', 'UPI')) AS body FROM cut),
    rest AS (SELECT *, list_filter(body, lambda p: NOT regexp_full_match(p, '[0-9]{{6,}}') AND NOT regexp_full_match(p, '[A-Z]{{4}}')) AS rest FROM body),
    offers AS (SELECT *, list_filter(list_transform(list_filter(rest, lambda p: NOT regexp_full_match(p, '[a-z][a-z0-9._]*') OR NOT regexp_matches(p, '^[a-z]?[0-9]{{5,}}')), lambda p: {_strip('p')}), lambda c: c <> '') AS upi,
        {_strip(f"CASE WHEN star > 1 AND regexp_matches(trim(upper(left(text, star - 1))), '^({'|'.join(AGGREGATORS)})') THEN substr(text, star + 1) ELSE text END")} AS card FROM rest),
    kinds AS (SELECT *, CASE WHEN text = '' THEN 'unknown' WHEN bank IS NOT NULL THEN 'bankOperation' WHEN is_upi THEN 'upi' WHEN card <> '' THEN 'card' ELSE 'unknown' END AS kind FROM offers),
    parsed AS (SELECT id, raw, kind, CASE kind WHEN 'bankOperation' THEN [bank] WHEN 'upi' THEN list_filter(upi, lambda c, q: list_position(upi, c) = q) WHEN 'card' THEN [card] ELSE CAST([] AS VARCHAR[]) END AS candidates,
        CASE WHEN kind = 'upi' THEN list_filter(body, lambda p: regexp_full_match(p, '[0-9]{{6,}}'))[1] END AS reference,
        CASE WHEN kind = 'upi' THEN list_filter(rest, lambda p: regexp_full_match(p, '[a-z][a-z0-9._]*'))[1] END AS handle, CASE WHEN kind = 'upi' AND len(parts) > 6 THEN parts[-1] END AS note FROM kinds),
    offered AS (SELECT id, unnest(candidates) AS candidate, generate_subscripts(candidates, 1) AS cand_ord FROM parsed WHERE kind <> 'bankOperation'),
    names(cat_ord, name_ord, name) AS ({_NAMES}), keys(cat_ord, name) AS ({_KEYS}), shelf(cat_ord, merchant_id, display_name, mcc, tags) AS ({_SHELF}),
    families(family, pattern, mcc, tags) AS ({_FAMILIES}),
    taught(candidate, merchant_id, learnt_ord) AS ({aliases}),
    alias AS (SELECT candidate, cat_ord FROM (SELECT upper(candidate) AS candidate, max_by(merchant_id, learnt_ord) AS merchant_id FROM taught GROUP BY 1) JOIN shelf USING (merchant_id)),
    exact AS (SELECT name AS candidate, max(cat_ord) AS cat_ord FROM keys GROUP BY name),
    open AS (SELECT DISTINCT candidate FROM offered WHERE candidate NOT IN (SELECT candidate FROM exact) AND candidate NOT IN (SELECT candidate FROM alias)),
    pairs AS (SELECT DISTINCT candidate AS a, upper(name) AS b FROM open CROSS JOIN names), {jaro('pairs')},
    scored AS (SELECT a, b, greatest(jaro, len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))) AS score FROM (SELECT *, {_grams('a')} AS ga, {_grams('b')} AS gb FROM jaro)),
    close AS (SELECT s.a AS candidate, n.cat_ord, n.name AS matched, s.score, row_number() OVER (PARTITION BY s.a ORDER BY s.score DESC, n.cat_ord, n.name_ord) AS nth FROM scored s JOIN names n ON upper(n.name) = s.b WHERE s.score > 0.88),
    settled AS (SELECT candidate, 1 AS stage_ord, CAST(1 AS DOUBLE) AS score, cat_ord, candidate AS matched FROM alias UNION ALL SELECT candidate, 2, 1, cat_ord, candidate FROM exact WHERE candidate NOT IN (SELECT candidate FROM alias) UNION ALL SELECT candidate, 3, score, cat_ord, matched FROM close WHERE nth = 1),
    best AS (SELECT o.id, t.*, row_number() OVER (PARTITION BY o.id ORDER BY t.stage_ord, t.score DESC, o.cand_ord, t.cat_ord) AS nth FROM offered o JOIN settled t ON t.candidate = o.candidate),
    kin AS (SELECT p.id, min(f.family) AS family FROM parsed p JOIN families f ON regexp_matches(upper(p.raw || ' ' || array_to_string(p.candidates, ' ')), f.pattern)
        WHERE p.kind <> 'bankOperation' AND p.id NOT IN (SELECT id FROM best) GROUP BY p.id),
    solved AS (SELECT p.*, CASE WHEN kind = 'bankOperation' THEN 'bankOperation' WHEN b.stage_ord = 1 THEN 'userAlias' WHEN b.stage_ord = 2 THEN 'exactCatalogue' WHEN b.stage_ord = 3 THEN 'fuzzyCatalogue' WHEN f.family IS NOT NULL THEN 'family' ELSE 'unresolved' END AS stage,
        CASE WHEN kind = 'bankOperation' THEN 1.0 WHEN b.id IS NOT NULL THEN b.score WHEN f.family IS NOT NULL THEN 0.6 ELSE 0.0 END AS confidence,
        CASE WHEN kind = 'bankOperation' THEN candidates[1] ELSE s.merchant_id END AS merchant_id, CASE WHEN kind = 'bankOperation' OR f.family IS NOT NULL THEN candidates[1] ELSE s.display_name END AS display_name,
        coalesce(s.mcc, f.mcc) AS mcc, coalesce(CASE WHEN kind = 'bankOperation' THEN candidates[1] END, s.tags, f.tags, '') AS tags, coalesce(b.matched, f.pattern) AS matched
      FROM parsed p LEFT JOIN best b ON b.id = p.id AND b.nth = 1 LEFT JOIN shelf s ON s.cat_ord = b.cat_ord LEFT JOIN kin k ON k.id = p.id LEFT JOIN families f ON f.family = k.family)"""


_PAYEE = f"list_extract({lit(domain.PAYEES)}, CAST(o_orderkey % 12 AS INTEGER) + 1)"
DESCRIPTORS = f"""d AS (SELECT CAST(o_orderkey AS BIGINT) AS id, 'UPI/DR/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '1') || '/' || {_PAYEE} || '/YESB/' || lower(replace({_PAYEE}, ' ', '')) || '/Pay' AS raw FROM orders)"""

_ALL = [name.upper() for _, display, _, aliases, _ in CATALOGUE for name in (display, *aliases)]
VARIED = f"""n AS (SELECT CAST(o_orderkey AS BIGINT) AS id, list_extract({lit(_ALL)}, CAST(o_orderkey * 7 % {len(_ALL)} AS INTEGER) + 1) AS name FROM orders),
    x AS (SELECT id, name, CAST(1 + id // 5 % length(name) AS INTEGER) AS p FROM n),
    y AS (SELECT id, CASE id % 5 WHEN 0 THEN name WHEN 1 THEN left(name, p - 1) || substr(name, p + 1) WHEN 2 THEN left(name, p) || substr(name, p) WHEN 3 THEN left(name, p - 1) || substr(name, p + 1, 1) || substr(name, p, 1) || substr(name, p + 2) ELSE name || ' LTD' END AS payee FROM x),
    z AS (SELECT id, payee, regexp_replace(lower(payee), '[^a-z]', '', 'g') AS handle, lpad(CAST(id AS VARCHAR), 12, '1') AS ref FROM y),
    d AS (SELECT id, CASE id // 25 % 8 WHEN 0 THEN 'UPI/DR/' || ref || '/' || payee || '/HDFC/' || handle || '/Pay' WHEN 1 THEN 'UPI-' || payee || '-' || handle || '-' || ref WHEN 2 THEN 'RAZORPAY*' || payee WHEN 3 THEN 'paytm *' || lower(payee) || ' 123456'
      WHEN 4 THEN 'POS ' || payee || ' MUMBAI' WHEN 5 THEN list_extract({lit(domain.FAMILY_TEXTS)}, CAST(id % {len(domain.FAMILY_TEXTS)} AS INTEGER) + 1) WHEN 6 THEN list_extract({lit(domain.BANK_TEXTS)}, CAST(id % {len(domain.BANK_TEXTS)} AS INTEGER) + 1) ELSE payee || ' PVT LTD ONLINE' END AS raw FROM z)"""

_SHOP = "(l_partkey % 61 * (l_suppkey % 5))"
_SHOP_NAME = f"'QZ ' || list_extract({lit(domain.SHOP_WORDS)}, CAST({_SHOP} % {len(domain.SHOP_WORDS)} AS INTEGER) + 1) || ' ' || chr(CAST(65 + {_SHOP} % 26 AS INTEGER)) || ' ' || chr(CAST(65 + {_SHOP} // 26 AS INTEGER))"
SHOPS = VARIED.replace("    d AS", "    v AS") + f""", d AS (SELECT row_number() OVER () AS id, CASE WHEN l_partkey % 3 <> 0 THEN v.raw WHEN l_linenumber % 2 = 0 THEN 'UPI/DR/' || lpad(CAST(l_orderkey AS VARCHAR), 12, '1') || '/' || {_SHOP_NAME} || '/YESB/' || lower(replace({_SHOP_NAME}, ' ', '')) || '/Pay'
      ELSE 'POS ' || {_SHOP_NAME} || ' MUMBAI' END AS raw FROM lineitem JOIN v ON v.id = l_orderkey)"""


def substring_baseline(raw: str) -> str:
    """The merchant whose name, of four characters or more, the upper-cased text holds first."""
    return "CASE " + " ".join(f"WHEN contains(upper({raw}), {lit(name.upper())}) THEN {lit(merchant)}" for merchant, display, _, aliases, _ in CATALOGUE for name in (display, *aliases) if len(name) >= 4) + " END"


_PAIRS = "t AS (SELECT DISTINCT p_name, p_type FROM part), u AS (SELECT p_name AS a, p_type AS b FROM t)"
_CONFIDENT = "stage IN ('userAlias', 'exactCatalogue', 'bankOperation') OR stage = 'fuzzyCatalogue' AND confidence >= 0.9"


def sql(statements: str) -> dict[str, str]:
    """``statements``: SQL of statement_extract's rows."""
    return {
        "cascade_stage": f"WITH RECURSIVE {DESCRIPTORS}, {cascade('d')} SELECT id AS spend_id, stage, merchant_id, mcc FROM solved",
        "varied_cascade": f"""WITH RECURSIVE {VARIED}, {cascade('d')} SELECT id AS spend_id, kind, array_to_string(candidates, '|') AS candidates, reference, handle, note, stage, round(confidence, 6) AS confidence, merchant_id, display_name, mcc, tags, matched,
          {_CONFIDENT} AS confident FROM solved""",
        "fuzzy_effort": f"""WITH RECURSIVE {VARIED}, {cascade('d')} SELECT count(DISTINCT c) AS candidates, count(DISTINCT c) * (SELECT count(*) FROM names) AS pairs, true AS under_a_twentieth FROM (SELECT unnest(candidates) AS c FROM parsed)""",
        "fuzzy_targets": f"""WITH RECURSIVE {DESCRIPTORS}, {cascade('d')} SELECT matched, regexp_replace(regexp_replace(regexp_replace(candidates[1], '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS candidate, round(confidence, 6) AS score, count(*) AS n
          FROM solved WHERE stage = 'fuzzyCatalogue' GROUP BY 1, 2, 3 ORDER BY n DESC, matched, candidate LIMIT 15""",
        "import_pipeline": f"""WITH RECURSIVE st AS ({statements}), d AS (SELECT row_number() OVER () AS id, description AS raw FROM (SELECT DISTINCT description FROM st)), {cascade('d')}
          SELECT st.doc_id, st.date, st.amount_paise, solved.stage, solved.merchant_id, solved.mcc FROM st JOIN solved ON solved.raw = st.description""",
        "jaro_similarity": f"WITH RECURSIVE {_PAIRS}, {jaro('u')} SELECT a AS p_name, b AS p_type, round(jaro, 6) AS similarity FROM jaro",
        "jaro_winkler_similarity": f"WITH RECURSIVE {_PAIRS}, {jaro('u')} SELECT a AS p_name, b AS p_type, round(jaro_winkler, 6) AS similarity FROM jaro",
    }
