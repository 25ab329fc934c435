"""The same results in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from ..functions.vocab import COMPONENTS, DIRECTIONS, EXPANSIONS, ORDINALS, SUFFIXES, UNITS
from . import fixtures as X


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LOCATIONS = f"""raw_locations AS (
  SELECT 'loc-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS location_id,
    CAST(100 + 37 * c_custkey % 900 AS VARCHAR) || ' ' || {_list(X.DIRECTIONS)}[c_custkey % 8 + 1] || ' ' || {_list(X.STREETS)}[7 * c_custkey % 23 + 1]
      || CASE WHEN c_custkey % 3 = 0 THEN ' ' || {_list(X.ENDINGS)}[c_custkey % 13 + 1] ELSE '' END || ' ' || {_list(X.SUFFIXES)}[3 * c_custkey % 10 + 1] AS street,
    {_list(X.CITIES)}[c_nationkey + 1] AS city, {_list(X.STATES)}[c_nationkey + 1] AS state,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(10000 + 1000 * c_nationkey + c_custkey % 97 AS VARCHAR) END AS zip_code, c_custkey AS k
  FROM customer),
loaded AS (
  SELECT location_id, upper(street) AS street, upper(city) AS city, upper(state) AS state, coalesce(zip_code, '') AS postal_code,
    upper(street) || ', ' || upper(city) || ', ' || upper(state) || ' ' || coalesce(zip_code, '') AS address
  FROM raw_locations WHERE coalesce(location_id, '') <> '' AND coalesce(street, '') <> '' AND coalesce(city, '') <> '' AND coalesce(state, '') <> '')"""

_FULL = "{s} || ', ' || {c} || ', ' || state || ' ' || {z}"
_Z = "coalesce(zip_code, '')"
_ADDRESSES = f"""raw_addresses AS (
  SELECT o_orderkey AS record_id, CASE o_orderkey % 10
    WHEN 0 THEN {_FULL.format(s="street", c="city", z=_Z)}
    WHEN 1 THEN lower(street || ' ' || city || ' ' || state || ' ' || {_Z})
    WHEN 2 THEN {_FULL.format(s="substr(street, 1, length(street) - 5) || substr(street, length(street) - 3, 4)", c="city", z=_Z)}
    WHEN 3 THEN street || ', ' || city || ', ' || state
    WHEN 4 THEN {_FULL.format(s="'9' || street", c="city", z=_Z)}
    WHEN 5 THEN {_FULL.format(s="street", c="city", z="coalesce(zip_code, '00000') || '-1234'")}
    WHEN 6 THEN 'Customer ' || city || chr(9) || {_FULL.format(s="street", c="city", z=_Z)} || chr(10)
    WHEN 7 THEN {_FULL.format(s="street || ' APT ' || CAST(o_orderkey % 50 AS VARCHAR) || 'B'", c="substr(city, 2)", z=_Z)}
    WHEN 8 THEN {_FULL.format(s="street || '.'", c="city", z=_Z)}
    ELSE CASE o_orderkey % 30 WHEN 9 THEN ' , ,' WHEN 19 THEN 'UNKNOWN ADDRESS' ELSE '   ' END END AS raw_address
  FROM orders JOIN raw_locations ON o_custkey = k),
squeezed AS (SELECT record_id, raw_address, regexp_replace(regexp_replace(raw_address, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS x FROM raw_addresses),
cleaned AS (SELECT record_id, raw_address, CASE WHEN regexp_matches(x, '^[0-9]') OR NOT regexp_matches(x, ' [0-9]') THEN x ELSE regexp_replace(x, '^.*? ([0-9])', '\\1', 's') END AS address FROM squeezed)"""


def _expand(c: str) -> str:
    out = f"upper(' ' || {c} || ' ')"
    for short, long in (*EXPANSIONS, *ORDINALS):
        out = f"replace({out}, '{short}', '{long}')"
    return out


_TOKENS = "list_filter(list_transform(string_split_regex({b}, '[ ,]+'), lambda w: regexp_replace(w, '^\\s+|\\s+$', '', 'g')), lambda w: w <> '')[1:64]"
_UNIT = f"(w IN {_in(UNITS)} OR starts_with(w, '#'))"
_FOLLOW = "(regexp_matches(w, '^[#0-9]') OR strlen(w) <= 3)"


def _zip(c: str) -> str:
    out = f"regexp_replace({c}, '[^0-9-]', '', 'g')"
    for _ in range(5):
        out = f"regexp_replace({out}, '^([0-9]{{0,4}})-+', '\\1')"
    return out


def _parse(source: str, ident: str, p: str) -> str:
    """Tables that end in ``{p}`` with ident and the components ('-' if there are none)."""
    directions = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in DIRECTIONS.items()) + "}"
    free = "i <> z AND i <> s"
    return f"""
{p}1 AS (SELECT *, {_TOKENS.format(b=_expand("address"))} AS t FROM {source}),
{p}2 AS (SELECT *, len(t) AS n, coalesce(list_max(list_transform(t, lambda w, i: CASE WHEN regexp_matches(w, '^[0-9]{{5}}[0-9-]*$') THEN i END)), 0) AS z FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN z = n THEN n - 1 ELSE n END AS s FROM {p}2),
{p}4 AS (SELECT *, coalesce(list_min(list_transform(t, lambda w, i: CASE WHEN {_UNIT} AND {free} THEN i END)), n + 1) AS u FROM {p}3),
{p}5 AS (SELECT *, coalesce(list_min(list_transform(t, lambda w, i: CASE WHEN i > u AND NOT ({free} AND {_FOLLOW}) THEN i END)), n + 1) AS v FROM {p}4),
{p}6 AS (SELECT *, list_filter(t, lambda w, i: {free} AND (i < u OR i >= v)) AS a FROM {p}5),
{p}7 AS (SELECT *, coalesce(list_min(list_transform(a, lambda w, i: CASE WHEN regexp_matches(w, '^[0-9-]+') THEN i END)), 0) AS h FROM {p}6),
{p}8 AS (SELECT *, CASE WHEN h > 0 THEN regexp_extract(a[h], '^[0-9-]+') ELSE '' END AS street_number,
  list_filter(list_transform(a, lambda w, i: CASE WHEN i = h THEN regexp_replace(w, '^[0-9-]+', '') ELSE w END), lambda w: w <> '') AS b FROM {p}7),
{p}9 AS (SELECT *, coalesce(substr(coalesce({directions}[b[1]], b[1]), 1, 15), '') AS street_direction, b[2:] AS c FROM {p}8),
{p}10 AS (SELECT *, coalesce(list_min(list_transform(c, lambda w, i: CASE WHEN w IN {_in(SUFFIXES)} THEN i END)), 0) AS f FROM {p}9),
{p}11 AS (SELECT *, array_to_string(list_transform(CASE WHEN f > 0 THEN c[1:f-1] ELSE c END, lambda w: regexp_replace(w, '^([0-9]|[0-9].*[0-9])(ST|ND|RD|TH)$', '\\1')), ' ') AS street_name,
  CASE WHEN f > 0 THEN c[f] ELSE '' END AS street_suffix, array_to_string(t[u:v-1], ' ') AS unit, CASE WHEN f > 0 THEN array_to_string(c[f+1:], ' ') ELSE '' END AS city_,
  CASE WHEN s > 0 THEN substr(t[s], 1, 2) ELSE '' END AS state_, CASE WHEN z > 0 THEN {_zip("t[z]")} ELSE '' END AS zip_ FROM {p}10),
{p} AS MATERIALIZED (SELECT {ident}, n, address, street_number, street_direction, street_name, street_suffix, unit, city_ AS city, state_ AS state, zip_ AS postal_code,
  CASE WHEN street_number <> '' AND street_name <> '' THEN street_number || '|' || street_direction || '|' || street_name || '|' || street_suffix || '|' || city_ || '|' || state_ || '|' || zip_ ELSE '' END AS canonical_key
  FROM {p}11)"""


def _sim(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(strlen({a}), strlen({b})) END)"


def _same(c: str) -> str:
    return f"(CASE WHEN l.{c} <> '' AND l.{c} = r.{c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


_PARTS = {"street_number": _same("street_number"), "street_name": _sim("l.street_name", "r.street_name"), "directional": _same("street_direction"), "suffix": _same("street_suffix"), "city": _sim("l.city", "r.city"), "state": _same("state"), "postal_code": _same("postal_code")}
_WEIGHTED = "0.35::DOUBLE * street_number + 0.25::DOUBLE * street_name + 0.05::DOUBLE * directional + 0.05::DOUBLE * suffix + 0.15::DOUBLE * city + 0.05::DOUBLE * state + 0.1::DOUBLE * postal_code"
_BOTH = f"WITH {_LOCATIONS},\n{_ADDRESSES},{_parse('loaded', 'location_id', 'loc')},{_parse('cleaned', 'record_id, raw_address', 'adr')}"

_PAIRS = f"""{_BOTH},
parts AS (SELECT record_id, location_id, l.canonical_key <> '' AND l.canonical_key = r.canonical_key AS same_key, {_sim("l.postal_code", "r.postal_code")} AS zs,
  {", ".join(f"{v} AS {k}" for k, v in _PARTS.items())} FROM adr l CROSS JOIN loc r WHERE l.n > 0),
sums AS (SELECT *, {_WEIGHTED} AS s FROM parts),
both_ AS (SELECT *, 0.6::DOUBLE * s + 0.25::DOUBLE * street_name + 0.15::DOUBLE * city AS f0 FROM sums),
scored AS (SELECT record_id, location_id, {", ".join(_PARTS)},
  CASE WHEN same_key THEN CASE WHEN s >= 0.9 THEN 1.0 ELSE s END END AS canonical,
  CASE WHEN s >= 0.65 THEN least(s, 1.0) END AS structured,
  CASE WHEN least(CASE WHEN zs > 0.8 THEN f0 + 0.05::DOUBLE ELSE f0 END, 1.0) >= 0.55 THEN least(CASE WHEN zs > 0.8 THEN f0 + 0.05::DOUBLE ELSE f0 END, 1.0) END AS fuzzy FROM both_),
merged AS (SELECT *, greatest(canonical, structured, fuzzy) AS confidence FROM scored WHERE coalesce(canonical, structured, fuzzy) IS NOT NULL),
named AS (SELECT *, CASE WHEN canonical = confidence THEN 'canonical' WHEN structured = confidence THEN 'structured' ELSE 'fuzzy' END AS strategy FROM merged),
candidates AS (SELECT *, CASE strategy WHEN 'canonical' THEN 'canonical_key_match' WHEN 'structured' THEN 'weighted_component_score' ELSE 'approximate_text_similarity' END AS reason FROM named),
top AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY confidence DESC, location_id) AS INTEGER) AS rank FROM candidates) WHERE rank <= 5),
best AS MATERIALIZED (SELECT a.*, t.location_id, t.confidence, coalesce(t.strategy, 'none') AS selected_strategy, coalesce(printf('%.3f', t.confidence), '0.00') AS selected_confidence FROM adr a LEFT JOIN top t ON a.record_id = t.record_id AND t.rank = 1)"""

_C = ", ".join(f"CASE WHEN n > 0 THEN {c} ELSE '-' END AS {c}" for c in COMPONENTS)
_ONE = "SELECT record_id, location_id, round({s}, 6) AS confidence, '{s}' AS strategy, '{r}' AS reason FROM scored WHERE {s} IS NOT NULL"
_VOTES = """voted AS (SELECT record_id, max_by(location_id, rank) AS voted FROM top WHERE rank <= 2 GROUP BY record_id),
votes AS (SELECT record_id, CASE WHEN record_id % 50 = 0 THEN 'loc-9999999' ELSE voted END AS location_id, CASE record_id % 4 WHEN 1 THEN 0.82::DOUBLE WHEN 2 THEN 0.99::DOUBLE END AS confidence FROM voted WHERE record_id % 4 IN (1, 2))"""
_BEST = "SELECT record_id, coalesce(location_id, '-') AS location_id, selected_strategy, selected_confidence FROM best"
_SIDES = {"street_number": "street_number", "street_name": "street_name", "directional": "street_direction", "suffix": "street_suffix", "city": "city", "state": "state", "postal_code": "postal_code"}
_WEIGHT = dict(zip(_SIDES, (0.35, 0.25, 0.05, 0.05, 0.15, 0.05, 0.1), strict=True))
_EXPLAIN = "\nUNION ALL ".join(
    f"SELECT b.record_id, b.location_id, '{k}' AS component, b.{c} AS address_value, r.{c} AS location_value, round({_WEIGHT[k]}::DOUBLE * t.{k}, 6) AS weight FROM best b JOIN loc r ON b.location_id = r.location_id JOIN top t ON t.record_id = b.record_id AND t.rank = 1" for k, c in _SIDES.items()
)


def _text(*pairs: tuple[str, str]) -> str:
    """Members of a JSON object with text values, as SQL."""
    return " || ',' || ".join(f"""'"{name}":"' || {value} || '"'""" for name, value in pairs)


_COLUMNS = ("street", "city", "state", "postal_code")
_CONFIDENCE = """',"confidence":' || printf('%.3f', {t}.confidence) || ','"""
_LISTED = f"""'{{' || {_text(("location_id", "t.location_id"))} || {_CONFIDENCE.format(t="t")} || {_text(("strategy", "t.strategy"), ("reason", "t.reason"))} || '}}'"""
_PAIRS_OF = " || ',' || ".join(f"""'"{k}":{{"value":"' || b.{c} || '|' || r.{c} || '","weight":' || printf('%.2f', {_WEIGHT[k]}::DOUBLE * t.{k}) || '}}'""" for k, c in _SIDES.items())
_DOCUMENTS = f"""lists AS MATERIALIZED (SELECT record_id, string_agg({_LISTED}, ',' ORDER BY rank) AS list FROM top t GROUP BY record_id),
bests AS MATERIALIZED (SELECT b.record_id, '{{' || {_text(("location_id", "t.location_id"))} || {_CONFIDENCE.format(t="t")} || {_text(("strategy", "t.strategy"), ("reason", "t.reason"), *[(c, f"p.{c}") for c in _COLUMNS])} || ',"breakdown":{{' || {_PAIRS_OF} || '}}}}' AS best
  FROM best b JOIN top t ON t.record_id = b.record_id AND t.rank = 1 JOIN loc r ON b.location_id = r.location_id JOIN loaded p ON b.location_id = p.location_id)
SELECT b.record_id, '{{"best_candidate":' || coalesce(best, 'null') || ',"candidates":[' || coalesce(list, '') || '],"diagnostics":{{' || {_text(("selected_strategy", "selected_strategy"), ("selected_confidence", "selected_confidence"))}
  || '}},"record_components":{{' || {_text(*[(c, f"CASE WHEN n > 0 THEN b.{c} ELSE '' END") for c in COMPONENTS])} || '}}}}' AS document
FROM best b LEFT JOIN lists USING (record_id) LEFT JOIN bests USING (record_id)"""
_PAYLOAD = f"""items AS (SELECT record_id, string_agg('{{' || {_text(("location_id", "t.location_id"))} || {_CONFIDENCE.format(t="t")} || {_text(("strategy", "t.strategy"), *[(c, f"p.{c}") for c in _COLUMNS])} || '}}', ',' ORDER BY rank) AS list FROM top t JOIN loaded p ON t.location_id = p.location_id GROUP BY record_id)
SELECT record_id, '{{' || {_text(("address", "address"))} || ',"candidates":[' || list || ']}}' AS payload FROM adr JOIN items USING (record_id)"""
_LINES = """voted AS (SELECT record_id, max_by(location_id, rank) AS voted FROM top WHERE rank <= 2 GROUP BY record_id)
SELECT record_id, 'location_id=' || CASE WHEN record_id % 50 = 0 THEN 'loc-9999999' ELSE voted END || CASE record_id % 4 WHEN 0 THEN ' confidence=0.69' WHEN 1 THEN ' confidence=0.82' WHEN 2 THEN ' confidence=0.99' ELSE '' END AS response FROM voted"""

ORACLE_SQL = {
    "match_documents": f"{_PAIRS}, {_DOCUMENTS}",
    "rerank_payloads": f"{_PAIRS}, {_PAYLOAD}",
    "read_rerank_decisions": f"{_PAIRS}, {_LINES}",
    "load_locations": f"WITH {_LOCATIONS} SELECT location_id, street, city, state, postal_code, address FROM loaded",
    "clean_pasted_text": f"WITH {_LOCATIONS},\n{_ADDRESSES} SELECT record_id, address FROM cleaned",
    "expand_abbreviations": f"WITH {_LOCATIONS},\n{_ADDRESSES} SELECT record_id, {_expand('address')} AS expanded FROM cleaned",
    "tokenize": f"WITH {_LOCATIONS},\n{_ADDRESSES}, b AS (SELECT record_id, {_TOKENS.format(b=_expand('address'))} AS t FROM cleaned) SELECT record_id, CAST(i - 1 AS INTEGER) AS place, t[i] AS token FROM (SELECT record_id, t, unnest(range(1, len(t) + 1)) AS i FROM b)",
    "canonicalize_zip": f"WITH {_LOCATIONS},\n{_ADDRESSES} SELECT record_id, substr({_zip('raw_address')}, 1, 31) AS zip FROM raw_addresses",
    "parse_addresses": f"{_BOTH} SELECT record_id, {_C} FROM adr",
    "parse_distinct": f"{_BOTH} SELECT record_id, {_C} FROM adr",
    "seen_addresses": f"{_BOTH}, k AS (SELECT canonical_key, min(location_id) AS representative, count(*) AS members FROM loc WHERE canonical_key <> '' GROUP BY canonical_key) SELECT record_id, canonical_key, coalesce(representative, '-') AS representative, coalesce(members, 0) AS members FROM adr LEFT JOIN k USING (canonical_key) WHERE canonical_key <> ''",
    "parse_locations": f"{_BOTH} SELECT location_id, {_C} FROM loc",
    "canonical_key_index": f"{_BOTH} SELECT canonical_key, min(record_id) AS representative, count(*) AS members FROM adr WHERE canonical_key <> '' GROUP BY canonical_key",
    "similarity_ratio": f"{_BOTH}, names AS (SELECT DISTINCT street_name AS a FROM loc) SELECT x.a AS a, y.a AS b, round({_sim('x.a', 'y.a')}, 6) AS similarity FROM names x JOIN names y ON x.a < y.a",
    "score_components": f"{_BOTH}, p AS (SELECT record_id, location_id, {', '.join(f'{v} AS {k}' for k, v in _PARTS.items())} FROM adr l JOIN loc r ON l.postal_code = r.postal_code AND l.postal_code <> '' WHERE l.n > 0) SELECT record_id, location_id, {', '.join(f'round({k}, 6) AS {k}' for k in _PARTS)}, round({_WEIGHTED}, 6) AS score FROM p",
    "canonical_candidates": f"{_PAIRS} {_ONE.format(s='canonical', r='canonical_key_match')}",
    "structured_candidates": f"{_PAIRS} {_ONE.format(s='structured', r='weighted_component_score')}",
    "fuzzy_candidates": f"{_PAIRS} {_ONE.format(s='fuzzy', r='approximate_text_similarity')}",
    "merge_candidates": f"{_PAIRS} SELECT record_id, location_id, round(confidence, 6) AS confidence, strategy, reason FROM candidates",
    "top_candidates": f"{_PAIRS} SELECT record_id, rank, location_id, round(confidence, 6) AS confidence, strategy, reason FROM top",
    "best_match": f"{_PAIRS} {_BEST}",
    "match_stream": f"{_PAIRS} {_BEST}",
    "unmatched_addresses": f"{_PAIRS} SELECT record_id, raw_address FROM best WHERE location_id IS NULL",
    "match_outcome": f"{_PAIRS} SELECT record_id, CASE WHEN address = '' THEN 'empty' WHEN location_id IS NOT NULL THEN 'matched' ELSE 'no_match' END AS outcome FROM best",
    "match_results": f"{_PAIRS}, ids AS (SELECT record_id, count(*) AS n_candidates, string_agg(location_id, ',' ORDER BY rank) AS location_ids FROM top GROUP BY record_id) SELECT b.record_id, CASE WHEN address = '' THEN 'empty' WHEN b.location_id IS NOT NULL THEN 'matched' ELSE 'no_match' END AS outcome, selected_strategy, selected_confidence, coalesce(n_candidates, 0) AS n_candidates, coalesce(location_ids, '') AS location_ids FROM best b LEFT JOIN ids USING (record_id)",
    "parse_rerank_decisions": f"{_PAIRS}, {_VOTES} SELECT record_id, location_id, round(confidence, 6) AS confidence FROM votes",
    "apply_rerank": f"""{_PAIRS}, {_VOTES},
every AS (SELECT record_id, location_id, confidence, strategy, reason, CASE strategy WHEN 'canonical' THEN 0 WHEN 'structured' THEN 1 ELSE 2 END AS o FROM top
  UNION ALL SELECT record_id, location_id, confidence, 'llm', 'llm_ranked', 3 FROM votes WHERE location_id IN (SELECT location_id FROM loc)),
kept AS (SELECT *, row_number() OVER (PARTITION BY record_id, location_id ORDER BY confidence DESC, o) AS r FROM every),
again AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY confidence DESC, location_id) AS INTEGER) AS rank FROM kept WHERE r = 1)
SELECT record_id, rank, location_id, round(confidence, 6) AS confidence, strategy, reason FROM again WHERE rank <= 5""",
    "score_payloads": f"{_PAIRS} SELECT record_id, 'location_id=' || location_id || ' confidence=0.9' AS response FROM top WHERE rank = 1",
    "audit_zip_mismatch": f"{_PAIRS} SELECT b.record_id, b.location_id, b.postal_code AS address_zip, r.postal_code AS location_zip, round(b.confidence, 6) AS confidence FROM best b JOIN loc r ON b.location_id = r.location_id WHERE selected_strategy = 'fuzzy' AND b.postal_code <> '' AND r.postal_code <> '' AND b.postal_code <> r.postal_code",
    "explain_matches": f"{_PAIRS} {_EXPLAIN}",
    "location_count": f"WITH {_LOCATIONS} SELECT count(*) AS locations FROM loaded",
}
