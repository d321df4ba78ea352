"""DuckDB SQL for the registered queries, keyed like QUERIES. Queries that SQL can't express have none."""

from __future__ import annotations

from tidemark.functions.dates import AGO, ISO, LAST_MONTH, LAST_UNIT, MONTH_DAY, NUMERIC, PHRASES, YESTERDAY
from tidemark.functions.text import HONORIFICS, STOP_WORDS, TEMPORAL_MARKERS
from tidemark.operators.extract import BAD_SUBJECTS, DISLIKES, LIKES, NAME, POSSESSIVE, VERBS
from tidemark.operators.retrieve import AS_OF, KEYWORDS, SESSION


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def _toks(x: str, stop: bool = True) -> str:
    all_ = f"regexp_extract_all({_fold(x)}, '[\\p{{L}}\\p{{N}}]+')"
    return f"list_filter({all_}, lambda t: NOT list_contains({_list(STOP_WORDS)}, t))" if stop else all_


def _count(x: str) -> str:
    return f"len({_toks(x, False)})"


def _hash(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


_EV = """ev AS (SELECT 'n' || (user_id % 4) AS namespace, event_id AS id, 'user' || user_id AS subject, 'state' AS predicate, event_type AS object,
    epoch(ts) AS valid_from, epoch(ts) AS created_at FROM events)"""
_VER = f"""{_EV},
ch AS (SELECT *, lag(lower(object)) OVER (PARTITION BY namespace, subject ORDER BY created_at, id) AS b FROM ev),
ver AS (SELECT namespace, id, subject, predicate, object, valid_from, lead(valid_from) OVER w AS valid_to, created_at,
    lead(created_at) OVER w AS expired_at, lead(id) OVER w AS superseded_by
  FROM ch WHERE b IS NULL OR b <> lower(object) WINDOW w AS (PARTITION BY namespace, subject ORDER BY created_at, id))"""
_PROF = """cn AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
prof AS (SELECT c_custkey * 4 AS id, 'c' || c_custkey AS subject, 'city' AS predicate, n_name AS object FROM cn
  UNION ALL SELECT c_custkey * 4 + 1, 'c' || c_custkey, 'role', c_mktsegment FROM cn
  UNION ALL SELECT c_custkey * 4 + 2, 'c' || c_custkey, 'manager', 'c' || (c_custkey // 10) FROM cn WHERE c_custkey >= 10)"""
_Q = """q AS (SELECT c_custkey * 4 + k AS query_id, CASE k WHEN 0 THEN 'What city does c' || c_custkey || ' live in?' WHEN 1 THEN 'What is the role of c' || c_custkey || '''s manager?'
    WHEN 2 THEN 'As of session 3, who was the boss of c' || c_custkey || '?' ELSE 'Tell me about c' || c_custkey || '.' END AS question
  FROM customer, range(4) t(k))"""
_NM = "'N' || translate(({})::VARCHAR, '0123456789', 'abcdefghij')"
_A, _B = _NM.format("c_custkey"), _NM.format("c_custkey + 1")
_SENT = f"""sent AS (SELECT 'n' || (c_custkey % 4) AS namespace, c_custkey AS text_id, c_custkey::DOUBLE AS ts, CASE c_custkey % 8
    WHEN 0 THEN {_A} || '''s current mailing address is ' || n_name || '.'
    WHEN 1 THEN {_A} || ' moved to ' || n_name || '. After that, their role was ' || c_mktsegment || '.'
    WHEN 2 THEN {_A} || ' works at Acme ' || c_mktsegment || '; ' || {_A} || ' lives in ' || n_name
    WHEN 3 THEN {_A} || ' is an ' || c_mktsegment || ' buyer! The weather is a mess.'
    WHEN 4 THEN {_A} || ' reports to ' || {_B} || '. His location is ' || n_name || '.'
    WHEN 5 THEN {_A} || ' likes classic ' || c_mktsegment || '. ' || {_A} || '''s favorite ice cream is ' || n_name || '.'
    WHEN 6 THEN 'I moved to ' || n_name || '. It was ' || c_mktsegment || '.'
    ELSE {_A} || ' was promoted to a senior ' || c_mktsegment || '. ' || {_A} || ' worked on the project ' || n_name || '.' END AS text
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _clauses(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _clean(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|[.!?,;:\\s]+$', '', 'g')"


def _canon(x: str) -> str:
    key = f"array_to_string(list_filter({_toks(x)}, lambda t: NOT list_contains({_list(TEMPORAL_MARKERS)}, t)), ' ')"
    return f"CASE WHEN {key} = 'location' THEN 'city' ELSE {key} END"


def _parse(c: str, likes: bool = False) -> str:
    """A CASE that gives a struct of subject, predicate and object for a clause, or null."""

    def named(p: str) -> str:
        return f"regexp_extract({c}, {_lit(p)}, 1) <> '' AND NOT list_contains({_list(BAD_SUBJECTS)}, lower(regexp_extract({c}, {_lit(p)}, 1)))"

    def fact(s: str, p: str, o: str) -> str:
        return f"{{'subject': {s}, 'predicate': {p}, 'object': {o}}}"

    get = lambda p, k: f"regexp_extract({c}, {_lit(p)}, {k})"
    attr, value = get(POSSESSIVE, 2), _clean(get(POSSESSIVE, 3))
    out = "CASE "
    if likes:
        topic = f"array_to_string(({_toks(attr)})[2:], ' ')"
        out += f"WHEN {named(POSSESSIVE)} AND ({_toks(attr)})[1] IN ('favorite', 'favourite') AND {topic} <> '' AND {value} <> '' THEN {fact(get(POSSESSIVE, 1), f'concat({_lit("preference:")}, {topic})', value)} "
    out += f"WHEN {named(POSSESSIVE)} AND ({_canon(attr)}) <> '' AND {value} <> '' THEN {fact(get(POSSESSIVE, 1), _canon(attr), value)} "
    if likes:
        form = NAME + rf"\s+({'|'.join(sorted(LIKES + DISLIKES))})\s+(.+)"
        what = _clean(get(form, 3))
        polar = f"CASE WHEN {get(form, 2)} IN ('hates', 'dislikes') THEN 'dislike' ELSE 'like' END"
        out += f"WHEN {named(form)} AND NOT regexp_matches({what}, '\\bto\\b|\\bover\\b|\\brather than\\b') AND len({_toks(what)}) > 0 THEN {fact(get(form, 1), f'concat({_lit("preference:")}, ({_toks(what)})[-1])', polar)} "
    for p, name in VERBS:
        out += f"WHEN {named(p)} AND {_clean(get(p, 2))} <> '' THEN {fact(get(p, 1), _lit(name), _clean(get(p, 2)))} "
    return out + "END"


_CL = f"cl AS (SELECT s.*, i - 1 AS clause_no, cs[i] AS clause FROM (SELECT *, {_clauses('text')} AS cs FROM sent) s, range(1, 20) r(i) WHERE i <= len(cs))"
_WHO = "(?i)^(\\s*(?:[A-Za-z][^,]*,\\s+)?)(?:their|his|her|its)\\s+(.*)$"
_TURNS = "turns AS (SELECT 'n' || (conv_id % 4) AS namespace, conv_id * 1000 + turn AS id, conv_id * 86400.0::DOUBLE + turn * 60.0::DOUBLE AS ts, 's' || conv_id AS session_id, role AS actor, text FROM conversations)"
_EPI = f"""{_VER},
epi AS (SELECT namespace, id, created_at AS ts, subject || ' is ' || object AS content, 1 + id % 3 AS support_count, created_at AS last_seen_ts,
    CASE WHEN id % 10 <> 9 THEN subject END AS fs, CASE WHEN id % 10 <> 9 THEN predicate END AS fp, CASE WHEN id % 10 <> 9 THEN object END AS fo FROM ev),
cur AS (SELECT namespace, subject, lower(object) AS o FROM ver WHERE valid_to IS NULL),
kept AS (SELECT e.* FROM epi e JOIN cur c ON e.namespace = c.namespace AND e.fs = c.subject AND lower(e.fo) = c.o)"""
_CLAIMS = """claims AS (SELECT namespace, first(content ORDER BY support_count DESC, id) AS content, sum(support_count)::BIGINT AS support_count, max(last_seen_ts) AS last_seen_ts,
    array_to_string(list(id ORDER BY id), ',') AS supports, fs AS entities, count(*) AS n FROM kept GROUP BY namespace, fs HAVING count(*) > 1)"""
_DEC = f"""dec AS (SELECT event_type AS namespace, event_id AS id, epoch(ts) AS ts, event_id // 100 * 100 AS target,
    CASE WHEN {_hash('event_id::VARCHAR')} % 1000 / 1000.0::DOUBLE >= 0.7 THEN 'stored' WHEN {_hash('event_id::VARCHAR')} % 1000 / 1000.0::DOUBLE <= 0.3 THEN 'reinforced' ELSE 'discarded' END AS decision FROM events)"""


def _sparse(name: str, source: str, key: str) -> str:
    """A sparse hash embedding as CTEs."""
    return f"""{name}0 AS (SELECT {key} AS id, unnest({_toks('text')}) AS t FROM {source}),
{name}1 AS (SELECT id, {_hash('t')} % 256 AS bucket, sum(CASE WHEN {_hash('t')} // 256 % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM {name}0 GROUP BY ALL HAVING w <> 0),
{name} AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}1)"""


def _hybrid(records: str) -> str:
    return f"""{_sparse('dv', records, 'id')}, {_sparse('qv', 'benchmark', 'item_id')},
cosines AS (SELECT qv.id AS query_id, dv.id, sum(dv.weight * qv.weight) AS cosine FROM dv JOIN qv USING (bucket) GROUP BY ALL),
dt AS (SELECT DISTINCT id, t FROM dv0), qt AS (SELECT DISTINCT id, t FROM qv0),
dn AS (SELECT id, count(*) AS n FROM dt GROUP BY id), qn AS (SELECT id, count(*) AS n FROM qt GROUP BY id),
lex0 AS (SELECT qt.id AS query_id, dt.id, count(*) AS both_ FROM dt JOIN qt USING (t) GROUP BY ALL),
lex AS (SELECT query_id, l.id, both_ / (dn.n + qn.n - both_) AS jaccard FROM lex0 l JOIN dn ON dn.id = l.id JOIN qn ON qn.id = l.query_id),
hy AS (SELECT query_id, id, round(0.5 * coalesce(cosine, 0) + 0.5 * coalesce(jaccard, 0), 6) AS score FROM cosines FULL JOIN lex USING (query_id, id)),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM hy)"""


_FUSED = f"""{_TURNS}, {_hybrid('turns')},
fused AS (SELECT query_id, h.id, text, round(score + 0.5 * pow(0.5, greatest(0, 90000000.0 - ts) / 2592000.0) + 0.15, 6) AS fused FROM hr h JOIN turns USING (id) WHERE rank <= 8)"""
_KNN = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _knn(k: int, where: str = "true", extra: str = "true", ties: str = "id") -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_KNN}, 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND {extra} WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties})::INTEGER AS rank FROM s)
SELECT query_id, rank, id, score FROM r WHERE rank <= {k}"""


_MONTH_NUMBER = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr({}, 1, 3)))"
_DATED = """dated AS (SELECT o_orderkey AS id, epoch(o_orderdate) + 3600.0 AS ref, CASE o_orderkey // 32 % 12
    WHEN 0 THEN 'Moved on ' || strftime(o_orderdate, '%Y-%m-%d') || ' for good' WHEN 1 THEN 'It was ' || (o_orderkey % 12 + 1) || '/' || (o_orderkey % 31 + 1) || '/2019 at last'
    WHEN 2 THEN 'Met in ' || mon || ' ' || (o_orderkey % 31 + 1) || 'th, 2018' WHEN 3 THEN 'Since ' || mon || ' ' || (o_orderkey % 28 + 1)
    WHEN 4 THEN 'Left ' || (o_orderkey % 40) || ' days ago' WHEN 5 THEN 'Started two months ago in ' || mon WHEN 6 THEN 'Joined a year ago' WHEN 7 THEN 'Back last ' || mon
    WHEN 8 THEN 'It happened last week' WHEN 9 THEN 'Seen yesterday' WHEN 10 THEN 'No date here' ELSE 'On 2021-02-30 or 2021-13-01 ten weeks ago' END AS text
  FROM (SELECT *, ['January', 'feb', 'March', 'Apr', 'May', 'june', 'Jul', 'August', 'Sept', 'October', 'nov', 'December'][o_orderkey % 12 + 1] AS mon FROM orders))"""


def _event_date(x: str, ref: str) -> str:
    get = lambda p, k: f"regexp_extract({x}, {_lit(p)}, {k})"
    num = lambda p, k: f"try_cast(nullif({get(p, k)}, '') AS INTEGER)"
    day = lambda y, m, d: f"epoch(try_strptime(printf('%04d-%02d-%02d', ({y})::BIGINT, ({m})::BIGINT, ({d})::BIGINT), '%Y-%m-%d'))"
    at = f"to_timestamp({ref}) AT TIME ZONE 'UTC'"
    shift = lambda n: f"epoch(({at})::DATE + to_months(({n})::INTEGER)) + ({ref} - floor({ref} / 86400) * 86400)"
    mon, last = _MONTH_NUMBER.format(get(MONTH_DAY, 1)), _MONTH_NUMBER.format(get(LAST_MONTH, 1))
    words = "{'a': 1, 'an': 1, 'one': 1, 'two': 2, 'three': 3, 'four': 4, 'five': 5, 'six': 6, 'seven': 7, 'eight': 8, 'nine': 9, 'ten': 10, 'eleven': 11, 'twelve': 12}"
    n = f"coalesce(try_cast({get(AGO, 1)} AS INTEGER), map_extract_value(MAP {words}, lower({get(AGO, 1)})))"
    unit, span = f"lower({get(AGO, 2)})", f"lower({get(LAST_UNIT, 1)})"
    year = f"year({at})"
    this, before = day(year, mon, num(MONTH_DAY, 2)), day(f"{year} - 1", mon, num(MONTH_DAY, 2))
    return f"""CASE WHEN {num(ISO, 2)} BETWEEN 1 AND 12 AND {num(ISO, 3)} BETWEEN 1 AND 31 THEN {day(num(ISO, 1), num(ISO, 2), num(ISO, 3))}
    WHEN {num(NUMERIC, 1)} BETWEEN 1 AND 12 AND {num(NUMERIC, 2)} BETWEEN 1 AND 31 THEN {day(num(NUMERIC, 3), num(NUMERIC, 1), num(NUMERIC, 2))}
    WHEN {mon} > 0 AND {num(MONTH_DAY, 2)} IS NOT NULL THEN CASE WHEN {num(MONTH_DAY, 3)} IS NOT NULL THEN {day(num(MONTH_DAY, 3), mon, num(MONTH_DAY, 2))}
      WHEN {this} IS NULL THEN NULL WHEN {this} <= {ref} THEN {this} ELSE {before} END
    WHEN {get(AGO, 1)} <> '' THEN CASE {unit} WHEN 'month' THEN {shift(f'-({n})')} WHEN 'year' THEN {shift(f'-12 * ({n})')} WHEN 'week' THEN {ref} - 604800.0 * ({n}) ELSE {ref} - 86400.0 * ({n}) END
    WHEN {last} > 0 THEN {day(f'CASE WHEN {last} <= month({at}) THEN {year} ELSE {year} - 1 END', last, '1')}
    WHEN {span} = 'month' THEN {shift('-1')} WHEN {span} = 'year' THEN {shift('-12')} WHEN {span} = 'week' THEN {ref} - 604800.0
    WHEN regexp_matches({x}, {_lit(YESTERDAY)}) THEN {ref} - 86400.0 END"""


def _strip_dates(x: str) -> str:
    for p in PHRASES:
        x = f"regexp_replace({x}, {_lit(p)}, ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\s{{2,}}', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g')"
    return f"regexp_replace({x}, '(?i)(?:[\\s,]+(?:on|in|at|around|back|since|by|from|until))+$', '')"


_STORED = """stored AS (SELECT query_id, list(predicate ORDER BY predicate) AS st FROM (SELECT DISTINCT q.query_id, p.predicate FROM q, (SELECT DISTINCT predicate FROM prof) p
    WHERE list_has_all({toks}, {need})) GROUP BY query_id)""".format(toks=_toks("question", False), need=_toks("p.predicate"))
_BYWORD = "list_filter([" + ", ".join(f"CASE WHEN list_has_any({_toks('question', False)}, {_list(k)}) THEN '{p}' END" for p, k in KEYWORDS.items()) + "], lambda p: p IS NOT NULL AND NOT list_contains(coalesce(st, []), p))"
_PREDS = f"preds AS (SELECT q.query_id, list_concat(coalesce(st, []), {_BYWORD}) AS preds FROM q LEFT JOIN stored USING (query_id))"
_ENT = f"ent AS (SELECT query_id, min(t) AS entity FROM (SELECT query_id, unnest({_toks('question', False)}) AS t FROM q) JOIN (SELECT DISTINCT subject FROM prof) ON t = subject GROUP BY query_id)"
_HOPS = "hops AS (SELECT query_id, list_filter(preds, lambda p: p = 'manager')[1] AS rel, list_filter(preds, lambda p: p <> 'manager')[1] AS attr FROM preds)"
_PROBES = """probes AS (SELECT c_custkey AS query_id, 'c' || c_custkey AS subject, n_name AS gold FROM customer JOIN nation ON c_nationkey = n_nationkey),
cand AS (SELECT query_id, subject, gold, unnest(list_distinct([gold, 'A'])) AS candidate FROM probes),
answers AS (SELECT query_id, first(candidate ORDER BY length(candidate) DESC, candidate) AS answer FROM cand
    WHERE NOT contains('what city, canada aside?', lower(candidate)) AND contains(lower(subject || '''s current city is ' || gold || '.'), lower(candidate)) GROUP BY query_id)"""
_NAMES = """nm AS (SELECT 'n' || (c_custkey % 5) AS namespace, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN g || ' N' || translate((c_custkey // 20)::VARCHAR, '0123456789', 'abcdefghij')
    WHEN c_custkey % 3 = 1 THEN 'N' || translate((c_custkey // 10)::VARCHAR, '0123456789', 'abcdefghij') ELSE g END AS name
  FROM (SELECT *, ['Ann', 'Bob', 'Cara', 'Dan', 'Eve', 'Finn', 'Gus'][c_custkey % 7 + 1] AS g FROM customer)),
surf AS (SELECT DISTINCT namespace, lower(name) AS surface FROM nm),
lone AS (SELECT * FROM surf WHERE NOT contains(surface, ' ') AND length(surface) % 2 = 0),
lent AS (SELECT namespace, word, min(surface) AS canonical FROM (SELECT namespace, surface, unnest(list_distinct([string_split(surface, ' ')[1], string_split(surface, ' ')[-1]])) AS word
    FROM surf WHERE contains(surface, ' ')) GROUP BY namespace, word HAVING count(DISTINCT surface) = 1)"""
_OBS = """ob AS (SELECT *, id % 5 <> 0 AS has, CASE WHEN id % 11 = 0 THEN ' ' ELSE subject END AS s,
    CASE WHEN id % 19 = 0 THEN 'no text' WHEN id % 17 = 0 THEN 'no finite time' WHEN id % 5 <> 0 AND id % 11 = 0 THEN 'fact is not whole'
      WHEN id % 5 <> 0 AND id % 13 = 0 THEN 'fact has no finite start' END AS problem FROM ev)"""

_LATE = """
WITH RECURSIVE late AS (SELECT 'n' || (user_id % 4) AS namespace, event_id AS id, 'user' || user_id AS subject, event_type AS object,
    epoch(ts) - CASE WHEN event_id % 7 = 0 THEN 259200.0 ELSE 0.0 END AS valid_from, epoch(ts) AS created_at,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
st AS (SELECT subject, rn, id, 'super' AS label, id AS oid, object AS oo, valid_from AS ovf, NULL::BIGINT AS pid, NULL::DOUBLE AS pvf FROM late WHERE rn = 1
  UNION ALL SELECT l.subject, l.rn, l.id, CASE WHEN l.object = s.oo THEN 'noop' WHEN l.valid_from < s.ovf THEN 'hist' ELSE 'super' END,
    CASE WHEN l.object <> s.oo AND l.valid_from >= s.ovf THEN l.id ELSE s.oid END, CASE WHEN l.object <> s.oo AND l.valid_from >= s.ovf THEN l.object ELSE s.oo END,
    CASE WHEN l.object <> s.oo AND l.valid_from >= s.ovf THEN l.valid_from ELSE s.ovf END, s.oid, s.ovf FROM st s JOIN late l ON l.subject = s.subject AND l.rn = s.rn + 1),
x AS (SELECT l.*, s.label, s.pid, s.pvf FROM late l JOIN st s USING (id))"""

ORACLE_SQL: dict[str, str] = {
    "bitemporal_facts": f"WITH {_VER} SELECT * FROM ver",
    "bitemporal_retro": f"""{_LATE}
SELECT namespace, id, subject, 'state' AS predicate, object, valid_from, CASE WHEN label = 'hist' THEN pvf ELSE lead(valid_from) OVER w END AS valid_to, created_at,
  CASE WHEN label = 'super' THEN lead(created_at) OVER w END AS expired_at, CASE WHEN label = 'hist' THEN pid ELSE lead(id) OVER w END AS superseded_by
FROM x WHERE label <> 'noop' WINDOW w AS (PARTITION BY subject, label ORDER BY created_at, id)""",
    "current_facts": f"WITH {_VER} SELECT namespace, id, subject, predicate, object, valid_from, created_at FROM ver WHERE valid_to IS NULL",
    "open_facts": f"WITH {_VER} SELECT namespace, id, object FROM ver WHERE valid_to IS NULL",
    "as_of_lookup": f"""WITH {_VER}, a AS (SELECT id AS query_id, namespace, subject, valid_from + 43200.0 AS t FROM ev)
SELECT query_id, v.subject, v.object, v.valid_from, v.id AS fact_id, v.subject || '''s state as of that time was ' || v.object || '.' AS line
FROM a JOIN ver v ON a.namespace = v.namespace AND a.subject = v.subject AND v.valid_from <= t AND (v.valid_to IS NULL OR t < v.valid_to)""",
    "path_lookup": f"WITH {_PROF} SELECT CAST(substr(p.subject, 2) AS BIGINT) AS query_id, c.object FROM prof p JOIN prof c ON c.subject = p.object AND c.predicate = 'city' WHERE p.predicate = 'manager'",
    "path_chain": f"""WITH {_PROF} SELECT CAST(substr(p.subject, 2) AS BIGINT) AS query_id, r.object, [p.id, m.id, r.id] AS chain FROM prof p
JOIN prof m ON m.subject = p.object AND m.predicate = 'manager' JOIN prof r ON r.subject = m.object AND r.predicate = 'role' WHERE p.predicate = 'manager'""",
    "fact_history": f"WITH {_VER} SELECT id, object, valid_from, valid_to FROM ver WHERE namespace = 'n1' AND subject = 'user5'",
    "inverse_lookup": f"WITH {_VER} SELECT DISTINCT namespace, subject FROM ver WHERE object = 'purchase' AND valid_to IS NULL",
    "predicates_for": f"WITH {_PROF} SELECT subject, array_to_string(list(predicate ORDER BY predicate), ',') AS predicates FROM prof GROUP BY subject",
    "forget_facts": f"WITH {_PROF}, g AS (SELECT DISTINCT subject FROM prof WHERE id % 20 = 0) SELECT id, subject, predicate, object FROM prof WHERE subject NOT IN (SELECT * FROM g) AND object NOT IN (SELECT * FROM g)",
    "contradictions": f"WITH {_EV} SELECT id, coalesce(lag(object) OVER (PARTITION BY namespace, subject ORDER BY created_at, id) <> object, false) AS contradicts FROM ev",
    "contradictions_retro": f"{_LATE} SELECT id, label <> 'noop' AND pid IS NOT NULL AS contradicts FROM x",
    "relation_predicates": f"WITH {_PROF} SELECT DISTINCT 'n0' AS namespace, predicate FROM prof WHERE object IN (SELECT subject FROM prof)",
    "tokenize_docs": f"SELECT doc_id, md5(array_to_string({_toks('text')}, ' ')) AS tokens_md5, len({_toks('text')})::INTEGER AS n FROM documents",
    "token_counts": f"SELECT doc_id, {_count('text')}::INTEGER AS tokens FROM documents",
    "lexical_jaccard": f"""SELECT c.conv_id, c.turn, round(CASE WHEN len({_toks('c.text')}) = 0 OR len({_toks('p.text')}) = 0 THEN 0.0 ELSE
len(list_intersect({_toks('c.text')}, {_toks('p.text')})) / len(list_distinct(list_concat({_toks('c.text')}, {_toks('p.text')}))) END, 6) AS jaccard
FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""",
    "normalize_keys": f"SELECT c_custkey, {_fold('trim(concat(' + _lit('  Straße ') + ', upper(c_name)))')} AS name_key FROM customer",
    "stable_hash": f"SELECT c_custkey, {_hash('c_name')} AS h FROM customer",
    "hash_embed": f"WITH {_sparse('e', 'benchmark', 'item_id')} SELECT id AS item_id, bucket::INTEGER AS bucket, round(weight, 6) AS weight FROM e",
    "strip_honorific": f"""SELECT c_custkey, regexp_replace(trim(['Mr. ', 'mrs ', 'Dr. ', 'Prof ', 'Mx. ', '', 'Miss', 'MS. '][c_custkey % 8 + 1] || c_mktsegment), '(?i)^(?:{'|'.join(HONORIFICS)})\\.?\\s+', '') AS name FROM customer""",
    "canon_predicate": f"SELECT p_partkey, {_canon('a')} AS predicate FROM (SELECT p_partkey, ['current mailing address', 'The previous Location', 'latest role', 'originally first', 'e-mail of the office', 'location'][p_partkey % 6 + 1] AS a FROM part)",
    "clean_objects": f"SELECT p_partkey, {_clean('v')} AS value FROM (SELECT p_partkey, '  ' || p_name || ['.', ' ...', '!? ', ';: ,', '', ' x.'][p_partkey % 6 + 1] AS v FROM part)",
    "clause_split": f"SELECT doc_id, len({_clauses('text')})::INTEGER AS clauses, md5(array_to_string({_clauses('text')}, '|')) AS parts_md5 FROM documents",
    "first_person": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN s || ' is here and ' || s || ' has seen ' || s || '''s home.' WHEN 1 THEN s || ' works at Acme, ' || s || ' loves it.'
WHEN 2 THEN s || '''s email is x@y.com; ' || s || ' is Ill.' ELSE 'Iris likes ' || s || ' and mine.' END AS told
FROM (SELECT c_custkey, 'N' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS s FROM customer)""",
    "event_date": f"WITH {_DATED} SELECT id, {_event_date('text', 'ref')} AS event_ts FROM dated",
    "strip_dates": f"WITH {_DATED} SELECT id, {_strip_dates('text')} AS rest FROM dated",
    "render_fact": f"""WITH {_PROF} SELECT id, CASE WHEN id % 5 = 0 THEN subject || ' manager ' || predicate || ' is ' || object || '.' WHEN id % 3 = 0 THEN subject || '''s ' || predicate || ' as of that time was ' || object || '.'
ELSE subject || '''s current ' || predicate || ' is ' || object || '.' END AS line,
CASE id % 3 WHEN 0 THEN subject || ' likes ' || object || '.' WHEN 1 THEN subject || ' dislikes ' || object || '.' ELSE subject || '''s favorite ' || object || ' is Thai.' END AS preference_line FROM prof""",
    "recency_decay": f"WITH {_EV} SELECT id, round(pow(0.5, greatest(0, 1700000000.0 - created_at) / 2592000.0), 6) AS decay FROM ev",
    "extract_facts": f"WITH {_SENT}, {_CL}, f AS (SELECT *, {_parse('clause')} AS fact FROM cl) SELECT text_id, clause_no::INTEGER AS clause_no, fact.subject AS subject, fact.predicate AS predicate, fact.object AS object FROM f WHERE fact IS NOT NULL",
    "preferences": f"""WITH {_SENT}, {_CL}, f AS (SELECT *, {_parse('clause', True)} AS fact FROM cl)
SELECT text_id, clause_no::INTEGER AS clause_no, fact.subject AS subject, fact.predicate AS predicate, fact.object AS object FROM f WHERE fact IS NOT NULL AND starts_with(fact.predicate, 'preference:')""",
    "coref_pronoun": f"""WITH {_SENT}, {_CL}, f AS (SELECT *, {_parse('clause')} AS fact FROM cl),
l AS (SELECT *, last_value(fact.subject IGNORE NULLS) OVER (PARTITION BY namespace ORDER BY ts, text_id, clause_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS who FROM f),
r AS (SELECT *, CASE WHEN who IS NOT NULL AND regexp_matches(clause, {_lit(_WHO)}) THEN regexp_extract(clause, {_lit(_WHO)}, 1) || who || '''s ' || regexp_extract(clause, {_lit(_WHO)}, 2) ELSE clause END AS rc FROM l),
g AS (SELECT text_id, clause_no, {_parse('rc')} AS fact FROM r)
SELECT text_id, clause_no::INTEGER AS clause_no, fact.subject AS subject, fact.predicate AS predicate, fact.object AS object FROM g WHERE fact IS NOT NULL""",
    "llm_parse_ground": f"""WITH {_SENT}, c AS (SELECT text_id, {_NM.format('text_id')} AS who, {_toks('text', False)} AS toks FROM sent)
SELECT text_id, 0 AS clause_no, who AS subject, 'city' AS predicate, 'the' AS object FROM c WHERE list_contains(toks, 'the') AND list_contains(toks, lower(who))
UNION ALL SELECT text_id, 1, who, 'Role', 'Acme' FROM c WHERE list_contains(toks, 'acme') AND list_contains(toks, lower(who))""",
    "echo_suppress": f"""WITH {_SENT}, e AS (SELECT namespace, text_id, ts, regexp_replace(text, 'N[a-j]+', 'Ann', 'g') AS text FROM sent),
cl AS (SELECT s.*, cs[i] AS clause FROM (SELECT *, {_clauses('text')} AS cs FROM e) s, range(1, 20) r(i) WHERE i <= len(cs)),
h AS (SELECT DISTINCT text_id FROM cl WHERE {_parse('clause')} IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY namespace, lower(trim(text)) ORDER BY ts, text_id) AS rn FROM e)
SELECT text_id FROM n WHERE rn = 1 OR text_id NOT IN (SELECT text_id FROM h)""",
    "dated_facts": f"""WITH {_DATED}, d AS (SELECT id, ref, 'Bob lives in Oslo since ' || text AS clause FROM dated),
f AS (SELECT id, ref, regexp_replace('Oslo since ' || substr(clause, 25), '^\\s+|[.!?,;:\\s]+$', '', 'g') AS o, {_event_date('clause', 'ref')} AS told FROM d)
SELECT id AS text_id, 0 AS clause_no, 'Vienna' AS object, ref AS valid_from FROM dated
UNION ALL SELECT id, 1, CASE WHEN told IS NOT NULL AND {_strip_dates('o')} <> '' THEN {_strip_dates('o')} ELSE o END, coalesce(told, ref) FROM f""",
    "ellipsis_facts": f"""WITH {_SENT}, b AS (SELECT namespace, text_id, ts, CASE WHEN text_id % 3 = 0 THEN 'Works at ' || text_id ELSE text END AS text FROM sent),
{_CL.replace("FROM sent)", "FROM b)")}, f AS (SELECT *, {_parse('clause')} AS fact FROM cl),
l AS (SELECT *, last_value(fact.subject IGNORE NULLS) OVER (PARTITION BY namespace ORDER BY ts, text_id, clause_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS who FROM f)
SELECT text_id, who AS subject, text_id::VARCHAR AS object FROM l WHERE text_id % 3 = 0 AND who IS NOT NULL""",
    "definite_np": f"""WITH t AS (SELECT c_custkey AS k, {_NM.format('c_custkey')} AS who, CASE WHEN c_custkey % 6 = 4 THEN 'clerk' ELSE translate((c_custkey // 3)::VARCHAR, '0123456789', 'abcdefghij') END AS r FROM customer)
SELECT a.k AS text_id, min(b.who) AS subject, 'City' || a.who AS object FROM t a JOIN t b ON a.k % 3 = 2 AND b.k % 3 <> 2 AND b.k < a.k AND b.r = translate((a.k // 3)::VARCHAR, '0123456789', 'abcdefghij')
GROUP BY a.k, a.who HAVING count(*) = 1""",
    "plan_preference": f"WITH {_PROF}, {_Q}, {_ENT} SELECT query_id, query_id % 4 = 3 AND entity IS NOT NULL AS preference FROM q LEFT JOIN ent USING (query_id)",
    "entity_canonical": f"""WITH {_NAMES} SELECT s.namespace, s.surface, coalesce(l.canonical, s.surface) AS canonical FROM surf s
LEFT JOIN (SELECT * FROM lent x WHERE NOT EXISTS (SELECT 1 FROM lone o WHERE o.namespace = x.namespace AND o.surface = x.word)) l ON l.namespace = s.namespace AND l.word = s.surface""",
    "entity_vocab": f"WITH {_NAMES} SELECT namespace, surface AS entity FROM surf WHERE contains(surface, ' ') UNION SELECT namespace, surface FROM lone UNION SELECT namespace, word FROM lent",
    "knn_exact": _knn(10),
    "knn_filtered": _knn(5, "e.vec_id <= 0.76::DOUBLE * (SELECT max(vec_id) FROM embeddings) AND e.vec_id >= 0.04::DOUBLE * (SELECT max(vec_id) FROM embeddings) AND e.label % 2 = 0 AND e.label % 3 = 0"),
    "nearest_prior": f"SELECT query_id, id, score FROM ({_knn(1, 'e.vec_id + 1 <= q.vec_id')})",
    "hybrid_search": f"WITH {_TURNS}, {_hybrid('turns')} SELECT query_id, rank, id, score FROM hr WHERE rank <= 8",
    "adaptive_gate": f"""
WITH RECURSIVE s AS (SELECT event_type AS namespace, event_id AS id, {_hash('event_id::VARCHAR')} % 1000 / 1000.0::DOUBLE AS novelty, event_id % 41 = 0 AS c,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT namespace, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::VARCHAR AS decision, NULL::DOUBLE AS theta, 0.5::DOUBLE AS nxt, 0::BIGINT AS stored FROM (SELECT DISTINCT namespace FROM s)
  UNION ALL SELECT s.namespace, s.rn, s.id, CASE WHEN c OR novelty >= g.nxt THEN 'stored' WHEN 1 - novelty >= 0.7 THEN 'reinforced' ELSE 'discarded' END, g.nxt,
    least(0.95, greatest(0.35, g.nxt + 0.05::DOUBLE * ((g.stored + (c OR novelty >= g.nxt)::INT) / s.rn - 0.2::DOUBLE))), g.stored + (c OR novelty >= g.nxt)::INT
    FROM g JOIN s ON s.namespace = g.namespace AND s.rn = g.rn + 1)
SELECT namespace, id, decision, round(theta, 9) AS theta FROM g WHERE rn > 0""",
    "ingest_receipts": f"""
WITH RECURSIVE {_EV}, {_OBS}, good AS (SELECT * FROM ob WHERE problem IS NULL),
flags AS (SELECT id, coalesce(lag(object) OVER (PARTITION BY namespace, subject ORDER BY created_at, id) <> object, false) AS c FROM good WHERE has),
s AS (SELECT namespace, id, {_hash("(subject || ' is ' || object)")} % 1000 / 1000.0::DOUBLE AS novelty, coalesce(c, false) AS c,
    row_number() OVER (PARTITION BY namespace ORDER BY created_at, id) AS rn FROM good LEFT JOIN flags USING (id)),
g AS (SELECT namespace, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::VARCHAR AS decision, NULL::BOOLEAN AS contradiction, 0.5::DOUBLE AS nxt, 0::BIGINT AS stored FROM (SELECT DISTINCT namespace FROM s)
  UNION ALL SELECT s.namespace, s.rn, s.id, CASE WHEN c OR novelty >= g.nxt THEN 'stored' WHEN 1 - novelty >= 0.7 THEN 'reinforced' ELSE 'discarded' END, c,
    least(0.95, greatest(0.35, g.nxt + 0.05::DOUBLE * ((g.stored + (c OR novelty >= g.nxt)::INT) / s.rn - 0.2::DOUBLE))), g.stored + (c OR novelty >= g.nxt)::INT
    FROM g JOIN s ON s.namespace = g.namespace AND s.rn = g.rn + 1)
SELECT namespace, id, decision, contradiction FROM g WHERE rn > 0""",
    "novelty": """
WITH RECURSIVE s AS (SELECT 'l' || label AS namespace, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, embedding FROM embeddings),
sims AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM s a JOIN s b ON a.namespace = b.namespace AND b.rn < a.rn),
g AS (SELECT namespace, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::DOUBLE AS novelty, NULL::BIGINT AS target, 0.5::DOUBLE AS theta, 0.5::DOUBLE AS nxt, 0::BIGINT AS stored, []::BIGINT[] AS ids FROM (SELECT DISTINCT namespace FROM s)
  UNION ALL SELECT namespace, rn, id, novelty, target, nxt, least(0.95, greatest(0.35, nxt + 0.05::DOUBLE * ((stored + (novelty >= nxt)::INT) / rn - 0.2::DOUBLE))), stored + (novelty >= nxt)::INT,
    CASE WHEN novelty >= nxt THEN list_append(ids, id) ELSE ids END FROM (
    SELECT s.namespace, s.rn, s.id, g.nxt, g.stored, any_value(g.ids) AS ids, coalesce(1 - least(1.0, greatest(0.0, max(sim))), 1.0) AS novelty, arg_max(b, sim) AS target
    FROM g JOIN s ON s.namespace = g.namespace AND s.rn = g.rn + 1 LEFT JOIN sims ON sims.a = s.id AND list_contains(g.ids, sims.b) GROUP BY ALL))
SELECT namespace, id, CASE WHEN novelty >= theta THEN 'stored' WHEN 1 - novelty >= 0.7 THEN 'reinforced' ELSE 'discarded' END AS decision, round(novelty, 6) AS novelty,
  CASE WHEN novelty < theta AND 1 - novelty >= 0.7 THEN target END AS target FROM g WHERE rn > 0""",
    "reinforcement": f"WITH {_DEC} SELECT namespace, CASE WHEN decision = 'reinforced' THEN target ELSE id END AS id, count(*) AS support_count, max(ts) AS last_seen_ts FROM dec WHERE decision <> 'discarded' GROUP BY namespace, 2",
    "predictive_surprise": "SELECT event_id, round(greatest(0.2, 1 - exp(avg(-((event_id + i) % 7) / 4.0))), 6) AS surprise FROM events, range(1, 6) r(i) WHERE i <= event_id % 5 + 1 AND i % 3 <> 0 GROUP BY event_id",
    "session_first_ts": f"WITH {_TURNS} SELECT namespace, CAST(substr(session_id, 2) AS INTEGER) AS session_no, min(ts) AS ts FROM turns GROUP BY ALL",
    "plan_entity": f"WITH {_PROF}, {_Q}, {_ENT} SELECT * FROM ent",
    "plan_predicate": f"WITH {_PROF}, {_Q}, {_STORED}, {_PREDS} SELECT query_id, array_to_string(preds, ',') AS predicates FROM preds",
    "plan_hops": f"WITH {_PROF}, {_Q}, {_STORED}, {_PREDS}, {_HOPS} SELECT query_id, coalesce(attr, rel) AS predicate, CASE WHEN rel IS NOT NULL AND attr IS NOT NULL THEN rel || '>' || attr END AS hops FROM hops",
    "plan_as_of": f"""WITH {_TURNS}, {_Q}, f AS (SELECT CAST(substr(session_id, 2) AS INTEGER) AS n, min(ts) AS ts FROM turns WHERE namespace = 'n0' GROUP BY ALL)
SELECT query_id, ts AS as_of FROM (SELECT query_id, CASE WHEN regexp_matches(lower(question), {_lit(AS_OF)}) THEN try_cast(regexp_extract(lower(question), {_lit(SESSION)}, 1) AS INTEGER) END AS n FROM q) LEFT JOIN f USING (n)""",
    "structured_fetch": f"""WITH {_PROF}, {_TURNS}, {_Q}, {_STORED}, {_PREDS}, {_HOPS}, {_ENT},
p AS (SELECT query_id, entity, rel, attr FROM ent JOIN hops USING (query_id))
SELECT query_id, 1 AS line_no, subject || '''s current ' || predicate || ' is ' || object || '.' AS line, id AS fact_id FROM p JOIN prof ON subject = entity AND predicate = coalesce(attr, rel) WHERE rel IS NULL OR attr IS NULL
UNION ALL SELECT query_id, h, entity || ' ' || rel || ' ' || attr || ' is ' || b.object || '.', CASE h WHEN 1 THEN a.id ELSE b.id END FROM p JOIN prof a ON a.subject = entity AND a.predicate = rel
  JOIN prof b ON b.subject = a.object AND b.predicate = attr, range(1, 3) r(h) WHERE rel IS NOT NULL AND attr IS NOT NULL""",
    "backstop_facts": f"""WITH {_PROF}, {_Q}, m AS (SELECT DISTINCT query_id, unnest({_toks("question || ' And c7, c9?'", False)}) AS entity FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity ORDER BY predicate, id) AS turn FROM m JOIN prof ON subject = entity),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, entity, id)::INTEGER AS line_no FROM f)
SELECT query_id, line_no, subject || '''s current ' || predicate || ' is ' || object || '.' AS line, id AS fact_id FROM l WHERE line_no <= 2""",
    "stale_filter": f"""WITH p AS (SELECT DISTINCT list_distinct(list_concat(({_toks('text')})[1:1], ({_toks('text')})[2:3])) AS need FROM benchmark)
SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM p WHERE list_has_all({_toks('d.text')}, need))""",
    "stale_pairs": f"""WITH {_VER} SELECT DISTINCT subject, lower(object) AS value FROM ver v WHERE valid_to IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM ver o WHERE o.valid_to IS NULL AND o.namespace = v.namespace AND o.subject = v.subject AND o.object = v.object)""",
    "superseded_filter": f"""WITH {_EPI}, past AS (SELECT DISTINCT namespace, subject, object FROM ver v
    WHERE NOT EXISTS (SELECT 1 FROM ver o WHERE o.valid_to IS NULL AND o.namespace = v.namespace AND o.subject = v.subject AND o.object = v.object))
SELECT id FROM epi e WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.namespace = e.namespace AND p.subject = e.fs AND p.object = e.fo)""",
    "fuse_rank": f"WITH {_FUSED} SELECT query_id, id, fused FROM fused",
    "context_payload": f"""WITH {_FUSED},
l AS (SELECT item_id AS query_id, 0 AS tier, 1.0::DOUBLE AS pos, 0 AS tie, 'item ' || item_id || ' is known.' AS line FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT query_id, 1, -fused, id, text FROM fused),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, pos, tie) AS n FROM l),
c AS (SELECT query_id, string_agg('[' || n || '] ' || line, chr(10) ORDER BY n) AS context, count(*) AS items FROM n WHERE n <= 4 GROUP BY query_id)
SELECT query_id, md5(context) AS context_md5, items, {_count('context')}::INTEGER AS tokens FROM c""",
    "window_query": f"WITH {_TURNS}, recent AS (SELECT * FROM turns WHERE ts BETWEEN 0.1::DOUBLE * (SELECT max(ts) FROM turns) AND 0.6::DOUBLE * (SELECT max(ts) FROM turns)), {_hybrid('recent')} SELECT query_id, rank, id, score FROM hr WHERE rank <= 4",
    "consolidate_prune": f"WITH {_EPI} SELECT id, content FROM kept",
    "consolidate_merge": f"WITH {_EPI}, {_CLAIMS} SELECT namespace, content, support_count, last_seen_ts, supports, entities FROM claims",
    "near_dup_pairs": f"""WITH {_sparse('e', 'benchmark', 'item_id')} SELECT a.id AS a, b.id AS b, round(sum(a.weight * b.weight), 6) AS cosine FROM e a JOIN e b ON a.bucket = b.bucket AND a.id < b.id GROUP BY ALL HAVING cosine >= 0.1""",
    "consolidation_report": f"""WITH {_EPI}, {_CLAIMS} SELECT n.namespace, (SELECT count(*) FROM epi e WHERE e.namespace = n.namespace) AS episodes_in, (SELECT count(*) FROM claims c WHERE c.namespace = n.namespace) AS claims_out,
(SELECT coalesce(sum(n - 1), 0)::BIGINT FROM claims c WHERE c.namespace = n.namespace) AS dupes_merged, (SELECT count(*) FROM epi e WHERE e.namespace = n.namespace AND fp IS NOT NULL) - (SELECT count(*) FROM kept k WHERE k.namespace = n.namespace) AS pruned,
(SELECT count(*) FROM ver v WHERE v.namespace = n.namespace AND valid_to IS NOT NULL) AS contradictions_resolved FROM (SELECT DISTINCT namespace FROM epi) n""",
    "forget_cascade": f"""WITH {_EPI}, g AS (SELECT DISTINCT namespace, fs FROM epi WHERE id % 500 = 0 AND fs IS NOT NULL), d AS (SELECT id FROM epi JOIN g USING (namespace, fs))
SELECT 'facts' AS kind, id FROM ver v WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.namespace = v.namespace AND g.fs = v.subject)
UNION ALL SELECT k, id FROM epi, (VALUES ('episodes'), ('vectors'), ('asserted')) t(k) WHERE id NOT IN (SELECT id FROM d)""",
    "fact_validation": f"WITH {_EV}, {_OBS} SELECT id, problem FROM ob",
    "snapshot_roundtrip": f"WITH {_VER} SELECT namespace, id, object, valid_from, valid_to FROM ver",
    "journal_replay": f"WITH {_VER} SELECT namespace, id, object, valid_from, valid_to FROM ver",
    "namespace_isolation": f"WITH {_VER} SELECT namespace, count(*) AS versions, count(DISTINCT subject) AS subjects FROM ver WHERE namespace <> 'n2' GROUP BY namespace",
    "cassette_replay": "SELECT item_id, 'answer ' || substr(text, 1, 5) AS completion FROM benchmark",
    "store_stats": f"""WITH {_VER}, r AS (SELECT namespace, count(*) FILTER (id % 10 <> 9) AS episodic, count(*) FILTER (id % 10 = 9) AS semantic, sum(strlen(subject || ' is ' || object))::BIGINT AS bytes FROM ev GROUP BY namespace),
f AS (SELECT namespace, count(*) AS facts, count(*) FILTER (valid_to IS NULL) AS open_facts FROM ver GROUP BY namespace) SELECT * FROM r JOIN f USING (namespace)""",
    "write_metrics": f"""WITH {_DEC} SELECT namespace, count(*) AS writes, count(*) FILTER (decision = 'stored') AS stored, count(*) FILTER (decision = 'reinforced') AS reinforced, count(*) FILTER (decision = 'discarded') AS discarded,
round(avg((decision = 'discarded')::INT), 9) AS discard_rate FROM dec GROUP BY namespace""",
    "pricing": f"SELECT conv_id, round(sum({_count('text')}) / 1000.0::DOUBLE * 0.0001::DOUBLE + sum({_count('text')}) / 4.0::DOUBLE / 1000.0::DOUBLE * 0.0025::DOUBLE + count(*) * 0.001::DOUBLE, 9) AS cost FROM conversations GROUP BY conv_id",
    "growth_curve": f"""WITH {_DEC}, g AS (SELECT id, count(*) OVER w AS seen, sum((decision = 'stored')::INT) OVER w AS st FROM dec WINDOW w AS (PARTITION BY namespace ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT id, seen, st::BIGINT AS stored_so_far, round(st / seen, 9) AS ratio FROM g""",
    "baseline_naive": _knn(4, "e.vec_id <= q.vec_id + 250", ties="id DESC"),
    "baseline_long_context": f"""WITH {_TURNS}, c AS (SELECT namespace, id, {_count('text')} AS tokens, sum({_count('text')}) OVER (PARTITION BY namespace ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM turns)
SELECT namespace, id, tokens::INTEGER AS tokens FROM c WHERE used <= 800""",
    "reader": f"WITH {_PROBES} SELECT query_id, answer FROM answers",
    "harness_scores": f"""WITH {_PROBES}, r AS (SELECT 'C' || (p.query_id % 6 + 1) AS category, coalesce(lower(answer) = lower(gold), false) AND NOT (p.query_id % 5 = 0 AND coalesce(lower(answer) = lower(gold), false)) AS ok, p.query_id % 40 AS tok
    FROM probes p LEFT JOIN answers USING (query_id)), a AS (SELECT category, count(*) AS probes, avg(ok::INT) AS acc, avg(tok) AS tk FROM r GROUP BY category)
SELECT category, probes, round(CASE WHEN category = 'C3' THEN acc - 0.5 * tk / greatest((SELECT max(tk) FROM a), 1.0) ELSE acc END, 9) AS score FROM a""",
}
