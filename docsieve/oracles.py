"""DuckDB SQL equivalents of ``docsieve.queries``, put together from shared parts."""

from __future__ import annotations

import hashlib

from docsieve.operators.state import WORKFLOW_LOGS, workflow_moves
from docsieve.plans import packs
from docsieve.plans.rule_run import SKIPPED
from docsieve.queries import RAW_ANSWERS, WRITE_RESPONSES
from docsieve.schemas import WORKFLOW_EVENTS

_WS = "' ' || chr(9) || chr(13)"
_BLOCKS = f"""
docs AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: trim(t, {_WS}) <> '') AS l FROM documents),
blocks AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS idx, unnest(l) AS raw, trim(unnest(l), {_WS}) AS t FROM docs)"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PATTERNS = {f.name: f.pattern for f in packs.CORPUS.fields}
_CANDIDATES = ",\ncands AS (\n" + "\nUNION ALL ".join(
    f"SELECT doc_id, '{n}' AS field, idx, idx AS last, t AS src, regexp_extract(t, {_q(p)}, 1) AS v FROM blocks WHERE regexp_matches(t, {_q(p)})" for n, p in _PATTERNS.items()
) + ")"
_LABEL = "CASE " + " ".join(f"WHEN starts_with(t, '{k[0]}') THEN '{s}'" for s, k in packs.CORPUS.sections.items()) + " END"
_SECTIONS = f""",
heads AS (
  SELECT doc_id, idx, name, lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM (SELECT doc_id, idx, {_LABEL} AS name FROM blocks) WHERE name IS NOT NULL),
sects AS (
  SELECT h.doc_id, h.name, h.idx, max(b.idx) AS last, string_agg(b.t, chr(10) ORDER BY b.idx) AS v
  FROM heads h JOIN blocks b ON b.doc_id = h.doc_id AND b.idx >= h.idx AND b.idx < coalesce(h.nxt, 1000000000) GROUP BY 1, 2, 3)"""


def _facts(names: list[str], source: str) -> str:
    grid = " UNION ALL ".join(f"SELECT '{n}' AS field" for n in names)
    return f"""
  SELECT d.doc_id, g.field, CASE WHEN a.n = 1 THEN a.v END AS value, CASE WHEN a.n = 1 THEN a.src ELSE a.srcs END AS source_text,
    CASE WHEN a.n IS NULL THEN 'not_found' WHEN a.n > 1 THEN 'ambiguous' ELSE 'found' END AS status, a.lo AS block_start, CASE WHEN a.n > 1 THEN a.hi ELSE a.last END AS block_end
  FROM documents d CROSS JOIN ({grid}) g LEFT JOIN (
    SELECT doc_id, field, count(DISTINCT v) AS n, arg_min(v, idx) AS v, arg_min(src, idx) AS src, string_agg(src, chr(10) ORDER BY idx) AS srcs, min(idx) AS lo, max(last) AS hi, arg_min(last, idx) AS last
    FROM {source} GROUP BY 1, 2) a ON a.doc_id = d.doc_id AND a.field = g.field"""


_FACTS = f""",
facts AS ({_facts(list(_PATTERNS), "cands")}
UNION ALL {_facts(list(packs.CORPUS.sections), "(SELECT doc_id, name AS field, idx, last, v AS src, v FROM sects)")})"""
_ALL = "WITH " + _BLOCKS + _CANDIDATES + _SECTIONS + _FACTS

_MISSING = "(status IN ('not_found', 'failed') OR coalesce(value, '') = '')"
_TEXT = "coalesce(nullif(source_text, ''), nullif(value, ''), '')"
_VERSION = packs.CORPUS_METRICS["version"]


def _word(keywords: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({_TEXT}, {_q(k)}) THEN {_q(k)}" for k in keywords) + " END"


def _keyword(rule_id: int) -> str:
    c = packs.CORPUS_RULES[rule_id - 1].config
    fields = [p.split(".")[1] for p in c["fields"]]
    rank = "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(fields)) + " END"
    return f"""
  SELECT doc_id, {rule_id} AS rule_id, 'source' AS evidence_type, txt AS evidence_text, word AS actual_value, NULL AS expected_value, block_start, block_end FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {rank}) AS rn FROM (
      SELECT *, {_TEXT} AS txt, {_word(c["keywords"])} AS word FROM facts WHERE field IN ({", ".join(_q(f) for f in fields)}) AND NOT {_MISSING}) WHERE word IS NOT NULL) WHERE rn = 1"""


def _missing(rule_id: int) -> str:
    c = packs.CORPUS_RULES[rule_id - 1].config
    fields = [p.split(".")[1] for p in c["fields"]]
    path = "CASE field " + " ".join(f"WHEN '{p.split('.')[1]}' THEN '{p}'" for p in c["fields"]) + " END"
    rank = "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(fields)) + " END"
    least = 1 if c["trigger"] == "any" else len(fields)
    return f"""
  SELECT doc_id, {rule_id} AS rule_id, 'missing' AS evidence_type, {_q(c["hit_message"])} AS evidence_text, string_agg({path}, ', ' ORDER BY {rank}) AS actual_value, {_q(packs.CORPUS_WORDING.expected_field)} AS expected_value, NULL::INTEGER AS block_start, NULL::INTEGER AS block_end
  FROM facts WHERE field IN ({", ".join(_q(f) for f in fields)}) AND {_MISSING} GROUP BY doc_id HAVING count(*) >= {least}"""


_HITS = f""",
raw_hits AS ({_missing(1)} UNION ALL {_missing(2)} UNION ALL
  SELECT doc_id, 3, 'derived', txt, CASE WHEN m = floor(m) THEN m::BIGINT::VARCHAR ELSE m::VARCHAR END, 'at most 2.5', block_start, block_end FROM (
    SELECT *, {_TEXT} AS txt, list_max(list_transform(list_filter(list_concat(regexp_extract_all({_TEXT}, {_q(_VERSION)}, 1), regexp_extract_all({_TEXT}, {_q(_VERSION)}, 2)), lambda x: coalesce(x, '') <> ''), lambda x: x::DOUBLE)) AS m
    FROM facts WHERE field = 'license' AND NOT {_MISSING}) WHERE m > 2.5
  UNION ALL {_keyword(4)} UNION ALL {_keyword(5)}),
rules AS (SELECT * FROM (VALUES {", ".join(f"({r.rule_id}, '{r.rule_code}', {_q(r.rule_name)}, '{r.risk_level}', '{r.rule_version}', {_q(r.config['hit_message'])}, {_q(r.suggestion)}, '{r.match_mode}')" for r in packs.CORPUS_RULES)})
  t(rule_id, rule_code, rule_name, risk_level, rule_version, hit_message, suggestion, match_mode)),
hits AS (SELECT h.*, r.* EXCLUDE (rule_id), CASE risk_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w FROM raw_hits h JOIN rules r ON r.rule_id = h.rule_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, rule_code, rule_id) AS place FROM hits),
rolled AS (
  SELECT d.doc_id, count(h.rule_id) AS n, count(*) FILTER (risk_level = 'high') AS high_count, count(*) FILTER (risk_level = 'medium') AS medium_count, count(*) FILTER (risk_level = 'low') AS low_count,
    CASE coalesce(max(w), 1) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS overall_risk_level,
    string_agg(rule_name, ', ' ORDER BY place) FILTER (place <= 3) AS names,
    string_agg(place || '. ' || rule_name || ': ' || hit_message, chr(10) ORDER BY place) AS focus, string_agg(place || '. ' || suggestion, chr(10) ORDER BY place) AS advice
  FROM documents d LEFT JOIN placed h ON h.doc_id = d.doc_id GROUP BY 1),
results AS (
  SELECT *, CASE WHEN n = 0 THEN 'no rule hit, risk low' ELSE n || ' hits: ' || high_count || ' high, ' || medium_count || ' medium, ' || low_count || ' low; first ' || names END AS summary_text FROM rolled)"""
_REVIEW = _ALL + _HITS


def _mode(*modes: str) -> str:
    return f"{_REVIEW}\nSELECT doc_id, rule_code, actual_value, expected_value, evidence_text FROM hits WHERE match_mode IN ({', '.join(_q(m) for m in modes)})"


_TARGET = "CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'reviewing' WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'done' END"
_OK = "((a.state = 'pending' AND x.t = 'parsing') OR (a.state = 'parsing' AND x.t IN ('reviewing', 'blocked')) OR (a.state = 'reviewing' AND x.t IN ('blocked', 'done')) OR (a.state = 'blocked' AND x.t IN ('parsing', 'reviewing')))"
# fixed values: what ``functions.text.folded`` leaves out
_FOLD_SUPPORT = r"""regexp_replace({0}, '[\s,，。；;：:（）()￥¥$\-年月日/]', '', 'g')"""


def _supported(value: str, evidence: str) -> str:
    v, e = _FOLD_SUPPORT.format(value), _FOLD_SUPPORT.format(evidence)
    return f"({v} <> '' AND contains(lower({e}), lower({v})))"


# fixed values: what the fixture of the contract domain must give
_GOLDEN_BASIC = (("contract_title", "软件采购合同", 0), ("contract_number", "HT-2026-0098", 1), ("signing_party", "星河科技有限公司（虚构）", 2), ("counterparty", "远航软件服务有限公司（虚构）", 3), ("amount", "500000", 4), ("currency", "CNY", 4), ("effective_date", "2026-10-01", 5), ("expiry_date", "2027-09-30", 6))
_GOLDEN_CLAUSES = (("payment_clause", 7, 9, 1), ("delivery_clause", 10, 11, 2), ("acceptance_clause", 12, 13, 2), ("breach_clause", 14, 15, 2), ("confidentiality_clause", 16, 17, 2), ("data_clause", 18, 19, 2), ("intellectual_property_clause", 20, 21, 2), ("dispute_resolution_clause", 22, 23, 2))
_GOLDEN = ", ".join([f"('basic_info', '{f}', '{v}', 'found', {b}, {b}, 1, 1)" for f, v, b in _GOLDEN_BASIC] + [f"('clauses', '{f}', NULL, 'found', {a}, {b}, {p}, 2)" for f, a, b, p in _GOLDEN_CLAUSES])

_LADDER = f"""
WITH lines AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2),
rules AS (SELECT * FROM (VALUES {", ".join("(" + str(r[0]) + "::BIGINT, " + ", ".join(_q(x) for x in r[1:]) + ")" for r in packs.LADDER_RULES)}) t(rule_id, rule_code, risk_level, rule_status, match_mode, rule_version)),
hits AS (
  SELECT l_orderkey * 10 + l_linenumber AS hit_id, l_orderkey AS contract_parse_id, l_linenumber AS rule_id, CASE WHEN l_linenumber >= 6 THEN '1.0-abc' WHEN l_returnflag = 'R' THEN '0.9' ELSE '1.0' END AS rule_version, 'rule ' || l_linenumber AS rule_name FROM lines),
first_evals AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 2 AS evaluation_id, l_orderkey AS contract_parse_id, l_linenumber AS rule_id, CASE WHEN l_suppkey % 10 = 0 THEN '0.9' ELSE '1.0' END AS rule_version, 'fp' || (l_suppkey % 2) AS fp, 'success' AS status, 'hit' AS decision, l_orderkey * 10 + l_linenumber AS hit_id, l_partkey, l_suppkey, l_linestatus
  FROM lines WHERE l_linenumber >= 6),
evaluations AS (
  SELECT evaluation_id, contract_parse_id, rule_id, rule_version, fp, status, decision, hit_id FROM first_evals
  UNION ALL SELECT evaluation_id + 1, contract_parse_id, rule_id, rule_version, fp, CASE WHEN l_partkey % 3 = 1 THEN 'degraded' ELSE 'success' END, CASE l_partkey % 3 WHEN 0 THEN CASE WHEN l_suppkey % 4 <> 0 THEN 'not_hit' END WHEN 2 THEN 'uncertain' END, NULL FROM first_evals WHERE l_linestatus = 'F'),
latest AS (
  SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY contract_parse_id, e.rule_id ORDER BY evaluation_id DESC) AS rn FROM evaluations e JOIN rules r ON r.rule_id = e.rule_id AND r.rule_version = e.rule_version AND rule_status = 'active' AND match_mode = 'llm_semantic') WHERE rn = 1),
current_hits AS (
  SELECT h.* FROM hits h JOIN rules r ON r.rule_id = h.rule_id AND r.rule_version = h.rule_version AND rule_status = 'active' AND match_mode <> 'llm_semantic'
  UNION ALL SELECT h.* FROM hits h WHERE hit_id IN (SELECT hit_id FROM latest WHERE hit_id IS NOT NULL)),
partials AS (
  SELECT o_orderkey AS contract_parse_id, count(l.rule_id) FILTER (status = 'success' AND decision IS DISTINCT FROM 'uncertain') < (SELECT count(*) FROM rules WHERE rule_status = 'active' AND match_mode = 'llm_semantic') AS partial
  FROM orders LEFT JOIN latest l ON l.contract_parse_id = o_orderkey GROUP BY 1),
rule_set AS (SELECT sha256(string_agg(rule_code || '@' || rule_version, chr(10) ORDER BY rule_code)) AS rule_set_fingerprint FROM rules WHERE rule_status = 'active'),
hit_parts AS (SELECT contract_parse_id, string_agg(p, chr(10) ORDER BY p) AS h FROM (SELECT contract_parse_id, hit_id || '@' || rule_id || '@' || rule_version AS p FROM current_hits) GROUP BY 1),
eval_parts AS (SELECT contract_parse_id, string_agg(p, chr(10) ORDER BY p) AS e FROM (SELECT contract_parse_id, rule_id || '@' || rule_version || '@' || fp || '@' || status || '@' || coalesce(decision, 'None') AS p FROM latest) GROUP BY 1),
marks AS (
  SELECT o_orderkey AS contract_parse_id, o_custkey AS task_id, rule_set_fingerprint, sha256(coalesce(h, '') || CASE WHEN e IS NULL THEN '' ELSE chr(10) || '--semantic--' || chr(10) || e END) AS rule_hit_fingerprint
  FROM orders CROSS JOIN rule_set LEFT JOIN hit_parts hp ON hp.contract_parse_id = o_orderkey LEFT JOIN eval_parts ep ON ep.contract_parse_id = o_orderkey),
results AS (SELECT contract_parse_id + 7 AS review_result_id, contract_parse_id, CASE WHEN contract_parse_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS review_status, rule_set_fingerprint, rule_hit_fingerprint FROM marks WHERE contract_parse_id % 4 = 1),
levels AS (SELECT h.*, r.rule_code, r.risk_level, CASE r.risk_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w FROM current_hits h JOIN rules r ON r.rule_id = h.rule_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY contract_parse_id ORDER BY w DESC, rule_code, rule_id) AS place FROM levels),
rolled AS (
  SELECT m.contract_parse_id, m.task_id, m.rule_set_fingerprint, m.rule_hit_fingerprint, any_value(p.partial) AS partial, any_value(x.review_result_id) AS review_result_id, count(h.hit_id) AS n,
    count(*) FILTER (risk_level = 'high') AS hi, count(*) FILTER (risk_level = 'medium') AS me, count(*) FILTER (risk_level = 'low') AS lo, CASE coalesce(max(w), 1) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk,
    string_agg(rule_name, ', ' ORDER BY place) FILTER (place <= 3) AS names, string_agg(place || '. ' || rule_name || ': hit of ' || rule_name, chr(10) ORDER BY place) AS focus, string_agg(place || '. mend ' || rule_name, chr(10) ORDER BY place) AS advice,
    coalesce(string_agg(hit_id::VARCHAR, ',' ORDER BY hit_id), '') AS hit_ids
  FROM marks m JOIN partials p ON p.contract_parse_id = m.contract_parse_id LEFT JOIN placed h ON h.contract_parse_id = m.contract_parse_id
    LEFT JOIN results x ON x.contract_parse_id = m.contract_parse_id AND x.review_status = 'completed' GROUP BY 1, 2, 3, 4),
told AS (
  SELECT *, CASE WHEN contract_parse_id % 5 = 0 THEN 'RULE_REVIEW_NOT_FOUND' WHEN review_result_id IS NOT NULL THEN 'REVIEW_RESULT_REUSED' ELSE 'REVIEW_RESULT_CREATED' END AS outcome,
    CASE WHEN n = 0 THEN 'no rule hit, risk low' ELSE n || ' hits: ' || hi || ' high, ' || me || ' medium, ' || lo || ' low; first ' || names END AS summary FROM rolled)"""
_START, _MOVES = workflow_moves()
_MOVE = "CASE a.state || '>' || x.t " + " ".join(f"WHEN '{s}>{e}' THEN '{int(r)}{t}'" for (s, e), (t, r) in _MOVES.items()) + " END"
_ACTION = "CASE event_id * 7 % " + str(len(WORKFLOW_EVENTS)) + " " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(WORKFLOW_EVENTS)) + " END"
_MADE = "CASE WHEN outcome = 'REVIEW_RESULT_CREATED' THEN "

ORACLES: dict[str, str] = {
    "block_segmentation": f"WITH {_BLOCKS}\nSELECT doc_id, idx AS block_index, length(raw)::INTEGER AS n_chars, length(regexp_replace(raw, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 10 AS meaningful FROM blocks",
    "field_extraction": f"{_ALL}\nSELECT doc_id, field, value, source_text, status AS extract_status, 'regex' AS extract_method, block_start, block_end FROM facts WHERE field IN ({', '.join(_q(n) for n in _PATTERNS)})",
    "field_status_rollup": f"{_ALL}\nSELECT doc_id, count(*) FILTER (status = 'found') AS n_found, count(*) FILTER (status = 'ambiguous') AS n_ambiguous, count(*) FILTER (status = 'not_found') AS n_not_found, CASE WHEN bool_and(status = 'found') THEN 'success' ELSE 'partial' END AS parse_status FROM facts GROUP BY 1",
    "ambiguous_candidates": f"SELECT conv_id, count(DISTINCT v) AS n_values, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(DISTINCT v, ',' ORDER BY v) AS found FROM (SELECT *, regexp_extract(trim(text, {_WS} || chr(10)), '^([A-Z][a-z]+)', 1) AS v FROM conversations) WHERE v <> '' GROUP BY 1 HAVING count(DISTINCT v) > 1",
    "section_assembly": f"{_ALL}\nSELECT doc_id, name AS section, idx AS block_start, last AS block_end, sha256(v) AS text_sha256 FROM sects",
    "conversation_sections": "SELECT conv_id, section, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns FROM (SELECT *, (sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS section FROM conversations) WHERE section > 0 GROUP BY 1, 2",
    "rule_hits_all": f"{_REVIEW}\nSELECT doc_id, rule_id::BIGINT AS rule_id, rule_code, risk_level, evidence_type, evidence_text, actual_value, expected_value, block_start, block_end FROM hits",
    "rule_field_missing": _mode("field_missing"),
    "rule_numeric_threshold": _mode("numeric_threshold"),
    "rule_keyword_presence": _mode("keyword", "presence"),
    "risk_rollup": f"{_REVIEW}\nSELECT doc_id, high_count, medium_count, low_count, overall_risk_level FROM rolled",
    "focus_points_topk": f"{_REVIEW}\nSELECT doc_id, place::INTEGER AS place, rule_code, risk_level FROM placed WHERE place <= 3",
    "review_summary_text": f"{_REVIEW}\nSELECT doc_id, overall_risk_level, summary_text, 'review: ' || overall_risk_level || chr(10) || chr(10) || summary_text || CASE WHEN n = 0 THEN chr(10) || chr(10) || 'nothing found' ELSE chr(10) || chr(10) || 'focus:' || chr(10) || focus || chr(10) || chr(10) || 'advice:' || chr(10) || advice END AS comment_text FROM results",
    "risk_by_label": f"{_REVIEW}\nSELECT quality, overall_risk_level, count(*) AS n_docs FROM rolled LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "rule_set_fingerprint": "SELECT sha256(string_agg(p, chr(10) ORDER BY p)) AS rule_set_fingerprint FROM (SELECT 'RULE_' || item_id || '@' || length(text) AS p FROM benchmark WHERE item_id % 3 <> 0)",
    "hit_set_fingerprint": f"{_REVIEW}\nSELECT doc_id, sha256(string_agg(p, chr(10) ORDER BY p)) AS rule_hit_fingerprint FROM (SELECT doc_id, (doc_id * 100 + rule_id) || '@' || rule_id || '@' || rule_version AS p FROM hits) GROUP BY 1",
    "latest_per_key": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "latest_order_per_customer": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "latest_supersedes": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type IN ('error', 'view')) WHERE rn = 1 AND event_type = 'error'",
    "main_choice_by_priority": "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey) AS rn FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') THEN 2 END AS p FROM orders) WHERE p IS NOT NULL) WHERE rn = 1",
    "reuse_vs_new": "SELECT doc_id, first_id, CASE WHEN doc_id = first_id THEN 'created' ELSE 'reused' END AS outcome FROM (SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY sha256(text)) END AS first_id FROM documents)",
    "reuse_against_history": "SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) THEN 'reused' ELSE 'created' END AS outcome FROM documents WHERE doc_id % 2 = 1",
    "seed_missing_only": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)",
    "dedup_upsert": """
WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id::VARCHAR AS instance_id, 'code-' || user_id AS approval_code, coalesce(n.t, s.t) AS title, CASE WHEN s.t IS NULL THEN 'pending' ELSE 'reviewing' END AS task_status FROM s FULL JOIN n USING (user_id)""",
    "upsert_event_counts": """
SELECT event, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 0) THEN 'created' ELSE 'updated' END AS event
FROM events WHERE event_type <> 'signup') GROUP BY 1""",
    "identity_conflicts": """
SELECT 'n' AS side, c_nationkey::VARCHAR AS value, count(DISTINCT c_mktsegment) AS others FROM customer GROUP BY 2 HAVING count(DISTINCT c_mktsegment) > 1
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(DISTINCT c_nationkey) FROM customer GROUP BY 2 HAVING count(DISTINCT c_nationkey) > 1""",
    "content_change_events": """
SELECT user_id, event, count(*) AS n FROM (SELECT user_id, CASE WHEN d IS NULL THEN 'FAILED' WHEN b IS NULL THEN 'DOWNLOADED' WHEN b = d AND event_id % 7 <> 0 THEN 'REUSED' ELSE 'UPDATED' END AS event
FROM (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN event_type END AS d FROM events))) GROUP BY 1, 2""",
    "state_machine_replay": f"""
WITH e AS (SELECT user_id, list({{'t': t, 'state': 'pending', 'accepted': 0::BIGINT, 'rejected': 0::BIGINT, 'retries': 0::BIGINT}} ORDER BY ts, event_id) AS l FROM (SELECT *, {_TARGET} AS t FROM events) WHERE t IS NOT NULL GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_prepend({{'t': NULL, 'state': 'pending', 'accepted': 0::BIGINT, 'rejected': 0::BIGINT, 'retries': 0::BIGINT}}, l), lambda a, x:
  {{'t': x.t, 'state': CASE WHEN {_OK} THEN x.t ELSE a.state END, 'accepted': a.accepted + CASE WHEN {_OK} THEN 1 ELSE 0 END, 'rejected': a.rejected + CASE WHEN {_OK} THEN 0 ELSE 1 END, 'retries': a.retries + CASE WHEN {_OK} AND a.state = 'blocked' THEN 1 ELSE 0 END}}) AS s FROM e)
SELECT user_id, s.state AS state, s.accepted::BIGINT AS accepted, s.rejected::BIGINT AS rejected, s.retries::BIGINT AS retries FROM f""",
    "lineage_join": "SELECT n_name, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "evidence_range_validation": f"""
WITH {_BLOCKS}, r AS (SELECT doc_id, (doc_id % 5)::INTEGER AS s, (doc_id % 5 + doc_id % 4 - 1)::INTEGER AS e FROM documents)
SELECT r.doc_id, s AS start, e AS "end", s <= e AND count(b.idx) = e - s + 1 AS valid, CASE WHEN s <= e AND count(b.idx) = e - s + 1 THEN length(string_agg(t, chr(10) ORDER BY idx))::INTEGER END AS n_chars
FROM r LEFT JOIN blocks b ON b.doc_id = r.doc_id AND b.idx BETWEEN s AND e GROUP BY 1, 2, 3""",
    "range_coverage": f"""{_ALL},
asked AS (SELECT doc_id, idx AS start, (last + doc_id % 3)::INTEGER AS "end", last FROM sects)
SELECT a.doc_id, a.start, a."end", count(b.idx) = a."end" - a.start + 1 AS whole, a."end" <= any_value(a.last) AS within, count(b.idx) AS n_points, CASE WHEN count(b.idx) = a."end" - a.start + 1 THEN sum(length(b.t))::BIGINT END AS n_chars
FROM asked a LEFT JOIN blocks b ON b.doc_id = a.doc_id AND b.idx BETWEEN a.start AND a."end" GROUP BY 1, 2, 3""",
    "value_in_evidence": f"""
WITH v AS (
  SELECT item_id, 0 AS place, text FROM benchmark UNION ALL
  SELECT item_id, unnest(range(1, len(l) + 1)) AS place, unnest(l) AS text FROM (SELECT item_id, string_split(text, '.') AS l FROM benchmark)),
folded AS (SELECT item_id, place::INTEGER AS place, lower({_FOLD_SUPPORT.format("text")}) AS v FROM v),
docs AS (SELECT doc_id, lower({_FOLD_SUPPORT.format("text")}) AS t FROM documents)
SELECT item_id, place, count(doc_id) AS n_docs, min(doc_id) AS first_doc FROM folded LEFT JOIN docs ON contains(t, v) WHERE v <> '' GROUP BY 1, 2""",
    "keyword_rule_table": """
WITH facts AS (
  SELECT doc_id, 'title' AS path, string_split(text, chr(10))[1] AS txt FROM documents UNION ALL SELECT doc_id, 'body', text FROM documents),
words AS (SELECT item_id, w, i FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark) WHERE length(w) >= 8),
met AS (SELECT item_id AS rule_id, path, w AS keyword, doc_id, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY (path = 'title') <> (item_id % 2 = 0), i) AS rn FROM facts JOIN words ON contains(txt, w))
SELECT rule_id, path, keyword, count(*) AS n_docs, min(doc_id) AS first_doc FROM met WHERE rn = 1 GROUP BY 1, 2, 3""",
    "filename_sanitize": r"""
SELECT page_id, CASE WHEN n IN ('', '.', '..') THEN 'file' ELSE n END AS name, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g')[1:64] AS schema_name FROM (
  SELECT page_id, url, regexp_replace(trim(regexp_replace(string_split(replace(url || '?a=1*.', '\', '/'), '/')[-1], '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '[. ]+$', '') AS n FROM pages)""",
    "date_normalize": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "contract_golden_facts": f"""
SELECT o_orderkey::BIGINT AS doc_id, section, field, CASE field WHEN 'contract_number' THEN 'HT-2026-' || o_orderkey WHEN 'amount' THEN floor(o_totalprice)::BIGINT::VARCHAR WHEN 'effective_date' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 'expiry_date' THEN strftime(o_orderdate::DATE + 365, '%Y-%m-%d') ELSE value END AS value, extract_status, block_start, block_end, page_start, page_end FROM orders, (VALUES {_GOLDEN}) t(section, field, value, extract_status, block_start, block_end, page_start, page_end)""",
    "contract_golden_hits": "SELECT o_orderkey::BIGINT AS doc_id, 'DISPUTE_JURISDICTION_PRESENT' AS rule_code, 'low' AS overall_risk_level, '人民法院' AS actual_value, 22 AS block_start, 23 AS block_end FROM orders",
    "llm_merge": """
SELECT c_custkey::BIGINT AS doc_id, field, replace(value, '#', c_custkey::VARCHAR) AS value, replace(source_text, '#', c_custkey::VARCHAR) AS source_text, extract_status, note FROM customer, (VALUES ('a', 'HT-#', 'No. HT' || chr(10) || '-# end', 'found', 'llm_verified'), ('b', 'x', 'x', 'found', 'LLM_EXTRACTION_CONFLICT'),
  ('c', NULL, '-# end', 'ambiguous', 'VALUE_NOT_IN_EVIDENCE'), ('d', NULL, NULL, 'failed', 'INVALID_BLOCK_RANGE'), ('e', NULL, NULL, 'failed', 'LLM_EXTRACTION_CONFLICT'), ('f', NULL, NULL, 'not_found', 'unchanged')) t(field, value, source_text, extract_status, note)""",
    "semantic_evaluation": "SELECT o_orderkey::BIGINT AS doc_id, rule_id::BIGINT AS rule_id, evaluation_status, decision, is_hit FROM orders, (VALUES (10, 'success', 'hit', true), (11, 'rejected', 'uncertain', false), (12, 'success', 'not_hit', false), (13, 'degraded', NULL, false)) t(rule_id, evaluation_status, decision, is_hit)",
    "limit_before_merge": "SELECT CASE WHEN rn = 1 THEN 'created' ELSE 'updated' END AS event, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)) GROUP BY 1",
    "current_hits": f"{_LADDER}\nSELECT contract_parse_id, hit_id, rule_id::BIGINT AS rule_id, rule_version FROM current_hits",
    "hits_of_tasks": f"{_LADDER}\nSELECT c_nationkey::BIGINT AS task_id, rule_code, risk_level, count(*) AS n_hits, max(hit_id) AS last_hit FROM hits h JOIN orders ON o_orderkey = contract_parse_id JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM rules WHERE rule_id <> 4) r ON r.rule_id = h.rule_id GROUP BY 1, 2, 3",
    "semantic_incomplete": f"{_LADDER}\nSELECT contract_parse_id, partial FROM partials",
    "rule_review": f"""{_LADDER},
own AS (SELECT h.contract_parse_id, CASE WHEN EXISTS (SELECT 1 FROM hits k WHERE k.hit_id = h.hit_id AND k.rule_version = '1.0') THEN 'reused' ELSE 'created' END AS hit, NULL AS event FROM hits h WHERE rule_id <= 4),
earlier AS (SELECT contract_parse_id, rule_id, rule_version, arg_max(coalesce(hit_id, -1), evaluation_id) AS hit_id FROM evaluations WHERE status <> 'degraded' AND fp = 'fp1' GROUP BY 1, 2, 3),
said AS (
  SELECT e.contract_parse_id, CASE WHEN p.rule_id IS NOT NULL THEN CASE WHEN p.hit_id > 0 THEN 'reused' END WHEN e.rule_id = 6 AND e.contract_parse_id % 2 = 0 THEN 'created' END,
    CASE WHEN p.rule_id IS NOT NULL THEN 'reused' WHEN e.rule_id = 7 THEN 'degraded' WHEN e.contract_parse_id % 2 = 1 THEN 'uncertain' ELSE 'evaluated' END
  FROM evaluations e LEFT JOIN earlier p ON p.contract_parse_id = e.contract_parse_id AND p.rule_id = e.rule_id AND p.rule_version = e.rule_version WHERE e.hit_id IS NOT NULL),
counted AS (
  SELECT o_orderkey AS contract_parse_id, count(*) FILTER (hit = 'created') AS created_hit_count, count(*) FILTER (hit = 'reused') AS reused_hit_count, count(*) FILTER (event = 'evaluated') AS semantic_evaluated_count,
    count(*) FILTER (event = 'degraded') AS semantic_degraded_count, count(*) FILTER (event = 'uncertain') AS semantic_uncertain_count, count(*) FILTER (event = 'reused') AS semantic_reused_count
  FROM orders LEFT JOIN (SELECT * FROM own UNION ALL SELECT * FROM said) b ON b.contract_parse_id = o_orderkey GROUP BY 1)
SELECT *, 1::BIGINT AS skipped_future_llm_count, CASE WHEN reused_hit_count > 0 AND created_hit_count = 0 THEN 'RULE_REVIEW_REUSED' ELSE 'RULE_REVIEW_COMPLETED' END AS log_type FROM counted""",
    "review_result": f"""{_LADDER}
SELECT task_id, contract_parse_id, outcome, rule_set_fingerprint, rule_hit_fingerprint, CASE WHEN outcome = 'REVIEW_RESULT_REUSED' THEN review_result_id END AS review_result_id,
  {_MADE} CASE WHEN partial THEN 'partial' ELSE 'completed' END END AS review_status, {_MADE} risk END AS overall_risk_level, {_MADE} summary || CASE WHEN partial THEN 'Some rules are open.' ELSE '' END END AS summary_text,
  {_MADE} 'review: ' || risk || chr(10) || chr(10) || summary || CASE WHEN n = 0 THEN chr(10) || chr(10) || 'nothing found' ELSE chr(10) || chr(10) || 'focus:' || chr(10) || focus || chr(10) || chr(10) || 'advice:' || chr(10) || advice END
    || CASE WHEN partial THEN chr(10) || chr(10) || 'Note: Some rules are open.' ELSE '' END END AS comment_text, {_MADE} hit_ids END AS hit_ids FROM told""",
    "result_hit_links": f"{_LADDER}\nSELECT contract_parse_id, hit_id FROM told JOIN current_hits USING (contract_parse_id) WHERE outcome = 'REVIEW_RESULT_CREATED'",
    "failed_results": f"{_LADDER}\nSELECT contract_parse_id, risk AS overall_risk_level, '' AS summary_text, '' AS comment_text, 'failed' AS review_status, 'REVIEW_RESULT_GENERATION_FAILED: no words' AS review_error FROM rolled",
    "results_with_hits": f"{_LADDER}\nSELECT review_result_id, any_value(review_status) AS review_status, coalesce(string_agg(hit_id || ':' || rule_code, ',' ORDER BY hit_id), '') AS hits FROM results x LEFT JOIN (SELECT hits.*, rule_code FROM hits JOIN rules USING (rule_id) WHERE hit_id % 3 = 0) h ON h.contract_parse_id = x.contract_parse_id GROUP BY 1",
    "current_result_choice": f"{_LADDER}\nSELECT contract_parse_id, review_result_id + CASE WHEN contract_parse_id % 8 = 1 THEN 0 ELSE 1000000000 END AS review_result_id FROM results WHERE review_status <> 'failed'",
    "parse_choice": """
WITH lines AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2),
mains AS (SELECT o_custkey AS task_id, min(o_orderkey) AS attachment_id, arg_min(o_orderpriority, o_orderkey) AS sha FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'O' GROUP BY 1),
reads AS (SELECT task_id, max(l_orderkey * 10 + l_linenumber) AS snap FROM mains JOIN lines ON l_orderkey = attachment_id WHERE l_partkey % 7 <> 0 AND l_partkey % 5 <> 0 GROUP BY 1)
SELECT task_id, snap * 2 AS contract_parse_id FROM reads JOIN lines ON l_orderkey * 10 + l_linenumber = snap WHERE l_returnflag <> 'R'""",
    "comments_once": "SELECT user_id AS instance_id, event_type AS review_id, min(event_id) AS attempt_id FROM events WHERE event_id % 2 = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 10 = 0) GROUP BY 1, 2",
    "outcome_ladders": """
SELECT read, prepared, comment, retry, count(*) AS n FROM (SELECT
  CASE WHEN l_partkey % 11 = 0 THEN 'DOCUMENT_FILE_NOT_FOUND' WHEN l_partkey % 7 = 0 THEN 'DOCUMENT_READ_REUSED' WHEN l_partkey % 5 = 0 THEN 'DOCUMENT_READ_FAILED' WHEN l_suppkey % 7 = 0 THEN 'DOCUMENT_FILE_NOT_FOUND' WHEN l_suppkey % 5 = 0 THEN 'DOCUMENT_READ_FAILED'
    WHEN l_suppkey % 3 = 0 THEN 'DOCUMENT_FILE_EMPTY' WHEN l_partkey % 2 = 0 THEN 'DOCUMENT_OCR_REQUIRED' ELSE 'DOCUMENT_READ_SUCCESS' END AS read,
  CASE WHEN l_partkey % 9 = 0 THEN 'ATTACHMENT_NOT_FOUND' WHEN l_partkey % 8 = 0 THEN 'MAIN_CONTRACT_NOT_FOUND' WHEN l_suppkey % 4 = 0 THEN 'UNSUPPORTED_ATTACHMENT_TYPE' WHEN l_suppkey % 6 = 0 THEN 'ATTACHMENT_DOWNLOAD_FAILED' WHEN l_suppkey % 2 = 0 THEN 'ATTACHMENT_REUSED' ELSE 'ATTACHMENT_UPDATED' END AS prepared,
  CASE WHEN l_partkey % 10 = 0 THEN 'REVIEW_RESULT_NOT_FOUND' WHEN l_partkey % 9 = 0 THEN 'COMMENT_WRITE_REUSED' WHEN l_partkey % 8 = 0 THEN 'COMMENT_TEXT_EMPTY' WHEN l_suppkey % 7 = 0 THEN 'COMMENT_WRITE_FAILED' WHEN l_suppkey % 5 = 0 THEN 'COMMENT_RESPONSE_INVALID' ELSE 'COMMENT_WRITE_SUCCEEDED' END AS comment,
  CASE l_partkey % 4 WHEN 0 THEN 'write_comment' WHEN 3 THEN NULL ELSE 'prepare_attachments' END AS retry FROM lineitem) GROUP BY 1, 2, 3, 4""",
    "workflow_replay": f"""
WITH e AS (SELECT user_id, list({{'t': t, 'state': '', 'accepted': 0::BIGINT, 'rejected': 0::BIGINT, 'retries': 0::BIGINT}} ORDER BY ts, event_id) AS l FROM (SELECT *, {_ACTION} AS t FROM events WHERE event_type <> 'signup') GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_prepend({{'t': NULL, 'state': '{_START}', 'accepted': 0::BIGINT, 'rejected': 0::BIGINT, 'retries': 0::BIGINT}}, l), lambda a, x:
  {{'t': x.t, 'state': coalesce(substr({_MOVE}, 2), a.state), 'accepted': a.accepted + ({_MOVE} IS NOT NULL)::INT, 'rejected': a.rejected + ({_MOVE} IS NULL)::INT, 'retries': a.retries + coalesce(starts_with({_MOVE}, '1'), false)::INT}}) AS s FROM e)
SELECT user_id, s.state AS state, s.accepted::BIGINT AS accepted, s.rejected::BIGINT AS rejected, s.retries::BIGINT AS retries FROM f""",
    "hybrid_parses": """
SELECT o_orderkey AS document_read_snapshot_id, CASE WHEN reused THEN 'LLM_CONTRACT_PARSE_REUSED' WHEN o_custkey % 5 = 0 THEN 'LLM_EXTRACTION_DEGRADED' WHEN o_custkey % 7 = 0 THEN 'LLM_EXTRACTION_SKIPPED' ELSE 'LLM_EXTRACTION_COMPLETED' END AS log_type,
  CASE WHEN reused THEN o_orderkey::BIGINT * 4 END AS contract_parse_id, CASE WHEN NOT reused THEN CASE WHEN o_custkey % 5 = 0 OR o_orderstatus <> 'O' THEN 'partial' ELSE 'success' END END AS parse_status
FROM (SELECT *, o_custkey % 4 = 0 AND o_orderkey % 9 <> 0 AND o_orderstatus <> 'F' AS reused FROM orders)""",
    "ocr_outcomes": """
SELECT CASE WHEN st NOT IN ('parsing', 'blocked') OR (st = 'blocked' AND coalesce(stage, '') <> 'document_reading') THEN 'DOCUMENT_OCR_NOT_ALLOWED' WHEN l_partkey % 11 = 0 OR l_partkey % 7 = 0 THEN 'OCR_INPUT_FILE_NOT_FOUND' WHEN l_suppkey % 5 = 0 THEN 'DOCUMENT_OCR_REUSED'
  WHEN src IS NULL THEN 'OCR_REQUIRED_SNAPSHOT_NOT_FOUND' WHEN src = 'success' THEN 'OCR_NOT_REQUIRED' WHEN src <> 'ocr_required' THEN 'OCR_REQUIRED_SNAPSHOT_NOT_FOUND' WHEN l_suppkey % 3 = 0 THEN 'OCR_EMPTY_RESULT' ELSE 'DOCUMENT_OCR_SUCCEEDED' END AS outcome, count(*) AS n
FROM (SELECT *, ['parsing', 'blocked', 'reviewing', 'parsing'][l_partkey % 4 + 1] AS st, ['document_reading', 'parsing', NULL][l_suppkey % 3 + 1] AS stage, ['ocr_required', 'success', 'failed', NULL, 'ocr_required'][(l_partkey + l_suppkey) % 5 + 1] AS src FROM lineitem) GROUP BY 1""",
    "llm_merge_documents": f"""{_ALL},
own AS (SELECT * FROM facts WHERE field IN ({", ".join(_q(n) for n in _PATTERNS)})),
asked AS (SELECT doc_id, field, doc_id + length(field) AS k, (doc_id % 3)::INTEGER AS s, (doc_id % 3 + doc_id % 2)::INTEGER AS e, value, source_text, status FROM own),
ranges AS (SELECT a.doc_id, a.field, count(b.idx) = e - s + 1 AS whole, string_agg(b.t, chr(10) ORDER BY b.idx) AS txt FROM asked a LEFT JOIN blocks b ON b.doc_id = a.doc_id AND b.idx BETWEEN a.s AND a.e GROUP BY a.doc_id, a.field, e, s),
answers AS (
  SELECT a.*, whole, CASE WHEN whole THEN txt END AS txt, CASE WHEN k % 4 = 0 THEN 'nowhere to be found' ELSE string_split(b.t, ' ')[1] END AS answer, CASE WHEN k % 7 = 0 THEN 'not_found' WHEN k % 11 = 0 THEN 'ambiguous' ELSE 'found' END AS said
  FROM asked a JOIN ranges r ON r.doc_id = a.doc_id AND r.field = a.field LEFT JOIN blocks b ON b.doc_id = a.doc_id AND b.idx = a.s),
noted AS (
  SELECT *, CASE WHEN k % 13 = 0 THEN 'no_answer' WHEN status NOT IN ('not_found', 'ambiguous') THEN CASE WHEN answer IS NOT NULL AND answer IS DISTINCT FROM value THEN 'LLM_EXTRACTION_CONFLICT' ELSE 'not_requested' END
    WHEN said = 'not_found' THEN 'unchanged' WHEN NOT whole THEN 'INVALID_BLOCK_RANGE' WHEN said = 'ambiguous' THEN 'ambiguous' WHEN NOT {_supported("coalesce(answer, '')", "txt")} THEN 'VALUE_NOT_IN_EVIDENCE' ELSE 'llm_verified' END AS note FROM answers)
SELECT doc_id, field, CASE WHEN note = 'llm_verified' THEN answer WHEN note IN ('INVALID_BLOCK_RANGE', 'ambiguous', 'VALUE_NOT_IN_EVIDENCE') THEN NULL ELSE value END AS value,
  CASE WHEN note = 'INVALID_BLOCK_RANGE' THEN NULL WHEN note IN ('ambiguous', 'VALUE_NOT_IN_EVIDENCE', 'llm_verified') THEN txt ELSE source_text END AS source_text,
  CASE WHEN note = 'llm_verified' THEN 'found' WHEN note = 'INVALID_BLOCK_RANGE' THEN 'failed' WHEN note IN ('ambiguous', 'VALUE_NOT_IN_EVIDENCE') THEN 'ambiguous' ELSE status END AS extract_status, note FROM noted""",
    "semantic_evaluation_documents": f"""{_ALL},
grid AS (SELECT f.doc_id, r.rule_id, status, block_start, block_end, (f.doc_id % 4)::INTEGER AS s, (f.doc_id % 4 + f.doc_id % 3)::INTEGER AS e, f.doc_id + r.rule_id AS k FROM facts f JOIN (VALUES (1::BIGINT, 'the_part'), (2, 'of_part'), (3, 'and_part')) r(rule_id, field) ON r.field = f.field),
met AS (SELECT g.doc_id, g.rule_id, any_value(status) AS status, any_value(k) AS k, any_value(s >= block_start AND e <= block_end) AND count(b.idx) = any_value(e - s + 1) AS good, string_agg(b.t, chr(10) ORDER BY b.idx) AS txt FROM grid g LEFT JOIN blocks b ON b.doc_id = g.doc_id AND b.idx BETWEEN s AND e GROUP BY 1, 2),
said AS (SELECT *, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN 'not_hit' WHEN k % 7 = 0 THEN 'uncertain' WHEN k % 11 = 0 THEN NULL ELSE 'hit' END AS d FROM met),
done AS (SELECT *, CASE WHEN status <> 'found' THEN 'skipped' WHEN d IS NULL OR k % 17 = 0 THEN 'degraded' WHEN d = 'hit' AND NOT coalesce(good, false) THEN 'rejected' ELSE 'success' END AS evaluation_status FROM said)
SELECT doc_id, rule_id, evaluation_status, CASE WHEN evaluation_status IN ('skipped', 'rejected') THEN 'uncertain' WHEN evaluation_status = 'degraded' THEN NULL ELSE d END AS decision, evaluation_status = 'success' AND coalesce(d = 'hit', false) AS is_hit,
  CASE WHEN evaluation_status = 'success' AND d = 'hit' THEN sha256(txt) END AS evidence_sha256 FROM done""",
}
ORACLES["streamed_replay"] = ORACLES["state_machine_replay"]
ORACLES["attachment_records"] = """
SELECT user_id, event_type AS attachment, 'file ' || arg_max(event_id % 4, event_id) AS file_name, arg_max(sha256(value::VARCHAR), event_id) FILTER (event_id % 11 <> 0) AS sha256,
  CASE WHEN max(event_id) % 11 = 0 THEN 'failed' ELSE 'success' END AS download_status, CASE WHEN max(event_id) % 11 = 0 THEN 'ATTACHMENT_DOWNLOAD_FAILED: no answer' END AS download_error, count(*) AS attempts
FROM events GROUP BY 1, 2"""
ORACLES["comment_marks"] = """
WITH marks AS (
  SELECT event_id - event_id % 5 + CASE WHEN event_id % 35 = 1 THEN 2 ELSE 0 END AS log_id, event_id, event_type AS said, CASE WHEN event_type = 'error' THEN 'COMMENT_WRITE_FAILED' END AS code
  FROM events WHERE event_id % 5 IN (1, 2, 3) AND event_type <> 'signup'),
last AS (SELECT log_id, arg_max(row(code, said), event_id) AS l, 'c' || max(event_id) FILTER (code IS NULL) AS id FROM marks GROUP BY 1),
met AS (SELECT coalesce(a.event_id, m.log_id) AS log_id, a.event_id IS NULL AS unknown, m.log_id IS NULL AS open, l[1] AS code, l[2] AS said, id FROM (SELECT event_id FROM events WHERE event_id % 5 = 0) a FULL JOIN last m ON m.log_id = a.event_id)
SELECT log_id, CASE WHEN unknown THEN 'unknown_log' WHEN open THEN 'writing' WHEN code IS NULL THEN 'success' ELSE 'failed' END AS write_status, id AS external_comment_id, code AS error_code, said AS response_text FROM met"""
ORACLES["rule_hits_by_table"] = ORACLES["rule_hits_all"]
_LOGS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {i} AS place, '{level}' AS level, '{t}' AS log_type" for k, x in WORKFLOW_LOGS.items() for i, (level, t) in enumerate(x))
ORACLES["workflow_logs"] = f"""
WITH e AS (
  SELECT user_id, list({{'t': t, 'n': event_id, 'state': '', 'log': []::STRUCT(n BIGINT, t VARCHAR, a VARCHAR, b VARCHAR)[]}} ORDER BY ts, event_id) AS l FROM (SELECT *, {_ACTION} AS t FROM events WHERE event_type <> 'signup') GROUP BY 1),
f AS (SELECT user_id, unnest(list_reduce(list_prepend({{'t': NULL, 'n': 0::BIGINT, 'state': '{_START}', 'log': []::STRUCT(n BIGINT, t VARCHAR, a VARCHAR, b VARCHAR)[]}}, l), lambda a, x:
  {{'t': x.t, 'n': x.n, 'state': coalesce(substr({_MOVE}, 2), a.state), 'log': list_append(a.log, {{'n': x.n, 't': x.t, 'a': a.state, 'b': coalesce(substr({_MOVE}, 2), a.state)}})}}).log) AS g FROM e),
logs AS ({_LOGS})
SELECT user_id, g.n AS event_id, place, level, log_type, string_split(g.a, '/')[1] AS from_status, string_split(g.b, '/')[1] AS to_status, string_split(g.b, '/')[3] AS stage
FROM f JOIN logs ON kind = string_split(g.t, '@')[1] WHERE g.a <> g.b"""
ORACLES["checked_answers"] = """
WITH raw AS (SELECT event_id, event_id % 12 AS k, replace(""" + "[" + ", ".join(_q(x) for x in RAW_ANSWERS) + """][event_id % 12 + 1], '#', event_id::VARCHAR) AS t, event_id % 17 = 0 AS late, event_id % 19 = 0 AS refused FROM events),
read AS (SELECT *, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM raw),
told AS (
  SELECT *, CASE WHEN j IS NULL THEN 'NOT_JSON' WHEN json_type(j) <> 'OBJECT' THEN 'NOT_AN_OBJECT' WHEN len(list_filter(json_keys(j), lambda x: x NOT IN ('decision', 'reason', 'block_start', 'block_end'))) > 0 THEN 'EXTRA:more'
    WHEN json_type(j->'decision') <> 'VARCHAR' THEN 'TYPE:decision' WHEN j->>'decision' NOT IN ('hit', 'not_hit', 'uncertain') THEN 'CHOICE:decision' WHEN NOT list_contains(json_keys(j), 'reason') THEN 'MISSING:reason'
    WHEN j->>'reason' = '' THEN 'EMPTY:reason' WHEN j->>'block_start' IS NOT NULL AND try_cast(j->>'block_start' AS BIGINT) IS NULL THEN 'TYPE:block_start'
    WHEN j->>'decision' = 'hit' AND j->>'block_start' IS NULL THEN 'NEEDS:block_start' WHEN j->>'decision' = 'hit' AND j->>'block_end' IS NULL THEN 'NEEDS:block_end' END AS fault FROM read),
done AS (SELECT *, CASE WHEN late THEN 'LlmProviderTimeoutError' WHEN refused THEN 'LlmProviderError' WHEN fault IS NOT NULL THEN 'LlmResponseValidationError' END AS failure FROM told)
SELECT event_id, failure, CASE WHEN failure = 'LlmResponseValidationError' THEN fault END AS fault, CASE WHEN failure IS NULL THEN j->>'decision' END AS decision, CASE WHEN failure IS NULL THEN j->>'reason' END AS reason,
  CASE WHEN failure IS NULL THEN try_cast(j->>'block_start' AS BIGINT) END AS block_start, CASE WHEN failure IS NULL THEN try_cast(j->>'block_end' AS BIGINT) END AS block_end FROM done"""
ORACLES["incremental_review"] = f"""{_REVIEW},
texts AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 11 <> 0 THEN coalesce(CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || ' ' || chr(10) WHEN doc_id % 7 = 1 THEN 'Old. ' || text ELSE text END, '') END AS old FROM documents),
parts AS (
  SELECT *, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 10 AS good, length(regexp_replace(old, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 10 AS old_good, trim(t) = '' AS failed,
    CASE WHEN good THEN list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') WHEN NOT failed THEN list_filter([t], lambda x: trim(x, {_WS} || chr(10)) <> '') END AS b,
    CASE WHEN old_good THEN list_filter(string_split(old, chr(10)), lambda x: trim(x, {_WS}) <> '') WHEN trim(old) <> '' THEN list_filter([old], lambda x: trim(x, {_WS} || chr(10)) <> '') END AS old_b,
    CASE WHEN good THEN NULL ELSE 1 END AS page FROM texts),
marked AS (
  SELECT *, NOT good OR t NOT IN (SELECT old FROM parts WHERE old IS NOT NULL) AS read_again, b IS NOT NULL AND len(b) > 0 AND (b, page) NOT IN (SELECT (old_b, CASE WHEN old_good THEN NULL ELSE 1 END) FROM parts WHERE old_b IS NOT NULL) AS parsed_again FROM parts)
SELECT doc_id, CASE WHEN b IS NOT NULL THEN overall_risk_level END AS overall_risk_level, CASE WHEN b IS NOT NULL THEN n END AS hit_count, CASE WHEN b IS NOT NULL THEN summary_text END AS summary_text,
  read_again, parsed_again, CASE WHEN parsed_again THEN 5 ELSE 0 END::BIGINT AS evaluated_again, parsed_again AS result_again FROM marked JOIN results USING (doc_id)"""
ORACLES["storage_paths"] = r"""
SELECT page_id, '/store/' || ['A 1', 'unknown_approval', 'b_c', 'unknown_approval'][page_id % 4 + 1] || '/' || page_id || '_' || CASE WHEN n IN ('', '.', '..') THEN 'contract_file' ELSE n END AS path FROM (
  SELECT page_id, regexp_replace(trim(regexp_replace(string_split(replace(url || '?a=1*.', '\\', '/'), '/')[-1], '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '[. ]+$', '') AS n FROM pages)"""
ORACLES["listed_events"] = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events"
ORACLES["write_responses"] = """
SELECT event_type, coalesce(json_type(j) = 'OBJECT' AND json_type(j->'success') = 'BOOLEAN' AND (j->>'success') = 'true' AND json_type(j->'external_comment_id') = 'VARCHAR' AND trim(j->>'external_comment_id') <> ''
  AND json_type(j->'message') = 'VARCHAR' AND trim(j->>'message') <> '', false) AS valid, count(*) AS n
FROM (SELECT event_type, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM (SELECT event_type, """ + "[" + ", ".join(_q(x) for x in WRITE_RESPONSES) + """][event_id % """ + str(len(WRITE_RESPONSES)) + """ + 1] AS t FROM events)) GROUP BY 1, 2"""
ORACLES["paged_pull"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5000"
_RULE_FP = hashlib.sha256(b"1.0|1.0|p|m").hexdigest()
_RUN = f"""{_REVIEW},
asked AS (SELECT * FROM (VALUES (101::BIGINT, 'ASKED_1', 'asked 1', 'high', 'the_part'), (102, 'ASKED_2', 'asked 2', 'medium', 'of_part'), (103, 'ASKED_3', 'asked 3', 'low', 'and_part')) t(rule_id, rule_code, rule_name, risk_level, field)),
grid AS (SELECT f.doc_id, r.*, status, block_start, block_end, (f.doc_id % 4)::INTEGER AS s, (f.doc_id % 4 + f.doc_id % 3)::INTEGER AS e, f.doc_id + r.rule_id - 100 AS k FROM facts f JOIN asked r ON r.field = f.field),
met AS (SELECT g.doc_id, g.rule_id, any_value(g.rule_code) AS rule_code, any_value(g.rule_name) AS rule_name, any_value(g.risk_level) AS risk_level, any_value(g.status) AS status, any_value(g.k) AS k, any_value(s >= block_start AND e <= block_end) AND count(b.idx) = any_value(e - s + 1) AS good, string_agg(b.t, chr(10) ORDER BY b.idx) AS txt FROM grid g LEFT JOIN blocks b ON b.doc_id = g.doc_id AND b.idx BETWEEN s AND e GROUP BY 1, 2),
said AS (SELECT *, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN 'not_hit' WHEN k % 7 = 0 THEN 'uncertain' WHEN k % 11 = 0 THEN NULL ELSE 'hit' END AS d FROM met),
judged AS (SELECT *, CASE WHEN status <> 'found' THEN 'skipped' WHEN d IS NULL OR k % 17 = 0 THEN 'degraded' WHEN d = 'hit' AND NOT coalesce(good, false) THEN 'rejected' ELSE 'success' END AS st FROM said),
told AS (
  SELECT *, rule_id = 101 AND doc_id % 4 = 0 AND doc_id % 3 <> 0 AND doc_id % 8 <> 0 AS reused, CASE WHEN st IN ('skipped', 'rejected') THEN 'uncertain' WHEN st = 'degraded' THEN NULL ELSE d END AS decision, st = 'success' AND coalesce(d = 'hit', false) AS is_hit,
    CASE WHEN k % 13 <> 0 THEN 'reason ' || k END AS reason FROM judged),
run_hits AS (
  SELECT doc_id, rule_id, rule_code, rule_name, risk_level, hit_message, CASE WHEN doc_id % 3 = 0 AND rule_id <= 3 THEN doc_id * 1000 + rule_id END AS hit_id, false AS sem, NOT (doc_id % 3 = 0 AND rule_id <= 3) AS created, rule_version, actual_value, evidence_text FROM hits
  UNION ALL SELECT doc_id, rule_id, rule_code, rule_name, risk_level, reason, NULL, true, true, '1.0-{_RULE_FP[:12]}', 'semantic_hit', coalesce(txt, '') FROM told WHERE is_hit AND NOT reused
  UNION ALL SELECT doc_id, rule_id, rule_code, rule_name, risk_level, reason, doc_id * 1000 + 101, true, false, NULL, NULL, NULL FROM told WHERE reused AND doc_id % 5 <> 0)"""
ORACLES["rule_run_reviews"] = f"""{_RUN},
a AS (
  SELECT doc_id, count(*) FILTER (created) AS created_hit_count, count(*) FILTER (NOT created) AS reused_hit_count, count(*) AS hit_count, count(*) FILTER (risk_level = 'high') AS high_count, count(*) FILTER (risk_level = 'medium') AS medium_count,
    count(*) FILTER (risk_level = 'low') AS low_count, string_agg(rule_name || ': ' || coalesce(hit_message, ''), chr(10) ORDER BY hit_id NULLS LAST, sem, rule_id) AS focus_points, string_agg(rule_code, ',' ORDER BY hit_id NULLS LAST, sem, rule_id) AS rule_codes FROM run_hits GROUP BY 1),
e AS (
  SELECT doc_id, count(*) FILTER (ev = 'evaluated') AS semantic_evaluated_count, count(*) FILTER (ev = 'degraded') AS semantic_degraded_count, count(*) FILTER (ev = 'uncertain') AS semantic_uncertain_count, count(*) FILTER (ev = 'reused') AS semantic_reused_count
  FROM (SELECT doc_id, CASE WHEN reused THEN 'reused' WHEN st = 'degraded' THEN 'degraded' WHEN decision = 'uncertain' THEN 'uncertain' ELSE 'evaluated' END AS ev FROM told) GROUP BY 1)
SELECT doc_id, coalesce(created_hit_count, 0)::BIGINT AS created_hit_count, coalesce(reused_hit_count, 0)::BIGINT AS reused_hit_count, coalesce(hit_count, 0)::BIGINT AS hit_count, coalesce(high_count, 0)::BIGINT AS high_count, coalesce(medium_count, 0)::BIGINT AS medium_count, coalesce(low_count, 0)::BIGINT AS low_count, coalesce(semantic_evaluated_count, 0)::BIGINT AS semantic_evaluated_count, coalesce(semantic_degraded_count, 0)::BIGINT AS semantic_degraded_count, coalesce(semantic_uncertain_count, 0)::BIGINT AS semantic_uncertain_count, coalesce(semantic_reused_count, 0)::BIGINT AS semantic_reused_count, 0::BIGINT AS skipped_future_llm_count, CASE WHEN high_count > 0 THEN 'high' WHEN medium_count > 0 THEN 'medium' ELSE 'low' END AS overall_risk_level, coalesce(focus_points, '') AS focus_points, coalesce(rule_codes, '') AS rule_codes,
  CASE WHEN reused_hit_count > 0 AND created_hit_count = 0 THEN 'RULE_REVIEW_REUSED' ELSE 'RULE_REVIEW_COMPLETED' END AS log_type FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN e USING (doc_id)"""
ORACLES["rule_run_evaluations"] = f"""{_RUN}
SELECT doc_id, rule_id, '1.0' AS rule_version, '{_RULE_FP}' AS evaluation_fingerprint, st AS evaluation_status, decision, CASE WHEN st = 'skipped' THEN {_q(SKIPPED)} WHEN st <> 'degraded' THEN reason END AS reason,
  '{{"provider":"p","model":"m","evaluator_version":"1.0","rule_code":"' || rule_code || '","error_type":' || CASE WHEN st <> 'degraded' THEN 'null' WHEN k % 17 = 0 AND k % 13 <> 0 THEN '"timeout"' ELSE '"LLM_PROVIDER_NOT_CONFIGURED"' END
    || ',"error_message":' || CASE WHEN st = 'degraded' AND k % 17 = 0 AND k % 13 <> 0 THEN '"timeout"' ELSE 'null' END || '}}' AS metadata_json, CASE WHEN is_hit THEN '1.0-{_RULE_FP[:12]}' END AS hit_version FROM told WHERE NOT reused"""
ORACLES["rule_run_stored_hits"] = f"""{_RUN}
SELECT doc_id, rule_id, rule_version, sem AS is_semantic, actual_value, hit_message, sha256(evidence_text) AS evidence_sha256 FROM run_hits WHERE created"""
ORACLES["rule_run_logs"] = f"""{_RUN}
SELECT rule_code, CASE WHEN t IN ('LLM_RULE_EVALUATION_DEGRADED', 'LLM_RULE_SKIPPED_NO_CLAUSE', 'LLM_RULE_EVIDENCE_INVALID') THEN 'warning' ELSE 'info' END AS level, t AS log_type, count(*) AS n FROM (
  SELECT rule_code, CASE WHEN reused THEN 'LLM_RULE_EVALUATION_REUSED' WHEN st = 'degraded' THEN 'LLM_RULE_EVALUATION_DEGRADED' WHEN st = 'skipped' THEN 'LLM_RULE_SKIPPED_NO_CLAUSE' WHEN st = 'rejected' THEN 'LLM_RULE_EVIDENCE_INVALID'
    WHEN decision = 'uncertain' THEN 'LLM_RULE_UNCERTAIN' WHEN is_hit THEN 'LLM_RULE_HIT_CREATED' ELSE 'LLM_RULE_NOT_HIT' END AS t FROM told) GROUP BY 1, 2, 3"""
_TYPES = ", ".join(_q(t) for t in packs.FILE_TYPES)
_TASKS = """
WITH tasks AS (SELECT c_custkey AS task_id, ['parsing', 'blocked', 'reviewing', 'parsing', 'blocked'][c_custkey % 5 + 1] AS status, ['document_reading', 'parsing', NULL][c_nationkey % 3 + 1] AS stage FROM customer),
mains AS (SELECT o_custkey AS task_id, min(o_orderkey) AS attachment_id, arg_min(row(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END), o_orderkey)[1] AS sha FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'O' GROUP BY 1),
lines AS (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
snaps AS (
  SELECT l_orderkey * 10 + n AS id, l_orderkey AS attachment_id, CASE WHEN p % 7 = 0 THEN 'old' ELSE o_orderpriority END AS sha, n % 3 = 0 AS is_ocr, CASE WHEN p % 5 = 0 THEN 'failed' WHEN n % 3 <> 0 AND p % 2 = 0 THEN 'ocr_required' ELSE 'success' END AS st, p % 3 <> 0 AS current_version
  FROM lines JOIN orders ON o_orderkey = l_orderkey)"""
ORACLES["prepared_tasks"] = f"""{_TASKS},
offered AS (
  SELECT o_custkey AS task_id, o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 1 WHEN o_orderkey % 6 = 0 THEN 2 END AS p, ['pdf', 'docx', 'txt', 'png'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS sha,
    CASE WHEN o_orderkey % 4 <> 1 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'old' ELSE o_orderpriority END END AS old, o_orderkey % 5 <> 0 AS there FROM orders WHERE o_custkey % 11 <> 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY p, id) AS rn FROM offered WHERE p IS NOT NULL) WHERE rn = 1)
SELECT t.task_id, b.id AS attachment_id, CASE WHEN t.task_id NOT IN (SELECT task_id FROM offered) THEN 'ATTACHMENT_NOT_FOUND' WHEN b.id IS NULL THEN 'MAIN_CONTRACT_NOT_FOUND' WHEN kind NOT IN ({_TYPES}) THEN 'UNSUPPORTED_ATTACHMENT_TYPE'
  WHEN sha IS NULL THEN 'ATTACHMENT_DOWNLOAD_FAILED' WHEN old IS NULL THEN 'ATTACHMENT_DOWNLOADED' WHEN old = sha AND there THEN 'ATTACHMENT_REUSED' ELSE 'ATTACHMENT_UPDATED' END AS outcome FROM tasks t LEFT JOIN best b USING (task_id)"""
ORACLES["read_tasks"] = f"""{_TASKS},
known AS (SELECT attachment_id, sha, max(id) AS id FROM snaps WHERE st = 'success' AND current_version GROUP BY 1, 2)
SELECT t.task_id, m.attachment_id, CASE WHEN m.attachment_id IS NULL THEN 'DOCUMENT_FILE_NOT_FOUND' WHEN k.id IS NOT NULL THEN 'DOCUMENT_READ_REUSED' WHEN m.sha IS NULL THEN 'DOCUMENT_READ_FAILED' WHEN m.attachment_id % 5 = 0 THEN 'DOCUMENT_FILE_NOT_FOUND'
  WHEN m.attachment_id % 9 = 0 THEN 'DOCUMENT_READ_FAILED' WHEN m.attachment_id % 4 = 0 THEN 'DOCUMENT_FILE_EMPTY' WHEN m.attachment_id % 2 = 0 THEN 'DOCUMENT_OCR_REQUIRED' ELSE 'DOCUMENT_READ_SUCCESS' END AS outcome, k.id AS document_read_snapshot_id
FROM tasks t LEFT JOIN mains m USING (task_id) LEFT JOIN known k ON k.attachment_id = m.attachment_id AND k.sha = m.sha"""
ORACLES["ocr_tasks"] = f"""{_TASKS},
known AS (SELECT attachment_id, sha, max(id) AS id FROM snaps WHERE st = 'success' AND current_version AND is_ocr GROUP BY 1, 2),
source AS (SELECT attachment_id, sha, arg_max(st, id) AS st FROM snaps WHERE NOT is_ocr GROUP BY 1, 2)
SELECT t.task_id, m.attachment_id, CASE WHEN status NOT IN ('parsing', 'blocked') OR (status = 'blocked' AND coalesce(stage, '') <> 'document_reading') THEN 'DOCUMENT_OCR_NOT_ALLOWED' WHEN m.attachment_id IS NULL OR m.sha IS NULL THEN 'OCR_INPUT_FILE_NOT_FOUND'
  WHEN k.id IS NOT NULL THEN 'DOCUMENT_OCR_REUSED' WHEN s.st IS NULL THEN 'OCR_REQUIRED_SNAPSHOT_NOT_FOUND' WHEN s.st = 'success' THEN 'OCR_NOT_REQUIRED' WHEN s.st <> 'ocr_required' THEN 'OCR_REQUIRED_SNAPSHOT_NOT_FOUND'
  WHEN m.attachment_id % 2 = 0 THEN 'OCR_EMPTY_RESULT' ELSE 'DOCUMENT_OCR_SUCCEEDED' END AS outcome, k.id AS document_read_snapshot_id
FROM tasks t LEFT JOIN mains m USING (task_id) LEFT JOIN known k ON k.attachment_id = m.attachment_id AND k.sha = m.sha LEFT JOIN source s ON s.attachment_id = m.attachment_id AND s.sha = m.sha"""
ORACLES["written_back_tasks"] = f"""{_TASKS}
SELECT task_id, CASE WHEN task_id % 10 <> 0 THEN task_id * 2 END AS review_result_id, CASE WHEN task_id % 10 = 0 THEN 'REVIEW_RESULT_NOT_FOUND' WHEN task_id % 9 = 0 THEN 'COMMENT_WRITE_REUSED' WHEN status <> 'reviewing' THEN 'INVALID_TASK_STATE'
  WHEN task_id % 8 = 0 THEN 'COMMENT_TEXT_EMPTY' WHEN task_id % 7 = 0 THEN 'COMMENT_WRITE_FAILED' WHEN task_id % 5 = 1 THEN 'COMMENT_RESPONSE_INVALID' ELSE 'COMMENT_WRITE_SUCCEEDED' END AS outcome FROM tasks"""
ORACLES["task_results"] = f"""{_LADDER},
points AS (
  SELECT contract_parse_id, '[' || string_agg('{{"rule_code":"' || rule_code || '","rule_name":"' || rule_name || '","risk_level":"' || risk_level || '","message":"hit of ' || rule_name || '","suggestion":"mend ' || rule_name
    || '","evidence_type":"source","evidence_text":"text of ' || rule_name || '"}}', ',' ORDER BY place) || ']' AS points FROM placed GROUP BY 1),
chosen AS (SELECT o_custkey AS task_id, max(o_orderkey) AS contract_parse_id FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1),
tasks AS (SELECT c_custkey::BIGINT AS task_id, ['reviewing', 'parsing', 'reviewing', 'blocked', 'reviewing'][c_custkey % 5 + 1] AS status FROM customer),
ends AS (
  SELECT t.task_id, CASE WHEN status <> 'blocked' THEN c.contract_parse_id END AS parse, CASE WHEN status = 'blocked' THEN 'INVALID_TASK_STATE' WHEN c.contract_parse_id IS NULL THEN 'CONTRACT_PARSE_NOT_FOUND' WHEN status <> 'reviewing' THEN 'RULE_REVIEW_NOT_FOUND' ELSE outcome END AS outcome,
    outcome AS own, told.* EXCLUDE (outcome, task_id), points FROM tasks t LEFT JOIN chosen c USING (task_id) LEFT JOIN told ON told.contract_parse_id = c.contract_parse_id LEFT JOIN points p ON p.contract_parse_id = c.contract_parse_id)
SELECT task_id, parse AS contract_parse_id, outcome, CASE WHEN outcome = 'REVIEW_RESULT_REUSED' THEN review_result_id END AS review_result_id, {_MADE} CASE WHEN partial THEN 'partial' ELSE 'completed' END END AS review_status, {_MADE} risk END AS overall_risk_level,
  {_MADE} summary || CASE WHEN partial THEN 'Some rules are open.' ELSE '' END END AS summary_text,
  {_MADE} 'review: ' || risk || chr(10) || chr(10) || summary || CASE WHEN n = 0 THEN chr(10) || chr(10) || 'nothing found' ELSE chr(10) || chr(10) || 'focus:' || chr(10) || focus || chr(10) || chr(10) || 'advice:' || chr(10) || advice END
    || CASE WHEN partial THEN chr(10) || chr(10) || 'Note: Some rules are open.' ELSE '' END END AS comment_text, {_MADE} coalesce(points, '[]') END AS focus_points FROM ends"""
