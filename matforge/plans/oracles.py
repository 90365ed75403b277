"""Oracles of the derived queries: DuckDB SQL over the base tables, written apart from what they check.

They share the materials and their coded attributes with the queries (those have goldens of their own) and the fixed values of the
dictionary. Everything after that is stated again: pairs by nested loops over a block's rows, the decision by comparing lists of
attributes, chains by recursion, links and roll-ups by windows.
"""

from __future__ import annotations

import re

from matforge.operators import dictionary as D
from matforge.operators.decide import BEST_OF, NO_MATCH, REASONS
from matforge.plans import derived
from matforge.plans import views as V
from matforge.sources import documents


def _attribute_list(kind: str, skip: str = "") -> str:
    """The subtype's attributes of a kind as a list of texts, missing ones empty."""
    return "CASE subtype " + " ".join(f"WHEN '{s.code}' THEN [{', '.join(f'coalesce(a_{k}, {chr(39) * 2})' for k in getattr(s, kind) if k != skip)}]" for s in D.SUBTYPES) + " ELSE [] END"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


PRESSURE = ", ".join(f"'{s.code}'" for s in D.SUBTYPES if s.pressure_bearing)
WITH_STANDARD = ", ".join(f"'{s.code}'" for s in D.SUBTYPES if "standard" in s.mats)


def _reason() -> str:
    """The fixed reasons with their blanks filled."""
    dims, part = (f"list_extract([{', '.join(repr(v) for v in vs)}], list_position([{', '.join(repr(s.code) for s in D.SUBTYPES)}], sub_a))" for vs in (["/".join(s.dims) for s in D.SUBTYPES], ["pressure-bearing" if s.pressure_bearing else "" for s in D.SUBTYPES]))
    fill = {"dims": dims, "standard_a": "std_a", "standard_b": "std_b", "class": "class_a", "grade_a": "coalesce(grade_a, '?')", "grade_b": "coalesce(grade_b, '?')", "risk": "lower(step_risk)", "bearing": part, "percent": "CAST(floor(100 * sim + 0.5) AS INT)"}
    blanks = lambda t: "concat(" + ", ".join(fill[x[1:-1]] if x[0] == "{" else f"'{x}'" for x in re.findall(r"{\w+}|[^{}]+", t)) + ")"
    return "CASE rule_no " + " ".join(f"WHEN {k} THEN {blanks(t)}" for k, t in enumerate(REASONS, 1)) + " END"


#: Product of two texts' vectors, where both have one.
_DOT = "list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _judged(pairs: str, vectors: bool = False) -> str:
    """Decided pairs of texts; ``pairs`` gives a_text and b_text. One row per pair: rule, verdict, confidence, stage, risk, review, reason, sim."""
    near = """0.5 * CASE WHEN len(x.ctoks) = 0 OR len(y.ctoks) = 0 THEN 0 ELSE len(list_intersect(x.ctoks, y.ctoks)) / len(list_distinct(x.ctoks || y.ctoks)) END
        + 0.5 * coalesce(list_sum(list_transform(map_keys(x.hist), lambda g: CAST(x.hist[g] AS BIGINT) * coalesce(CAST(y.hist[g] AS BIGINT), 0))), 0) / sqrt(list_sum(list_transform(map_values(x.hist), lambda c: CAST(c AS DOUBLE) * c)) * list_sum(list_transform(map_values(y.hist), lambda c: CAST(c AS DOUBLE) * c)))"""
    via = "CASE WHEN x.vec IS NOT NULL AND y.vec IS NOT NULL THEN 'embedding' ELSE 'lexical' END" if vectors else "'lexical'"
    near = f"CASE WHEN x.vec IS NOT NULL AND y.vec IS NOT NULL THEN {_DOT} ELSE {near} END" if vectors else near
    texts = "vector_texts" if vectors else "texts"
    return f"""
SELECT *, CASE rule_no WHEN 1 THEN 'duplicate' WHEN 2 THEN 'distinct' WHEN 3 THEN 'similar' WHEN 4 THEN 'duplicate' WHEN 5 THEN 'functionally_equivalent' WHEN 6 THEN 'similar' WHEN 7 THEN 'similar' WHEN 10 THEN 'duplicate' WHEN 11 THEN 'similar' ELSE 'distinct' END AS verdict,
  CASE WHEN rule_no IN (1, 4) THEN 1.0 WHEN rule_no = 2 THEN 0.9 WHEN rule_no = 3 THEN 0.85 WHEN rule_no = 5 THEN 0.75 WHEN rule_no = 6 THEN 0.6 WHEN rule_no = 9 THEN 0.7 WHEN rule_no IN (7, 10, 11) THEN sim ELSE 1 - sim END AS confidence,
  CASE WHEN rule_no < 7 THEN 'rule' ELSE via END AS stage,
  CASE WHEN rule_no IN (1, 4) THEN 'LOW' WHEN rule_no IN (3, 5, 6, 7, 8) THEN step_risk WHEN rule_no IN (10, 11) THEN 'MEDIUM' END AS safety_risk,
  rule_no IN (3, 5, 6, 7, 10, 11) AS needs_review,
  {_reason()} AS reason
FROM (SELECT *, CASE
    WHEN closed AND same_code THEN 1 WHEN closed AND dims_a <> dims_b THEN 2
    WHEN closed AND mats_a = mats_b AND std_a <> std_b AND interchangeable THEN 3 WHEN closed AND mats_a = mats_b AND std_a = std_b THEN 4
    WHEN closed AND class_a = class_b THEN 5 WHEN closed AND step_risk IN ('HIGH', 'MEDIUM') THEN 6 WHEN closed AND sim > 0.7 THEN 7 WHEN closed THEN 8
    WHEN len(digits_a) > 0 AND len(digits_b) > 0 AND len(list_intersect(digits_a, digits_b)) / len(list_distinct(digits_a || digits_b)) < 0.5 THEN 9 WHEN sim > 0.9 THEN 10 WHEN sim > 0.6 THEN 11 ELSE 12 END AS rule_no
  FROM (SELECT t.a_text, t.b_text, x.complete AND y.complete AS closed, x.nmc_code = y.nmc_code AS same_code, x.dims AS dims_a,
      CASE x.subtype {" ".join(f"WHEN '{s.code}' THEN [{', '.join(f'coalesce(y.a_{k}, {chr(39) * 2})' for k in s.dims)}]" for s in D.SUBTYPES)} ELSE [] END AS dims_b,
      x.mats AS mats_a, CASE x.subtype {" ".join(f"WHEN '{s.code}' THEN [{', '.join(f'coalesce(y.a_{k}, {chr(39) * 2})' for k in s.mats if k != 'standard')}]" for s in D.SUBTYPES)} ELSE [] END AS mats_b,
      CASE WHEN x.subtype IN ({WITH_STANDARD}) THEN coalesce(x.a_standard, '') ELSE '' END AS std_a, CASE WHEN x.subtype IN ({WITH_STANDARD}) THEN coalesce(y.a_standard, '') ELSE '' END AS std_b,
      EXISTS (SELECT 1 FROM interchange g JOIN interchange h ON g.k = h.k WHERE g.name = x.a_standard AND h.name = y.a_standard) AS interchangeable,
      x.corrosion AS class_a, y.corrosion AS class_b, x.subtype AS sub_a, x.a_grade AS grade_a, y.a_grade AS grade_b, list_filter(x.ctoks, lambda w: regexp_matches(w, '[0-9]')) AS digits_a, list_filter(y.ctoks, lambda w: regexp_matches(w, '[0-9]')) AS digits_b,
      CASE abs(x.severity - y.severity) WHEN 0 THEN 'LOW' WHEN 1 THEN CASE WHEN x.subtype IN ({PRESSURE}) THEN 'MEDIUM' ELSE 'LOW' END WHEN 2 THEN CASE WHEN x.subtype IN ({PRESSURE}) THEN 'HIGH' ELSE 'MEDIUM' END END AS step_risk,
      {near} AS sim, {via} AS via
    FROM ({pairs}) t JOIN {texts} x ON t.a_text = x.raw_description JOIN {texts} y ON t.b_text = y.raw_description) f) r"""


def _explained(judged: str) -> str:
    """The explanation of decided pairs, attribute by attribute."""
    keys = [(s.code, k, n, "dimension" if k in s.dims else "standard" if k == "standard" else "material") for s in D.SUBTYPES for n, k in enumerate(s.dims + s.mats)]
    value = lambda t: "CASE q.attribute " + " ".join(f"WHEN '{k}' THEN {t}.a_{k}" for k in sorted({x[1] for x in keys})) + " END"
    return f"""
SELECT j.a_text, j.b_text, q.attribute, q.place, q.role, {value("x")} AS a_value, {value("y")} AS b_value,
  CASE WHEN {value("x")} IS NULL AND {value("y")} IS NULL THEN 'unknown' WHEN {value("x")} = {value("y")} THEN 'same'
    WHEN q.attribute = 'standard' AND EXISTS (SELECT 1 FROM interchange g JOIN interchange h ON g.k = h.k WHERE g.name = {value("x")} AND h.name = {value("y")}) THEN 'compatible' ELSE 'different' END AS status
FROM {judged} j JOIN texts x ON j.a_text = x.raw_description JOIN texts y ON j.b_text = y.raw_description JOIN (VALUES {_values(keys)}) q(subtype, attribute, place, role) ON q.subtype = x.subtype"""


def _reasoned(judged: str, evidence: str) -> str:
    names = _values((s.code, s.label.lower()) for s in D.SUBTYPES)
    outcome = "CASE WHEN verdict = 'distinct' THEN 'REJECT' WHEN needs_review THEN 'HUMAN REVIEW' ELSE 'AUTO ISSUE' END"
    return f"""
SELECT *, CASE WHEN same_text IS NULL THEN 'Both are a ' || item || '; no attribute could be compared as equal.' ELSE 'Both are a ' || item || ' with the same ' || same_text || '.' END
  || CASE WHEN differ_text IS NULL THEN ' No attribute differs.' ELSE ' They differ in ' || differ_text || '.' END || ' Risk: ' || coalesce(safety_risk, 'not calculated') || '. Outcome: ' || outcome || '.' AS reasoning, outcome || ': ' || reason AS outcome_why
FROM (SELECT j.*, {outcome} AS outcome, coalesce(n.item, 'item') AS item, e.* EXCLUDE (a_text, b_text),
    CASE WHEN e.n_dims IS NULL OR e.n_dims = 0 THEN 'unknown' WHEN e.same_dims = e.n_dims THEN 'compatible' ELSE 'different' END AS dimensions, CASE WHEN sim >= 0.85 THEN 'same' WHEN sim >= 0.6 THEN 'compatible' ELSE 'different' END AS description_status,
    CASE WHEN class_a IS NULL OR class_b IS NULL THEN 'unknown' WHEN class_a = class_b THEN 'same' ELSE 'different' END AS corrosion_status,
    CASE WHEN safety_risk IS NULL THEN 'unknown' WHEN safety_risk = 'LOW' THEN 'same' ELSE 'different' END AS risk_status, CASE WHEN x.subtype = 'UNK' THEN safety_risk ELSE step_risk END AS recomputed_risk
  FROM {judged} j JOIN texts x ON j.a_text = x.raw_description LEFT JOIN (VALUES {names}) n(subtype, item) ON x.subtype = n.subtype
  LEFT JOIN (SELECT a_text, b_text, count(*) FILTER (role = 'dimension') AS n_dims, count(*) FILTER (role = 'dimension' AND status = 'same') AS same_dims, count(*) FILTER (status = 'same') / count(*) AS attribute_score,
      max(status) FILTER (attribute = 'grade') AS grade_status, max(status) FILTER (attribute = 'standard') AS standard_status, string_agg(attribute || ' (' || a_value || ')', ', ' ORDER BY place) FILTER (status = 'same') AS same_text,
      string_agg(attribute || ' ' || coalesce(a_value, '?') || ' / ' || coalesce(b_value, '?') || CASE WHEN status = 'compatible' THEN ' (equivalent)' ELSE '' END, '; ' ORDER BY place) FILTER (status IN ('different', 'compatible')) AS differ_text
    FROM {evidence} GROUP BY a_text, b_text) e ON j.a_text = e.a_text AND j.b_text = e.b_text) z"""


_UNIT = "CASE WHEN upper(trim(uom)) IN ('NOS', 'NO', 'EA', 'EACH', 'PC', 'PCS', 'UNIT') THEN 'EA' WHEN upper(trim(uom)) IN ('M', 'MTR', 'METER', 'METRE') THEN 'M' WHEN upper(trim(uom)) IN ('L', 'LTR', 'LITRE', 'LITER') THEN 'L' WHEN upper(trim(uom)) IN ('MT', 'TON', 'TONNE') THEN 'MT' ELSE upper(trim(uom)) END"
_CELL = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({1}, '\"', '\"\"') || '\"' ELSE {1} END"


def _text(x: str) -> str:
    guarded = f"CASE WHEN left({x}, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN chr(39) || {x} ELSE {x} END"
    return f"coalesce({_CELL.format(x, guarded)}, '')"


def _number(x: str) -> str:
    return f"coalesce(rtrim(rtrim(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 12)) AS VARCHAR), '0'), '.'), '')"


#: CTEs in order; each may read those before it.
CTES: list[tuple[str, str]] = [
    *V.duck_coded(),
    ("interchange(name, k)", f"SELECT * FROM (VALUES {_values((name, k) for k, g in enumerate(D.EQUIVALENT_STANDARDS) for name in g)}) g"),
    ("texts", f"SELECT DISTINCT ON (raw_description) * EXCLUDE (ord), {_attribute_list('dims')} AS dims, {_attribute_list('mats', 'standard')} AS mats, list_position(['LOW', 'MEDIUM', 'HIGH'], corrosion) AS severity, list_histogram(grams) AS hist FROM m ORDER BY raw_description, ord"),
    ("seats", "SELECT ord, block, raw_description, complete, dim_key, nmc_code, min(ord) OVER (PARTITION BY block, nmc_code, complete) AS rep FROM m"),
    ("stage_pool", "SELECT * FROM seats WHERE NOT complete OR ord = rep"),
    ("facing", "SELECT x.ord AS a_ord, y.ord AS b_ord, x.raw_description AS a_text, y.raw_description AS b_text, y.complete AS b_complete FROM stage_pool x JOIN stage_pool y ON x.block = y.block AND y.ord < x.ord WHERE NOT (x.complete AND y.complete AND x.dim_key <> y.dim_key)"),
    ("echoes", "SELECT s.ord AS a_ord, s.raw_description AS a_text, y.raw_description AS b_text FROM seats s JOIN stage_pool y ON s.block = y.block AND y.complete AND y.dim_key = s.dim_key AND y.ord < s.rep WHERE s.complete AND s.ord <> s.rep"),
    ("ruled", _judged("SELECT a_text, b_text FROM facing UNION SELECT a_text, b_text FROM echoes")),
    ("tally", "SELECT ord, count(*) AS n FROM (SELECT a_ord AS ord, a_text, b_text FROM facing UNION ALL SELECT a_ord, a_text, b_text FROM echoes UNION ALL SELECT ord, NULL, NULL FROM seats WHERE complete AND ord <> rep) t LEFT JOIN ruled r USING (a_text, b_text) WHERE t.a_text IS NULL OR verdict <> 'distinct' GROUP BY ord"),
    ("ranked", "SELECT f.*, r.* EXCLUDE (a_text, b_text), row_number() OVER (PARTITION BY a_ord ORDER BY CASE verdict WHEN 'duplicate' THEN 1 WHEN 'functionally_equivalent' THEN 2 ELSE 3 END, confidence DESC, CASE safety_risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END, b_complete DESC, b_ord) AS k FROM facing f JOIN ruled r ON f.a_text = r.a_text AND f.b_text = r.b_text WHERE verdict <> 'distinct'"),
    ("chosen", "SELECT s.ord, CASE WHEN s.complete AND s.ord <> s.rep THEN s.rep ELSE r.b_ord END AS matched_ord, CASE WHEN s.complete AND s.ord <> s.rep THEN 'duplicate' ELSE coalesce(r.verdict, 'distinct') END AS verdict, CASE WHEN s.complete AND s.ord <> s.rep THEN 1.0 ELSE coalesce(r.confidence, 1.0) END AS confidence, CASE WHEN s.complete AND s.ord <> s.rep THEN 'rule' ELSE coalesce(r.stage, 'rule') END AS stage, CASE WHEN s.complete AND s.ord <> s.rep THEN 'LOW' ELSE r.safety_risk END AS safety_risk, CASE WHEN s.complete AND s.ord <> s.rep THEN false ELSE coalesce(r.needs_review, false) END AS needs_review, CASE WHEN s.complete AND s.ord <> s.rep THEN '" + REASONS[0] + "' ELSE coalesce(r.reason, '" + NO_MATCH + "') END || CASE WHEN t.n > 1 THEN ' | ' || replace('" + BEST_OF + "', '{n}', CAST(t.n AS VARCHAR)) ELSE '' END AS reason FROM seats s LEFT JOIN ranked r ON s.ord = r.a_ord AND r.k = 1 LEFT JOIN tally t ON s.ord = t.ord"),
    ("climb(ord, top)", "SELECT ord, ord FROM chosen WHERE verdict <> 'duplicate' UNION ALL SELECT c.ord, b.top FROM chosen c JOIN climb b ON c.matched_ord = b.ord WHERE c.verdict = 'duplicate'"),
    ("mapping", "SELECT m.ord, m.cpse_id, m.own_code, m.raw_description, m.uom, m.quantity, m.unit_price, m.subtype, m.category, m.canonical, m.complete, m.nmc_code AS own_nmc, t.nmc_code, c.* EXCLUDE (ord), u.nmc_code AS matched_nmc, CASE WHEN c.needs_review THEN 'pending-review' ELSE 'auto-issued' END AS status FROM m JOIN chosen c ON m.ord = c.ord JOIN climb b ON m.ord = b.ord JOIN m t ON b.top = t.ord LEFT JOIN climb v ON c.matched_ord = v.ord LEFT JOIN m u ON v.top = u.ord"),
    ("chain", derived.CHAIN.format(m="m")),
    ("walk(nmc_code, root, k)", "SELECT nmc_code, nmc_code, 0 FROM (SELECT DISTINCT nmc_code FROM m) u UNION ALL SELECT w.nmc_code, c.new_code, w.k + 1 FROM walk w JOIN chain c ON w.root = c.old_code WHERE w.k < 1000"),
    ("ends", "SELECT nmc_code, arg_max(root, k) AS root FROM walk GROUP BY nmc_code"),
    ("now", "SELECT p.*, e.root AS code, nullif(e.root, p.nmc_code) AS current_code FROM mapping p JOIN ends e ON p.nmc_code = e.nmc_code"),
    ("units", f"SELECT code, ord, cpse_id, {_UNIT} AS unit, quantity AS q, unit_price AS p, quantity > 0 AND unit_price > 0 AS priced FROM now"),
    ("kinds", "SELECT code, count(*) AS legacy_codes, string_agg(DISTINCT cpse_id, '|' ORDER BY cpse_id) AS cpses, count(DISTINCT cpse_id) AS n_cpses, CASE WHEN count(DISTINCT unit) FILTER (unit <> '') > 1 THEN 'MIXED' ELSE coalesce(max(unit), '') END AS uom, sum(q) FILTER (q > 0) AS pooled, min(ord) AS first_ord FROM units GROUP BY code"),
    ("sums", "SELECT code, count(*) AS n, min(p) AS low, max(p) AS high, sum(CAST(q * p AS DECIMAL(28, 6))) AS spent, sum(CAST(q * (p - lowest) AS DECIMAL(28, 6))) AS over, sum(q) AS q FROM (SELECT *, min(p) OVER (PARTITION BY code) AS lowest FROM units WHERE priced) u GROUP BY code"),
    ("by_code", "SELECT k.code AS nmc_code, legacy_codes, cpses, n_cpses, uom, CASE WHEN uom <> 'MIXED' THEN pooled END AS total_quantity, CASE WHEN uom <> 'MIXED' THEN low END AS min_price, CASE WHEN uom <> 'MIXED' THEN high END AS max_price, CASE WHEN uom <> 'MIXED' THEN floor(CAST(spent AS DOUBLE) / s.q * 100 + 0.5) / 100 END AS weighted_avg_price, CASE WHEN uom <> 'MIXED' AND n > 0 THEN floor(CAST(spent AS DOUBLE) * 100 + 0.5) / 100 ELSE 0.0 END AS value, CASE WHEN uom <> 'MIXED' AND n > 1 THEN floor(CAST(over AS DOUBLE) * 100 + 0.5) / 100 ELSE 0.0 END AS savings, CASE WHEN uom <> 'MIXED' THEN coalesce(n, 0) ELSE 0 END AS priced_rows, first_ord FROM kinds k LEFT JOIN sums s ON k.code = s.code"),
    ("decisions", derived.DECISIONS.format(m="m")),
    ("judgement", "SELECT d.*, safety_risk = 'HIGH' AND outcome = 'confirmed' AS grave, CASE WHEN coalesce(p.status, '') <> 'pending-review' THEN 'not pending' WHEN trim(reviewer) = '' THEN 'reviewer missing' WHEN safety_risk = 'HIGH' AND outcome = 'confirmed' THEN CASE WHEN second_reviewer IS NULL OR trim(second_reviewer) = '' THEN 'second reviewer missing' WHEN upper(trim(second_reviewer)) = upper(trim(reviewer)) THEN 'second reviewer is the first' END END AS fault FROM decisions d LEFT JOIN mapping p USING (ord)"),
    ("checked", "SELECT * EXCLUDE (fault), CASE WHEN EXISTS (SELECT 1 FROM judgement k WHERE k.ord = j.ord AND k.fault IS NULL AND k.audit_seq < j.audit_seq) THEN 'not pending' ELSE fault END AS refused FROM judgement j"),
    ("taken", "SELECT *, trim(reviewer) || CASE WHEN grave THEN '; ' || trim(second_reviewer) ELSE '' END AS signers FROM checked WHERE refused IS NULL"),
    ("voted", "SELECT p.* EXCLUDE (status, nmc_code), p.nmc_code AS original_nmc, t.outcome, t.at AS reviewed_at, t.audit_seq, t.signers AS reviewed_by, CASE t.outcome WHEN 'confirmed' THEN 'reviewed-confirmed' WHEN 'rejected' THEN 'reviewed-rejected' ELSE p.status END AS status, CASE WHEN t.outcome = 'rejected' AND verdict = 'duplicate' THEN own_nmc ELSE p.nmc_code END AS nmc_code, CASE WHEN t.outcome = 'confirmed' AND verdict IN ('functionally_equivalent', 'similar') THEN nullif(matched_nmc, p.nmc_code) END AS linked_nmc FROM mapping p LEFT JOIN taken t USING (ord)"),
    ("reviewed", "SELECT v.*, nullif(e.root, v.nmc_code) AS current_code FROM voted v JOIN ends e ON v.nmc_code = e.nmc_code"),
    ("backed", "SELECT least(nmc_code, linked_nmc) AS code_a, greatest(nmc_code, linked_nmc) AS code_b, * FROM reviewed WHERE linked_nmc IS NOT NULL"),
    ("witness", "SELECT code_a || '<->' || code_b AS link_id, audit_seq * 2 AS place, cpse_id, own_code, nmc_code AS member_code, raw_description FROM backed UNION ALL SELECT b.code_a || '<->' || b.code_b, b.audit_seq * 2 + 1, o.cpse_id, o.own_code, o.nmc_code, o.raw_description FROM backed b JOIN mapping o ON b.matched_ord = o.ord"),
    ("led", "SELECT code_a || '<->' || code_b AS link_id, * FROM backed QUALIFY row_number() OVER (PARTITION BY code_a, code_b ORDER BY audit_seq) = 1"),
    ("signed", "SELECT link_id, string_agg(signer, '; ' ORDER BY place) AS confirmed_by FROM (SELECT link_id, signer, min(place) AS place FROM (SELECT code_a || '<->' || code_b AS link_id, audit_seq AS place, unnest(string_split(reviewed_by, '; ')) AS signer FROM backed) u GROUP BY ALL) v GROUP BY link_id"),
    ("heard", "SELECT link_id, string_agg(cpse_id, '; ' ORDER BY place) AS cpses FROM (SELECT link_id, cpse_id, min(place) AS place FROM witness GROUP BY ALL) v GROUP BY link_id"),
    ("links", "SELECT l.link_id, l.code_a, l.code_b, l.verdict, l.safety_risk, l.confidence, l.reason, l.reviewed_at AS confirmed_at, l.audit_seq, cpses, confirmed_by, (SELECT count(*) FROM backed b WHERE b.code_a = l.code_a AND b.code_b = l.code_b) AS n_evidence, (SELECT count(DISTINCT (cpse_id, own_code, member_code)) FROM witness w WHERE w.link_id = l.link_id) AS n_members FROM led l JOIN heard USING (link_id) JOIN signed USING (link_id)"),
    ("naming", "SELECT 2 * ord AS entry, unnest([CAST(ord AS VARCHAR), cpse_id, own_code, nmc_code, verdict, stage, safety_risk, reason]) AS word FROM mapping UNION ALL SELECT 2 * v.ord + 1, unnest([CAST(v.ord AS VARCHAR), p.nmc_code, v.cpse_id, v.verdict, v.safety_risk, v.linked_nmc] || string_split(v.reviewed_by, '; ')) FROM voted v JOIN mapping p USING (ord) WHERE v.outcome IS NOT NULL"),
    ("references", "SELECT word AS code, count(DISTINCT entry) AS entries FROM naming WHERE word IN (SELECT nmc_code FROM m) GROUP BY word"),
    ("matched", _judged("SELECT DISTINCT x.raw_description AS a_text, y.raw_description AS b_text FROM mapping x JOIN mapping y ON x.matched_ord = y.ord")),
    ("evidence", _explained("matched")),
    ("proposals", derived.PROPOSALS.format(m="m")),
    ("circles", derived.CIRCLES.format(m="m")),
    ("circling(node, here, seen)", "SELECT node, node, CAST([] AS BIGINT[]) FROM circles UNION ALL SELECT w.node, c.up, list_append(w.seen, w.here) FROM circling w JOIN circles c ON c.node = w.here WHERE c.up IS NOT NULL AND NOT list_contains(w.seen, w.here)"),
    ("labelled", derived.PAIRS.format(m="m")),
    ("judged", _judged("SELECT DISTINCT a_text, b_text FROM labelled")),
    ("judged_evidence", _explained("judged")),
    ("evaluated", f"SELECT l.*, {derived.LABEL} AS predicted, CASE WHEN sim >= 0.8 THEN 'DUPLICATE' ELSE 'NOT_EQUIVALENT' END AS baseline, rule_no, confidence, safety_risk, needs_review, sim FROM labelled l JOIN judged j ON l.a_text = j.a_text AND l.b_text = j.b_text"),
]


def _graph_nodes() -> str:
    return """
WITH care AS (SELECT *, CASE WHEN status = 'reviewed-rejected' OR safety_risk = 'HIGH' THEN 'risk' WHEN status = 'pending-review' THEN 'review' ELSE 'ok' END AS health FROM reviewed),
folded AS (SELECT nmc_code, list(health) AS seen, arg_min(status, ord) FILTER (status IN ('pending-review', 'reviewed-rejected')) AS first_status FROM care GROUP BY nmc_code),
paired AS (SELECT code_a AS code FROM links UNION SELECT code_b FROM links), codes AS (SELECT nmc_code AS code FROM reviewed UNION SELECT code FROM paired UNION SELECT old_code FROM chain UNION SELECT new_code FROM chain)
SELECT 'c:' || cpse_id AS id, 'cpse' AS type, cpse_id AS label, 'CPSE' AS title, '—' AS category, CASE WHEN bool_or(health = 'risk') THEN 'review' ELSE 'ok' END AS health, 'active' AS status FROM care GROUP BY cpse_id
UNION ALL SELECT 'm:' || ord, 'material', own_code, raw_description, coalesce((SELECT first(x.category ORDER BY x.ord) FROM m x WHERE x.nmc_code = care.nmc_code), 'Unknown'), health, status FROM care
UNION ALL SELECT 'n:' || code, CASE WHEN code IN (SELECT old_code FROM chain) THEN 'superseded' WHEN seen IS NULL AND code IN (SELECT code FROM paired) THEN 'substitute' ELSE 'nmc' END, code, coalesce((SELECT first(x.canonical ORDER BY x.ord) FROM m x WHERE x.nmc_code = code), '(not in current run)'), coalesce((SELECT first(x.category ORDER BY x.ord) FROM m x WHERE x.nmc_code = code), 'Unknown'),
  CASE WHEN list_contains(seen, 'risk') THEN 'risk' WHEN list_contains(seen, 'review') OR code IN (SELECT old_code FROM chain) OR (seen IS NULL AND code IN (SELECT code FROM paired)) THEN 'review' ELSE 'ok' END,
  CASE WHEN code IN (SELECT old_code FROM chain) THEN 'superseded' WHEN seen IS NULL AND code IN (SELECT code FROM paired) THEN 'substitute-only' WHEN first_status = 'reviewed-rejected' THEN 'rejected' WHEN first_status IS NOT NULL THEN 'pending-review' ELSE 'active' END
FROM codes LEFT JOIN folded ON code = nmc_code"""


_GRAPH_EDGES = """
WITH e(a, b, rel) AS (
  SELECT 'm:' || ord, 'c:' || cpse_id, 'USED_BY' FROM reviewed UNION ALL SELECT 'm:' || ord, 'n:' || nmc_code, coalesce(map {'duplicate': 'DUPLICATE', 'functionally_equivalent': 'FUNCTIONALLY_EQUIVALENT'}[verdict], 'MAPPED_TO') FROM reviewed
  UNION ALL SELECT 'n:' || split_part(link_id, '<->', 1), 'n:' || split_part(link_id, '<->', 2), 'SUBSTITUTE' FROM links
  UNION ALL SELECT unnest(['n:' || old_code, 'n:' || new_code]), unnest(['n:' || new_code, 'n:' || old_code]), unnest(['SUPERSEDED_BY', 'SUPERSEDES']) FROM chain)
SELECT concat_ws('|', a, rel, b) AS id, a AS src, b AS dst, rel FROM e"""
_PROFILE = """
SELECT r.nmc_code, string_agg(DISTINCT cpse_id, '|' ORDER BY cpse_id) AS used_by, count(DISTINCT (cpse_id, own_code)) AS legacy_codes, count(*) FILTER (verdict = 'duplicate') AS duplicates, count(*) FILTER (verdict = 'functionally_equivalent') AS equivalents,
  count(*) FILTER (status = 'pending-review') AS pending, count(*) FILTER (outcome IS NOT NULL) AS review_decisions,
  coalesce((SELECT string_agg(DISTINCT CASE WHEN code_a = r.nmc_code THEN code_b ELSE code_a END, '|' ORDER BY CASE WHEN code_a = r.nmc_code THEN code_b ELSE code_a END) FROM links WHERE r.nmc_code IN (code_a, code_b)), '') AS substitutes,
  coalesce((SELECT string_agg(old_code, '|' ORDER BY old_code) FROM chain WHERE new_code = r.nmc_code), '') AS superseded_codes, (SELECT max(new_code) FROM chain WHERE old_code = r.nmc_code) AS superseded_by,
  coalesce((SELECT max(entries) FROM "references" f WHERE f.code = r.nmc_code), 0) AS audit_entries
FROM reviewed r GROUP BY r.nmc_code"""


def _mapping_lines(where: str = "true") -> str:
    cells = [_text(x) for x in ("cpse_id", "own_code", "raw_description", "uom", "coalesce(current_code, nmc_code)", "CASE WHEN current_code IS NULL THEN NULL ELSE nmc_code END", "CASE status WHEN 'pending-review' THEN 'REVIEW_PENDING' ELSE 'READY' END", "status", "verdict")]
    cells += [_number("round(confidence, 3)"), *(_text(x) for x in ("safety_risk", "stage", "linked_nmc", "matched_nmc", "reviewed_by", "reviewed_at")), _number("quantity"), _number("unit_price"), _text("reason")]
    return "SELECT ord, " + " || ',' || ".join(cells) + f" AS line FROM reviewed WHERE {where}"


_LINK_CELLS = " || ',' || ".join([*(_text(x) for x in ("code_a", "code_b", "verdict", "safety_risk")), _number("round(confidence, 3)"), *(_text(x) for x in ("cpses", "confirmed_by", "confirmed_at")), _number("audit_seq"), _text("reason")])
_ECONOMICS_CELLS = " || ',' || ".join([_text("nmc_code"), _number("legacy_codes"), _text("replace(cpses, '|', '; ')"), _text("uom"), *(_number(f"CAST({x} AS DOUBLE)") for x in ("total_quantity", "min_price", "max_price", "weighted_avg_price", "value", "savings")), _number("priced_rows")])
_PROPOSED = """
SELECT old_code, new_code, reason, CASE WHEN a IN ('', b) OR b = '' THEN CASE WHEN a = b AND a <> '' THEN 'itself' ELSE 'code missing' END WHEN length(trim(reason)) < 3 THEN 'reason' WHEN a NOT IN (SELECT nmc_code FROM m) THEN 'unknown code' WHEN b NOT IN (SELECT nmc_code FROM m) THEN 'unknown replacement'
  WHEN EXISTS (SELECT 1 FROM chain WHERE chain.old_code = a) THEN 'already superseded by ' || (SELECT max(c.new_code) FROM chain c WHERE c.old_code = a) WHEN (SELECT max(root) FROM ends WHERE nmc_code = b) = a THEN 'cycle' ELSE 'ok' END AS outcome
FROM (SELECT *, trim(old_code) AS a, trim(new_code) AS b FROM proposals) p"""
_DOCUMENTS = " UNION ALL ".join(
    f"SELECT '{name}' AS document, count(*) AS lines, CAST(sum(strlen(line) + 2) + {len(','.join(header)) + 5} AS BIGINT) AS bytes FROM ({lines}) {name[:3]}"
    for name, header, lines in (("mapping.csv", documents.MAPPING_HEADER, _mapping_lines()), ("substitutions.csv", documents.SUBSTITUTION_HEADER, f"SELECT {_LINK_CELLS} AS line FROM links"), ("economics.csv", documents.ECONOMICS_HEADER, f"SELECT {_ECONOMICS_CELLS} AS line FROM by_code"))
)
_METRICS = """
WITH r AS (SELECT 'matcher' AS model, truth, predicted, needs_review FROM evaluated UNION ALL SELECT 'text baseline', truth, baseline, false FROM evaluated),
f AS (SELECT *, truth[1] IN ('D', 'F') AS t, predicted[1] IN ('D', 'F') AS p, predicted = 'DUPLICATE' AND NOT needs_review AS auto FROM r),
c AS (SELECT model, count(*) AS n, sum((t AND p)::INT) AS tp, sum((NOT t AND p)::INT) AS fp, sum((t AND NOT p)::INT) AS fn, sum((NOT t AND NOT p)::INT) AS tn, sum((truth = predicted)::INT) AS exact, sum(auto::INT) AS auto_merges, sum((auto AND truth <> 'DUPLICATE')::INT) AS false_merges, sum((truth <> 'DUPLICATE')::INT) AS others, sum(needs_review::INT) AS reviewed FROM f GROUP BY model)
SELECT model, n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall_, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / n, 6) AS accuracy, round(exact / n, 6) AS exact_class,
  round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate, round(fn / nullif(fn + tp, 0), 6) AS false_negative_rate, CAST(auto_merges AS BIGINT) AS auto_merges, CAST(false_merges AS BIGINT) AS false_merges, round(false_merges / nullif(others, 0), 6) AS false_merge_rate, CAST(reviewed AS BIGINT) AS reviewed, round(reviewed / n, 6) AS review_rate,
  CASE WHEN n < 20 THEN 'too few pairs' WHEN tp + fn < 5 THEN 'too few equivalent pairs' WHEN tn + fp < 5 THEN 'too few other pairs' ELSE 'sufficient' END AS sufficiency FROM c"""
_STATS = """
WITH flags AS (SELECT *, CASE WHEN complete AND ord = rep THEN 1 ELSE 0 END AS is_rep FROM seats),
met AS (SELECT count(*) AS n FROM flags x JOIN flags y ON x.block = y.block AND y.ord < x.ord AND CASE WHEN NOT x.complete THEN y.is_rep = 1 OR NOT y.complete WHEN x.is_rep = 1 THEN NOT y.complete OR (y.is_rep = 1 AND y.dim_key = x.dim_key) ELSE y.is_rep = 1 AND y.dim_key = x.dim_key AND y.ord <= x.rep END)
SELECT count(*) AS materials, count(*) FILTER (subtype = 'UNK') AS uncategorised, any_value(met.n) AS comparisons, count(*) FILTER (stage = 'rule') AS rule_decisions, count(*) FILTER (stage = 'lexical') AS lexical_decisions, count(*) FILTER (stage = 'embedding') AS embedding_decisions, count(*) FILTER (stage = 'embedding') AS embedding_calls, 'not-needed' AS embedder_status FROM mapping, met"""

def _vector_ctes() -> list[tuple[str, str]]:
    """The relations from pairs to mapping again, over vectors of bucketed trigrams for the planned texts."""
    points = "list_transform(range(1, length(raw_description) + 2), lambda i: (ascii(whole[i]) * 961 + ascii(whole[i + 1]) * 31 + ascii(whole[i + 2])) % 251)"
    counts = f"SELECT raw_description, b, count(*) AS n FROM (SELECT raw_description, unnest({points}) AS b FROM (SELECT raw_description, '  ' || upper(raw_description) || ' ' AS whole FROM planned) w) u GROUP BY ALL"
    planned = """SELECT DISTINCT raw_description FROM m WHERE trim(raw_description) <> '' AND CASE WHEN complete THEN (block, dim_key) IN (SELECT (block, dim_key) FROM m WHERE complete GROUP BY block, dim_key HAVING count(DISTINCT nmc_code) > 1)
  ELSE block IN (SELECT block FROM m GROUP BY block HAVING count(*) > 1) END"""
    made = [
        ("planned", planned),
        ("bucketed", counts),
        ("vectored", "SELECT p.raw_description, list(CAST(coalesce(n, 0) / norm AS FLOAT) ORDER BY k) AS vec FROM planned p CROSS JOIN range(251) r(k) LEFT JOIN bucketed b ON b.raw_description = p.raw_description AND b.b = k JOIN (SELECT raw_description, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM bucketed GROUP BY ALL) q ON q.raw_description = p.raw_description GROUP BY p.raw_description"),
        ("vector_texts", "SELECT t.*, v.vec FROM texts t LEFT JOIN vectored v USING (raw_description)"),
    ]
    again = {"ruled": _judged("SELECT a_text, b_text FROM facing UNION SELECT a_text, b_text FROM echoes", True)}
    named = ("ruled", "tally", "ranked", "chosen", "climb", "mapping")
    for name, query in CTES:
        plain = name.split("(")[0]
        if plain in named:
            query = again.get(plain, query)
            for other in named:
                query = re.sub(rf"\b(FROM|JOIN) {other}\b", rf"\1 vector_{other}", query)
            made.append((f"vector_{name}", query))
    return made


CTES += _vector_ctes()

CTES += [("nodes", _graph_nodes()), ("edges", _GRAPH_EDGES)]
_FIRST = """
SELECT e.id, e.src, e.dst, e.rel FROM edges e WHERE rel IN ('USED_BY', 'MAPPED_TO', 'DUPLICATE', 'SUBSTITUTE', 'SUPERSEDED_BY') AND (src[1] <> 'c' OR src = 'c:ONGC') AND (dst[1] <> 'c' OR dst = 'c:ONGC')"""
_ORGANISATION = f"""
WITH shown AS ({_FIRST}), own AS (SELECT src AS id FROM shown WHERE rel = 'USED_BY'), codes AS (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM own) AND dst[1] = 'n'),
fine AS (SELECT 'c:ONGC' AS id UNION SELECT id FROM own UNION SELECT id FROM codes UNION SELECT dst FROM edges WHERE dst[1] = 'n' AND src IN (SELECT id FROM codes) UNION SELECT src FROM edges WHERE src[1] = 'n' AND dst IN (SELECT id FROM codes))
SELECT * FROM shown WHERE src IN (SELECT id FROM fine) AND dst IN (SELECT id FROM fine)"""
_FILTERED = """
SELECT e.id, e.src, e.dst, e.rel FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id
WHERE (a.type = 'cpse' OR (a.category = 'Fastener' AND a.status = 'pending-review' AND (a.type = 'material' OR a.label ILIKE '%hnt%'))) AND (b.type = 'cpse' OR (b.category = 'Fastener' AND b.status = 'pending-review' AND (b.type = 'material' OR b.label ILIKE '%hnt%')))"""
_REACH = """
WITH begun AS (SELECT DISTINCT 'n:' || old_code AS id FROM chain JOIN mapping ON old_code = nmc_code WHERE cpse_id = 'ONGC'),
pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), one AS (SELECT DISTINCT b AS id FROM pairs WHERE a IN (SELECT id FROM begun)), two AS (SELECT DISTINCT b AS id FROM pairs WHERE a IN (SELECT id FROM one))
SELECT id, CAST(min(hop) AS INT) AS hop FROM (SELECT id, 0 AS hop FROM begun UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) u GROUP BY id"""

BODIES: dict[str, str] = {
    "visible_edges": _ORGANISATION,
    "visible_edges_filtered": _FILTERED,
    "visible_search": f"SELECT id, type, label, title FROM nodes WHERE (label ILIKE '%hex%' OR title ILIKE '%hex%') AND id IN (SELECT unnest([src, dst]) FROM ({_ORGANISATION}) o)",
    "graph_reach": _REACH,
    "mapping_by_vectors": "SELECT ord, nmc_code, matched_ord, verdict, round(confidence, 6) AS confidence, stage, safety_risk, status FROM vector_mapping",
    "mapping_free_texts": "SELECT ord, nmc_code, matched_ord, verdict, round(confidence, 6) AS confidence, status, reason FROM mapping",
    "planned_texts": "SELECT raw_description AS text, len(vec) AS width FROM vectored",
    "mapping": "SELECT ord, cpse_id, own_code, nmc_code, own_nmc, matched_ord, matched_nmc, verdict, round(confidence, 6) AS confidence, stage, safety_risk, needs_review, status, reason FROM mapping",
    "nmc_records": "SELECT p.nmc_code, canonical, category, subtype, complete, n AS n_materials, c.new_code AS superseded_by FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY nmc_code) AS n FROM mapping WINDOW w AS (PARTITION BY nmc_code ORDER BY ord)) p LEFT JOIN chain c ON p.nmc_code = c.old_code WHERE k = 1",
    "stage_status_counts": "SELECT stage, verdict, status, count(*) AS n, count(DISTINCT nmc_code) AS codes FROM mapping GROUP BY ALL",
    "verdict_summary": "SELECT count(*) AS materials, count(*) FILTER (verdict = 'duplicate') AS duplicates, count(*) FILTER (verdict = 'functionally_equivalent') AS equivalents, count(*) FILTER (verdict = 'similar') AS similars, count(*) FILTER (verdict = 'distinct') AS uniques, floor(count(*) FILTER (NOT needs_review) * 1000 / count(*) + 0.5) / 10 AS auto_resolved_pct FROM mapping",
    "run_stats": _STATS,
    "pending_queue": "SELECT ord, own_code, nmc_code, verdict, round(confidence, 6) AS confidence, safety_risk, CASE safety_risk WHEN 'HIGH' THEN 2 ELSE 1 END AS reviewers_needed FROM mapping WHERE needs_review",
    "outcome_labels": "SELECT if(verdict = 'distinct', 'REJECT', if(needs_review, 'HUMAN REVIEW', 'AUTO ISSUE')) AS outcome, subtype, count(*) AS n FROM mapping GROUP BY ALL",
    "economics_by_code": "SELECT nmc_code, legacy_codes, cpses, n_cpses, uom, total_quantity, round(min_price, 6) AS min_price, round(max_price, 6) AS max_price, round(weighted_avg_price, 6) AS weighted_avg_price, round(value, 6) AS value, round(savings, 6) AS savings, priced_rows FROM by_code",
    "economics_summary": "SELECT entries, with_quantity, with_price, with_both, unique_codes, entries - unique_codes AS redundant_codes, floor((entries - unique_codes) / entries * 1000 + 0.5) / 10 AS reduction_pct, multi_cpse_codes, mixed_uom_codes, v AS total_value, s AS savings, coalesce(floor(s / nullif(v, 0) * 1000 + 0.5) / 10, 0.0) AS savings_pct FROM (SELECT count(*) AS entries, count(*) FILTER (quantity > 0) AS with_quantity, count(*) FILTER (unit_price > 0) AS with_price, count(*) FILTER (quantity > 0 AND unit_price > 0) AS with_both FROM now) a, (SELECT count(*) AS unique_codes, count(*) FILTER (contains(cpses, '|')) AS multi_cpse_codes, count(*) FILTER (uom = 'MIXED') AS mixed_uom_codes, floor(CAST(sum(CAST(value AS DECIMAL(28, 2))) AS DOUBLE) * 100 + 0.5) / 100 AS v, floor(CAST(sum(CAST(savings AS DECIMAL(28, 2))) AS DOUBLE) * 100 + 0.5) / 100 AS s FROM by_code) b",
    "top_savings": "SELECT nmc_code, round(savings, 6) AS savings, legacy_codes FROM by_code WHERE savings > 0 ORDER BY round(savings, 6) DESC, first_ord LIMIT 10",
    "top_combined_demand": "SELECT nmc_code, total_quantity, n_cpses FROM by_code WHERE contains(cpses, '|') AND total_quantity IS NOT NULL ORDER BY total_quantity DESC, first_ord LIMIT 10",
    "export_economics": f"SELECT nmc_code, {_ECONOMICS_CELLS} AS line FROM by_code",
    "supersession_resolve": "SELECT nmc_code, root AS current_code FROM ends",
    "supersession_apply": "SELECT ord, nmc_code, current_code, (SELECT max(new_code) FROM chain WHERE old_code = nmc_code) AS superseded_by FROM now",
    "supersession_validate": _PROPOSED,
    "cycle_resolve": "SELECT node, arg_max(here, len(seen)) AS root FROM circling GROUP BY node",
    "export_documents": _DOCUMENTS,
    "supersessions_latest": "SELECT old_code, new_code, '2024-' || lpad(CAST(1 + ascii(sha256(old_code)) % 12 AS VARCHAR), 2, '0') AS at FROM chain",
    "active_codes": "SELECT nmc_code FROM mapping EXCEPT SELECT old_code FROM chain",
    "review_checks": "SELECT ord, outcome, refused, trim(reviewer) || CASE WHEN grave THEN coalesce('; ' || trim(second_reviewer), '') ELSE '' END AS signers FROM checked",
    "review_apply": "SELECT ord, status, linked_nmc, nmc_code, original_nmc, current_code, reviewed_by, reviewed_at FROM reviewed",
    "records_after_review": "SELECT r.nmc_code, f.canonical, f.category, f.subtype, count(*) AS n_materials, count(*) FILTER (r.nmc_code <> r.original_nmc) AS restored, any_value(c.new_code) AS superseded_by FROM reviewed r JOIN (SELECT DISTINCT ON (nmc_code) nmc_code, canonical, category, subtype FROM m ORDER BY nmc_code, ord) f USING (nmc_code) LEFT JOIN chain c ON r.nmc_code = c.old_code GROUP BY ALL",
    "substitution_links": "SELECT link_id, code_a, code_b, verdict, safety_risk, round(confidence, 6) AS confidence, cpses, confirmed_by, confirmed_at, audit_seq, n_evidence, n_members FROM links",
    "link_members": "SELECT link_id, cpse_id, own_code, member_code, last(raw_description ORDER BY place) AS raw_description FROM witness GROUP BY ALL",
    "export_mapping": _mapping_lines(),
    "export_mapping_ready": _mapping_lines("cpse_id = 'ONGC' AND status IN ('auto-issued', 'reviewed-confirmed', 'reviewed-rejected')"),
    "export_substitutions": f"SELECT link_id, {_LINK_CELLS} AS line FROM links",
    "graph_nodes": _graph_nodes(),
    "graph_edges": _GRAPH_EDGES,
    "visible_subgraph": "SELECT ord, cpse_id, nmc_code FROM mapping WHERE nmc_code IN (SELECT nmc_code FROM mapping WHERE cpse_id = 'ONGC')",
    "node_search": "SELECT ord, own_code, nmc_code, raw_description FROM mapping WHERE contains(lower(concat_ws(' ', raw_description, nmc_code, own_code)), 'valve') ORDER BY ord LIMIT 100",
    "filter_domains": "SELECT DISTINCT unnest(['organisation', 'category', 'status']) AS domain, unnest([cpse_id, category, status]) AS value FROM mapping",
    "code_profile": _PROFILE,
    "audit_code_counts": 'SELECT code, entries FROM "references"',
    "org_insight": "SELECT cpse_id, count(*) AS materials, count(DISTINCT nmc_code) AS codes, count(DISTINCT nmc_code) FILTER (EXISTS (SELECT 1 FROM mapping o WHERE o.nmc_code = p.nmc_code AND o.cpse_id <> p.cpse_id)) AS shared_codes, count(*) FILTER (needs_review) AS pending FROM mapping p GROUP BY cpse_id",
    "explain_attributes": "SELECT a_text, b_text, attribute, role, a_value, b_value, status FROM evidence",
    "explain_pairs": f"SELECT a_text, b_text, outcome, dimensions, description_status, coalesce(grade_status, 'unknown') AS grade_status, coalesce(standard_status, 'unknown') AS standard_status, corrosion_status, risk_status, recomputed_risk, round(attribute_score, 6) AS attribute_score, round(same_dims / nullif(n_dims, 0), 6) AS dimension_score, round(confidence, 6) AS confidence, reasoning, outcome_why FROM ({_reasoned('matched', 'evidence')}) q",
    "validation_decisions": "SELECT ord, truth, predicted, baseline, rule_no, round(confidence, 6) AS confidence, safety_risk, needs_review, round(sim, 6) AS similarity FROM evaluated",
    "validation_metrics": _METRICS,
    "validation_confusion": f"SELECT t.x AS truth, p.x AS predicted, (SELECT count(*) FROM evaluated e WHERE e.truth = t.x AND e.predicted = p.x) AS n FROM (SELECT unnest({list(derived.LABELS)}) AS x) t, (SELECT unnest({list(derived.LABELS)}) AS x) p",
    "validation_summary": "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (truth = '{x}') AS {x.lower()}" for x in derived.LABELS) + " FROM labelled",
    "validation_safety": "SELECT count(*) FILTER (neg) AS negatives, count(*) FILTER (neg AND bad) AS unsafe, count(*) FILTER (neg AND bad AND auto) AS auto_merged, count(*) FILTER (neg AND bad AND NOT auto AND needs_review) AS held_for_review, count(*) FILTER (neg AND NOT bad) AS correctly_rejected, count(*) FILTER (high) AS high_risk, count(*) FILTER (high AND needs_review) AS sent_to_review, count(*) FILTER (high AND NOT bad) AS rejected, count(*) FILTER (high AND NOT needs_review AND bad) AS auto_accepted, count(*) >= 20 AND count(*) FILTER (neg) >= 5 AS sufficient FROM (SELECT *, truth[1] = 'N' AS neg, predicted[1] <> 'N' AS bad, predicted = 'DUPLICATE' AND NOT needs_review AS auto, safety_risk IS NOT DISTINCT FROM 'HIGH' AS high FROM evaluated) e",
    "validation_drilldown": f"SELECT l.ord, l.a_text, l.b_text, e.predicted, q.outcome, q.reasoning FROM labelled l JOIN evaluated e USING (ord) JOIN ({_reasoned('judged', 'judged_evidence')}) q ON l.a_text = q.a_text AND l.b_text = q.b_text WHERE l.truth = 'NOT_EQUIVALENT' AND e.predicted <> 'NOT_EQUIVALENT'",
}


def oracle(name: str) -> str:
    # relations that several others read are kept; a recursion is none of them
    base = {"materials": derived.FREE_TEXTS.format(part="part")} if name == "mapping_free_texts" else {}
    ctes = ",\n".join(f"{n if n != 'references' else chr(34) + n + chr(34)} AS {'' if '(' in n else 'MATERIALIZED '}({base.get(n, q)})" for n, q in CTES)
    return f"WITH RECURSIVE {ctes}\nSELECT * FROM ({BODIES[name]}) answer"


def oracle_sql() -> dict[str, str]:
    return {name: oracle(name) for name in BODIES}
