"""Why two materials were decided as they were: evidence per attribute, safety checks, scores and a text.

SQL over a relation of decided pairs: structs a and b (coded rows), verdict, confidence, stage, safety_risk,
needs_review, reason and sim.
"""

from __future__ import annotations

from matforge.functions import text as T
from matforge.operators import dictionary as D
from matforge.operators.decide import equivalent_standards, risk

OUTCOME = "CASE WHEN verdict = 'distinct' THEN 'REJECT' WHEN needs_review THEN 'HUMAN REVIEW' ELSE 'AUTO ISSUE' END"
#: Similarity of descriptions from which they count as the same, or as compatible.
SAME, COMPATIBLE = 0.85, 0.6


def _status(k: str) -> str:
    equivalent = f" WHEN {equivalent_standards('a.a_standard', 'b.a_standard')} THEN 'compatible'" if k == "standard" else ""
    return f"CASE WHEN a.a_{k} IS NULL AND b.a_{k} IS NULL THEN 'unknown' WHEN a.a_{k} = b.a_{k} THEN 'same'{equivalent} ELSE 'different' END"


def _evidence() -> str:
    """Array of the attributes of a's subtype in order: attribute, role, both values, status."""
    one = lambda s, k: f"struct('{k}' AS attribute, '{'dimension' if k in s.dims else 'standard' if k == 'standard' else 'material'}' AS role, a.a_{k} AS a_value, b.a_{k} AS b_value, {_status(k)} AS status)"
    none = "CAST(array() AS ARRAY<STRUCT<attribute: STRING, role: STRING, a_value: STRING, b_value: STRING, status: STRING>>)"
    return "CASE a.subtype " + " ".join(f"WHEN '{s.code}' THEN array({', '.join(one(s, k) for k in s.dims + s.mats)})" for s in D.SUBTYPES) + f" ELSE {none} END"


def explained(pairs: str) -> str:
    """Pairs with evidence, dimension and similarity status, scores, recomputed risk, outcome and reasoning."""
    bearing = f"a.subtype IN {T.in_list(s.code for s in D.SUBTYPES if s.pressure_bearing)}"
    of = lambda status: f"size(filter(evidence, x -> x.status = '{status}'))"
    dims = "filter(evidence, x -> x.role = 'dimension')"
    listed = lambda keep, each, by: f"array_join(transform(filter(evidence, x -> {keep}), x -> {each}), '{by}')"
    item = "CASE a.subtype " + " ".join(f"WHEN '{s.code}' THEN '{s.label.lower()}'" for s in D.SUBTYPES) + " ELSE 'item' END"
    return f"""
SELECT *, CASE WHEN n_same > 0 THEN 'Both are a ' || item || ' with the same ' || {listed("x.status = 'same'", "x.attribute || ' (' || x.a_value || ')'", ", ")} || '.' ELSE 'Both are a ' || item || '; no attribute could be compared as equal.' END
    || CASE WHEN n_differ > 0 THEN ' They differ in ' || {listed("x.status IN ('different', 'compatible')", "x.attribute || ' ' || coalesce(x.a_value, '?') || ' / ' || coalesce(x.b_value, '?') || CASE WHEN x.status = 'compatible' THEN ' (equivalent)' ELSE '' END", "; ")} || '.' ELSE ' No attribute differs.' END
    || ' Risk: ' || coalesce(safety_risk, 'not calculated') || '. Outcome: ' || outcome || '.' AS reasoning,
  outcome || ': ' || reason AS outcome_why
FROM (SELECT *, {item} AS item, {OUTCOME} AS outcome, {of("same")} AS n_same, {of("different")} + {of("compatible")} AS n_differ,
    CASE WHEN size(evidence) > 0 THEN {of("same")} / CAST(size(evidence) AS DOUBLE) END AS attribute_score,
    CASE WHEN size({dims}) > 0 THEN size(filter(evidence, x -> x.role = 'dimension' AND x.status = 'same')) / CAST(size({dims}) AS DOUBLE) END AS dimension_score,
    CASE WHEN size({dims}) = 0 THEN 'unknown' WHEN forall({dims}, x -> x.status = 'same') THEN 'compatible' ELSE 'different' END AS dimensions,
    CASE WHEN sim >= {SAME} THEN 'same' WHEN sim >= {COMPATIBLE} THEN 'compatible' ELSE 'different' END AS description_status,
    coalesce(get(filter(evidence, x -> x.attribute = 'grade'), 0).status, 'unknown') AS grade_status, coalesce(get(filter(evidence, x -> x.attribute = 'standard'), 0).status, 'unknown') AS standard_status,
    CASE WHEN a.corrosion IS NULL OR b.corrosion IS NULL THEN 'unknown' WHEN a.corrosion = b.corrosion THEN 'same' ELSE 'different' END AS corrosion_status,
    CASE WHEN safety_risk = 'LOW' THEN 'same' WHEN safety_risk IS NULL THEN 'unknown' ELSE 'different' END AS risk_status,
    CASE WHEN a.subtype = 'UNK' THEN safety_risk ELSE {risk("a", "b")} END AS recomputed_risk, {bearing} AS pressure_bearing
  FROM (SELECT *, {_evidence()} AS evidence FROM {pairs}) e1) e2"""
