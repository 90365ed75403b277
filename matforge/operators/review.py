"""Review decisions as data: which of them hold, what they change, and the substitution links they confirm.

SQL over two relations: a mapping (see ``match``) and decisions (ord, outcome ``confirmed`` or ``rejected``, reviewer,
second_reviewer, audit_seq, at). Decisions apply in the order of ``audit_seq``: the first sound one on a material settles it, later ones
find it no longer pending.
"""

from __future__ import annotations


def _blank(x: str) -> str:
    return f"trim(coalesce({x}, '')) = ''"


def checked(mapping: str, decisions: str) -> str:
    """Each decision with ``refused``: why it does not count, or NULL; and who signs it."""
    grave = "d.outcome = 'confirmed' AND m.safety_risk = 'HIGH'"
    alone = f"""
SELECT /*+ MERGE(m) */ d.*, CASE WHEN m.ord IS NULL OR m.status <> 'pending-review' THEN 'not pending' WHEN {_blank("d.reviewer")} THEN 'reviewer missing'
    WHEN {grave} AND {_blank("d.second_reviewer")} THEN 'second reviewer missing'
    WHEN {grave} AND lower(trim(d.second_reviewer)) = lower(trim(d.reviewer)) THEN 'second reviewer is the first' END AS fault,
  CASE WHEN {grave} THEN array(trim(d.reviewer), trim(d.second_reviewer)) ELSE array(trim(d.reviewer)) END AS signers
FROM {decisions} d LEFT JOIN {mapping} m ON d.ord = m.ord"""
    settled = "count_if(fault IS NULL) OVER (PARTITION BY ord ORDER BY audit_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0"
    return f"SELECT * EXCEPT (fault), CASE WHEN {settled} THEN 'not pending' ELSE fault END AS refused FROM ({alone}) a"


def applied(mapping: str, accepted: str, ends: str) -> str:
    """The mapping after the accepted decisions.

    A confirmed match that is no merge links the row to the other code; a rejected merge gives the row its own code
    back; the code in force is looked up again. Rows without a decision keep their state.
    """
    confirmed, rejected = "a.outcome = 'confirmed'", "a.outcome = 'rejected'"
    return f"""
SELECT r.*, CASE WHEN e.root <> r.nmc_code THEN e.root END AS current_code FROM (
  SELECT /*+ MERGE(a) */ m.* EXCEPT (status, nmc_code), m.nmc_code AS original_nmc, CASE WHEN {rejected} AND m.verdict = 'duplicate' THEN m.own_nmc ELSE m.nmc_code END AS nmc_code,
    CASE WHEN {confirmed} THEN 'reviewed-confirmed' WHEN {rejected} THEN 'reviewed-rejected' ELSE m.status END AS status,
    CASE WHEN {confirmed} AND m.verdict NOT IN ('duplicate', 'distinct') AND m.matched_nmc <> m.nmc_code THEN m.matched_nmc END AS linked_nmc,
    array_join(a.signers, '; ') AS reviewed_by, a.at AS reviewed_at, a.audit_seq
  FROM {mapping} m LEFT JOIN {accepted} a ON m.ord = a.ord) r LEFT JOIN {ends} e ON r.nmc_code = e.nmc_code"""


def evidence(reviewed: str, mapping: str, accepted: str) -> str:
    """One row per piece of evidence of a link, in order of place: each confirmed row and then the row it was matched with."""
    link = "least(r.nmc_code, r.linked_nmc) AS code_a, greatest(r.nmc_code, r.linked_nmc) AS code_b"
    return f"""
SELECT code_a || '<->' || code_b AS link_id, * FROM (
  SELECT /*+ MERGE(a) */ {link}, r.audit_seq * 2 AS place, r.cpse_id, r.own_code, r.raw_description, r.nmc_code AS member_code, r.verdict, r.safety_risk, r.confidence, r.reason, a.signers, a.at, r.audit_seq, true AS leads
  FROM {reviewed} r JOIN {accepted} a ON r.ord = a.ord WHERE r.linked_nmc IS NOT NULL
  UNION ALL SELECT /*+ MERGE(o) */ {link}, r.audit_seq * 2 + 1, o.cpse_id, o.own_code, o.raw_description, o.nmc_code, r.verdict, r.safety_risk, r.confidence, r.reason, array(), r.reviewed_at, r.audit_seq, false
  FROM {reviewed} r JOIN {mapping} o ON r.matched_ord = o.ord WHERE r.linked_nmc IS NOT NULL) e"""


def members(proof: str) -> str:
    """Link members: each (organisation, own code, code) once, with its last description, in order of first appearance."""
    return f"SELECT link_id, cpse_id, own_code, member_code, max_by(raw_description, place) AS raw_description, min(place) AS place FROM {proof} GROUP BY link_id, cpse_id, own_code, member_code"


def links(proof: str) -> str:
    """One row per link: the first confirmation's decision, all organisations and reviewers in order of appearance."""
    joined = lambda value, source: f"SELECT link_id, array_join(transform(array_sort(collect_list(struct(place, value))), x -> x.value), '; ') AS listed, count(*) AS n FROM (SELECT link_id, {value} AS value, min(place) AS place FROM {source} GROUP BY link_id, {value}) v GROUP BY link_id"
    # of one decision the reviewer signs before the second reviewer, whatever their names
    signers = f"(SELECT link_id, struct(place, nth) AS place, signer FROM {proof} LATERAL VIEW posexplode(signers) s AS nth, signer WHERE leads)"
    return f"""
SELECT f.*, o.listed AS cpses, s.listed AS confirmed_by, m.n AS n_members
FROM (SELECT link_id, any_value(code_a) AS code_a, any_value(code_b) AS code_b, min_by(verdict, place) AS verdict, min_by(safety_risk, place) AS safety_risk, min_by(confidence, place) AS confidence,
    min_by(reason, place) AS reason, min_by(at, place) AS confirmed_at, min(audit_seq) AS audit_seq, count_if(leads) AS n_evidence FROM {proof} GROUP BY link_id) f
JOIN ({joined("cpse_id", proof)}) o ON f.link_id = o.link_id JOIN ({joined("signer", signers)}) s ON f.link_id = s.link_id
JOIN (SELECT link_id, count(*) AS n FROM ({members(proof)}) p GROUP BY link_id) m ON f.link_id = m.link_id"""
