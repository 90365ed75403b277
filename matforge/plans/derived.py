"""Queries over the mapping: codes in force, reviews, links, economics, graph, profiles, explanations, exports, run statistics.

Each is a SELECT over named relations, which :class:`Relations` builds when a query first asks for them. Their oracles are
written apart from them, in ``oracles``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matforge.functions.dialect import SPARK
from matforge.operators import audit, economics, explain, graph, match, review, supersession, vectors
from matforge.operators.decide import BEST_OF, filled
from matforge.operators.decide import decisions as decide
from matforge.operators.pointers import roots
from matforge.plans import views as V
from matforge.runtime import materialise, scratch_path
from matforge.sources.documents import ECONOMICS_HEADER, MAPPING_HEADER, SUBSTITUTION_HEADER, line, number_cell, text_cell, write_documents

d = SPARK
#: Retired codes point at the next code of their block in alphabetical order, every third one stays.
CHAIN = "SELECT nmc_code AS old_code, next_code AS new_code FROM (SELECT nmc_code, row_number() OVER (PARTITION BY block ORDER BY nmc_code) AS k, lead(nmc_code) OVER (PARTITION BY block ORDER BY nmc_code) AS next_code FROM (SELECT DISTINCT block, nmc_code FROM {m} WHERE complete) u) s WHERE next_code IS NOT NULL AND k % 3 <> 0"
#: Places among a block's codes: retired in favour of the next one, the one after, or an earlier one, some twice.
BATCH = """SELECT row_number() OVER (ORDER BY k, block, old_code, new_code) AS place, old_code, new_code, 'replaced' AS reason FROM (
  SELECT block, k * 7 % 11 AS k, nmc_code AS old_code, coalesce(lead(nmc_code) OVER w, first_value(nmc_code) OVER w) AS new_code FROM {coded_places} WINDOW w AS (PARTITION BY block, k div 5 ORDER BY nmc_code)
  UNION ALL SELECT block, k * 5 % 11, nmc_code, coalesce(lag(nmc_code, 2) OVER w, lead(nmc_code, 3) OVER w, '') FROM {coded_places} WINDOW w AS (PARTITION BY block ORDER BY nmc_code)) b"""
#: Materials as pointers: chains of eight, every other one of which turns back into a circle.
CIRCLES = "SELECT ord AS node, CASE WHEN ord % 8 <> 7 THEN ord + 1 WHEN ord % 16 = 15 THEN ord - ord % 5 - 1 END AS up FROM {m}"
#: Parts as materials that are described by their names, types and brands.
FREE_TEXTS = "SELECT p_partkey AS ord, 'ONGC' AS cpse_id, 'P-' || CAST(p_partkey AS VARCHAR(20)) AS own_code, 'EA' AS uom, CAST(p_size AS DOUBLE) AS quantity, p_retailprice AS unit_price, upper(p_name) || ' ' || p_type || ' ' || p_brand AS raw_description FROM {part}"
#: Review decisions on some materials, pending or not; a few lack a reviewer, or a second one where that is needed, and some
#: materials are decided a second time, the other way round.
DECISIONS = """SELECT ord, CASE WHEN (ord + again) % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS outcome, CASE WHEN ord % 11 = 0 AND again = 0 THEN ' ' ELSE 'REV-' || CAST(ord % 4 AS VARCHAR(9)) END AS reviewer,
  CASE ord % 3 WHEN 0 THEN NULL WHEN 1 THEN 'rev-' || CAST(ord % 4 AS VARCHAR(9)) || ' ' ELSE 'REV-' || CAST(ord % 4 + 1 AS VARCHAR(9)) END AS second_reviewer,
  1000 + ord + again AS audit_seq, '2024-01-' || CAST(10 + ord % 18 AS VARCHAR(9)) || 'T00:00:00.000Z' AS at
FROM (SELECT ord, 0 AS again FROM {m} WHERE ord % 7 <> 3 UNION ALL SELECT ord, 1000000001 FROM {m} WHERE ord % 11 = 0 OR ord % 5 = 2) x"""
#: Neighbouring materials as labelled pairs.
PAIRS = """SELECT x.ord, CASE x.ord % 4 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'NOT_EQUIVALENT' WHEN 2 THEN 'SIMILAR' ELSE 'FUNCTIONALLY_EQUIVALENT' END AS truth, x.raw_description AS a_text, y.raw_description AS b_text
FROM {m} x JOIN {m} y ON y.ord = x.ord + CASE x.ord % 3 WHEN 0 THEN 29 WHEN 1 THEN 13 ELSE 1 END"""
LABEL = "CASE verdict WHEN 'duplicate' THEN 'DUPLICATE' WHEN 'functionally_equivalent' THEN 'FUNCTIONALLY_EQUIVALENT' WHEN 'similar' THEN 'SIMILAR' ELSE 'NOT_EQUIVALENT' END"
LABELS = ("DUPLICATE", "FUNCTIONALLY_EQUIVALENT", "SIMILAR", "NOT_EQUIVALENT")


class Relations:
    """The relations of one query, each built at most once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, str] = {}

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text.format(**{n: self.view(n) for n in re.findall(r"{(\w+)}", text)}))

    def view(self, name: str) -> str:
        if name not in self.made:
            self.made[name] = V.named(getattr(self, name)())
        return self.made[name]

    def materials(self) -> DataFrame:
        return V.materials(self.spark, self.sf_dir)

    def rows(self) -> DataFrame:
        """Coded materials for joins of rows with rows: merged, since a broadcast would take all of them through the driver."""
        return self.spark.table(self.view("m")).hint("merge")

    def labelled(self) -> DataFrame:
        return self.sql(PAIRS.replace("{m}", "{rows}"))

    def texts(self) -> DataFrame:
        return V.coded_texts(self.spark.table(self.view("materials")))

    def m(self) -> DataFrame:
        """Coded materials without their words and trigrams, which lie once per text in ``texts``."""
        return materialise(V.code_materials(self.spark.table(self.view("materials")), match.told(self.spark.table(self.view("texts")))), "coded")

    def mapping(self) -> DataFrame:
        return match.map_materials(self.spark.table(self.view("m")), texts=self.spark.table(self.view("texts")))

    def vectors(self) -> DataFrame:
        """Vectors of the texts that may be compared, by the stand-in model."""
        m = self.spark.table(self.view("m"))
        return materialise(vectors.embed_texts(match.planned_texts(m), vectors.bucket_vectors, scratch_path(self.spark, "vector-cache")), "vectors")

    def vector_mapping(self) -> DataFrame:
        return match.map_materials(self.spark.table(self.view("m")), vectors=self.spark.table(self.view("vectors")), texts=self.spark.table(self.view("texts")))

    def free_mapping(self) -> DataFrame:
        """The mapping of the parts under their own names: incomplete texts of few words, nearly all different."""
        parts = self.spark.sql(FREE_TEXTS.format(part=V.named(self.spark.read.parquet(f"{self.sf_dir}/part.parquet"))))
        texts = V.coded_texts(parts)
        return match.map_materials(materialise(V.code_materials(parts, match.told(texts)), "coded"), texts=texts)

    def chain(self) -> DataFrame:
        return materialise(self.sql(CHAIN), "chain")

    def ends(self) -> DataFrame:
        return roots(self.sql("SELECT u.nmc_code, c.new_code FROM (SELECT DISTINCT nmc_code FROM {m}) u LEFT JOIN {chain} c ON u.nmc_code = c.old_code"), "nmc_code", "new_code")

    def proposals(self) -> DataFrame:
        return materialise(self.sql(PROPOSALS), "proposals")

    def coded_places(self) -> DataFrame:
        return materialise(self.sql("SELECT block, nmc_code, CAST(row_number() OVER (PARTITION BY block ORDER BY nmc_code) AS BIGINT) AS k FROM (SELECT DISTINCT block, nmc_code FROM {m}) u"), "places")

    def batch(self) -> DataFrame:
        """A batch that proposes a replacement for codes out of order, some twice, some in a circle."""
        return supersession.accepted(self.sql(BATCH), self.sql("SELECT nmc_code FROM {m}"), self.sql("SELECT * FROM {chain} LIMIT 0"), self.sql("SELECT DISTINCT nmc_code, nmc_code AS root FROM {m}"))

    def circled(self) -> DataFrame:
        return roots(self.sql(CIRCLES), "node", "up")

    def now(self) -> DataFrame:
        """The mapping with the code in force: ``code``, and ``current_code`` where that is another than the issued one."""
        return self.sql("SELECT p.*, CASE WHEN e.root <> p.nmc_code THEN e.root END AS current_code, coalesce(e.root, p.nmc_code) AS code FROM {mapping} p LEFT JOIN {ends} e ON p.nmc_code = e.nmc_code")

    def by_code(self) -> DataFrame:
        return self.sql(economics.by_code(d, "(SELECT * EXCEPT (nmc_code), code AS nmc_code FROM {now})"))

    def decisions(self) -> DataFrame:
        return self.sql(DECISIONS)

    def checked(self) -> DataFrame:
        return self.sql(review.checked("{mapping}", "{decisions}"))

    def accepted(self) -> DataFrame:
        return materialise(self.sql("SELECT * FROM {checked} WHERE refused IS NULL"), "accepted")

    def reviewed(self) -> DataFrame:
        return materialise(self.sql(review.applied("{mapping}", "{accepted}", "{ends}")), "reviewed")

    def proof(self) -> DataFrame:
        return materialise(self.sql(review.evidence("{reviewed}", "{mapping}", "{accepted}")), "proof")

    def links(self) -> DataFrame:
        return materialise(self.sql(review.links("{proof}")), "links")

    def log(self) -> DataFrame:
        """Entries of the audit log: one per issued code and one per accepted decision."""
        best = filled(BEST_OF, {"n": "CAST(n_comparable AS STRING)"})
        issued = f"to_json(named_struct('materialId', CAST(ord AS STRING), 'cpseId', cpse_id, 'ownCode', own_code, 'nmcCode', nmc_code, 'verdict', verdict, 'confidence', round(confidence, 3), 'stage', stage, 'safetyRisk', safety_risk, 'reasons', CASE WHEN n_comparable > 1 THEN array(first_reason, {best}) ELSE array(first_reason) END))"
        decided = "to_json(named_struct('materialId', CAST(r.ord AS STRING), 'nmcCode', o.nmc_code, 'cpseId', r.cpse_id, 'verdict', r.verdict, 'safetyRisk', r.safety_risk, 'signers', a.signers, 'linkedNmcCode', r.linked_nmc, 'mergeReverted', a.outcome = 'rejected' AND r.verdict = 'duplicate'))"
        return self.sql(f"SELECT 2 * ord AS entry, 'code_issued_' || verdict AS action, {issued} AS details FROM {{mapping}} UNION ALL SELECT /*+ MERGE(a, o) */ 2 * r.ord + 1, 'review_' || a.outcome, {decided} FROM {{reviewed}} r JOIN {{accepted}} a ON r.ord = a.ord JOIN {{mapping}} o ON r.ord = o.ord")

    def references(self) -> DataFrame:
        return self.sql(audit.references("{log}", "(SELECT DISTINCT nmc_code FROM {m})"))

    def exported(self) -> DataFrame:
        """The three files, written; a row for each."""
        path = scratch_path(self.spark, "exports")
        told = (("mapping.csv", MAPPING_HEADER, "ord", f"({mapping_lines('{reviewed}')})"), ("substitutions.csv", SUBSTITUTION_HEADER, "audit_seq", f"({_substitution_lines()})"), ("economics.csv", ECONOMICS_HEADER, "first_ord", f"({_economics_lines()})"))
        return write_documents(self.sql(" UNION ALL ".join(f"SELECT '{name}' AS document, '{','.join(header)}' AS header, {place} AS place, line FROM {lines} x" for name, header, place, lines in told)), path)

    def nodes(self) -> DataFrame:
        return materialise(self.sql(_NODES), "nodes")

    def edges(self) -> DataFrame:
        return materialise(self.sql(_EDGES), "edges")

    def reach(self) -> DataFrame:
        """What lies at most two edges away from an organisation's superseded codes."""
        start = self.sql("SELECT DISTINCT 'n:' || old_code AS id FROM {chain} c JOIN {mapping} p ON c.old_code = p.nmc_code WHERE p.cpse_id = 'ONGC'")
        return graph.within(self.spark.table(self.view("edges")), start, 2)

    def matched(self) -> DataFrame:
        """Materials with their matches, as decided and explained, once per pair of texts."""
        pairs = "SELECT /*+ MERGE(x, y) */ DISTINCT x.raw_description AS a_text, y.raw_description AS b_text FROM {mapping} x JOIN {mapping} y ON x.matched_ord = y.ord"
        return self._explained(pairs)

    def judged(self) -> DataFrame:
        """Labelled pairs' texts, decided and explained."""
        return self._explained("SELECT DISTINCT a_text, b_text FROM {labelled}")

    def _explained(self, pairs: str) -> DataFrame:
        texts = f"(SELECT raw_description, struct({', '.join(match.COMPARED)}) AS row FROM {{texts}})"
        structs = V.named(materialise(self.sql(f"SELECT a.row AS a, b.row AS b FROM ({pairs}) t JOIN {texts} a ON t.a_text = a.raw_description JOIN {texts} b ON t.b_text = b.raw_description"), "pairs"))
        decided = V.named(self.spark.sql(decide(d, structs)))
        found = self.spark.sql(explain.explained(decided))
        return materialise(found.selectExpr("a.raw_description AS a_text", "b.raw_description AS b_text", "* EXCEPT (a, b)"), "explained")

    def evaluated(self) -> DataFrame:
        """Labelled pairs with the matcher's and the text baseline's label."""
        return materialise(self.sql(f"SELECT p.*, {LABEL} AS predicted, CASE WHEN sim >= 0.8 THEN 'DUPLICATE' ELSE 'NOT_EQUIVALENT' END AS baseline, rule_no, confidence, safety_risk, needs_review, sim, outcome, reasoning FROM {{labelled}} p JOIN {{judged}} j ON p.a_text = j.a_text AND p.b_text = j.b_text"), "evaluated")


#: Two ways of looking at the graph, and a text to look for.
VIEWS = {
    "organisation": {"organisation": "ONGC", "relations": ("USED_BY", "MAPPED_TO", "DUPLICATE", "SUBSTITUTE", "SUPERSEDED_BY")},
    "filtered": {"category": "Fastener", "status": "pending-review", "code": "hnt"},
}
SOUGHT = "Hex"


def _r(x: str) -> str:
    return f"round({x}, 6)"


_ECONOMICS = f"nmc_code, legacy_codes, cpses, n_cpses, uom, total_quantity, {_r('min_price')} AS min_price, {_r('max_price')} AS max_price, {_r('weighted_avg_price')} AS weighted_avg_price, {_r('value')} AS value, {_r('savings')} AS savings, priced_rows"
_HEALTH = "CASE WHEN status = 'reviewed-rejected' OR safety_risk = 'HIGH' THEN 2 WHEN status = 'pending-review' THEN 1 ELSE 0 END"
_LINKED = "(SELECT code_a AS code FROM {links} UNION SELECT code_b FROM {links})"
_RETIRED, _ONLY_LINKED = "s.old_code IS NOT NULL", "s.old_code IS NULL AND u.nmc_code IS NULL AND l.code IS NOT NULL"


def _word(x: str) -> str:
    return f"CASE {x} WHEN 2 THEN 'risk' WHEN 1 THEN 'review' ELSE 'ok' END"


def _first(status: str) -> str:
    return f"min(CASE WHEN status = '{status}' THEN ord END)"


_RECORD = "(SELECT nmc_code, min_by(struct(canonical, category), ord) AS f FROM {m} GROUP BY nmc_code)"
_KNOWN = "coalesce(f.category, 'Unknown')"
_NODES = f"""
SELECT 'c:' || cpse_id AS id, 'cpse' AS type, cpse_id AS label, 'CPSE' AS title, '—' AS category, CASE WHEN max({_HEALTH}) = 2 THEN 'review' ELSE 'ok' END AS health, 'active' AS status FROM {{reviewed}} GROUP BY cpse_id
UNION ALL SELECT 'm:' || CAST(ord AS VARCHAR(20)), 'material', own_code, raw_description, {_KNOWN}, {_word(_HEALTH)}, status FROM {{reviewed}} v LEFT JOIN {_RECORD} k ON v.nmc_code = k.nmc_code
UNION ALL SELECT 'n:' || c.code, CASE WHEN {_RETIRED} THEN 'superseded' WHEN {_ONLY_LINKED} THEN 'substitute' ELSE 'nmc' END, c.code, coalesce(f.canonical, '(not in current run)'), {_KNOWN},
  {_word(f"greatest(coalesce(u.worst, 0), CASE WHEN {_RETIRED} OR ({_ONLY_LINKED}) THEN 1 ELSE 0 END)")},
  CASE WHEN {_RETIRED} THEN 'superseded' WHEN {_ONLY_LINKED} THEN 'substitute-only' WHEN u.rejected < coalesce(u.pending, u.rejected + 1) THEN 'rejected' WHEN u.pending IS NOT NULL THEN 'pending-review' ELSE 'active' END
FROM (SELECT nmc_code AS code FROM {{reviewed}} UNION SELECT code FROM {_LINKED} k UNION SELECT old_code FROM {{chain}} UNION SELECT new_code FROM {{chain}}) c
  LEFT JOIN (SELECT nmc_code, max({_HEALTH}) AS worst, {_first('pending-review')} AS pending, {_first('reviewed-rejected')} AS rejected FROM {{reviewed}} GROUP BY nmc_code) u ON c.code = u.nmc_code
  LEFT JOIN (SELECT DISTINCT old_code FROM {{chain}}) s ON c.code = s.old_code LEFT JOIN {_LINKED} l ON c.code = l.code LEFT JOIN {_RECORD} k ON c.code = k.nmc_code"""
_EDGES = """
SELECT src || '|' || rel || '|' || dst AS id, src, dst, rel FROM (
  SELECT 'm:' || CAST(ord AS VARCHAR(20)) AS src, 'c:' || cpse_id AS dst, 'USED_BY' AS rel FROM {reviewed}
  UNION ALL SELECT 'm:' || CAST(ord AS VARCHAR(20)), 'n:' || nmc_code, CASE verdict WHEN 'duplicate' THEN 'DUPLICATE' WHEN 'functionally_equivalent' THEN 'FUNCTIONALLY_EQUIVALENT' ELSE 'MAPPED_TO' END FROM {reviewed}
  UNION ALL SELECT 'n:' || code_a, 'n:' || code_b, 'SUBSTITUTE' FROM {links}
  UNION ALL SELECT 'n:' || old_code, 'n:' || new_code, 'SUPERSEDED_BY' FROM {chain}
  UNION ALL SELECT 'n:' || new_code, 'n:' || old_code, 'SUPERSEDES' FROM {chain}) e"""


def _profile() -> str:
    substitutes = "SELECT code, array_join(array_sort(collect_set(other)), '|') AS substitutes FROM (SELECT code_a AS code, code_b AS other FROM {links} UNION ALL SELECT code_b, code_a FROM {links}) s GROUP BY code"
    return f"""
SELECT p.*, coalesce(substitutes, '') AS substitutes, coalesce(superseded_codes, '') AS superseded_codes, c.new_code AS superseded_by, coalesce(r.entries, 0) AS audit_entries FROM (
  SELECT nmc_code, {d.collect('cpse_id')} AS used_by, count(DISTINCT cpse_id || '/' || own_code) AS legacy_codes, count_if(verdict = 'duplicate') AS duplicates, count_if(verdict = 'functionally_equivalent') AS equivalents,
    count_if(status = 'pending-review') AS pending, count_if(status LIKE 'reviewed-%') AS review_decisions FROM {{reviewed}} GROUP BY nmc_code) p
LEFT JOIN ({substitutes}) s ON p.nmc_code = s.code LEFT JOIN (SELECT new_code, {d.collect('old_code')} AS superseded_codes FROM {{chain}} GROUP BY new_code) o ON p.nmc_code = o.new_code
LEFT JOIN {{chain}} c ON p.nmc_code = c.old_code LEFT JOIN {{references}} r ON p.nmc_code = r.code"""


def mapping_lines(rows: str, cpse: str | None = None, include_pending: bool = True) -> str:
    """The migration file's lines, of one organisation or all, with rows that wait for review or without."""
    text = ["cpse_id", "own_code", "raw_description", "uom", "coalesce(current_code, nmc_code)", "CASE WHEN current_code IS NOT NULL THEN nmc_code END", "CASE WHEN status = 'pending-review' THEN 'REVIEW_PENDING' ELSE 'READY' END", "status", "verdict"]
    after = ["safety_risk", "stage", "linked_nmc", "matched_nmc", "reviewed_by", "reviewed_at"]
    cells = [*(text_cell(d, x) for x in text), number_cell(d, "round(confidence, 3)"), *(text_cell(d, x) for x in after), number_cell(d, "quantity"), number_cell(d, "unit_price"), text_cell(d, "reason")]
    wanted = [f"cpse_id = '{cpse}'"] * (cpse is not None) + ["status <> 'pending-review'"] * (not include_pending)
    return f"SELECT ord, {line(cells)} AS line FROM {rows}" + (f" WHERE {' AND '.join(wanted)}" if wanted else "")


def _substitution_lines() -> str:
    cells = [*(text_cell(d, x) for x in ("code_a", "code_b", "verdict", "safety_risk")), number_cell(d, "round(confidence, 3)"), *(text_cell(d, x) for x in ("cpses", "confirmed_by", "confirmed_at")), number_cell(d, "audit_seq"), text_cell(d, "reason")]
    return f"SELECT link_id, audit_seq, {line(cells)} AS line FROM {{links}}"


def _economics_lines() -> str:
    number = lambda x: number_cell(d, f"CAST({x} AS DOUBLE)" if x not in ("legacy_codes", "priced_rows") else x)
    cells = [text_cell(d, "nmc_code"), number("legacy_codes"), text_cell(d, "replace(cpses, '|', '; ')"), text_cell(d, "uom"), *(number(x) for x in ("total_quantity", "min_price", "max_price", "weighted_avg_price", "value", "savings", "priced_rows"))]
    return f"SELECT nmc_code, first_ord, {line(cells)} AS line FROM {{by_code}}"


def _metrics() -> str:
    positive = lambda x: f"{x} IN ('DUPLICATE', 'FUNCTIONALLY_EQUIVALENT')"
    cell = lambda t, p: f"count_if({'' if t else 'NOT '}{positive('truth')} AND {'' if p else 'NOT '}{positive('predicted')})"
    share = lambda a, b: _r(f"CAST({a} AS DOUBLE) / nullif({b}, 0)")
    return f"""
SELECT model, n, tp, fp, fn, tn, {share("tp", "tp + fp")} AS precision_, {share("tp", "tp + fn")} AS recall_, {share("2 * tp", "2 * tp + fp + fn")} AS f1, {share("tp + tn", "n")} AS accuracy, {share("exact", "n")} AS exact_class,
  {share("fp", "fp + tn")} AS false_positive_rate, {share("fn", "fn + tp")} AS false_negative_rate, auto_merges, false_merges, {share("false_merges", "non_duplicates")} AS false_merge_rate, reviewed, {share("reviewed", "n")} AS review_rate,
  CASE WHEN n < 20 THEN 'too few pairs' WHEN tp + fn < 5 THEN 'too few equivalent pairs' WHEN tn + fp < 5 THEN 'too few other pairs' ELSE 'sufficient' END AS sufficiency
FROM (SELECT model, count(*) AS n, {cell(True, True)} AS tp, {cell(False, True)} AS fp, {cell(True, False)} AS fn, {cell(False, False)} AS tn, count_if(truth = predicted) AS exact, count_if(predicted = 'DUPLICATE' AND NOT needs_review) AS auto_merges,
    count_if(predicted = 'DUPLICATE' AND NOT needs_review AND truth <> 'DUPLICATE') AS false_merges, count_if(truth <> 'DUPLICATE') AS non_duplicates, count_if(needs_review) AS reviewed
  FROM (SELECT 'matcher' AS model, truth, predicted, needs_review FROM {{evaluated}} UNION ALL SELECT 'text baseline', truth, baseline, false FROM {{evaluated}}) z GROUP BY model) w"""


def _safety() -> str:
    return """SELECT count_if(neg) AS negatives, count_if(neg AND unsafe) AS unsafe, count_if(neg AND unsafe AND auto) AS auto_merged, count_if(neg AND unsafe AND NOT auto AND needs_review) AS held_for_review, count_if(neg AND NOT unsafe) AS correctly_rejected,
  count_if(high) AS high_risk, count_if(high AND needs_review) AS sent_to_review, count_if(high AND NOT unsafe) AS rejected, count_if(high AND NOT needs_review AND unsafe) AS auto_accepted, count(*) >= 20 AND count_if(neg) >= 5 AS sufficient
FROM (SELECT *, truth = 'NOT_EQUIVALENT' AS neg, predicted <> 'NOT_EQUIVALENT' AS unsafe, predicted = 'DUPLICATE' AND NOT needs_review AS auto, coalesce(safety_risk = 'HIGH', false) AS high FROM {evaluated}) e"""


def _confusion() -> str:
    domain = ", ".join(f"'{x}'" for x in LABELS)
    return f"""SELECT t.truth, p.predicted, coalesce(c.n, 0) AS n FROM (SELECT explode(array({domain})) AS truth) t CROSS JOIN (SELECT explode(array({domain})) AS predicted) p
LEFT JOIN (SELECT truth, predicted, count(*) AS n FROM {{evaluated}} GROUP BY truth, predicted) c ON t.truth = c.truth AND p.predicted = c.predicted"""


def _stats() -> str:
    stages = ", ".join(f"count_if(stage = '{s}') AS {s}_decisions" for s in ("rule", "lexical", "embedding"))
    return f"""SELECT materials, uncategorised, comparisons, rule_decisions, lexical_decisions, embedding_decisions, embedding_decisions AS embedding_calls, CASE WHEN embedding_decisions > 0 THEN 'ready' ELSE 'not-needed' END AS embedder_status
FROM (SELECT count(*) AS materials, count_if(subtype = 'UNK') AS uncategorised, {stages} FROM {{mapping}}) s CROSS JOIN ({match.comparisons("{m}")}) c"""


#: Proposals to retire codes, sound ones and those that break each rule.
PROPOSALS = """
SELECT CASE WHEN k % 9 = 0 THEN 'X-' || nmc_code WHEN k % 31 = 0 THEN ' ' WHEN k % 8 = 1 THEN nmc_code || ' ' ELSE nmc_code END AS old_code,
  CASE WHEN k % 7 = 0 THEN nmc_code WHEN k % 4 = 0 THEN nmc_code || '-X' WHEN k % 6 = 0 THEN lag(nmc_code) OVER (PARTITION BY block ORDER BY nmc_code) ELSE coalesce(lead(nmc_code, 2) OVER (PARTITION BY block ORDER BY nmc_code), nmc_code) END AS new_code,
  CASE k % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'ok ' WHEN 2 THEN 'old' ELSE 'withdrawn by the maker' END AS reason
FROM (SELECT block, nmc_code, row_number() OVER (PARTITION BY block ORDER BY nmc_code) AS k FROM (SELECT DISTINCT block, nmc_code FROM {m} WHERE complete) u) v"""

#: Query -> SELECT over the relations named in braces.
BODIES: dict[str, str] = {
    "mapping": f"SELECT ord, cpse_id, own_code, nmc_code, own_nmc, matched_ord, matched_nmc, verdict, {_r('confidence')} AS confidence, stage, safety_risk, needs_review, status, reason FROM {{mapping}}",
    "mapping_by_vectors": f"SELECT ord, nmc_code, matched_ord, verdict, {_r('confidence')} AS confidence, stage, safety_risk, status FROM {{vector_mapping}}",
    "mapping_free_texts": f"SELECT ord, nmc_code, matched_ord, verdict, {_r('confidence')} AS confidence, status, reason FROM {{free_mapping}}",
    "planned_texts": "SELECT text, CAST(size(vector) AS BIGINT) AS width FROM {vectors}",
    "nmc_records": "SELECT g.nmc_code, f.canonical, f.category, f.subtype, f.complete, n_materials, c.new_code AS superseded_by FROM (SELECT nmc_code, min_by(struct(canonical, category, subtype, complete), ord) AS f, count(*) AS n_materials FROM {mapping} GROUP BY nmc_code) g LEFT JOIN {chain} c ON g.nmc_code = c.old_code",
    "stage_status_counts": "SELECT stage, verdict, status, count(*) AS n, count(DISTINCT nmc_code) AS codes FROM {mapping} GROUP BY stage, verdict, status",
    "verdict_summary": "SELECT count(*) AS materials, count_if(verdict = 'duplicate') AS duplicates, count_if(verdict = 'functionally_equivalent') AS equivalents, count_if(verdict = 'similar') AS similars, count_if(verdict = 'distinct') AS uniques, CAST(floor(CAST(count_if(NOT needs_review) AS DOUBLE) * 1000 / count(*) + 0.5) AS DOUBLE) / 10 AS auto_resolved_pct FROM {mapping}",
    "run_stats": _stats(),
    "pending_queue": f"SELECT ord, own_code, nmc_code, verdict, {_r('confidence')} AS confidence, safety_risk, CASE WHEN safety_risk = 'HIGH' THEN 2 ELSE 1 END AS reviewers_needed FROM {{mapping}} WHERE status = 'pending-review'",
    "outcome_labels": f"SELECT {explain.OUTCOME} AS outcome, subtype, count(*) AS n FROM {{mapping}} GROUP BY 1, 2",
    "economics_by_code": f"SELECT {_ECONOMICS} FROM {{by_code}}",
    "economics_summary": economics.summary(d, "{now}", "{by_code}"),
    "top_savings": f"SELECT nmc_code, {_r('savings')} AS savings, legacy_codes FROM {{by_code}} WHERE savings > 0 ORDER BY {_r('savings')} DESC, first_ord LIMIT 10",
    "top_combined_demand": "SELECT nmc_code, total_quantity, n_cpses FROM {by_code} WHERE n_cpses > 1 AND total_quantity IS NOT NULL ORDER BY total_quantity DESC, first_ord LIMIT 10",
    "export_economics": f"SELECT nmc_code, line FROM ({_economics_lines()}) x",
    "supersession_resolve": "SELECT nmc_code, root AS current_code FROM {ends}",
    "supersession_apply": "SELECT ord, nmc_code, current_code, c.new_code AS superseded_by FROM {now} n LEFT JOIN {chain} c ON n.nmc_code = c.old_code",
    "supersession_validate": f"SELECT old_code, new_code, reason, outcome FROM ({supersession.checked('{proposals}', '{m}', '{chain}', '{ends}')}) p",
    "supersession_batch": "SELECT place, old_code, new_code, outcome FROM {batch}",
    "cycle_resolve": "SELECT node, root FROM {circled}",
    "supersessions_latest": "SELECT old_code, new_code, at FROM (SELECT old_code, new_code, '2024-' || lpad(CAST(1 + ascii(substr(sha2(old_code, 256), 1, 1)) % 12 AS STRING), 2, '0') AS at FROM {chain}) t ORDER BY at DESC, old_code",
    "active_codes": "SELECT DISTINCT nmc_code FROM {mapping} p WHERE NOT EXISTS (SELECT 1 FROM {chain} s WHERE s.old_code = p.nmc_code)",
    "review_checks": "SELECT ord, outcome, refused, array_join(signers, '; ') AS signers FROM {checked}",
    "review_apply": "SELECT ord, status, linked_nmc, nmc_code, original_nmc, current_code, reviewed_by, reviewed_at FROM {reviewed}",
    "records_after_review": "SELECT t.nmc_code, f.canonical, f.category, f.subtype, n_materials, restored, s.new_code AS superseded_by FROM (SELECT nmc_code, count(*) AS n_materials, count_if(nmc_code <> original_nmc) AS restored FROM {reviewed} GROUP BY nmc_code) t LEFT JOIN (SELECT nmc_code, min_by(struct(canonical, category, subtype), ord) AS f FROM {m} GROUP BY nmc_code) f ON t.nmc_code = f.nmc_code LEFT JOIN {chain} s ON t.nmc_code = s.old_code",
    "substitution_links": f"SELECT link_id, code_a, code_b, verdict, safety_risk, {_r('confidence')} AS confidence, cpses, confirmed_by, confirmed_at, audit_seq, n_evidence, n_members FROM {{links}}",
    "link_members": "SELECT link_id, cpse_id, own_code, member_code, raw_description FROM (" + review.members("{proof}") + ") p",
    "export_mapping": mapping_lines("{reviewed}"),
    "export_mapping_ready": mapping_lines("{reviewed}", "ONGC", False),
    "export_substitutions": f"SELECT link_id, line FROM ({_substitution_lines()}) x",
    "export_documents": "SELECT * FROM {exported}",
    "graph_nodes": _NODES,
    "graph_edges": _EDGES,
    "visible_edges": "SELECT id, src, dst, rel FROM (" + graph.visible_edges("{nodes}", "{edges}", **VIEWS["organisation"]) + ") e",
    "visible_edges_filtered": "SELECT id, src, dst, rel FROM (" + graph.visible_edges("{nodes}", "{edges}", **VIEWS["filtered"]) + ") e",
    "visible_search": "SELECT id, type, label, title FROM (" + graph.found_nodes("{nodes}", graph.visible_edges("{nodes}", "{edges}", **VIEWS["organisation"]), SOUGHT) + ") e",
    "graph_reach": "SELECT id, hop FROM {reach}",
    "visible_subgraph": "SELECT e.ord, e.cpse_id, e.nmc_code FROM {mapping} e WHERE EXISTS (SELECT 1 FROM {mapping} o WHERE o.nmc_code = e.nmc_code AND o.cpse_id = 'ONGC')",
    "node_search": "SELECT ord, own_code, nmc_code, raw_description FROM {mapping} WHERE lower(raw_description) LIKE '%valve%' OR lower(nmc_code) LIKE '%valve%' OR lower(own_code) LIKE '%valve%' ORDER BY ord LIMIT 100",
    "filter_domains": "SELECT 'organisation' AS domain, cpse_id AS value FROM {mapping} GROUP BY cpse_id UNION ALL SELECT 'category', category FROM {mapping} GROUP BY category UNION ALL SELECT 'status', status FROM {mapping} GROUP BY status ORDER BY domain, value",
    "code_profile": _profile(),
    "audit_code_counts": "SELECT code, entries FROM {references}",
    "org_insight": "SELECT a.cpse_id, count(*) AS materials, count(DISTINCT a.nmc_code) AS codes, count(DISTINCT CASE WHEN s.n > 1 THEN a.nmc_code END) AS shared_codes, count_if(a.status = 'pending-review') AS pending FROM {mapping} a JOIN (SELECT nmc_code, count(DISTINCT cpse_id) AS n FROM {mapping} GROUP BY nmc_code) s ON a.nmc_code = s.nmc_code GROUP BY a.cpse_id",
    "explain_attributes": "SELECT a_text, b_text, e.attribute, e.role, e.a_value, e.b_value, e.status FROM (SELECT a_text, b_text, explode(evidence) AS e FROM {matched}) x",
    "explain_pairs": f"SELECT a_text, b_text, outcome, dimensions, description_status, grade_status, standard_status, corrosion_status, risk_status, recomputed_risk, {_r('attribute_score')} AS attribute_score, {_r('dimension_score')} AS dimension_score, {_r('confidence')} AS confidence, reasoning, outcome_why FROM {{matched}}",
    "validation_decisions": f"SELECT ord, truth, predicted, baseline, rule_no, {_r('confidence')} AS confidence, safety_risk, needs_review, {_r('sim')} AS similarity FROM {{evaluated}}",
    "validation_metrics": _metrics(),
    "validation_confusion": _confusion(),
    "validation_summary": "SELECT count(*) AS total, " + ", ".join(f"count_if(truth = '{x}') AS {x.lower()}" for x in LABELS) + " FROM {evaluated}",
    "validation_safety": _safety(),
    "validation_drilldown": "SELECT ord, a_text, b_text, predicted, outcome, reasoning FROM {evaluated} WHERE truth = 'NOT_EQUIVALENT' AND predicted <> 'NOT_EQUIVALENT'",
}


def build(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Relations(spark, sf_dir).sql(BODIES[name])

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build(name) for name in BODIES}
