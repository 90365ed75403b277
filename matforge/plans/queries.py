"""The registered queries of the harmonisation operators, each with an oracle in SQL.

A query is one SELECT over named relations, written once for both engines; ``NEEDS`` says which relations
Spark prepares as tables first and what the oracle puts in its WITH clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matforge.functions import text as T
from matforge.functions.dialect import DUCK, SPARK, Dialect
from matforge.operators import dictionary as D
from matforge.operators.decide import decisions
from matforge.operators.extract import ATTRIBUTES
from matforge.plans import derived, files, oracles
from matforge.plans import views as V

Body = Callable[[Dialect], str]

def _r(x: str) -> str:
    return f"round({x}, 6)"


def tokenize_content(d: Dialect) -> str:
    return f"SELECT ord, u AS clean, {d.join('toks', ' ')} AS tokens, {d.join('ctoks', ' ')} AS content, token_key FROM m"


def tokenize_documents(d: Dialect) -> str:
    toks = T.tokens(d, T.preprocess(d, "coalesce(text, '')"))
    return f"SELECT doc_id, {d.size('toks')} AS n_tokens, {d.size(T.content(d, 'toks'))} AS n_content, {d.size(d.distinct('toks'))} AS n_distinct FROM (SELECT doc_id, {toks} AS toks FROM documents) t"


def short_hash(d: Dialect) -> str:
    return f"SELECT ord, {T.short_hash(d, 'raw_description')} AS hash FROM materials"


def parse_number(d: Dialect) -> str:
    forms = "CASE ord % 6 WHEN 0 THEN '₹ ' || t || '.50' WHEN 1 THEN '(' || t || ')' WHEN 2 THEN 'Rs. ' || t WHEN 3 THEN t || ' NOS' WHEN 4 THEN '1,' || t || ',000' ELSE ' -' || t || ' ' END"
    return f"SELECT ord, spelt, {T.parse_number(d, 'spelt')} AS amount FROM (SELECT ord, {forms} AS spelt FROM (SELECT ord, CAST(ord % 1000 AS VARCHAR(9)) AS t FROM materials) a) b"


def normalize_uom(d: Dialect) -> str:
    return f"SELECT unit, count(*) AS n FROM (SELECT {T.normalize_uom(d, 'uom')} AS unit FROM materials) u GROUP BY unit"


def subtype_detect(d: Dialect) -> str:
    return "SELECT ord, subtype, category, cat_code FROM m"


def attributes(d: Dialect) -> str:
    return "SELECT ord, " + ", ".join(f"a_{a}" for a in ATTRIBUTES) + " FROM m"


def corrosion_class(d: Dialect) -> str:
    return "SELECT ord, a_grade, a_finish, a_standard, corrosion FROM m"


def strength_rank(d: Dialect) -> str:
    rank = "CASE a_propClass " + " ".join(f"WHEN 'PC{p}' THEN {k}" for k, p in enumerate(D.PROPERTY_CLASSES)) + " ELSE CASE WHEN a_propClass IS NOT NULL THEN -1 END END"
    return f"SELECT ord, a_propClass, CAST({rank} AS INT) AS strength_rank FROM m"


def nmc_code(d: Dialect) -> str:
    return "SELECT ord, nmc_code, complete, dim_key, block, canonical FROM m"


def block_stats(d: Dialect) -> str:
    return "SELECT block, count(*) AS materials, count(DISTINCT nmc_code) AS codes, count(DISTINCT dim_key) AS dim_keys, count(CASE WHEN NOT complete THEN 1 END) AS incomplete, min(ord) AS first_ord FROM m GROUP BY block"


def dimension_groups(d: Dialect) -> str:
    return "SELECT block, dim_key, count(DISTINCT nmc_code) AS codes, count(*) AS materials FROM m WHERE complete GROUP BY block, dim_key HAVING count(DISTINCT nmc_code) > 1"


def exact_duplicates(d: Dialect) -> str:
    if not d.spark:
        return "SELECT * FROM (SELECT ord, nmc_code, min(ord) OVER (PARTITION BY block, nmc_code) AS rep_ord, count(*) OVER (PARTITION BY block, nmc_code) AS n_same FROM m WHERE complete) e WHERE ord <> rep_ord"
    return "SELECT m.ord, m.nmc_code, g.rep_ord, g.n_same FROM m JOIN (SELECT block, nmc_code, min(ord) AS rep_ord, count(*) AS n_same FROM m WHERE complete GROUP BY block, nmc_code) g ON m.block = g.block AND m.nmc_code = g.nmc_code WHERE m.complete AND m.ord <> g.rep_ord"


def mapping_order(d: Dialect) -> str:
    """A row's place in its block; counted within stretches of rows first, so that a block is no single task."""
    if not d.spark:
        return "SELECT ord, block, min(ord) OVER (PARTITION BY block) AS block_ord, row_number() OVER (PARTITION BY block ORDER BY ord) AS place FROM m"
    stretches = "SELECT block, ord div 65536 AS stretch, count(*) AS n, min(ord) AS low FROM m GROUP BY 1, 2"
    before = f"SELECT block, stretch, coalesce(sum(n) OVER (PARTITION BY block ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(low) OVER (PARTITION BY block) AS block_ord FROM ({stretches}) s"
    return f"SELECT ord, m.block, block_ord, before + row_number() OVER (PARTITION BY m.block, stretch ORDER BY ord) AS place FROM m JOIN ({before}) b ON m.block = b.block AND m.ord div 65536 = b.stretch"


def cross_org_index(d: Dialect) -> str:
    """For each code an organisation publishes, the others that have it; organisations publish in order of name."""
    pub = "SELECT DISTINCT nmc_code, cpse_id FROM m WHERE complete"
    return f"SELECT x.nmc_code, x.cpse_id, {d.collect('y.cpse_id')} AS others, {d.collect('CASE WHEN y.cpse_id < x.cpse_id THEN y.cpse_id END')} AS seen_at_publish FROM ({pub}) x JOIN ({pub}) y ON x.nmc_code = y.nmc_code AND x.cpse_id <> y.cpse_id GROUP BY x.nmc_code, x.cpse_id"


def cross_org_supply(d: Dialect) -> str:
    pub = "SELECT l_partkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, s_nationkey"
    return f"SELECT l_partkey, count(*) AS n_nations, min(s_nationkey) AS first_nation, max(s_nationkey) AS last_nation FROM ({pub}) p GROUP BY l_partkey HAVING count(*) > 1"


def _payload() -> str:
    return "'{\"seq\":' || CAST(event_id AS VARCHAR(20)) || ',\"action\":\"' || event_type || '\",\"details\":' || props || ',\"prevHash\":\"'"


def audit_chain_verify(d: Dialect) -> str:
    """Entries hashed over their neighbour's payload; every 1000th entry's hash is damaged and must be found."""
    entry = f"SELECT event_id, {_payload()} AS payload, lag({_payload()}) OVER (PARTITION BY floor(event_id / 4096) ORDER BY event_id) AS before FROM events"
    want = d.sha256(f"payload || {d.sha256('coalesce(before, ' + T.quoted('GENESIS') + ')')}")
    return f"SELECT event_id, hash = {want} AS valid, substr(hash, 1, 12) AS digest FROM (SELECT *, CASE WHEN event_id % 1000 = 999 THEN {d.sha256('payload')} ELSE {want} END AS hash FROM ({entry}) e) h"


def confusion_matrix(d: Dialect) -> str:
    """Predictions of the shout-and-length rule against the quality labels, with empty cells."""
    cells = "(SELECT 0 AS q UNION ALL SELECT 1) t CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1) u"
    pred = "SELECT l.quality AS q, CASE WHEN length(coalesce(d.text, '')) >= 200 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
    return f"SELECT t.q AS truth, u.p AS predicted, coalesce(c.n, 0) AS n FROM {cells} LEFT JOIN (SELECT q, p, count(*) AS n FROM ({pred}) r GROUP BY q, p) c ON c.q = t.q AND c.p = u.p"


def _scenario(d: Dialect) -> str:
    label = "CASE verdict WHEN 'duplicate' THEN 'DUPLICATE' WHEN 'functionally_equivalent' THEN 'FUNCTIONALLY_EQUIVALENT' WHEN 'similar' THEN 'SIMILAR' ELSE 'NOT_EQUIVALENT' END"
    return f"SELECT pair_id, truth, {label} AS predicted, rule_no, confidence, safety_risk, needs_review, sim FROM ({decisions(d, 'scenario').replace('SELECT a, b,', 'SELECT pair_id, truth, a, b,', 1)}) s"


def scenario_decisions(d: Dialect) -> str:
    return f"SELECT pair_id, truth, predicted, rule_no, {_r('confidence')} AS confidence, safety_risk, needs_review, {_r('sim')} AS similarity FROM ({_scenario(d)}) x"


def zero_shot_classify(d: Dialect) -> str:
    """Nearest label prototype (the first vector of each label) by dot product, if above 0.45."""
    dot = "aggregate(zip_with(v.embedding, p.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (acc, z) -> acc + z)" if d.spark else "list_dot_product(v.embedding::DOUBLE[], p.embedding::DOUBLE[])"
    return f"SELECT vec_id, CASE WHEN score > 0.45 THEN proto END AS predicted, {_r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, proto) AS k FROM (SELECT v.vec_id, p.label AS proto, round({dot}, 9) AS score FROM embeddings v CROSS JOIN (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) q WHERE r = 1) p) s) t WHERE k = 1"


#: Query -> relations it reads besides base tables: materials, m (coded), scenario.
CATALOGUE: dict[str, tuple[Body, tuple[str, ...]]] = {}
for _needs, _bodies in {
    ("materials",): (short_hash, parse_number, normalize_uom),
    ("m",): (tokenize_content, subtype_detect, attributes, corrosion_class, strength_rank, nmc_code, block_stats, dimension_groups, exact_duplicates, mapping_order, cross_org_index),
    ("scenario",): (scenario_decisions,),
    (): (tokenize_documents, cross_org_supply, audit_chain_verify, confusion_matrix, zero_shot_classify),
}.items():
    CATALOGUE |= {b.__name__: (b, _needs) for b in _bodies}
#: The labelled pairs are a fixed small input: their query is a test, not a registered one.
FIXED_INPUT = ("scenario_decisions",)
TABLES = ("supplier", "part", "lineitem", "events", "documents", "embeddings", "labels")


def build(name: str) -> Callable[[SparkSession, str], DataFrame]:
    body, needs = CATALOGUE[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        select = body(SPARK)
        ctes = [(t, f"SELECT * FROM {V.named(spark.read.parquet(f'{sf_dir}/{t}.parquet'))}") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", select)]
        made = {"materials": V.materials, "m": V.coded_materials, "scenario": lambda spark, _: V.scenario(spark)}
        ctes += [(n, f"SELECT * FROM {V.named(made[n](spark, sf_dir))}") for n in needs]
        return V.run(spark, ctes, select)

    return query


def oracle(name: str) -> str:
    body, needs = CATALOGUE[name]
    ctes = V.duck_scenario() if "scenario" in needs else V.duck_coded() if "m" in needs else V.duck_coded()[:1] if "materials" in needs else []
    return V.with_clause(ctes) + body(DUCK)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build(name) for name in CATALOGUE if name not in FIXED_INPUT} | derived.queries() | files.queries()


def oracle_sql() -> dict[str, str]:
    return {name: oracle(name) for name in CATALOGUE if name not in FIXED_INPUT} | oracles.oracle_sql() | files.oracle_sql()
