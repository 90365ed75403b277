"""A whole run: item lists in a folder to mapping, records, audit entries and figures."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from matforge.functions.dialect import SPARK
from matforge.operators import audit, match, vectors
from matforge.operators.decide import BEST_OF, filled, lexical
from matforge.operators.extract import coded
from matforge.operators.pointers import roots
from matforge.plans import views as V
from matforge.runtime import materialise
from matforge.sources import grids, items, state

SUPERSESSIONS = "old_code string, new_code string"
#: What an issued code's entry says of it.
ISSUED = "to_json(named_struct('materialId', CAST(ord AS STRING), 'cpseId', cpse_id, 'ownCode', own_code, 'nmcCode', nmc_code, 'verdict', verdict, 'confidence', round(confidence, 3), 'stage', stage, 'safetyRisk', safety_risk, 'reasons', {reasons}), map('ignoreNullFields', 'false'))"


@dataclass
class Run:
    """What a run gives; tables are written ones."""

    mapping: DataFrame
    records: DataFrame
    log: audit.AuditLog
    figures: dict = field(default_factory=dict)


def _reclassified(rows: DataFrame, embed: vectors.Embed, cache: str) -> tuple[DataFrame, int]:
    """Coded rows with those of unknown subtype coded again by the nearest phrase, and how many these are."""
    unknown = rows.filter("subtype = 'UNK'").select("raw_description").distinct()
    guessed = materialise(vectors.nearest_subtype(unknown, embed, cache).filter("forced IS NOT NULL").selectExpr("text AS raw_description", "forced"), "guessed")
    again = materialise(rows.sparkSession.sql(lexical(SPARK, f"({coded(SPARK, V.named(guessed), forced='forced')})")), "recoded")
    own = [c for c in rows.columns if c not in again.columns or c == "raw_description"]
    found = rows.select(*own).join(again, "raw_description").select(*rows.columns)
    return rows.join(guessed.select("raw_description"), "raw_description", "left_anti").select(*rows.columns).unionByName(found), found.count()


def in_mapping_order(mapping: DataFrame) -> DataFrame:
    """The mapping with block_ord, the place of its block's first row; (block_ord, ord) is the order in which a run reports."""
    first = mapping.groupBy("block").agg(F.min("ord").alias("block_ord"))
    return mapping.join(first, "block")


def run(spark: SparkSession, folder: str, home: str, embed: vectors.Embed | None = None, at: str | None = None, organisations: DataFrame | None = None) -> Run:
    """Read all item lists below ``folder``, code and match their rows, and log each issued code.

    ``home`` keeps what outlives a run: the audit log, the registered supersessions and the cache of vectors. With a model ``embed`` unknown
    items get the subtype of the nearest phrase, and texts are compared by their vectors. ``at`` is the entries' time, by default now. Rows
    without a description are counted and left out; if no row is left ``ParseError`` is raised. If the log cannot be written, the
    run goes on and says so in its figures.
    """
    began = time.time()
    read = materialise(grids.read_grids(spark, folder), "grids")
    kept = Observation()
    seen = items.item_rows(read, organisations).observe(kept, F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"))
    rows = materialise(seen.filter("kept").drop("kept"), "items")
    if not kept.get["kept"]:
        raise grids.ParseError("no valid material rows: every row was empty or had no description")
    made = V.code_materials(rows)
    reclassified = 0
    if embed:
        made, reclassified = _reclassified(materialise(made, "coded"), embed, f"{home}/vectors")
    known = Observation()
    made = materialise(made.observe(known, F.count(F.lit(1)).alias("materials"), F.count_if(F.col("subtype") == "UNK").alias("uncategorised")), "coded")
    parsed, told = time.time(), None
    if embed:
        told = vectors.embed_counted(match.planned_texts(made), embed, f"{home}/vectors")
    closed = match.map_materials(made, vectors=materialise(told.vectors, "vectors") if told else None)
    registered = materialise(state.read_or_empty(spark, f"{home}/supersessions", SUPERSESSIONS), "supersessions")
    codes = closed.select("nmc_code").distinct()
    chain = registered.select(F.col("old_code").alias("nmc_code"), "new_code")
    pointers = codes.join(chain, "nmc_code", "left").unionByName(chain.join(codes, "nmc_code", "left_anti"))
    ends = roots(pointers, "nmc_code", "new_code")
    stages = Observation()
    counted = in_mapping_order(closed).observe(stages, *(F.count_if(F.col("stage") == s).alias(s) for s in ("rule", "lexical", "embedding")))
    mapping = materialise(counted.join(ends, "nmc_code", "left").withColumn("current_code", F.expr("CASE WHEN root <> nmc_code THEN root END")).drop("root"), "mapping")
    first = mapping.groupBy("nmc_code").agg(F.min_by(F.struct("canonical", "category", "subtype", "complete"), "ord").alias("f"), F.count(F.lit(1)).alias("n_materials"))
    records = materialise(first.join(chain, "nmc_code", "left").selectExpr("nmc_code", "f.*", "n_materials", "new_code AS superseded_by"), "records")
    matched, log, written, failure = time.time(), audit.AuditLog(spark, f"{home}/log"), 0, None
    reasons = f"CASE WHEN n_comparable > 1 THEN array(first_reason, {filled(BEST_OF, {'n': 'CAST(n_comparable AS STRING)'})}) ELSE array(first_reason) END"
    entries = mapping.select("block_ord", "ord", F.lit(at or datetime.now(UTC).isoformat()).alias("timestamp"), F.expr("'code_issued_' || verdict").alias("action"), F.expr(ISSUED.format(reasons=reasons)).alias("details"))
    try:
        before = log.head()["entries"]
        log.append(entries, ["block_ord", "ord"])
        written = log.head()["entries"] - before
    except Exception as error:  # a run without its log is told, not lost
        failure = f"{type(error).__name__}: {error}"[:500]
    figures = {
        **kept.get, **known.get, "reclassified": reclassified, **{f"{k}_decisions": v for k, v in stages.get.items()},
        "comparisons": spark.sql(match.comparisons(V.named(made))).first()["comparisons"],
        "embeddings_computed": told.computed if told else 0, "cache_hits": told.hits if told else 0,
        "embedder_status": "not-needed" if told is None else "unavailable" if told.failed and not told.computed + told.hits else "ready",
        "audit_entries": written, "audit_error": failure, "parse_seconds": parsed - began, "match_seconds": matched - parsed,
    }
    return Run(mapping, records, log, figures)
