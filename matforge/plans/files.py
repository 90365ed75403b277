"""Registered queries that write files or logs and read them back, with oracles over the tables they come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matforge.functions.dialect import DUCK, SPARK
from matforge.operators import audit, vectors
from matforge.plans import oracles, run
from matforge.plans import views as V
from matforge.runtime import materialise, scratch_path
from matforge.sources import documents, grids, items, pairs
from matforge.streaming import published

#: Rows of an item list; a file stays far below the size that the reader takes.
LIST_ROWS = 20_000
#: Header styles of the item lists, by organisation in turn.
STYLES = (
    "Organization,Material Code,Material Description,UOM,Qty,Unit Price",
    "CPSE,MATNR,MAKTX,MEINS,Stock Qty,Rate",
    "Company,Item Code,Item Name,Unit,Quantity,Price",
)


def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each organisation's materials as item lists, read back with header and role inference."""
    m = V.named(V.materials(spark, sf_dir))
    d = SPARK
    cells = documents.line([*(documents.text_cell(d, c) for c in ("cpse_id", "own_code", "raw_description", "uom")), *(documents.number_cell(d, c) for c in ("quantity", "unit_price"))])
    style = " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(STYLES))
    rows = spark.sql(f"SELECT cpse_id || '-' || (ord div {LIST_ROWS}) || '.csv' AS document, CASE ascii(cpse_id) % {len(STYLES)} {style} END AS header, ord AS place, {cells} AS line FROM {m}")
    path = scratch_path(spark, "item-lists")
    documents.write_documents(rows, path)
    read = materialise(grids.read_grids(spark, path), "grids")
    return items.items(read).select("cpse_id", "own_code", "raw_description", "uom", "quantity", "unit_price")


def whole_run(spark: SparkSession, sf_dir: str) -> run.Run:
    """A run over the materials as item lists, in order of place over as many files as they need; every fiftieth row is followed by an empty one."""
    m = V.named(V.materials(spark, sf_dir))
    d = SPARK
    cells = documents.line([*(documents.text_cell(d, c) for c in ("cpse_id", "own_code", "raw_description", "uom")), *(documents.number_cell(d, c) for c in ("quantity", "unit_price"))])
    told = f"SELECT ord, 2 * ord AS place, {cells} AS line FROM {m} UNION ALL SELECT ord, 2 * ord + 1, 'ONGC,E-' || ord || ',,EA,1,1' FROM {m} WHERE ord % 50 = 0"
    rows = spark.sql(f"SELECT 'list-' || lpad(CAST(ord div {LIST_ROWS} AS STRING), 9, '0') || '.csv' AS document, '{STYLES[0]}' AS header, place, line FROM ({told}) t")
    path = scratch_path(spark, "run")
    documents.write_documents(rows, f"{path}/lists")
    return run.run(spark, f"{path}/lists", f"{path}/home", at="2024-01-01T00:00:00.000Z")


def run_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = V.named(whole_run(spark, sf_dir).mapping)
    return spark.sql(f"SELECT x.own_code, x.nmc_code, y.own_code AS matched_own_code, x.verdict, round(x.confidence, 6) AS confidence, x.stage, x.safety_risk, x.status, x.reason FROM {done} x LEFT JOIN {done} y ON x.matched_ord = y.ord")


def run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = whole_run(spark, sf_dir).figures
    names = ("materials", "skipped", "uncategorised", "reclassified", "comparisons", "rule_decisions", "lexical_decisions", "embedding_decisions", "audit_entries")
    return spark.createDataFrame([(*(f[n] for n in names), f["embedder_status"])], ", ".join(f"{n} long" for n in names) + ", embedder_status string")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's entries in order, with what they name."""
    entries = whole_run(spark, sf_dir).log.entries()
    return entries.selectExpr("seq", "action", "get_json_object(details, '$.ownCode') AS own_code", "get_json_object(details, '$.nmcCode') AS nmc_code")


ITEM_FILES_SQL = V.with_clause([("materials", V.MATERIALS.format(part="part"))]) + "SELECT cpse_id, own_code, trim(raw_description) AS raw_description, uom, quantity, unit_price FROM materials"

#: What a pair's row says of it, some of it unusable.
_TOLD = "CASE ord % 6 WHEN 0 THEN 'Duplicate' WHEN 1 THEN 'functionally equivalent' WHEN 2 THEN 'distinct' WHEN 3 THEN 'SIMILAR' WHEN 4 THEN 'maybe' ELSE 'non-equivalent' END"


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring materials as rows of labelled-pair grids, one grid per organisation; usable and unusable rows."""
    m = V.named(V.materials(spark, sf_dir))
    other = "IF(ord % 11 = 0, '', lead(raw_description, 1, '') OVER (PARTITION BY cpse_id ORDER BY ord))"
    rows = spark.sql(f"SELECT cpse_id AS file, row_number() OVER (PARTITION BY cpse_id ORDER BY ord) - 1 AS row_idx, array(raw_description, {other}, {_TOLD}) AS cells FROM {m}")
    return pairs.labelled_rows(rows)


LABELLED_PAIRS_SQL = V.with_clause([("materials", V.MATERIALS.format(part="part"))]) + f"""
SELECT file, line, left_text, right_text, truth,
  CASE WHEN left_text = '' OR right_text = '' THEN 'both material descriptions are required' WHEN truth IS NULL THEN 'unknown ground truth maybe (use DUPLICATE, FUNCTIONALLY_EQUIVALENT, SIMILAR, NOT_EQUIVALENT)' END AS error
FROM (SELECT cpse_id AS file, row_number() OVER (PARTITION BY cpse_id ORDER BY ord) AS line, trim(raw_description) AS left_text,
    CASE WHEN ord % 11 = 0 THEN '' ELSE trim(lead(raw_description, 1, '') OVER (PARTITION BY cpse_id ORDER BY ord)) END AS right_text,
    CASE {_TOLD} WHEN 'Duplicate' THEN 'DUPLICATE' WHEN 'functionally equivalent' THEN 'FUNCTIONALLY_EQUIVALENT' WHEN 'SIMILAR' THEN 'SIMILAR' WHEN 'maybe' THEN NULL ELSE 'NOT_EQUIVALENT' END AS truth
  FROM materials) t"""


def log_of_events(spark: SparkSession, sf_dir: str) -> audit.AuditLog:
    """The events as an audit log, appended in three batches of which none fills its last segment."""
    events = V.named(spark.read.parquet(f"{sf_dir}/events.parquet"))
    log = audit.AuditLog(spark, scratch_path(spark, "audit-log"))
    told = f"SELECT event_id, CAST(user_id AS STRING) AS timestamp, event_type AS action, concat('{{\"value\":', CAST(CAST(value * 100 AS INT) AS STRING), ',\"props\":', props, ',\"by\":\"', user_id, '\"}}') AS details FROM {events} WHERE "
    for batch in ("event_id < 700", "event_id >= 700 AND event_id < 1111", "event_id >= 1111"):
        log.append(spark.sql(told + batch), ["event_id"])
    return log


def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a log that grew by batches: one gapless sequence."""
    return log_of_events(spark, sf_dir).entries().select("seq", "action", "prev_hash", "hash")


_PAYLOAD = """'{"seq":' || seq || ',"timestamp":"' || timestamp || '","action":"' || action || '","details":{"by":"' || timestamp || '","props":' || replace(props, ' ', '') || ',"value":' || amount || '},"prevHash":"'"""
_LOG = f"""entries AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, CAST(user_id AS VARCHAR) AS timestamp, event_type AS action, props, CAST(trunc(value * 100) AS INT) AS amount FROM events),
said AS (SELECT seq, action, {_PAYLOAD} AS start FROM entries),
chain(seq, action, prev_hash, hash) AS (
  SELECT seq, action, '{audit.GENESIS}', sha256(start || '{audit.GENESIS}"}}') FROM said WHERE seq % {audit.SEGMENT} = 0
  UNION ALL SELECT e.seq, e.action, c.hash, sha256(e.start || c.hash || '"}}') FROM chain c JOIN said e ON e.seq = c.seq + 1 WHERE e.seq % {audit.SEGMENT} <> 0
)"""
AUDIT_APPEND_SQL = f"WITH RECURSIVE {_LOG} SELECT seq, action, prev_hash, hash FROM chain"


def audit_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over the full segments of that log."""
    return log_of_events(spark, sf_dir).anchors()


AUDIT_ANCHORS_SQL = f"""
WITH RECURSIVE {_LOG}, ends AS (SELECT seq // {audit.SEGMENT} AS segment, hash AS last_hash FROM chain WHERE seq % {audit.SEGMENT} = {audit.SEGMENT - 1}),
linked(segment, last_hash, anchor) AS (
  SELECT segment, last_hash, sha256('{audit.GENESIS}:0:' || last_hash) FROM ends WHERE segment = 0
  UNION ALL SELECT e.segment, e.last_hash, sha256(l.anchor || ':' || e.segment || ':' || e.last_hash) FROM linked l JOIN ends e ON e.segment = l.segment + 1
)
SELECT segment, last_hash, anchor FROM linked"""


def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults found in the events' log after some entries' details and others' hashes were changed, and an anchor."""
    log = log_of_events(spark, sf_dir)
    changed = log.entries().selectExpr("seq", "timestamp", "action", "IF(seq % 1000 = 999, '{}', details) AS details", "signers", "prev_hash", "IF(seq % 1000 = 511, reverse(hash), hash) AS hash")
    kept = log.anchors().selectExpr("segment", "last_hash", "IF(segment % 5 = 3, reverse(anchor), anchor) AS anchor")
    return audit.verify(changed, kept, log.head())


#: One problem per entry: a changed hash is seen at its entry, at the next one, and at its segment's end; a changed anchor at its own segment and the next.
AUDIT_VERIFY_SQL = f"""
WITH RECURSIVE {_LOG}, top AS (SELECT max(seq) AS top FROM chain),
broken AS (SELECT segment FROM (SELECT seq // {audit.SEGMENT} AS segment FROM chain WHERE seq % {audit.SEGMENT} = {audit.SEGMENT - 1}) s WHERE segment % 5 = 3 OR (segment > 0 AND (segment - 1) % 5 = 3) OR (segment * {audit.SEGMENT} + {audit.SEGMENT - 1}) % 1000 = 511),
found AS (
  SELECT seq, 2 AS rank, 'hash' AS problem FROM chain WHERE seq % 1000 IN (511, 999)
  UNION ALL SELECT seq, 1, 'link' FROM chain WHERE (seq - 1) % 1000 = 511 AND seq % {audit.SEGMENT} <> 0
  UNION ALL SELECT segment * {audit.SEGMENT} + {audit.SEGMENT - 1}, 4, 'anchor' FROM broken
  UNION ALL SELECT top, 5, 'head' FROM top WHERE top % 1000 = 511 OR ((top + 1) // {audit.SEGMENT} - 1) % 5 = 3
)
SELECT seq, arg_min(problem, rank) AS problem FROM found GROUP BY seq"""


def publish_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every organisation publishes its codes, some twice, and asks who else has them."""
    coded = materialise(V.coded_materials(spark, sf_dir).filter("complete").select("ord", "nmc_code", "cpse_id"), "codes")
    path = scratch_path(spark, "published")
    for turn in ("ord % 2 = 0", "ord % 3 = 0", "ord % 2 = 1"):
        published.publish(spark, coded.filter(turn), path)
    return published.lookup(coded.select("nmc_code", "cpse_id").distinct(), published.index(spark, path))


def zero_shot_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown materials with the subtype whose phrase is nearest to their description, and the code that follows."""
    coded = materialise(V.coded_materials(spark, sf_dir).select("ord", "raw_description", "subtype"), "subtypes")
    again = vectors.reclassify(coded, vectors.trigram_vectors, scratch_path(spark, "vectors"))
    return coded.filter("subtype = 'UNK'").select("ord", "raw_description").join(again, "raw_description").selectExpr("ord", "raw_description", "classified_by", "round(ai_score, 6) AS ai_score", "subtype", "nmc_code", "complete")


def _publish_lookup_sql() -> str:
    pub = "pub AS (SELECT DISTINCT nmc_code, cpse_id FROM m WHERE complete)"
    return V.with_clause(V.duck_coded()) + ", " + pub + " SELECT x.nmc_code, x.cpse_id, " + DUCK.collect("y.cpse_id") + " AS others FROM pub x LEFT JOIN pub y ON x.nmc_code = y.nmc_code AND x.cpse_id <> y.cpse_id GROUP BY x.nmc_code, x.cpse_id"


def _run_sql() -> dict[str, str]:
    """The run's results from the oracles' mapping: lists change neither rows nor their order."""
    rest = oracles.oracle("run_stats")
    relations = oracles.oracle("mapping").rsplit("SELECT * FROM (", 1)[0]
    return {
        "run_mapping": relations + "SELECT x.own_code, x.nmc_code, y.own_code AS matched_own_code, x.verdict, round(x.confidence, 6) AS confidence, x.stage, x.safety_risk, x.status, x.reason FROM mapping x LEFT JOIN mapping y ON x.matched_ord = y.ord",
        "run_figures": f"SELECT materials, (SELECT count(*) FROM part WHERE p_partkey % 50 = 0) AS skipped, uncategorised, CAST(0 AS BIGINT) AS reclassified, comparisons, rule_decisions, lexical_decisions, CAST(0 AS BIGINT) AS embedding_decisions, materials AS audit_entries, 'not-needed' AS embedder_status FROM ({rest}) f",
        "run_log": relations + "SELECT row_number() OVER (ORDER BY b.first, p.ord) - 1 AS seq, 'code_issued_' || verdict AS action, p.own_code, p.nmc_code FROM mapping p JOIN seats s ON p.ord = s.ord JOIN (SELECT block, min(ord) AS first FROM seats GROUP BY block) b ON s.block = b.block",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (item_files, labelled_pairs, audit_append, audit_anchors, audit_verify, publish_lookup, zero_shot_reclassify, run_mapping, run_figures, run_log)}


def oracle_sql() -> dict[str, str]:
    return {"item_files": ITEM_FILES_SQL, "labelled_pairs": LABELLED_PAIRS_SQL, "audit_append": AUDIT_APPEND_SQL, "audit_anchors": AUDIT_ANCHORS_SQL, "audit_verify": AUDIT_VERIFY_SQL, "publish_lookup": _publish_lookup_sql()} | _run_sql()
