"""An audit log as hash chains that many writers append to and that is verified in parallel.

An entry's payload is canonical JSON: seq, timestamp, action, details with sorted keys, and the hash of the entry before.
The log is cut into segments of ``SEGMENT`` sequence numbers; a segment's first entry holds GENESIS. The last hashes of full
segments are chained in turn: an anchor is the hash of the anchor before and its segment's last hash. So any change, loss or
reordering is found, while hashing needs one bounded group per segment, and one short row per segment for the anchors.

:class:`AuditLog` keeps a log as a folder: a batch's entries are written first and count once its commit file is there, which only one
writer can make. A writer that finds the next commit taken hashes its batch again behind it.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.operators.numbering import placed
from matforge.sources import state

SEGMENT = 256
GENESIS = "GENESIS"
FIELDS = ("timestamp", "action", "details")
#: Signatures of an entry: who signed, with which public key, and the signature over the entry's payload.
SIGNERS = "array<struct<id: string, pub: string, sig: string>>"
ANCHORS = "segment long, last_hash string, anchor string"
#: Whether signatures hold: (public keys, payloads, signatures) of a batch -> one truth value each.
Verifier = Callable[[list[str], list[str], list[str]], list[bool]]
#: Problems in order of precedence for one entry.
KINDS = ("link", "hash", "signature", "anchor", "head")


def canonical(details: str) -> str:
    """SQL: a JSON text with its objects' keys sorted (by code points, at every level); a null is {}, other text a one-element list."""
    return f"CASE WHEN {details} IS NULL THEN '{{}}' ELSE coalesce(to_json(try_parse_json({details})), to_json(array({details}))) END"


def payload(seq: str, told: str, details: str, before: str) -> str:
    """SQL: what is hashed and signed; ``told`` is timestamp and action as JSON members, ``details`` canonical."""
    return f"'{{\"seq\":' || CAST({seq} AS STRING) || ',' || {told} || ',\"details\":' || {details} || ',\"prevHash\":\"' || {before} || '\"}}'"


def told(timestamp: str, action: str) -> str:
    """SQL: timestamp and action as JSON members, nulls empty."""
    return f"trim(BOTH '{{}}' FROM to_json(named_struct('timestamp', coalesce({timestamp}, ''), 'action', coalesce({action}, ''))))"


def append(entries: DataFrame, after: int = 0, last: str = GENESIS) -> DataFrame:
    """Chain rows of (seq, timestamp, action, details and any others), ``seq`` gapless from ``after``.

    ``last`` is the hash of entry ``after`` - 1, which an open segment goes on from. Null parts count as empty. Adds prev_hash and hash. An
    empty batch gives no rows.
    """
    kept = [c for c in entries.columns if c != "seq"]
    rows = entries.withColumns({"__details": F.expr(canonical("details")), "__told": F.expr(told("timestamp", "action"))})
    rows = rows.groupBy(F.expr(f"seq div {SEGMENT}").alias("segment")).agg(F.array_sort(F.collect_list(F.struct("seq", *kept, "__details", "__told")), lambda a, b: (a["seq"] - b["seq"]).cast("int")).alias("rows"))
    start = f"IF(segment = {after // SEGMENT} AND {after % SEGMENT} > 0, '{last}', '{GENESIS}')"
    kind = "ARRAY<STRUCT<prev_hash: STRING, hash: STRING>>"
    step = f"transform(array(sha2({payload('x.seq', 'x.__told', 'x.__details', 'acc.last')}, 256)), h -> struct(h AS last, concat(acc.made, array(struct(acc.last AS prev_hash, h AS hash))) AS made))[0]"
    folded = rows.selectExpr("rows", f"aggregate(rows, struct({start} AS last, CAST(array() AS {kind}) AS made), (acc, x) -> {step}, acc -> acc.made) AS made")
    return folded.selectExpr("inline(arrays_zip(rows, made))").selectExpr("rows.seq", *(f"rows.{c}" for c in kept), "made.prev_hash", "made.hash")


def link_anchor(before: str, segment: int, last_hash: str) -> str:
    return hashlib.sha256(f"{before}:{segment}:{last_hash}".encode()).hexdigest()


def anchors(log: DataFrame, before: str = GENESIS) -> DataFrame:
    """(segment, last_hash, anchor) of the full segments that end in ``log``, chained behind the anchor ``before``.

    A short row per segment, streamed through one task in order.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = before
        for batch in batches:
            made = []
            for segment, last in zip(batch.column("segment").to_pylist(), batch.column("last_hash").to_pylist()):
                now = link_anchor(now, segment, last)
                made.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["segment", "last_hash", "anchor"])

    ends = log.filter(F.expr(f"seq % {SEGMENT} = {SEGMENT - 1}")).selectExpr(f"seq div {SEGMENT} AS segment", "hash AS last_hash")
    return ends.coalesce(1).sortWithinPartitions("segment").mapInArrow(chain, ANCHORS)


def signatures(log: DataFrame, verifier: Verifier | None = None) -> DataFrame:
    """(seq, id, sig_status) of each signature: ``valid`` or ``forged``, ``unverified`` without a verifier, ``unsigned`` where it is blank."""
    said = payload("seq", told("timestamp", "action"), canonical("details"), "prev_hash")
    rows = log.selectExpr("seq", f"{said} AS payload", "explode(signers) AS s").selectExpr("seq", "s.id", "s.pub", "s.sig", "payload")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pub, sig, text = (batch.column(c).to_pylist() for c in ("pub", "sig", "payload"))
            signed = [k for k, s in enumerate(sig) if s]
            status = ["unsigned"] * len(sig)
            held = verifier([pub[k] for k in signed], [text[k] for k in signed], [sig[k] for k in signed]) if verifier and signed else [None] * len(signed)
            for k, ok in zip(signed, held, strict=True):
                status[k] = "unverified" if ok is None else "valid" if ok else "forged"
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("id"), pa.array(status, pa.string())], ["seq", "id", "sig_status"])

    return rows.mapInArrow(check, "seq long, id string, sig_status string")


def verify(log: DataFrame, kept: DataFrame, head: dict | None = None, verifier: Verifier | None = None) -> DataFrame:
    """(seq, problem) of all faulty entries, one problem each, the first of :data:`KINDS`.

    ``link``: the hash before is another one; ``hash``: the entry was changed; ``signature``: one is forged; ``anchor``: a full segment's end is not
    what was kept, or an anchor does not follow from the one before; ``head``: the log does not end as ``head`` (entries, last, anchor)
    says. An intact log gives no rows; :func:`first_failure` says where the chain breaks first.
    """
    before = f"coalesce(lag(hash) OVER (PARTITION BY seq div {SEGMENT} ORDER BY seq), '{GENESIS}')"
    seen = log.selectExpr("seq", "hash", "prev_hash", f"{before} AS expected", f"sha2({payload('seq', told('timestamp', 'action'), canonical('details'), 'coalesce(prev_hash, ' + chr(39) * 2 + ')')}, 256) AS again")
    found = seen.selectExpr("seq", "CASE WHEN NOT prev_hash <=> expected THEN 'link' WHEN NOT hash <=> again THEN 'hash' END AS problem").filter("problem IS NOT NULL")
    if "signers" in log.columns:
        found = found.unionByName(signatures(log, verifier).filter("sig_status = 'forged'").selectExpr("seq", "'signature' AS problem"))
    ends = log.filter(F.expr(f"seq % {SEGMENT} = {SEGMENT - 1}")).selectExpr(f"seq div {SEGMENT} AS segment", "hash AS tail")
    chain = kept.join(kept.selectExpr("segment + 1 AS segment", "anchor AS earlier"), "segment", "left").join(ends, "segment", "full")
    follows = f"anchor <=> sha2(concat(coalesce(earlier, '{GENESIS}'), ':', CAST(segment AS STRING), ':', last_hash), 256)"
    found = found.unionByName(chain.filter(f"NOT (tail <=> last_hash AND {follows})").selectExpr(f"segment * {SEGMENT} + {SEGMENT - 1} AS seq", "'anchor' AS problem"))
    if head is not None:
        tail, top = log.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"), F.count(F.lit(1)).alias("n")), kept.agg(F.max_by("anchor", "segment").alias("anchor"))
        sound = f"n = {int(head['entries'])} AND coalesce(hash, '{GENESIS}') = '{head['last']}' AND coalesce(anchor, '{GENESIS}') = '{head['anchor']}'"
        found = found.unionByName(tail.crossJoin(top).filter(f"NOT ({sound})").selectExpr(f"greatest({int(head['entries'])} - 1, coalesce(seq, 0)) AS seq", "'head' AS problem"))  # one row each
    rank = "CASE problem " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    return found.groupBy("seq").agg(F.min_by("problem", F.expr(rank)).alias("problem"))


def first_failure(problems: DataFrame) -> DataFrame:
    """One row, the problem that a reader meets first, or none."""
    return problems.orderBy("seq").limit(1)


def digest(log: DataFrame) -> DataFrame:
    """One row: the first twelve digits of the last hash, or GENESIS for an empty log."""
    return log.agg(F.expr(f"coalesce(substr(max_by(hash, seq), 1, 12), '{GENESIS}') AS digest"))


class AuditLog:
    """A log in a folder that all executors share. Writers of one process queue up and share a commit; those of several race for it."""

    _turns: dict[str, tuple[threading.Lock, threading.Lock, list]] = {}
    _guard = threading.Lock()

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        with self._guard:
            self.turn, self.gate, self.queue = self._turns.setdefault(self.path, (threading.Lock(), threading.Lock(), []))
        files, _ = state._path(spark, self.path)
        for part in ("commits", "entries", "anchors"):
            files.mkdirs(state._path(spark, f"{self.path}/{part}")[1])

    def head(self) -> dict:
        """Number of commits and entries, the last entry's hash and the last anchor."""
        commits = state.names(self.spark, f"{self.path}/commits")
        if not commits:
            return {"commits": 0, "entries": 0, "last": GENESIS, "anchor": GENESIS}
        return json.loads(state.read_text(self.spark, f"{self.path}/commits/{commits[-1]}"))

    def _parts(self) -> list[str]:
        commits = self.spark.read.schema("part string").json(f"{self.path}/commits") if self.head()["commits"] else None
        return [r["part"] for r in commits.collect()] if commits is not None else []  # a name per commit

    def entries(self) -> DataFrame:
        parts = self._parts()
        schema = f"seq long, timestamp string, action string, details string, signers {SIGNERS}, prev_hash string, hash string"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/entries/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def anchors(self) -> DataFrame:
        parts = self._parts()
        return self.spark.read.schema(ANCHORS).parquet(*(f"{self.path}/anchors/{p}" for p in parts)) if parts else self.spark.createDataFrame([], ANCHORS)

    def append(self, batch: DataFrame, order: list[str]) -> None:
        """Add the rows of (timestamp, action, details, signers if any) in the given order, all or none of them."""
        plain = batch if "signers" in batch.columns else batch.withColumn("signers", F.lit(None).cast(SIGNERS))
        ticket = {"rows": plain.select(F.struct(*order).alias("order"), "timestamp", "action", "details", "signers"), "done": False, "error": None}
        with self.gate:
            self.queue.append(ticket)
        with self.turn:
            if not ticket["done"]:
                with self.gate:
                    waiting, self.queue[:] = list(self.queue), []
                try:
                    self._commit(waiting)
                except Exception as error:  # every writer whose rows were in the commit is told
                    for t in waiting:
                        t["error"] = error
                for t in waiting:
                    t["done"] = True
        if ticket["error"]:
            raise ticket["error"]

    def _commit(self, waiting: list[dict]) -> None:
        shapes: dict[str, list[DataFrame]] = {}
        for k, ticket in enumerate(waiting):
            shapes.setdefault(ticket["rows"].schema["order"].dataType.simpleString(), []).append(ticket["rows"].withColumn("turn", F.lit(k)))
        for same in shapes.values():  # batches ordered by other columns make a commit of their own
            rows = same[0]
            for more in same[1:]:
                rows = rows.unionByName(more)
            numbered = placed(rows, ["turn", "order"]).drop("turn", "order")
            if numbered.isEmpty():
                continue
            while not self._write(numbered):
                pass

    def _write(self, numbered: DataFrame) -> bool:
        head, part = self.head(), uuid.uuid4().hex
        folder = f"{self.path}/entries/{part}"
        append(numbered.withColumn("seq", F.col("place") + head["entries"]).drop("place"), head["entries"], head["last"]).write.parquet(folder)
        made = self.spark.read.parquet(folder)
        anchors(made, head["anchor"]).write.parquet(f"{self.path}/anchors/{part}")
        total, last = made.agg(F.count(F.lit(1)), F.max_by("hash", "seq")).first()
        anchor = self.spark.read.schema(ANCHORS).parquet(f"{self.path}/anchors/{part}").agg(F.max_by("anchor", "segment")).first()[0] or head["anchor"]
        commit = {"commits": head["commits"] + 1, "entries": head["entries"] + total, "last": last, "anchor": anchor, "part": part}
        return state.write_text(self.spark, f"{self.path}/commits/{head['commits']:020d}", json.dumps(commit), overwrite=False)

    def verify(self, verifier: Verifier | None = None) -> DataFrame:
        return verify(self.entries(), self.anchors(), self.head(), verifier)


def references(log: str, codes: str) -> str:
    """SQL: (code, entries) of the known codes that entries' details name, as a value or in a list of values, once per entry.

    ``log`` has entry and details (a JSON object), ``codes`` the column nmc_code.
    """
    values = "flatten(transform(map_values(from_json(details, 'MAP<STRING, STRING>')), v -> CASE WHEN v LIKE '[%' THEN coalesce(from_json(v, 'ARRAY<STRING>'), array(v)) ELSE array(v) END))"
    named = f"SELECT entry, explode(array_distinct({values})) AS code FROM {log}"
    # most values are no codes: only those that are reach the comparison of entries
    return f"SELECT code, count(*) AS entries FROM (SELECT DISTINCT entry, code FROM ({named}) n LEFT SEMI JOIN {codes} c ON n.code = c.nmc_code) k GROUP BY code"
