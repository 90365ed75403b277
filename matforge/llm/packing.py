"""Packing documents into fixed-length sequences by first-fit decreasing.

Documents are dealt into random groups of bounded size. Each group is packed on its own: full
sequences are cut off first, then the remainders are placed, longest first, into the first bin
with room, found by a tournament tree over the bins' free capacities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.llm.tokens import token_ids
from matforge.llm.words import chunks
from matforge.runtime import materialise

LENGTH = 1024
#: Mean number of documents in a group; a group's task holds a few numbers per document.
GROUP_DOCS = 1500
#: Groups that a task packs one after the other, on average, and tasks at most.
TASK_GROUPS, MOST_TASKS = 256, 20_000
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item (sizes falling, none above ``capacity``), first fit.

    ``tree`` is a tournament: leaves are the bins' free room, each inner node the larger child.
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [capacity] * (2 * width)
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k], offsets[k] = node - width, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def pack_group(group: int, doc_ids: list, tokens: list[int], crcs: list[list[int]], length: int) -> dict[str, list]:
    """Pieces of one group's documents. Sequence ids are the group number and a count."""
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

    def add(k: int, at: int, size: int, bin_: int, offset: int) -> None:
        for name, value in zip(out, (doc_ids[k], at, size, crcs[k][at // length], tokens[k], (group << 32) + bin_, offset), strict=True):
            out[name].append(value)

    rest = np.array([n % length for n in tokens], dtype=np.int64)
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    bins, offsets = first_fit(rest[order], length)
    for k, b, o in zip(order.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        add(k, tokens[k] - int(rest[k]), int(rest[k]), b, o)
    used = int(bins.max()) + 1 if len(bins) else 0
    for k, n in enumerate(tokens):
        for at in range(0, n - n % length, length):
            add(k, at, length, used, 0)
            used += 1
    return out


def tasks_for(groups: int, parallelism: int) -> int:
    """Tasks for a number of groups: as many as can run at once, more for many groups, never more than ``MOST_TASKS``."""
    return max(1, min(groups, MOST_TASKS, max(parallelism, -(-groups // TASK_GROUPS))))


def tokenised(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """doc_id, token count and the checksum of each stretch of ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            ids = [token_ids(t) for t in part.column("text").to_pylist()]
            crcs = [[zlib.crc32(x[at : at + length].astype("<u4").tobytes()) for at in range(0, len(x), length)] for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "tokens", "crcs"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tokens long, crcs array<long>")


def pack(df: DataFrame, length: int = LENGTH, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, its closing id included, lies in exactly one piece. A document
    longer than ``length`` fills whole sequences and leaves one remainder. Only counts and checksums
    are shuffled. Null texts are empty: one closing id. Null ids stay null; repeated rows are
    packed as documents of their own; an empty table gives no pieces.
    """
    counts = materialise(tokenised(df, id_col, text_col, length).withColumn("place", F.monotonically_increasing_id()), "tokens")
    groups = max(1, -(-counts.count() // group_docs))
    dealt = counts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "place"), F.lit(groups)).cast("int"))
    tasks = tasks_for(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionById(tasks, F.col("grp") % tasks).sortWithinPartitions("grp", "doc_id", "tokens", "crcs", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            out = pack_group(rows["grp"][0].as_py(), *(rows[c].to_pylist() for c in ("doc_id", "tokens", "crcs")), length)
            held.clear()
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch.column("grp").to_numpy())) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and b > a and held[-1].column("grp")[0] != batch.column("grp")[int(a)]:
                    yield flush()
                if b > a:
                    held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield flush()

    return dealt.select("grp", "doc_id", "tokens", "crcs").mapInArrow(run, PIECES_SCHEMA)
