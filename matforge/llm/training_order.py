"""Token ids on disk in training order.

All documents, in the order of their ids, are one stream of token ids, each document closed by the special
id 50256; sequence k is the k-th stretch of that stream. A keyed Feistel permutation of the sequence numbers
gives each its slot. So what lies in a slot depends on the documents, the key and the length alone, not on
how the input is split into files or partitions. Range partitions of the slots write binary shards with
one fixed stride: slot s lies in shard ``s div shard_slots`` at byte ``(s mod shard_slots) * stride``, and a
reader can stop and resume at any slot.

Record: sequence number, id of the document that the first token belongs to, that token's place in it
(int64 each), number of ids (int32), padding ids (int32), then the ids (uint16), zero-padded to the
sequence length; all little-endian. Only the last sequence is padded.

Ids are computed once and kept in compressed frames of many documents. Only a row of numbers per document is
sorted to find where it begins in the stream; then a task takes some frames, cuts them into pieces of
sequences, and sends all pieces for one range of slots as one compressed row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm.feistel import permute_array, permute_local
from matforge.llm.numbering import running_totals
from matforge.llm.tokens import fast
from matforge.llm.words import chunks, stretches
from matforge.runtime import materialise, scratch_path

#: The special token that closes a document; ordinary text never encodes to it.
CLOSE = 50256
SEQUENCE = 512
SHARD_SLOTS = 4096
#: Stands for a null document id in a record.
NO_ID = -(1 << 63)
#: A frame is closed once it holds this many documents or ids.
FRAME_DOCS, FRAME_IDS = 4096, 1 << 20
#: Ids that a task holds before it sends their pieces on; frames' ids that a task gets on average.
HELD_IDS, TASK_IDS = 1 << 24, 1 << 25
#: Shards in a range of slots; ranges' tasks at most (a task writes several ranges, one after the other).
RANGE_SHARDS, MOST_TASKS = 8, 20_000
LEVEL = 6
PIECE = np.dtype([("number", "<i8"), ("doc", "<i8"), ("begin", "<i8"), ("offset", "<i4"), ("count", "<i4")])
MANIFEST_SCHEMA = "shard long, first_slot long, slots long, bytes long, crc32 long"
RECORDS_SCHEMA = "slot long, shard long, byte_offset long, number long, doc_id long, start long, length int, closed long, ids array<int>"


@dataclass(frozen=True)
class Layout:
    """What a reader needs: where the shards are and how to compute a place."""

    path: str
    sequences: int
    key: str
    length: int = SEQUENCE
    shard_slots: int = SHARD_SLOTS

    @property
    def record(self) -> np.dtype:
        return np.dtype([("number", "<i8"), ("doc", "<i8"), ("begin", "<i8"), ("count", "<i4"), ("padding", "<i4"), ("ids", "<u2", (self.length,))])

    @property
    def stride(self) -> int:
        return self.record.itemsize

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.shard_slots)

    def place(self, number: int) -> tuple[str, int]:
        """Shard file and byte offset of the sequence with a given number."""
        slot = permute_local(number, self.sequences, self.key)
        return shard_name(slot // self.shard_slots), slot % self.shard_slots * self.stride


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, on the driver or an executor."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def write_frames(df: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Tokenise and write frames of ids below ``path``; doc_id, digest, tokens, file, at, bytes, place of each document.

    A task writes one file under a name of its own, so a task that runs again leaves its first file unused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(path)
        encode, packer = fast().encode_ordinary, zstandard.ZstdCompressor(level=LEVEL)
        name = f"{TaskContext.get().partitionId()}-{os.urandom(8).hex()}"
        docs: list[tuple] = []
        ids: list[np.ndarray] = []
        held = at = 0
        with where.open_output_stream(f"{base}/{name}") as out:

            def flush() -> pa.RecordBatch:
                nonlocal held, at
                frame = packer.compress(np.concatenate(ids).tobytes())
                out.write(frame)
                columns = [pa.array(c, pa.int64()) for c in zip(*docs, strict=True)]
                same = [pa.array([name] * len(docs)), *(pa.array(np.full(len(docs), x)) for x in (at, len(frame)))]
                at, held = at + len(frame), 0
                row = pa.RecordBatch.from_arrays([*columns, *same, pa.array(np.arange(len(docs), dtype=np.int32))], ["doc_id", "digest", "tokens", "file", "at", "bytes", "place"])
                docs.clear()
                ids.clear()
                return row

            for part in chunks(batches, "text"):
                for doc, digest, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "digest", "text")), strict=True):
                    own = np.array([*encode(text or ""), CLOSE], dtype="<u2")
                    docs.append((doc, digest, len(own)))
                    ids.append(own)
                    held += len(own)
                    if len(docs) >= FRAME_DOCS or held >= FRAME_IDS:
                        yield flush()
            if docs:
                yield flush()

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, tokens long, file string, at long, bytes long, place int")


def deal_pieces(frames: DataFrame, path: str, layout: Layout) -> DataFrame:
    """(range, pieces): the frames' ids cut at sequence ends, packed by the range of slots they belong to."""
    range_slots = layout.shard_slots * RANGE_SHARDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(path)
        packer, unpacker = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        heads: list[np.ndarray] = []
        places: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            head, place, flat = (np.concatenate(x) for x in (heads, places, ids))
            for kept in (heads, places, ids):
                kept.clear()
            held = 0
            own = permute_array(head["number"], layout.sequences, layout.key) // range_slots
            order = np.lexsort((head["offset"], head["number"], own))
            rows = []
            for group in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                body = flat[stretches(place[group], head["count"][group])]
                rows.append(packer.compress(len(group).to_bytes(8, "little") + head[group].tobytes() + body.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(np.unique(own)), pa.array(rows, pa.binary())], ["range", "pieces"])

        for batch in batches:
            for name, at, size, docs in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "bytes", "docs")), strict=True):
                with where.open_input_file(f"{base}/{name}") as source:
                    source.seek(at)
                    flat = np.frombuffer(unpacker.decompress(source.read(size)), dtype="<u2")
                starts, tokens = (np.array([d[k] for d in docs], dtype=np.int64) for k in ("start", "tokens"))
                doc = np.array([NO_ID if d["doc_id"] is None else d["doc_id"] for d in docs], dtype=np.int64)
                first = starts // layout.length
                many = (starts + tokens - 1) // layout.length - first + 1
                k = np.repeat(np.arange(len(docs)), many)
                head = np.empty(len(k), dtype=PIECE)
                head["number"] = stretches(first, many)
                begin = np.maximum(head["number"] * layout.length, starts[k])
                head["doc"], head["begin"], head["offset"] = doc[k], begin - starts[k], begin - head["number"] * layout.length
                head["count"] = np.minimum((head["number"] + 1) * layout.length, (starts + tokens)[k]) - begin
                heads.append(head)
                places.append(held + (np.cumsum(tokens) - tokens)[k] + head["begin"])
                ids.append(flat)
                held += len(flat)
                if held >= HELD_IDS:
                    yield flush()
        if held:
            yield flush()

    return frames.mapInArrow(run, "range long, pieces binary")


def write_shards(pieces: DataFrame, layout: Layout) -> DataFrame:
    """Write the shards of each range (rows come sorted by range); one manifest row per shard.

    A shard is written under a temporary name and renamed, so a task that is run again leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(layout.path)
        unpacker = zstandard.ZstdDecompressor()
        held: list[bytes] = []
        now = None

        def flush() -> pa.RecordBatch:
            heads, ids = [], []
            for row in held:
                raw = unpacker.decompress(row)
                n = int.from_bytes(raw[:8], "little")
                heads.append(np.frombuffer(raw, dtype=PIECE, count=n, offset=8))
                ids.append(np.frombuffer(raw, dtype="<u2", offset=8 + n * PIECE.itemsize))
            held.clear()
            head, flat = np.concatenate(heads), np.concatenate(ids)
            place = np.cumsum(head["count"]) - head["count"]
            slot = permute_array(head["number"], layout.sequences, layout.key)
            order = np.argsort(slot * layout.length + head["offset"])
            head, place, slot = head[order], place[order], slot[order]
            done = []
            for shard in range(int(slot[0]) // layout.shard_slots, int(slot[-1]) // layout.shard_slots + 1):
                a, b = np.searchsorted(slot, (shard * layout.shard_slots, (shard + 1) * layout.shard_slots))
                own, at = head[a:b], slot[a:b] - shard * layout.shard_slots
                records = np.zeros(int(at[-1]) + 1, dtype=layout.record)
                body = np.zeros(len(records) * layout.length, dtype="<u2")
                body[stretches(at * layout.length + own["offset"], own["count"])] = flat[stretches(place[a:b], own["count"])]
                records["ids"] = body.reshape(len(records), -1)
                records["count"] = np.bincount(at, weights=own["count"])
                records["padding"] = layout.length - records["count"]
                first = own["offset"] == 0
                for name in ("number", "doc", "begin"):
                    records[name] = own[name][first]
                raw = records.tobytes()
                temporary = f"{base}/_temporary/{shard_name(shard)}.{os.urandom(8).hex()}"
                with where.open_output_stream(temporary) as out:
                    out.write(raw)
                where.move(temporary, f"{base}/{shard_name(shard)}")
                done.append((shard, shard * layout.shard_slots, len(records), len(raw), zlib.crc32(raw)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], ["shard", "first_slot", "slots", "bytes", "crc32"])

        for batch in batches:
            for own, row in zip(batch.column("range").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                if held and own != now:
                    yield flush()
                now = own
                held.append(row)
        if held:
            yield flush()

    return pieces.mapInArrow(run, MANIFEST_SCHEMA)


def write_training_order(df: DataFrame, path: str, key: str = "order-v1", length: int = SEQUENCE, shard_slots: int = SHARD_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Layout, DataFrame]:
    """Write all documents' sequences below ``path``; the layout and a manifest of the shards.

    Every id of every document and its closing id are in one record. The stream's order is (id, hash of the
    text), null ids first. Null texts hold the closing id alone; null ids are stored as ``NO_ID``; repeated
    rows are separate documents; an empty table writes nothing. Other columns are not read.
    """
    spark = df.sparkSession
    ids_path = scratch_path(spark, "token-frames")
    scratch, frames_root = filesystem(ids_path)
    scratch.create_dir(frames_root, recursive=True)
    docs = materialise(write_frames(df, ids_path, id_col, text_col), "documents")
    started, total = running_totals(docs, ["doc_id", "digest", "tokens"], "tokens", "start")
    layout = Layout(path, -(-total // length), key, length, shard_slots)
    if not total:
        return layout, spark.createDataFrame([], MANIFEST_SCHEMA)
    tasks = min(max(spark.sparkContext.defaultParallelism, -(-total // TASK_IDS)), MOST_TASKS)
    frames = started.repartition(tasks, "file", "at").groupBy("file", "at", "bytes")
    frames = frames.agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "start", "tokens"))).alias("docs"))
    ranges = -(-layout.shards // RANGE_SHARDS)
    parts = min(ranges, MOST_TASKS)
    pieces = deal_pieces(frames, ids_path, layout)
    part = F.expr(f"CAST(range * {parts} div {ranges} AS INT)")
    target, root = filesystem(path)
    target.create_dir(f"{root}/_temporary", recursive=True)
    ordered = pieces.repartitionById(parts, part).sortWithinPartitions("range")
    manifest = materialise(write_shards(ordered, layout), "manifest")
    target.delete_dir(f"{root}/_temporary")  # with what failed attempts have left there
    scratch.delete_dir(frames_root)
    return layout, manifest


def read_training_order(spark: SparkSession, layout: Layout, first_slot: int = 0) -> DataFrame:
    """The records in their slots, from ``first_slot`` on (to resume): slot, shard, byte_offset, number, doc_id, start, length, closed, ids.

    ``closed`` is the number of documents that end in the record. Shards are dealt by number; a task streams its shards. A slot at or beyond the end gives no rows.
    """
    first_shard = first_slot // layout.shard_slots
    if layout.shards <= first_shard:
        return spark.createDataFrame([], RECORDS_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(layout.path)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                own = max(0, first_slot - shard * layout.shard_slots)
                with where.open_input_file(f"{base}/{shard_name(shard)}") as source:
                    source.seek(own * layout.stride)
                    while raw := source.read(layout.stride * 512):
                        records = np.frombuffer(raw, dtype=layout.record)
                        at = np.arange(own, own + len(records))
                        count = records["count"].astype(np.int64)
                        flat = records["ids"].reshape(-1)[stretches(np.arange(len(records)) * layout.length, count)].astype(np.int32)
                        ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(at + shard * layout.shard_slots),
                                pa.array(np.full(len(at), shard)),
                                pa.array(at * layout.stride),
                                pa.array(records["number"].astype(np.int64)),
                                pa.array(records["doc"].astype(np.int64), mask=records["doc"] == NO_ID),
                                pa.array(records["begin"].astype(np.int64)),
                                pa.array(count.astype(np.int32)),
                                pa.array(np.count_nonzero((records["ids"] == CLOSE) & (np.arange(layout.length) < count[:, None]), axis=1)),
                                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                            ],
                            ["slot", "shard", "byte_offset", "number", "doc_id", "start", "length", "closed", "ids"],
                        )
                        own += len(records)

    tasks = min(layout.shards - first_shard, max(spark.sparkContext.defaultParallelism, -(-(layout.shards - first_shard) // RANGE_SHARDS)), MOST_TASKS)
    return spark.range(first_shard, layout.shards, 1, tasks).mapInArrow(read, RECORDS_SCHEMA)
