"""Chat formatting as a prefix tree of tokens.

Conversations are sorted by their path of turn hashes, so those that share initial turns lie side by
side, and range partitions of that order can be cut anywhere, inside a tree too. A task walks its
rows depth-first and emits bounded segments of token ids: a segment holds each shared turn's tokens once, and for
each node its first token, its first position id (the number of its ancestors' tokens) and the segment intervals of its
ancestors' tokens, which are all it may attend to besides itself. A tree that crosses a segment's end repeats
the open path at the start of the next, so every segment can be trained on alone.

A turn reads ``[TURN role]body[/TURN]``. In roles and texts each of ``\\ [ ] < >`` gets a ``\\`` in front, so
no control string of this or another usual template survives in a body, and dropping one ``\\`` before
each escaped character gives the text back. Head, body and tail are tokenised apart, so the loss span, an assistant's
body, is whole tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.llm.tokens import fast

#: Tokens in a segment before it is closed at the next conversation's end.
SEGMENT_TOKENS = 1 << 16
#: Conversations in a segment at most, counted so that many copies of one conversation cannot swell it.
SEGMENT_CONVERSATIONS = 2048
LOSS_ROLE = "assistant"
ESCAPED = re.compile(r"[\\\[\]<>]")
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"\[TURN ((?:[^\\\[\]]|\\.)*)\]((?:[^\\\[\]]|\\.)*)\[/TURN\]", re.DOTALL)
SEGMENT_SCHEMA = (
    "segment long, ids array<int>, nodes array<struct<start:long,length:long,position:long,parent:int,loss_start:long,loss_length:long,attends:array<struct<start:long,end:long>>>>, "
    "members array<struct<conv_id:long,leaf:int>>"
)
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of the formatted turn."""
    return f"[TURN {escape(role)}]", escape(text), "[/TURN]"


def turn_ids(role: str, text: str) -> tuple[list[int], int, int]:
    """Token ids of the formatted turn, and where its body's begin and how many they are."""
    head, body, tail = (fast().encode_ordinary(x) for x in turn_parts(role, text))
    return head + body + tail, len(head), len(body)


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its id, its turns in order, and its path of turn hashes.

    A conversation is the unit of training and is held as one row. Turns that tie on the number go by role
    and text. Null roles and texts count as empty, null turn numbers come first. A row without a conv_id belongs to no
    other: it is a conversation of its own. An empty table gives no rows.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), lone, turn.alias("t"))
    grouped = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("lone")
    # eight hex digits a turn keep the sort key short; equal keys of unlike turns only lose sharing
    path = F.array_join(F.transform("turns", lambda t: F.substring(F.sha2(F.concat_ws("\n", t["role"], t["text"]).cast("binary"), 256), 1, 8)), "")
    return grouped.withColumn("path", path)


def build_segments(turns: DataFrame) -> DataFrame:
    """The emitted segments of all conversations (columns conv_id, turn, role, text of ``turns``).

    Rows are dealt by (path, conv_id), so neither a common first turn nor many copies of one
    conversation end in one task. An empty table gives no segment. Other columns are not read.
    """
    rows = conversations(turns).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = rows.select("conv_id", "turns", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        nodes: list[dict] = []
        members: list[dict] = []
        stack: list[tuple[tuple[str, str], int]] = []
        count = part = 0

        def close() -> pa.RecordBatch:
            nonlocal count
            row = {"segment": (part << 32) + count, "ids": list(ids), "nodes": list(nodes), "members": list(members)}
            for held in (ids, nodes, members, stack):
                held.clear()
            count += 1
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for conv, turns_, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [(t["role"], t["text"]) for t in turns_]
                shared = 0
                while shared < min(len(own), len(stack)) and own[shared] == stack[shared][0]:
                    shared += 1
                del stack[shared:]
                for role, text in own[shared:]:
                    whole, body_at, body = turn_ids(role, text)
                    size = len(ids)
                    parent = stack[-1][1] if stack else -1
                    up = nodes[parent] if stack else None
                    attends = []
                    if up:
                        attends = [dict(x) for x in up["attends"]]
                        if attends and attends[-1]["end"] == up["start"]:
                            attends[-1]["end"] = up["start"] + up["length"]
                        else:
                            attends.append({"start": up["start"], "end": up["start"] + up["length"]})
                    loss = role == LOSS_ROLE
                    nodes.append({"start": size, "length": len(whole), "position": up["position"] + up["length"] if up else 0, "parent": parent, "loss_start": size + body_at if loss else size, "loss_length": body if loss else 0, "attends": attends})
                    ids += whole
                    stack.append(((role, text), len(nodes) - 1))
                members.append({"conv_id": conv, "leaf": len(nodes) - 1 if len(own) > shared else stack[-1][1] if stack else -1})
                if len(ids) >= SEGMENT_TOKENS or len(members) >= SEGMENT_CONVERSATIONS:
                    yield close()
        if members:
            yield close()

    return rows.mapInArrow(run, SEGMENT_SCHEMA)


_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ARROW = pa.schema(
    [
        ("segment", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("nodes", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("loss_start", pa.int64()), ("loss_length", pa.int64()), ("attends", pa.list_(_INTERVAL))]))),
        ("members", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())]))),
    ]
)


def read_back(segments: DataFrame) -> DataFrame:
    """Each conversation as a model would see it, read from the segments' token ids alone.

    The visible tokens of a leaf are its ancestors' intervals and its own; turns are parsed from their text and
    unescaped; the loss text is what the loss spans of the nodes on the path spell. Null and empty texts read back as
    empty ones; a row without a conv_id gives a row with a null one; copies of a conversation give a row each; no
    segment gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = fast().decode
        for batch in batches:
            for segment in batch.to_pylist():
                ids, nodes = segment["ids"], segment["nodes"]
                seen: dict[int, tuple] = {}
                out = []
                for member in segment["members"]:
                    leaf = member["leaf"]
                    if leaf not in seen:
                        node, path, at = nodes[leaf], [], leaf
                        while at >= 0:
                            path.append(nodes[at])
                            at = nodes[at]["parent"]
                        visible = spell([t for i in node["attends"] for t in ids[i["start"] : i["end"]]] + ids[node["start"] : node["start"] + node["length"]])
                        turns = [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(visible)]
                        loss = unescape(spell([t for n in reversed(path) for t in ids[n["loss_start"] : n["loss_start"] + n["loss_length"]]]))
                        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                        seen[leaf] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(visible))
                    out.append((member["conv_id"], *seen[leaf]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return segments.select("ids", "nodes", "members").mapInArrow(run, READ_SCHEMA)
