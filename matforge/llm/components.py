"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.runtime import materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges connect: (node, least node) for every node but the least."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract_locally(edges: DataFrame) -> DataFrame:
    """Each task replaces its edges (a, b) by a spanning set of stars: never more rows, often far fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a = np.concatenate((a, batch.column("a").to_numpy()))
            b = np.concatenate((b, batch.column("b").to_numpy()))
            if len(a) > 1 << 20:
                done = forest(a, b)
                if len(done[0]) * 2 > len(a):  # little gained: pass on what is held
                    yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1])], ["a", "b"])
                    done = (np.empty(0, np.int64), np.empty(0, np.int64))
                a, b = done
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Each round every node hooks to its least neighbour, the hooks are followed to their roots, and the
    edges are rewritten to roots; loops and repeats go. At least half of the nodes that still have an edge go per
    round. Tables are written between rounds; joins are plain shuffles of two written tables, so a hub's
    rows can be split by adaptive execution. Loops and repeated edges change nothing; nulls are not allowed; no edge gives
    no rows.
    """
    edges = materialise(contract_locally(edges.select("a", "b").filter("a <> b")), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        hooks = materialise(hooks, "hooks")
        while True:  # follow hooks to their roots, doubling the distance each time
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = materialise(hooks.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "jumped")
            hooks = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        maps.append(hooks)
        to_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
        edges = materialise(contract_locally(moved.distinct()), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("root").alias("component"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), F.col("root").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
