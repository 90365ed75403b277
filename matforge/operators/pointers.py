"""Following pointers to their ends: codes in force, superseded codes, and the cycles among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.runtime import materialise


def _doubled(now: DataFrame) -> DataFrame:
    """Each node's pointer followed by the pointer of the node it reaches; both sides are as long as the pointers, so they are merged, never broadcast."""
    ahead = now.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("open").alias("more"))
    far = F.when(F.col("open"), F.coalesce("next", "root")).otherwise(F.col("root"))
    return materialise(now.join(ahead.hint("merge"), "root", "left").select("node", far.alias("root"), (F.col("open") & F.coalesce("more", F.lit(False))).alias("open")), "pointers")


def _ended(known: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(node, root) of the nodes whose walk ends; and the other nodes with some node far ahead of each, and their number.

    The distance looked ahead doubles in each round. As long as any chain goes on, a round ends some of its nodes; so when a round
    ends none, the walks that are left go round for ever.
    """
    alive = known.alias("k").join(known.select(F.col("node").alias("n2")).hint("merge"), F.col("up") == F.col("n2"), "left")
    first = F.coalesce("n2", F.when(F.col("up").isNotNull(), F.col("up")), F.col("node"))
    now = materialise(alive.select("node", first.alias("root"), F.col("n2").isNotNull().alias("open")), "pointers")
    left = now.filter("open").count()
    while left:
        now = _doubled(now)
        before, left = left, now.filter("open").count()
        if left == before:
            break
    return now.filter("NOT open").select("node", "root"), now.filter("open"), left


def roots(pointers: DataFrame, node: str, up: str) -> DataFrame:
    """(node, root) for rows of (node, up); a NULL or unknown ``up`` ends a chain.

    A chain of n steps takes log2(n) + 1 shuffles. A walk that goes round gives the first node that it meets again: for a node
    of the cycle itself, for one of its tails the node at which the tail enters. Each node may have one row; an empty table gives none.
    """
    known = pointers.select(F.col(node).alias("node"), F.col(up).alias("up"))
    ended, going, left = _ended(known)
    if left:
        cycle = on_cycles(going)
        # a tail ends where it reaches the cycle
        tails = known.join(going.select("node"), "node", "left_semi").join(cycle, "node", "left_anti")
        entered, _, _ = _ended(tails)
        ended = ended.unionByName(cycle.selectExpr("node", "node AS root")).unionByName(entered)
    return ended.withColumnRenamed("node", node)


def on_cycles(going: DataFrame) -> DataFrame:
    """The nodes that lie on a cycle, of walks that never end (node, root, open).

    What lies 2^k steps ahead of any node are fewer and fewer nodes, until they are those of the cycles alone; from then on their number stays.
    """
    ahead = materialise(going.select(F.col("root").alias("node")).distinct(), "ahead")
    number = ahead.count()
    while True:
        going = _doubled(going)
        further = materialise(going.select(F.col("root").alias("node")).distinct(), "ahead")
        before, number = number, further.count()
        if number == before:
            return further


def cycle_names(pointers: DataFrame, node: str, up: str) -> DataFrame:
    """(node, cycle) of the nodes on cycles, a cycle named by its least node; log2(length) + 1 shuffles."""
    known = pointers.select(F.col(node).alias("node"), F.col(up).alias("up"))
    _, going, left = _ended(known)
    if not left:
        return known.select("node", F.col("node").alias("cycle")).limit(0).withColumnRenamed("node", node)
    now = materialise(known.join(on_cycles(going), "node", "left_semi").selectExpr("node", "up AS far", "least(node, up) AS cycle"), "cycles")
    while True:
        step = now.select(F.col("node").alias("far"), F.col("far").alias("further"), F.col("cycle").alias("theirs"))
        ahead = materialise(now.join(step, "far").select("node", F.col("further").alias("far"), F.least("cycle", "theirs").alias("cycle"), (F.col("theirs") < F.col("cycle")).alias("lower")), "cycles")
        now = ahead.drop("lower")
        if ahead.filter("lower").isEmpty():
            return now.select(F.col("node").alias(node), "cycle")
