"""The part of the knowledge graph that is to be seen: filters on nodes and edges, reach from an organisation, search.

SQL over two relations: nodes (id, type, label, title, category, health, status) and edges (id, src, dst, rel). Ids begin with ``c:`` for
organisations, ``m:`` for materials and ``n:`` for codes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.functions.text import in_list, quoted
from matforge.runtime import materialise

RELATIONS = ("USED_BY", "MAPPED_TO", "DUPLICATE", "FUNCTIONALLY_EQUIVALENT", "SUBSTITUTE", "SUPERSEDES", "SUPERSEDED_BY")


def kept_nodes(nodes: str, organisation: str = "", category: str = "", status: str = "", code: str = "") -> str:
    """Ids of the nodes that pass: organisations by name, all others by category and status, codes by a part of their name."""
    rules = [f"category = {quoted(category)}"] * bool(category) + [f"status = {quoted(status)}"] * bool(status)
    rules += [f"(type = 'material' OR contains(lower(label), {quoted(code.strip().lower())}))"] * bool(code.strip())
    named = f"label = {quoted(organisation)}" if organisation else "true"
    return f"SELECT id FROM {nodes} WHERE CASE WHEN type = 'cpse' THEN {named} ELSE {' AND '.join(rules) or 'true'} END"


def visible_edges(nodes: str, edges: str, relations: Sequence[str] = RELATIONS, organisation: str = "", category: str = "", status: str = "", code: str = "") -> str:
    """The edges of the given relations between nodes that pass.

    With an organisation only those among itself, its materials, their codes, and the codes next to these in the whole graph.
    """
    kept = kept_nodes(nodes, organisation, category, status, code)
    shown = f"SELECT e.* FROM {edges} e LEFT SEMI JOIN ({kept}) a ON e.src = a.id LEFT SEMI JOIN ({kept}) b ON e.dst = b.id WHERE rel IN {in_list(relations)}"
    if not organisation:
        return shown
    centre = quoted(f"c:{organisation}")
    own = f"SELECT src AS id FROM ({shown}) s WHERE rel = 'USED_BY' AND dst = {centre}"
    codes = f"SELECT DISTINCT dst AS id FROM {edges} e LEFT SEMI JOIN ({own}) o ON e.src = o.id WHERE dst LIKE 'n:%'"
    beside = f"SELECT dst AS id FROM {edges} e LEFT SEMI JOIN ({codes}) c ON e.src = c.id WHERE dst LIKE 'n:%' UNION SELECT src FROM {edges} e LEFT SEMI JOIN ({codes}) c ON e.dst = c.id WHERE src LIKE 'n:%'"
    near = f"SELECT {centre} AS id UNION {own} UNION {codes} UNION {beside}"
    return f"SELECT e.* FROM ({shown}) e LEFT SEMI JOIN ({near}) a ON e.src = a.id LEFT SEMI JOIN ({near}) b ON e.dst = b.id"


def found_nodes(nodes: str, seen: str, text: str) -> str:
    """The nodes at the ends of the edges ``seen`` whose label or title holds a text; case does not matter, a blank text finds none."""
    wanted = quoted(text.strip().lower())
    hit = f"contains(lower(label), {wanted}) OR contains(lower(title), {wanted})" if text.strip() else "false"
    return f"SELECT n.* FROM {nodes} n LEFT SEMI JOIN (SELECT src AS id FROM ({seen}) s UNION SELECT dst FROM ({seen}) t) u ON n.id = u.id WHERE {hit}"


def within(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, hop): the nodes at most so many edges away from those of ``start`` (id), in either direction, with the fewest.

    One join per hop, of the nodes met last alone.
    """
    both = edges.select("src", "dst").unionByName(edges.selectExpr("dst AS src", "src AS dst"))
    met = materialise(start.select("id").distinct().withColumn("hop", F.lit(0)), "met")
    for hop in range(1, hops + 1):
        last = met.filter(F.col("hop") == hop - 1)
        new = both.join(last, both["src"] == last["id"]).select(F.col("dst").alias("id")).distinct().join(met, "id", "left_anti")
        met = materialise(met.unionByName(new.withColumn("hop", F.lit(hop))), "met")
    return met
