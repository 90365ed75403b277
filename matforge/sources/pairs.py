"""Labelled pairs from grids: (pair_id, left_text, right_text, truth) and the rows that cannot be used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.functions import text as T
from matforge.functions.dialect import SPARK

#: Classes of a pair, and other names of the last.
TRUTHS = ("DUPLICATE", "FUNCTIONALLY_EQUIVALENT", "SIMILAR", "NOT_EQUIVALENT")
NOT_EQUIVALENT = ("DISTINCT", "NON_EQUIVALENT", "NOT_EQUIVALENT")
#: Header names of the three columns.
HEADERS = {"a": "material *_?a|^a$|first", "b": "material *_?b|^b$|second", "truth": "truth|label"}


def labelled_rows(grids: DataFrame) -> DataFrame:
    """(file, line, left_text, right_text, truth, error): one row per non-blank data row of each file.

    Without a header that names the truth, the first three columns are taken. ``error`` is NULL for usable rows.
    A header that lacks one of the three columns gives one row, with that error. ``line`` counts non-blank rows from 1.
    """
    cell = lambda x: f"coalesce({T.trimmed(SPARK, x)}, '')"
    filled = grids.filter(f"exists(cells, c -> {cell('c')} <> '')")
    rows = filled.withColumn("line", F.expr("row_number() OVER (PARTITION BY file ORDER BY row_idx)"))
    first = rows.filter("line = 1").selectExpr("file", f"transform(cells, c -> lower({cell('c')})) AS head")
    at = lambda key: f"CAST(array_position(transform(head, h -> h RLIKE {T.quoted(HEADERS[key])}), true) - 1 AS INT)"
    named = first.selectExpr("file", f"{at('truth')} >= 0 AS named", *(f"{at(k)} AS at_{k}" for k in HEADERS))
    places = named.selectExpr("file", "named", "named AND least(at_a, at_b, at_truth) < 0 AS broken", *(f"IF(named, at_{k}, {i}) AS at_{k}" for i, k in enumerate(HEADERS)))
    part = lambda k: f"IF(at_{k} < 0, '', {cell(f'get(cells, at_{k})')})"
    cut = rows.join(places, "file").filter("NOT named OR line > 1 OR broken").filter("NOT broken OR line = 1")
    cut = cut.selectExpr("file", "line", "broken", f"{part('a')} AS left_text", f"{part('b')} AS right_text", f"{part('truth')} AS told")
    word = f"regexp_replace(upper(told), '[-{T.SPACE}]+', '_')"
    cut = cut.withColumn("truth", F.expr(f"CASE WHEN {word} IN {T.in_list(NOT_EQUIVALENT)} THEN 'NOT_EQUIVALENT' WHEN {word} IN {T.in_list(TRUTHS)} THEN {word} END"))
    error = f"CASE WHEN broken THEN 'Header must name material A, material B and the ground truth' WHEN left_text = '' OR right_text = '' THEN 'both material descriptions are required' WHEN truth IS NULL THEN 'unknown ground truth ' || told || ' (use {', '.join(TRUTHS)})' END AS error"
    return cut.selectExpr("file", "line", "left_text", "right_text", "truth", error)


def pairs(rows: DataFrame) -> DataFrame:
    """The usable pairs of ``labelled_rows``, numbered P1, P2, ... in each file."""
    return rows.filter("error IS NULL").selectExpr("file", "'P' || row_number() OVER (PARTITION BY file ORDER BY line) AS pair_id", "left_text", "right_text", "truth")


def errors(rows: DataFrame) -> DataFrame:
    return rows.filter("error IS NOT NULL").select("file", "line", "error")
