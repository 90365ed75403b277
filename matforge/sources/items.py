"""Item lists from grids: is there a header, which column plays which role, and the rows as materials.

Inference works on the first rows of each column, found by a windowed top-k that Spark limits before its
shuffle; a file's at most six scores a column are resolved by a fold over one small array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.functions import text as T
from matforge.functions.dialect import SPARK
from matforge.sources.grids import ParseError

#: Header names of each role; a header fits if it contains one of them.
ALIASES = {
    "ownCode": ("matnr", "material code", "material number", "code", "item code", "sap code", "material_code", "part no", "part number"),
    "description": ("maktx", "description", "material description", "desc", "item description", "material_desc", "item name"),
    "uom": ("meins", "uom", "unit", "unit of measure", "base uom"),
    "cpseId": ("cpse", "organisation", "organization", "plant name", "psu", "company", "source cpse", "vendor org"),
    "quantity": ("qty", "quantity", "stock qty", "order qty"),
    "unitPrice": ("unit price", "rate", "unit rate", "price"),
}
#: Least score with which a column takes a role.
LEAST = {"ownCode": 0.3, "description": 0.25, "uom": 0.4, "cpseId": 0.3, "quantity": 0.55, "unitPrice": 0.55}
#: Units that mark a column of units.
COMMON_UNITS = ("NOS", "NO", "EA", "EACH", "KG", "MTR", "M", "LTR", "L", "SET", "PCS", "PC", "BOX", "ROLL", "PAIR", "LOT", "TON", "MT", "SQM", "KL", "DRUM", "BAG")
#: Organisations, in the order in which staged files get them by default.
ORGANISATIONS = ("ONGC", "IOCL", "SAIL", "BHEL", "CPCL", "BPCL", "NTPC", "HPCL", "GAIL", "OIL", "MRPL", "NMDC", "COAL INDIA", "NALCO")
SAMPLE = 25


def _trim(x: str) -> str:
    return T.trimmed(SPARK, x)


def with_headers(grids: DataFrame) -> DataFrame:
    """One row per file: file, header (names, NULL where row 0 is data), n_cols.

    Row 0 is data if row 1 has as many cells of the same kinds (blank, with a digit, other), one with a digit.
    """
    kinds = f"array_join(transform(cells, c -> CASE WHEN {_trim('c')} = '' THEN 'E' WHEN c RLIKE '[0-9]' THEN 'N' ELSE 'T' END), '')"
    two = grids.filter("row_idx < 2").selectExpr("file", "row_idx", "cells", f"{kinds} AS kinds")
    pair = two.groupBy("file").agg(F.max(F.when(F.col("row_idx") == 0, F.struct("kinds", "cells"))).alias("a"), F.max(F.when(F.col("row_idx") == 1, F.col("kinds"))).alias("b"))
    return pair.selectExpr("file", "CASE WHEN a.kinds = b AND contains(a.kinds, 'N') THEN NULL ELSE a.cells END AS header", "size(a.cells) AS n_cols")


def data_rows(grids: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows below the headers, numbered from 1 in each file."""
    kept = grids.join(heads, "file").filter("row_idx > 0 OR header IS NULL")
    return kept.withColumn("row_number", F.expr("row_idx + IF(header IS NULL, 1, 0)"))


def role_scores(rows: DataFrame) -> DataFrame:
    """(file, col, n_chars, role, role_no, score): how well each column fits each role."""
    cells = rows.selectExpr("file", "row_number", "header", "posexplode(transform(sequence(0, n_cols - 1), k -> coalesce(get(cells, k), ''))) AS (col, v)")
    columns = cells.groupBy("file", "col").agg(F.sum(F.length("v")).alias("n_chars"), F.expr("any_value(get(header, col)) AS name"))
    filled = cells.selectExpr("file", "col", "row_number", "v", f"{_trim('v')} AS t").filter("t <> ''")
    filled = filled.withColumn("k", F.expr("row_number() OVER (PARTITION BY file, col ORDER BY row_number)")).filter(f"k <= {SAMPLE}")
    share = lambda x: f"avg(CASE WHEN {x} THEN 1D ELSE 0D END)"
    seen = filled.groupBy("file", "col").agg(
        F.expr("count(*) AS n"),
        F.expr(f"{share(f'upper(t) IN {T.in_list(COMMON_UNITS)}')} AS units"),
        F.expr(f"{share(f'upper(t) IN {T.in_list(ORGANISATIONS)}')} AS orgs"),
        F.expr("count(DISTINCT upper(t)) AS kinds"),
        F.expr("bool_and(length(t) <= 12) AS short"),
        F.expr(f"{share(T.parse_number(SPARK, 'v') + ' IS NOT NULL')} AS numeric"),
        F.expr(f"avg(size(split(t, '[{T.SPACE}]+'))) AS words"),
        F.expr("avg(length(v)) AS chars"),
        F.expr(f"{share('t RLIKE ' + T.quoted('^[A-Za-z0-9][-A-Za-z0-9/_.]{2,20}$') + ' AND v RLIKE ' + T.quoted('[0-9]'))} AS codes"),
        F.expr("count(DISTINCT t) AS different"),
    )
    content = {
        "ownCode": "codes * 0.6D + different / n * 0.4D",
        "description": "least(1D, words / 4) * 0.6D + least(1D, chars / 25) * 0.4D",
        "uom": "units",
        "cpseId": "CASE WHEN orgs > 0.5 THEN 1D WHEN kinds <= greatest(2, least(10, ceil(n / 3))) AND short THEN 0.3D ELSE 0D END",
        "quantity": "IF(numeric > 0.7, 0.6D, 0D)",
        "unitPrice": "IF(numeric > 0.7, 0.6D, 0D)",
    }
    plain = "trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' '))"
    known = lambda role: " OR ".join(f"contains({plain}, {T.quoted(a)})" for a in ALIASES[role])
    fits = ", ".join(f"struct('{r}' AS role, {k} AS role_no, IF({known(r)}, 0.75D, 0D) + IF({known(r)}, 0.25D, 1D) * IF(n IS NULL, 0D, {content[r]}) AS score)" for k, r in enumerate(ALIASES))
    return columns.join(seen, ["file", "col"], "left").selectExpr("file", "col", "n_chars", f"inline(array({fits}))")


def column_roles(scores: DataFrame) -> DataFrame:
    """(file, roles: role -> column), best score first; ties by column, then by the order of the roles.

    Without a description, the free column with the most text becomes it.
    """
    least = " ".join(f"WHEN '{r}' THEN {x}D" for r, x in LEAST.items())
    picks = scores.groupBy("file").agg(
        F.expr(f"array_sort(collect_list(struct(-score AS worse, col, role_no, role)) FILTER (WHERE score >= CASE role {least} END)) AS ranked"),
        F.expr("array_sort(collect_set(struct(-n_chars AS fewer, col))) AS free"),
    )
    none = "CAST(array() AS ARRAY<STRUCT<role: STRING, col: INT>>)"
    taken = f"aggregate(ranked, {none}, (acc, x) -> IF(exists(acc, a -> a.role = x.role OR a.col = x.col), acc, concat(acc, array(struct(x.role AS role, x.col AS col)))))"
    spare = "get(filter(free, f -> NOT exists(taken, a -> a.col = f.col)), 0).col"
    whole = f"IF(exists(taken, a -> a.role = 'description') OR {spare} IS NULL, taken, concat(taken, array(struct('description' AS role, {spare} AS col))))"
    return picks.selectExpr("file", "free", f"{taken} AS taken").selectExpr("file", f"map_from_entries({whole}) AS roles")


def item_rows(grids: DataFrame, organisations: DataFrame | None = None) -> DataFrame:
    """All data rows as materials, with ``kept`` false where the description is empty.

    ``organisations`` (file, fallback, place) tags rows whose organisation cell is missing or empty and orders
    the files; by default files take the organisations in turn, by path. A file without a description column
    raises ``ParseError``. Columns: ord, file, row_number, cpse_id, own_code, raw_description, uom, quantity,
    unit_price, kept. An own code is ``ROW-i`` only where the file has no such column.
    """
    heads = with_headers(grids)
    rows = data_rows(grids, heads)
    roles = column_roles(role_scores(rows))
    lost = roles.filter("NOT map_contains_key(roles, 'description')").select("file").first()
    if lost:
        raise ParseError(f"{lost['file']}: no material description column found")
    if organisations is None:  # one short row per file
        names = ", ".join(map(T.quoted, ORGANISATIONS))
        placed = heads.selectExpr("file", "row_number() OVER (ORDER BY file) - 1 AS place")
        organisations = placed.selectExpr("file", "place", f"element_at(array({names}), CAST(place % {len(ORGANISATIONS)} + 1 AS INT)) AS fallback")
    cell = lambda role: f"get(cells, roles['{role}'])"
    text = lambda role: f"coalesce({_trim(cell(role))}, '')"
    joined = rows.join(roles, "file").join(organisations.select("file", "fallback", "place"), "file")
    return joined.selectExpr(
        "place * 4294967296 + row_number AS ord",
        "file",
        "row_number",
        f"coalesce(nullif(upper({text('cpseId')}), ''), fallback) AS cpse_id",
        f"IF(map_contains_key(roles, 'ownCode'), {text('ownCode')}, 'ROW-' || row_number) AS own_code",
        f"{text('description')} AS raw_description",
        f"{text('uom')} AS uom",
        f"{T.parse_number(SPARK, cell('quantity'))} AS quantity",
        f"{T.parse_number(SPARK, cell('unitPrice'))} AS unit_price",
        f"{text('description')} <> '' AS kept",
    )


def items(grids: DataFrame, organisations: DataFrame | None = None) -> DataFrame:
    """The materials of all files, as the matching operators take them."""
    return item_rows(grids, organisations).filter("kept").drop("kept")


def skipped(grids: DataFrame) -> DataFrame:
    """(file, skipped): rows left out for want of a description."""
    return item_rows(grids).groupBy("file").agg(F.expr("count_if(NOT kept) AS skipped"))
