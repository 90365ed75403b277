"""Quantities, prices and savings per code, as SQL over a mapping (nmc_code, cpse_id, uom, quantity, unit_price)."""

from __future__ import annotations

from matforge.functions import text as T
from matforge.functions.dialect import Dialect


def by_code(d: Dialect, mapping: str) -> str:
    """One row per code. Prices count only where the code has one unit of measure."""
    unit = T.normalize_uom(d, "uom")
    return f"""
SELECT nmc_code, legacy_codes, cpses, n_cpses, uom, CASE WHEN uom <> 'MIXED' THEN total_quantity END AS total_quantity,
  CASE WHEN uom <> 'MIXED' THEN min_price END AS min_price, CASE WHEN uom <> 'MIXED' THEN max_price END AS max_price,
  CASE WHEN uom <> 'MIXED' THEN {T.round2("spent / nullif(priced_quantity, 0)")} END AS weighted_avg_price,
  CASE WHEN uom <> 'MIXED' AND priced > 0 THEN {T.round2("spent")} ELSE 0.0 END AS value,
  CASE WHEN uom <> 'MIXED' AND priced >= 2 THEN {T.round2("spent - min_price * priced_quantity")} ELSE 0.0 END AS savings,
  CASE WHEN uom <> 'MIXED' THEN priced ELSE 0 END AS priced_rows, first_ord
FROM (
  SELECT nmc_code, count(*) AS legacy_codes, {d.collect("cpse_id")} AS cpses, count(DISTINCT cpse_id) AS n_cpses,
    CASE WHEN count(DISTINCT nullif(unit, '')) > 1 THEN 'MIXED' ELSE coalesce(max(nullif(unit, '')), '') END AS uom,
    sum(CASE WHEN quantity > 0 THEN quantity END) AS total_quantity, min(CASE WHEN quantity > 0 AND unit_price > 0 THEN unit_price END) AS min_price,
    max(CASE WHEN quantity > 0 AND unit_price > 0 THEN unit_price END) AS max_price, count(CASE WHEN quantity > 0 AND unit_price > 0 THEN 1 END) AS priced,
    CAST(sum(CASE WHEN quantity > 0 AND unit_price > 0 THEN CAST(quantity * unit_price AS DECIMAL(28, 6)) END) AS DOUBLE) AS spent,
    sum(CASE WHEN quantity > 0 AND unit_price > 0 THEN quantity END) AS priced_quantity, min(ord) AS first_ord
  FROM (SELECT *, {unit} AS unit FROM {mapping}) e1 GROUP BY nmc_code
) e2"""


def summary(d: Dialect, mapping: str, per_code: str) -> str:
    """One row of totals over a mapping and its per-code table."""
    share = lambda a, b: f"coalesce(floor(({a}) / nullif(CAST({b} AS DOUBLE), 0) * 1000 + 0.5) / 10, 0.0)"
    return f"""
SELECT entries, with_quantity, with_price, with_both, unique_codes, entries - unique_codes AS redundant_codes, {share("entries - unique_codes", "entries")} AS reduction_pct,
  multi_cpse_codes, mixed_uom_codes, {T.round2("total_value")} AS total_value, {T.round2("total_savings")} AS savings, {share("total_savings", "total_value")} AS savings_pct
FROM (SELECT count(*) AS entries, count(CASE WHEN quantity > 0 THEN 1 END) AS with_quantity, count(CASE WHEN unit_price > 0 THEN 1 END) AS with_price,
    count(CASE WHEN quantity > 0 AND unit_price > 0 THEN 1 END) AS with_both FROM {mapping}) s1
CROSS JOIN (SELECT count(*) AS unique_codes, count(CASE WHEN n_cpses > 1 THEN 1 END) AS multi_cpse_codes, count(CASE WHEN uom = 'MIXED' THEN 1 END) AS mixed_uom_codes,
    CAST(coalesce(sum(CAST(value AS DECIMAL(28, 2))), 0) AS DOUBLE) AS total_value, CAST(coalesce(sum(CAST(savings AS DECIMAL(28, 2))), 0) AS DOUBLE) AS total_savings FROM {per_code}) s2"""
