"""The pairwise decision cascade as SQL over two coded rows."""

from __future__ import annotations

import re

from matforge.functions import text as T
from matforge.functions.dialect import Dialect
from matforge.operators import dictionary as D


def lexical(d: Dialect, source: str) -> str:
    """Adds what text similarity needs: distinct content tokens, character trigrams and their norm.

    In Spark the trigrams also come as a set, with the numbers of those that occur more than once (``gram_more``), so that
    a pair's product of counts is a set's size and a few corrections.
    """
    grams = T.trigrams(d, "raw_description")
    told = f"SELECT *, {d.distinct(T.content(d, 'toks'))} AS ctoks, {grams} AS grams FROM {source}"
    if not d.spark:
        norm = "list_sum(list_transform(list_distinct(grams), lambda g: len(list_filter(grams, lambda y: y = g)) * len(list_filter(grams, lambda y: y = g))))"
        return f"SELECT *, CAST({norm} AS DOUBLE) AS gram_norm FROM ({told}) l1"
    runs = f"SELECT *, filter(transform(sorted, (g, i) -> i), i -> i = 0 OR get(sorted, i) <> get(sorted, i - 1)) AS begins FROM (SELECT *, array_sort(grams) AS sorted FROM ({told}) l1) l2"
    counted = f"SELECT * EXCEPT (sorted, begins), transform(begins, (at, k) -> struct(get(sorted, at) AS g, CAST(coalesce(get(begins, k + 1), size(sorted)) - at AS BIGINT) AS n)) AS counts FROM ({runs}) l3"
    return f"SELECT * EXCEPT (counts), transform(counts, x -> x.g) AS gram_set, filter(counts, x -> x.n > 1) AS gram_more, CAST(aggregate(counts, 0L, (acc, x) -> acc + x.n * x.n) AS DOUBLE) AS gram_norm FROM ({counted}) l4"


def similarity(d: Dialect, a: str, b: str) -> str:
    """Half the Jaccard similarity of content tokens, half the cosine of character trigram counts."""
    if d.spark:
        x, y = f"{a}.gram_set", f"{b}.gram_set"
        times = f"coalesce(get(filter({b}.gram_more, f -> f.g = e.g), 0).n, 1L)"
        more = f"aggregate(filter({a}.gram_more, e -> array_contains({y}, e.g)), 0L, (acc, e) -> acc + e.n * {times} - 1L)"
        rest = f"aggregate(filter({b}.gram_more, e -> array_contains({x}, e.g) AND NOT exists({a}.gram_more, f -> f.g = e.g)), 0L, (acc, e) -> acc + e.n - 1L)"
        dot = f"(size(array_intersect({x}, {y})) + {more} + {rest})"
    else:
        x, y = f"{a}.grams", f"{b}.grams"
        dot = f"coalesce(list_sum(list_transform(list_intersect({x}, {y}), lambda g: len(list_filter({x}, lambda v: v = g)) * len(list_filter({y}, lambda v: v = g)))), 0)"
    return f"(0.5 * ({T.jaccard(d, f'{a}.ctoks', f'{b}.ctoks')}) + 0.5 * (CAST({dot} AS DOUBLE) / sqrt({a}.gram_norm * {b}.gram_norm)))"


def risk(a: str, b: str) -> str:
    """Safety risk of a change of corrosion class, graver on pressure-bearing parts of A's subtype."""
    order = lambda x: f"CASE {x}.corrosion WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END"
    bearing = f"{a}.subtype IN {T.in_list(s.code for s in D.SUBTYPES if s.pressure_bearing)}"
    return f"CASE abs({order(a)} - {order(b)}) WHEN 0 THEN 'LOW' WHEN 1 THEN CASE WHEN {bearing} THEN 'MEDIUM' ELSE 'LOW' END WHEN 2 THEN CASE WHEN {bearing} THEN 'HIGH' ELSE 'MEDIUM' END END"


def equivalent_standards(a: str, b: str) -> str:
    group = lambda x: "CASE " + " ".join(f"WHEN {x} IN {T.in_list(g)} THEN {k}" for k, g in enumerate(D.EQUIVALENT_STANDARDS)) + " END"
    return f"coalesce({group(a)} = {group(b)}, false)"


def facts(d: Dialect, pairs: str, vectors: bool = False) -> str:
    """Adds to pairs of coded rows (structs a and b) what the cascade asks: equal dimensions, material
    mismatches, equivalent standards, risk and text similarity.

    With ``vectors`` a pair whose rows both have one (of norm 1) takes their product for its similarity; others stay lexical.
    """
    both = "(a.vector IS NOT NULL AND b.vector IS NOT NULL)"
    dot = "aggregate(zip_with(a.vector, b.vector, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (acc, z) -> acc + z)"
    near = f"CASE WHEN {both} THEN {dot} ELSE {similarity(d, 'a', 'b')} END" if vectors else similarity(d, "a", "b")
    via = f"CASE WHEN {both} THEN 'embedding' ELSE 'lexical' END" if vectors else "'lexical'"
    case = lambda value: "(CASE a.subtype " + " ".join(f"WHEN '{s.code}' THEN {value(s)}" for s in D.SUBTYPES) + " END)"
    differs = lambda k: f"(a.a_{k} IS DISTINCT FROM b.a_{k})"
    soft = f"({differs('standard')} AND {equivalent_standards('a.a_standard', 'b.a_standard')})"
    hard = lambda k: f"CAST(({differs(k)}" + (f" AND NOT {equivalent_standards('a.a_standard', 'b.a_standard')}" if k == "standard" else "") + ") AS INT)"
    return f"""
SELECT *, (a.complete AND b.complete) AS whole,
  {case(lambda s: " OR ".join(map(differs, s.dims)))} AS dims_differ,
  {case(lambda s: " + ".join(map(hard, s.mats)) or "0")} AS hard_misses,
  {case(lambda s: soft if "standard" in s.mats else "false")} AS soft_standard,
  {risk("a", "b")} AS change_risk, coalesce(a.corrosion = b.corrosion, false) AS same_class,
  {T.numeric_mismatch(d, "a.ctoks", "b.ctoks")} AS numbers_clash, {near} AS sim, {via} AS via
FROM {pairs}"""


#: The reason of each row of the cascade; what stands in braces differs from pair to pair.
REASONS = (
    "Identical canonical attributes",
    "Different {dims} — not interchangeable regardless of material grade",
    "Same dimensions and material; standards {standard_a} / {standard_b} are dimensionally equivalent",
    "Identical canonical attributes",
    "Same {dims}, matching corrosion class ({class}) despite differing grade ({grade_a} vs {grade_b})",
    "Same dimensions, differing grade ({grade_a} vs {grade_b}) with a {risk}-risk corrosion-class change on a {bearing} part",
    "Same dimensions, differing material attributes; description similarity {percent}%",
    "Same dimensions but materially and descriptively distinct",
    "Numeric values in the descriptions disagree (likely different size/rating)",
    "Unrecognized item type, but wording is near-identical",
    "Unrecognized item type; description wording is substantially similar",
    "No meaningful overlap",
)
#: Reasons of rows without a pair, and of the best of several.
NO_MATCH, BEST_OF = "No match found in block", "Best of {n} comparable candidates in block"
#: Condition, verdict, confidence, stage, risk and review, in order; the first that holds decides.
CASCADE = (
    ("whole AND a.nmc_code = b.nmc_code", "duplicate", "1.0", "rule", "'LOW'", False),
    ("whole AND dims_differ", "distinct", "0.9", "rule", "NULL", False),
    ("whole AND hard_misses = 0 AND soft_standard", "similar", "0.85", "rule", "change_risk", True),
    ("whole AND hard_misses = 0", "duplicate", "1.0", "rule", "'LOW'", False),
    ("whole AND same_class", "functionally_equivalent", "0.75", "rule", "change_risk", True),
    ("whole AND change_risk IN ('HIGH', 'MEDIUM')", "similar", "0.6", "rule", "change_risk", True),
    ("whole AND sim > 0.7", "similar", "sim", "via", "change_risk", True),
    ("whole", "distinct", "1 - sim", "via", "change_risk", False),
    ("numbers_clash", "distinct", "0.7", "via", "NULL", False),
    ("sim > 0.9", "duplicate", "sim", "via", "'MEDIUM'", True),
    ("sim > 0.6", "similar", "sim", "via", "'MEDIUM'", True),
    ("true", "distinct", "1 - sim", "via", "NULL", False),
)


def filled(template: str, values: dict[str, str]) -> str:
    """A template as SQL: its texts joined with the expressions of its braces."""
    parts = re.split(r"{(\w+)}", template)
    return " || ".join(values[x] if k % 2 else T.quoted(x) for k, x in enumerate(parts) if x)


def _reason_values() -> dict[str, str]:
    by_subtype = lambda value: "(CASE a.subtype " + " ".join(f"WHEN '{s.code}' THEN '{value(s)}'" for s in D.SUBTYPES) + " ELSE '' END)"
    known = lambda x: f"coalesce({x}, '?')"
    return {
        "dims": by_subtype(lambda s: "/".join(s.dims)), "standard_a": known("a.a_standard"), "standard_b": known("b.a_standard"), "class": known("a.corrosion"), "grade_a": known("a.a_grade"), "grade_b": known("b.a_grade"),
        "risk": "coalesce(lower(change_risk), '')", "bearing": by_subtype(lambda s: "pressure-bearing" if s.pressure_bearing else ""), "percent": "CAST(CAST(floor(sim * 100 + 0.5) AS BIGINT) AS VARCHAR(9))",
    }


def decisions(d: Dialect, pairs: str, vectors: bool = False) -> str:
    """verdict, confidence, stage, risk, review, reason and the cascade row that decided, for structs a and b."""
    pick = lambda column: "CASE rule_no " + " ".join(f"WHEN {k} THEN {column(r)}" for k, r in enumerate(CASCADE, 1)) + " END"
    rule = "CASE " + " ".join(f"WHEN {row[0]} THEN {k}" for k, row in enumerate(CASCADE, 1)) + " END"
    reason = "CASE rule_no " + " ".join(f"WHEN {k} THEN {filled(t, _reason_values())}" for k, t in enumerate(REASONS, 1)) + " END"
    # a generator keeps the optimizer from writing out the rule's conditions again wherever rule_no is used
    ruled = f"({facts(d, pairs, vectors)}) f1 LATERAL VIEW inline(array(struct({rule} AS rule_no))) f2" if d.spark else f"(SELECT *, {rule} AS rule_no FROM ({facts(d, pairs, vectors)}) f1) f2"
    return f"""
SELECT a, b, sim, rule_no, {pick(lambda r: f"'{r[1]}'")} AS verdict, {pick(lambda r: f"CAST({r[2]} AS DOUBLE)")} AS confidence,
  {pick(lambda r: "via" if r[3] == "via" else f"'{r[3]}'")} AS stage, {pick(lambda r: r[4])} AS safety_risk, {pick(lambda r: str(r[5]).lower())} AS needs_review, {reason} AS reason
FROM {ruled}"""


#: Strength of a verdict and gravity of a risk, for ranking candidates.
STRENGTH = "CASE verdict WHEN 'duplicate' THEN 3 WHEN 'functionally_equivalent' THEN 2 WHEN 'similar' THEN 1 ELSE 0 END"
GRAVITY = "CASE safety_risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
