"""Typed attributes, subtype, corrosion class and code of free-text descriptions, as SQL over one row.

``coded(d, source)`` is the whole chain: a SELECT over ``source`` that adds the columns below without any
shuffle. Attribute columns are named ``a_<attribute>``; one is NULL if the text lacks it or the
item's subtype does not use it.
"""

from __future__ import annotations

from matforge.functions import text as T
from matforge.functions.dialect import Dialect
from matforge.operators import dictionary as D

#: A word's begin and end, in upper-case text.
B, E = "(?:^|[^A-Z0-9_])", "(?:[^A-Z0-9_]|$)"
DECIMAL = "([0-9]+(?:[.][0-9]+)?)"
AREA = "(?:SQ[.]? ?MM|SQMM|MM2)"

ATTRIBUTES = ("thread", "length", "size", "pressure", "schedule", "power", "voltage", "poles", "phase", "cores", "csa", "bearingNo", "seal", "thickness", "section", "range", "dial", "viscosity", "propClass", *D.KEYWORDS, "grade", "finish", "standard")


def number(d: Dialect, x: str) -> str:
    """A decimal without needless zeros."""
    return d.replace(d.replace(x, "^0+([0-9])", "$1"), "([.][0-9]*[1-9])0+$|[.]0+$", "$1")


def tagged(prefix: str, x: str, suffix: str = "") -> str:
    """The value between a prefix and a suffix; NULL stays NULL."""
    return f"('{prefix}' || {x} || '{suffix}')"


def lookup(x: str, values: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def vetoed(d: Dialect) -> str:
    """Codes of the subtypes that a word of the text rules out."""
    words = d.array(f"{s.code}|{D.spaced(x)}" for s in D.SUBTYPES for x in s.exclude)
    return d.map(d.keep(words, "instr(pad, split_part(x, '|', 2)) > 0"), "split_part(x, '|', 1)")


def earliest(d: Dialect) -> str:
    """Subtype whose spelling comes first in the text; of those the longest; of those the first defined."""
    forms = d.array(f"{99 - len(x):02d}|{k:02d}|{s.code}|{x}" for k, s in enumerate(D.SUBTYPES) for x in map(D.spaced, s.synonyms))
    found = d.keep(forms, "instr(pad, split_part(x, '|', 4)) > 0 AND NOT array_contains(vetoed, split_part(x, '|', 3))")
    ranked = d.map(found, "lpad(CAST(instr(pad, split_part(x, '|', 4)) AS VARCHAR(9)), 6, '0') || '|' || x")
    return f"coalesce(split_part({d.smallest(ranked)}, '|', 4), 'UNK')"


def longest(d: Dialect, entries: dict[str, list[str]]) -> str:
    """Canonical value of the longest spelling in the text; the first listed on a tie."""
    listed = [(name, form) for name, forms in entries.items() for form in forms]
    forms = d.array(f"{len(form):03d}|{999 - k:03d}|{name}|{form}" for k, (name, form) in enumerate(listed))
    return f"split_part({d.largest(d.keep(forms, 'instr(pad, split_part(x, ' + T.quoted('|') + ', 4)) > 0'))}, '|', 3)"


def keyword(pairs: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN instr(pad, ' {w} ') > 0 THEN '{v}'" for w, v in pairs) + " END"


def bore(d: Dialect, x: str) -> str:
    """DN of a size in inches; an unknown fraction counts as its leading whole number."""
    names = {k: f"DN{v}" for k, v in D.BORES.items()}
    plain = number(d, d.group(x, "^([0-9]+(?:[.][0-9]+)?)"))
    return f"coalesce({lookup(f'replace({x}, {T.quoted(" ")}, {T.quoted("-")})', names)}, {lookup(plain, names)})"


def raw_attributes(d: Dialect) -> dict[str, str]:
    """Expression of each attribute over the columns u, pad and subtype."""
    g = lambda pattern, group=1: d.group("u", pattern, group)
    num = lambda x: number(d, x)
    out: dict[str, str] = {}
    metric = f"{B}M ?([0-9]{{1,3}}(?:[.][0-9])?)(?:[^0-9]|$)"
    dims = f"{B}M ?[0-9]{{1,3}}(?:[.][0-9])? ?[X*] ?{DECIMAL}"
    pitch = f"{dims} ?[X*] ?{DECIMAL}"
    nominal = g(f"{B}([0-9]{{1,2}}) ?MM{E}")
    out["thread"] = f"coalesce({tagged('M', num(g(metric)))}, CASE WHEN subtype IN ('HNT', 'WSH', 'BLT', 'STD') AND CAST({nominal} AS INT) BETWEEN 3 AND 64 THEN {tagged('M', nominal)} END)"
    one = f"CASE WHEN {g(pitch, 2)} IS NULL AND {d.number(g(dims))} >= 6 AND {d.number(g(dims))} = floor({d.number(g(dims))}) THEN {num(g(dims))} END"
    spelt = f"coalesce({g(f'{B}([0-9]{{2,3}}) ?MM ?(?:LG|LONG|LENGTH){E}')}, {g(f'{B}LENGTH ?[:=]? ?([0-9]{{2,3}}){E}')}, {g(f'{B}L ?= ?([0-9]{{2,3}}){E}')})"
    out["length"] = tagged("", f"coalesce(CASE WHEN {g(metric)} IS NOT NULL THEN {num(g(pitch, 2))} END, CASE WHEN {g(metric)} IS NOT NULL THEN {one} END, {spelt})", "MM")
    pair = f"{B}([0-9]{{1,2}}(?:[.][0-9]+)?) ?(?:INCH|IN)? ?[X*] ?([0-9]{{1,2}}(?:[.][0-9]+)?) ?(?:INCH|IN){E}"
    inch = g(f"{B}([0-9]{{1,2}}(?:[- ][0-9]/[0-9]|[.][0-9]+|/[0-9])?) ?(?:INCH|INCHES|IN){E}")
    mm = g(f"{B}([0-9]{{2,3}}) ?MM{E}")
    bores = T.in_list(sorted({str(v) for v in D.BORES.values()}))
    out["size"] = f"coalesce({bore(d, g(pair))} || 'X' || {bore(d, g(pair, 2))}, {tagged('DN', g(f'{B}(?:DN|NB) ?([0-9]{{2,4}}){E}'))}, {bore(d, inch)}, CASE WHEN subtype IN ('PPE', 'FLG', 'VLV', 'FIT', 'GSK') AND {mm} IN {bores} THEN {tagged('DN', mm)} END)"
    rated = f"coalesce({g(f'{B}(?:CLASS|CL|CLS|RATING)[.]? ?([0-9]{{3,4}}){E}')}, {g(f'{B}([0-9]{{3,4}}) ?(?:#|LBS?)(?: |$)')}, {g(f'{B}ANSI ?([0-9]{{3,4}}){E}')})"
    out["pressure"] = f"coalesce({tagged('PN', g(f'{B}PN ?-?([0-9]{{1,3}}){E}'))}, CASE WHEN CAST({rated} AS INT) IN {tuple(D.CLASSES)} THEN 'CL' || CAST(CAST({rated} AS INT) AS VARCHAR(5)) END)"
    out["schedule"] = tagged("SCH", g(f"{B}SCH(?:EDULE)?[.]? ?([0-9]{{1,3}}S?|STD|XS|XXS){E}"))
    hp = g(f"{DECIMAL} ?HP{E}")
    converted = f"CAST(CAST(round({d.number(hp)} * 0.7457, 1) AS DECIMAL(12, 1)) AS VARCHAR(14))"
    out["power"] = tagged("", f"coalesce({num(g(f'{DECIMAL} ?KW{E}'))}, {lookup(num(hp), D.KILOWATTS)}, {converted})", "KW")
    out["voltage"] = f"coalesce({tagged('', num(g(f'{DECIMAL} ?KV{E}')), 'KV')}, {tagged('', g(f'{B}([0-9]{{2,4}}) ?V(?:OLTS?|AC)?{E}'), 'V')})"
    rpm = f"CAST({g('([0-9]{3,4}) ?RPM')} AS INT)"
    out["poles"] = f"coalesce({tagged('', g(f'{B}([2468]) ?(?:P|POLE|POLES){E}'), 'P')}, CASE WHEN {rpm} >= 2500 THEN '2P' WHEN {rpm} >= 1300 THEN '4P' WHEN {rpm} >= 850 THEN '6P' WHEN {rpm} >= 650 THEN '8P' END)"
    out["phase"] = f"coalesce({tagged('', g(f'{B}([13]) ?-? ?(?:PH|PHASE){E}'), 'PH')}, CASE {g(f'{B}(SINGLE|THREE) ?-? ?PHASE{E}')} WHEN 'SINGLE' THEN '1PH' WHEN 'THREE' THEN '3PH' END)"
    cable, plain = f"{B}{DECIMAL} ?C(?:ORE|ORES)? ?[X*] ?{DECIMAL}", f"{B}([0-9]+) ?[X*] ?{DECIMAL} ?{AREA}"
    out["cores"] = tagged("", f"coalesce({num(g(cable))}, {num(g(plain))}, {g(f'{B}([0-9]+) ?(?:CORE|CORES){E}')})", "C")
    out["csa"] = tagged("", f"coalesce({num(g(cable, 2))}, {num(g(plain, 2))}, {num(g(f'{DECIMAL} ?{AREA}'))})", "SQMM")
    bearing = f"{B}(NU|NJ|NUP|QJ)? ?(6[0-4][0-9]{{2}}|[23][0-9]{{4}}|7[0-3][0-9]{{2}}|[12][0-3][0-9]{{2}}){E}"
    out["bearingNo"] = f"CASE WHEN subtype = 'BRG' THEN coalesce({g(bearing)}, '') || {g(bearing, 2)} END"
    seal = g(f"{B}(2RS1?|2RSH|ZZ|2Z|RS|Z){E}")
    out["seal"] = f"CASE WHEN subtype = 'BRG' THEN CASE WHEN {seal} LIKE '2RS%' OR {seal} = 'RS' THEN '2RS' WHEN {seal} IS NOT NULL THEN 'ZZ' END END"
    thick = ", ".join(g(p) for p in (f"{DECIMAL} ?MM ?(?:THK[.]?|THICK(?:NESS)?){E}", f"{B}THK[.]? ?{DECIMAL}", f"{B}(?:PLATE|SHEET)(?:[^A-Z0-9_].*?)?{DECIMAL} ?MM{E}", f"{DECIMAL} ?MM{E}"))
    out["thickness"] = f"CASE WHEN subtype = 'PLT' THEN {tagged('', num(f'coalesce({thick})'), 'MM')} END"
    section = f"{B}(ISMB|ISMC|ISLB|ISJB|ISWB|ISHB|ISA) ?([0-9]+(?: ?X ?[0-9]+){{0,2}}){E}"
    out["section"] = f"coalesce({g(section)} || replace({g(section, 2)}, ' ', ''), {tagged('ISA', f'replace({g(f'{B}ANGLE ?([0-9]+ ?X ?[0-9]+ ?X ?[0-9]+){E}')}, {T.quoted(" ")}, {T.quoted("")})')})"
    scale = f"{B}0 ?(?:-|TO) ?{DECIMAL} ?(BAR|KG/CM2|KG/CM²|KG/CM|PSI|MPA|KPA){E}"
    out["range"] = f"'0-' || {num(g(scale))} || {d.replace(g(scale, 2), '[^A-Z0-9]', '')}"
    out["dial"] = tagged("DIAL", f"coalesce({g(f'{B}([0-9]{{2,3}}) ?MM ?(?:DIAL|DIA){E}')}, {g(f'{B}DIAL ?(?:SIZE)? ?([0-9]{{2,3}}){E}')})")
    sae = d.replace(g(f"{B}SAE ?([0-9]{{1,3}}W?(?: ?- ?[0-9]{{1,3}}W?)?){E}"), "[ -]", "")
    out["viscosity"] = f"coalesce({tagged('VG', g(f'{B}VG ?([0-9]{{2,4}}){E}'))}, {tagged('VG', g(f'{B}ISOVG ?([0-9]{{2,4}}){E}'))}, {tagged('SAE', sae)}, {tagged('NLGI', g(f'{B}NLGI ?([0-9]){E}'))})"
    listed = " ".join(f"WHEN {d.match('u', f'(^|[^0-9.]){p.replace(".", "[.]")}([^0-9.]|$)')} THEN 'PC{p}'" for p in D.PROPERTY_CLASSES)
    nut = g(f"{B}(?:GR(?:ADE)?|PC|PROPERTY CLASS)[.]? ?(4|5|6|8|10|12){E}")
    out["propClass"] = f"CASE {listed} ELSE {tagged('PC', nut)} END"
    for name, words in D.KEYWORDS.items():
        out[name] = keyword(words)
    turn = d.group("pad", "(?:^|[^A-Z0-9_])(45|90|180)(?:[^A-Z0-9_]|$)")
    out["fitType"] = f"CASE WHEN {keyword(D.KEYWORDS['fitType'])} IN ('ELBOW', 'BEND') THEN {keyword(D.KEYWORDS['fitType'])} || coalesce({turn}, '') ELSE {keyword(D.KEYWORDS['fitType'])} END"
    out["grade"] = longest(d, D.spellings(D.GRADES))
    out["finish"] = longest(d, D.spellings(D.FINISHES))
    out["standard"] = longest(d, D.standards())
    return {k: out[k] for k in ATTRIBUTES}


def by_subtype(value, other: str) -> str:
    """CASE over the subtype; ``value(subtype)`` gives the branch."""
    return "(CASE subtype " + " ".join(f"WHEN '{s.code}' THEN {value(s)}" for s in D.SUBTYPES) + f" ELSE {other} END)"


def coded(d: Dialect, source: str, description: str = "raw_description", forced: str | None = None) -> str:
    """SELECT over ``source``: its columns plus u, toks, pad, subtype, category, cat_code, attributes,
    corrosion, complete, dim_key, block, nmc_code and canonical. ``forced`` names a column whose subtype, where not
    NULL, is taken in place of the one found in the text."""
    users = {a: [s.code for s in D.SUBTYPES if a in s.dims + s.mats] for a in ATTRIBUTES}
    raw = ", ".join(f"{x} AS r_{a}" for a, x in raw_attributes(d).items())
    own = ", ".join(f"CASE WHEN subtype IN {T.in_list(['UNK', *users[a]])} THEN r_{a} END AS a_{a}" for a in ATTRIBUTES)
    rank = lookup("r_grade", D.CORROSION)
    parts = lambda keys, by: f"concat_ws('{by}', {', '.join(f'a_{k}' for k in keys)})" if keys else "''"
    whole = by_subtype(lambda s: " AND ".join(f"a_{k} IS NOT NULL" for k in s.dims), "false")
    dims, mats = by_subtype(lambda s: parts(s.dims, "-"), "''"), by_subtype(lambda s: parts(s.mats, "-"), "''")
    key = d.join(d.distinct(T.content(d, "toks")), " ")
    found = f"coalesce({forced}, {earliest(d)})" if forced else earliest(d)
    return f"""
SELECT *, {rank_lifted()} AS corrosion, CASE WHEN complete THEN {by_subtype(lambda s: parts(s.dims, '|'), 'NULL')} END AS dim_key, category || '|' || subtype AS block,
  concat_ws('-', 'NMC', cat_code, subtype, nullif({dims}, ''), nullif({mats}, ''), {T.base32(d, "h40")}) AS nmc_code,
  {by_subtype(lambda s: f"concat_ws(' ', '{s.label}', {', '.join(f'a_{k}' for k in s.dims + s.mats)})", f"upper(substr({description}, 1, 40))")} AS canonical
FROM (SELECT *, CASE WHEN NOT complete THEN {T.hash40(d, "token_key")} END AS h40
FROM (SELECT *, {whole} AS complete
FROM (SELECT *, {own}, {rank} AS grade_rank, {by_subtype(lambda s: f"'{s.category}'", "'Uncategorized'")} AS category, {by_subtype(lambda s: f"'{s.cat_code}'", "'UNC'")} AS cat_code, {key} AS token_key
FROM (SELECT *, {raw}
FROM (SELECT *, {found} AS subtype
FROM (SELECT *, {vetoed(d)} AS vetoed
FROM (SELECT *, {T.padded(d, "toks")} AS pad
FROM (SELECT *, {T.tokens(d, "u")} AS toks
FROM (SELECT *, {T.preprocess(d, f"coalesce({description}, '')")} AS u FROM {source}) s1) s2) s3) s4) s5) s6) s7) s8) s9
"""


def rank_lifted() -> str:
    """Corrosion class of the grade; zinc and galvanising lift low or unknown to medium."""
    return "CASE WHEN r_finish IN ('ZN', 'HDG') AND coalesce(grade_rank, 'LOW') = 'LOW' THEN 'MEDIUM' ELSE grade_rank END"
