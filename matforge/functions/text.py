"""Text functions as SQL expressions over a description."""

from __future__ import annotations

from matforge.functions.dialect import Dialect

#: Words without content.
STOP_WORDS = ("OF", "THE", "AND", "FOR", "WITH", "TO", "IN", "A", "AN", "AS", "PER", "TYPE", "ITEM", "STD", "STANDARD", "MAKE", "NOS", "PCS", "EA", "EACH", "QTY", "SET", "SIZE", "MATERIAL", "MM", "OR")
#: Digits of the short hash.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Unit spellings that mean the same.
UNITS = {"EA": ("NOS", "NO", "EA", "EACH", "PC", "PCS", "UNIT"), "M": ("M", "MTR", "METER", "METRE"), "L": ("L", "LTR", "LITRE", "LITER"), "MT": ("MT", "TON", "TONNE")}
#: White space as browsers see it, as a character class body.
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def trimmed(d: Dialect, text: str) -> str:
    return d.replace(text, f"^[{SPACE}]+|[{SPACE}]+$")


def preprocess(d: Dialect, text: str) -> str:
    """Upper case, one multiplication sign, inch marks after digits spelt out, single spaces."""
    whole = text if d.spark else f"replace({text}, 'ß', 'SS')"  # what upper() makes of it in Spark
    up = f"replace(upper({whole}), '×', 'X')"
    inch = d.replace(up, f"([0-9])[{SPACE}]*(?:\"|”|″|'''')", "$1 INCH ")
    return trimmed(d, d.replace(d.replace(inch, "[“”″]", " "), f"[{SPACE}]+", " "))


def cache_key(d: Dialect, text: str) -> str:
    """A text as a model that ignores case and spacing tells it from others."""
    return f"lower({trimmed(d, d.replace(text, f'[{SPACE}]+', ' '))})"


def tokens(d: Dialect, clean: str) -> str:
    """Tokens of preprocessed text."""
    return d.split(d.replace(clean, "[^A-Z0-9]+", " "))


def content(d: Dialect, array: str) -> str:
    return d.keep(array, f"NOT x IN {in_list(STOP_WORDS)}")


def padded(d: Dialect, array: str) -> str:
    return f"concat(' ', {d.join(array, ' ')}, ' ')"


def jaccard(d: Dialect, a: str, b: str) -> str:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    shared = d.common(a, b)
    return f"CASE WHEN {d.size(a)} = 0 OR {d.size(b)} = 0 THEN 0.0 ELSE CAST({shared} AS DOUBLE) / ({d.size(a)} + {d.size(b)} - {shared}) END"


def with_digit(d: Dialect, array: str) -> str:
    return d.keep(array, d.match("x", "[0-9]"))


def numeric_mismatch(d: Dialect, a: str, b: str) -> str:
    """Both sides have tokens with digits, and those overlap by less than half."""
    x, y = with_digit(d, a), with_digit(d, b)
    return f"({d.size(x)} > 0 AND {d.size(y)} > 0 AND {jaccard(d, x, y)} < 0.5)"


def trigrams(d: Dialect, text: str) -> str:
    """All runs of three characters of the text with two blanks before and one after."""
    whole = f"concat('  ', {text}, ' ')"
    if d.spark:
        return f"transform(sequence(1, length({text}) + 1), i -> substr({whole}, i, 3))"
    return f"list_transform(range(1, length({text}) + 2), lambda i: substr({whole}, i, 3))"


def hash40(d: Dialect, text: str) -> str:
    """Forty bits: eight of one 32-bit xor-multiply hash above all of another."""
    mask = "4294967295"
    points = d.code_points(text)
    mixed = d.xor("acc", "x")
    high = d.fold(points, "2166136261", f"({mixed} * 16777619) & {mask}")
    # the second multiplier is split so that no product leaves 63 bits
    low = d.fold(points, "2538058380", f"((((({mixed} * 34283) & {mask}) * 65536) & {mask}) + (({mixed} * 51819) & {mask})) & {mask}")
    return f"((({high}) & 255) * 4294967296 + ({low}))"


def base32(d: Dialect, value: str) -> str:
    """Eight digits of a 40-bit number."""
    return "(" + " || ".join(f"substr('{BASE32}', CAST({d.shift(value, 5 * k)} & 31 AS INT) + 1, 1)" for k in reversed(range(8))) + ")"


def short_hash(d: Dialect, text: str) -> str:
    return base32(d, hash40(d, text))


def parse_number(d: Dialect, text: str) -> str:
    """Amounts with Western or Indian grouping, a currency mark before or after, and bracketed negatives; else NULL."""
    bare = trimmed(d, text)
    inner = d.replace(bare, "^[(]|[)]$")
    plain = d.replace(d.replace(inner, f"^(₹|[Rr][Ss][.]?|[Ii][Nn][Rr]|[$])[{SPACE}]*"), f"[{SPACE}]*(₹|[Rr][Ss][.]?|[Ii][Nn][Rr])$")
    shape = "^-?([0-9]{1,3}(,[0-9]{2,3})*|[0-9]+)([.][0-9]+)?$"
    sign = f"CASE WHEN {d.match(bare, '^[(].*[)]$')} THEN -1 ELSE 1 END"
    return f"CASE WHEN {d.match(plain, shape)} THEN {sign} * {d.number(f'replace({plain}, {quoted(",")}, {quoted("")})')} END"


def normalize_uom(d: Dialect, text: str) -> str:
    unit = f"upper({trimmed(d, text)})"
    return "CASE " + " ".join(f"WHEN {unit} IN {in_list(v)} THEN '{k}'" for k, v in UNITS.items()) + f" ELSE {unit} END"


def round2(value: str) -> str:
    """Two decimals, halves upward."""
    return f"floor(({value}) * 100 + 0.5) / 100"
