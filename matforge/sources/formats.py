"""Numbers of a workbook as its cells show them: number formats, percentages, grouped digits, dates."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

#: The formats that workbooks name by number alone.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)",
    45: "mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_PIECE = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|\[[^\]]*\]|(AM/PM|A/P)|([ymdhs]+|\.0+)|(.)', re.I)


def general(value: float) -> str:
    """As a cell without a format: whole numbers in full, others in eleven characters at most."""
    if value == int(value) and abs(value) < 1e11:
        return str(int(value))
    text = f"{value:.10g}" if abs(value) >= 1 else f"{value:.9f}".rstrip("0").rstrip(".") if abs(value) >= 1e-4 else f"{value:.5e}"
    return re.sub(r"e([+-])0?(\d)", r"E\1\2", text)


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|General', "", code, flags=re.I)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and not re.search(r"[0#?]", re.sub(r"s\.0+|\.0+", "", bare, flags=re.I))


def as_date(value: float, code: str, from_1904: bool) -> str:
    """A serial day and its fraction; day 60 of the older count, which never was, is taken for the day after it."""
    base = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if value >= 60 else datetime(1899, 12, 31)
    at = base + timedelta(milliseconds=round(value * 86_400_000))
    noon = bool(re.search(r"AM/PM|A/P", code, re.I))
    out, clock = [], False  # an m next to hours or seconds is a minute
    pieces = list(_PIECE.finditer(code))
    marks = [(p[4] or "").lower()[:1] for p in pieces]
    for k, p in enumerate(pieces):
        word, mark = p[4] or "", marks[k]
        if p[1] is not None or p[2]:
            out.append(p[1] if p[1] is not None else p[2])
        elif p[3]:
            out.append(("AM" if at.hour < 12 else "PM")[: 2 if "/" in p[3][2:3] else 1])
        elif mark == "y":
            out.append(f"{at.year:04d}" if len(word) > 2 else f"{at.year % 100:02d}")
        elif mark == "d":
            out.append([str(at.day), f"{at.day:02d}", DAYS[at.weekday()][:3], DAYS[at.weekday()]][min(len(word), 4) - 1])
        elif mark == "h":
            hour = (at.hour - 1) % 12 + 1 if noon else at.hour
            out.append(f"{hour:02d}" if len(word) > 1 else str(hour))
        elif mark == "s":
            out.append(f"{at.second:02d}" if len(word) > 1 else str(at.second))
        elif mark == ".":
            out.append(f".{at.microsecond // 1000:03d}"[: len(word)])
        elif mark == "m" and (clock or next((x for x in marks[k + 1 :] if x), "") == "s"):
            out.append(f"{at.minute:02d}" if len(word) > 1 else str(at.minute))
        elif mark == "m":
            out.append([str(at.month), f"{at.month:02d}", MONTHS[at.month - 1][:3], MONTHS[at.month - 1], MONTHS[at.month - 1][0]][min(len(word), 5) - 1])
        elif p[5]:
            out.append(p[5])
        if mark:
            clock = mark == "h"
    return "".join(out)


def formatted(value: float, code: str, from_1904: bool = False) -> str:
    """A number by a format code; of several sections the one for its sign."""
    sections = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', code)
    own = sections[1] if value < 0 and len(sections) > 1 else sections[2] if value == 0 and len(sections) > 2 else sections[0]
    signed = value < 0 and len(sections) == 1
    if is_date(own):
        return as_date(value, own, from_1904)
    if re.fullmatch(r"\s*(General|@)?\s*", own, re.I):
        return general(value)
    bare = re.sub(r'"([^"]*)"|\\(.)|\[\$([^-\]]*)[^\]]*\]|\[[^\]]*\]|_.|\*.', lambda m: "\0" + (m[1] or m[2] or m[3] or "").replace("0", "\1").replace("#", "\2") + "\0" if m[1] or m[2] or m[3] else " " if m[0][0] == "_" else "", own)
    digits = re.search(r"[0#?][0#?,]*(?:\.[0#?]*,*)?(?:E[+-]?[0#?]+)?|\.[0#?]+", bare)
    if not digits:
        return bare.replace("\0", "").replace("\1", "0").replace("\2", "#")
    form, size = digits[0], abs(value) * 100 ** bare.count("%")
    whole, _, rest = form.partition(".")
    exponent = re.search(r"E([+-]?)([0#?]+)", form)
    places = re.sub(r"E.*|,", "", rest)
    size /= 1000 ** (len(whole) - len(whole.rstrip(",")) + rest.count(","))  # commas behind the digits stand for thousands
    if exponent:
        mantissa, power = f"{size:.{len(places)}e}".split("e")
        text = f"{mantissa}E{'-' if int(power) < 0 else '+' if exponent[1] == '+' else ''}{abs(int(power)):0{len(exponent[2])}d}"
    else:
        # halves go up, as they do on paper
        scale = 10 ** len(places)
        units = int(size * scale + 0.5 + 1e-9)
        left, right = str(units // scale), str(units % scale).zfill(len(places)) if places else ""
        while right and places[len(right) - 1] == "#" and right[-1] == "0":
            right = right[:-1]
        least = whole.replace(",", "").count("0")
        left = left.zfill(least) if left != "0" or least else ""
        if "," in whole.rstrip(","):
            left = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", left)
        text = left + ("." + right if right else "." if "." in form and "#" not in places and not places else "")
    out = bare[: digits.start()] + text + bare[digits.end() :]
    return ("-" if signed and re.search("[1-9]", text) else "") + out.replace("\0", "").replace("\1", "0").replace("\2", "#")
