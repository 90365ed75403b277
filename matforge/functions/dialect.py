"""Small differences between Spark SQL and the SQL that tests and oracles run.

Operators are written once as SQL text; what the two spell differently goes through a dialect.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def replace(self, text: str, pattern: str, by: str = "") -> str:
        """Replace all matches; ``by`` may hold $1. Patterns avoid backslashes."""
        if self.spark:
            return f"regexp_replace({text}, '{pattern}', '{by}')"
        return f"regexp_replace({text}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"

    def match(self, text: str, pattern: str) -> str:
        return f"regexp_like({text}, '{pattern}')" if self.spark else f"regexp_matches({text}, '{pattern}')"

    def group(self, text: str, pattern: str, group: int = 1) -> str:
        """A capture group, NULL if the pattern or the group does not take part."""
        return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"

    def split(self, text: str) -> str:
        """Non-empty parts between single spaces."""
        return f"filter(split({text}, ' '), x -> x <> '')" if self.spark else f"list_filter(string_split({text}, ' '), lambda x: x <> '')"

    def keep(self, array: str, condition: str) -> str:
        """Elements ``x`` of an array for which a condition holds."""
        return f"filter({array}, x -> {condition})" if self.spark else f"list_filter({array}, lambda x: {condition})"

    def distinct(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))" if self.spark else f"list_sort(list_distinct({array}))"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, '{by}')" if self.spark else f"coalesce(array_to_string({array}, '{by}'), '')"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)" if self.spark else f"CAST(len({array}) AS BIGINT)"

    def common(self, a: str, b: str) -> str:
        """Number of values that two arrays share."""
        return f"size(array_intersect({a}, {b}))" if self.spark else f"len(list_intersect({a}, {b}))"

    def explode(self, array: str) -> str:
        return f"explode({array})" if self.spark else f"unnest({array})"

    def range(self, low: str, high: str) -> str:
        """Whole numbers from low to high, both included; empty if high < low."""
        if self.spark:
            return f"CASE WHEN {high} >= {low} THEN sequence({low}, {high}) ELSE array() END"
        return f"range({low}, {high} + 1)"

    def collect(self, value: str) -> str:
        """Sorted distinct values, joined by a bar."""
        if self.spark:
            return f"array_join(array_sort(collect_set({value})), '|')"
        return f"coalesce(string_agg(DISTINCT {value}, '|' ORDER BY {value}), '')"

    def number(self, text: str) -> str:
        return f"try_cast({text} AS DOUBLE)"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})" if self.spark else f"xor({a}, {b})"

    def array(self, values) -> str:
        """A literal array of strings."""
        items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        return f"array({items})" if self.spark else f"[{items}]"

    def map(self, array: str, value: str) -> str:
        return f"transform({array}, x -> {value})" if self.spark else f"list_transform({array}, lambda x: {value})"

    def largest(self, array: str) -> str:
        return f"array_max({array})" if self.spark else f"list_max({array})"

    def smallest(self, array: str) -> str:
        return f"array_min({array})" if self.spark else f"list_min({array})"

    def shift(self, value: str, bits: int) -> str:
        return f"shiftright({value}, {bits})" if self.spark else f"(({value}) >> {bits})"

    def code_points(self, text: str) -> str:
        """The code points of a text in order."""
        if self.spark:
            return f"transform(CASE WHEN length({text}) > 0 THEN sequence(1, length({text})) ELSE array() END, i -> CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
        return f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT))"

    def fold(self, array: str, start: str, step: str) -> str:
        """Left fold with accumulator ``acc`` and element ``x``."""
        if self.spark:
            return f"aggregate({array}, CAST({start} AS BIGINT), (acc, x) -> {step})"
        return f"list_reduce(list_prepend(CAST({start} AS BIGINT), {array}), lambda acc, x: {step})"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.spark else f"sha256({text})"


SPARK, DUCK = Dialect(True), Dialect(False)
