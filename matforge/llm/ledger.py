"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger is a written table that keeps the measurements and one failure bit per
rule, and names the rules it was made by; versioned policies are masks over those bits, so changing a policy, asking what
a rule costs or filtering by another policy never measures a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm.selection import staying
from matforge.llm.words import chunks, utf8
from matforge.runtime import materialise, scratch_path

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Rule names; a rule's place is its bit.
RULES = ("too_short", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length", "shouting", "one_word_dominates", "few_letters", "stutter")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_letter_bytes", "top_word", "n_stutter")
LEDGER_SCHEMA = ", ".join(["doc_id long", "text_hash long", *[f"{m} long" for m in MEASURES], "failed long"])
#: Version of the rules and their thresholds; a ledger of another version is not read.
RULES_VERSION = "rules-1"


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a text."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", ("too_short", "repeated_windows"))
POLICIES = {
    "base": BASE,
    "v1": Policy("v1", RULES),
    "lenient": Policy("lenient", ("too_short", "repeated_windows", "symbol_heavy")),
}
PRODUCTION = POLICIES["v1"]


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over consecutive stretches that end at ``ends``."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[ends]
    return np.diff(total, prepend=0)


def repeated_words(codes: np.ndarray, text_of: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """True for each word inside a window of ``window`` words that its text holds twice or more."""
    n = len(codes)
    covered = np.zeros(n + window + 1, dtype=np.int64)
    if n >= window:
        gram, width = codes.astype(np.int64), 1
        while width < window:  # codes of runs of 1, 2, 4, 8 words, exact at each doubling
            gram = pd.factorize(gram[:-width] * np.int64(gram.max() + 1) + gram[width:])[0].astype(np.int64)
            width *= 2
        whole = np.flatnonzero(text_of[: n - window + 1] == text_of[window - 1 :])
        key = pd.factorize(text_of[whole] * np.int64(gram.max() + 1) + gram[whole])[0]
        again = whole[np.bincount(key)[key] > 1] if len(key) else whole
        np.add.at(covered, again, 1)
        np.add.at(covered, again + window, -1)
    return np.cumsum(covered)[:n] > 0


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The measurements of each text; a null text measures as an empty one."""
    texts = [t or b"" for t in texts]
    split = [t.split() for t in texts]
    out = {"n_words": np.array([len(w) for w in split], dtype=np.int64)}
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    kinds = np.zeros((5, 256), dtype=np.uint8)
    kinds[0] = [(b & 0xC0) != 0x80 and b != 32 and not 9 <= b <= 13 for b in range(256)]
    kinds[1, list(SYMBOLS)] = 1
    kinds[2, 65:91] = kinds[3, 97:123] = 1
    kinds[4] = [b >= 128 or chr(b).isalpha() for b in range(256)]
    for name, kind in zip(("word_chars", "n_symbols", "n_upper", "n_lower", "n_letter_bytes"), kinds, strict=True):
        out[name] = _per_text(kind[buffer], ends) if len(buffer) else np.zeros(len(texts), dtype=np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], dtype=np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    flat = [w for ws in split for w in ws]
    text_of = np.repeat(np.arange(len(texts), dtype=np.int64), out["n_words"])
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.empty(0, np.int64)
    out["n_repeat_words"] = np.bincount(text_of, weights=repeated_words(codes, text_of), minlength=len(texts)).astype(np.int64)
    same = (codes[1:] == codes[:-1]) & (text_of[1:] == text_of[:-1])
    out["n_stutter"] = np.bincount(text_of[1:][same], minlength=len(texts))
    top = np.zeros(len(texts), dtype=np.int64)
    if flat:
        pair, first = pd.factorize(text_of * np.int64(codes.max() + 1) + codes)
        np.maximum.at(top, first // np.int64(codes.max() + 1), np.bincount(pair))
    out["top_word"] = top
    return out


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """Failure bits from the measurements. Thresholds are shares in whole numbers, so exact."""
    n, lines, letters = m["n_words"], m["n_lines"], m["n_upper"] + m["n_lower"]
    failed = (
        n < 20,
        100 * m["n_repeat_words"] > 30 * n,
        100 * m["n_symbols"] > 20 * n,
        100 * m["n_dup_lines"] > 50 * lines,
        (m["word_chars"] < 2 * n) | (m["word_chars"] > 25 * n),
        100 * m["n_upper"] > 60 * letters,
        100 * m["top_word"] > 30 * n,
        100 * m["n_letter_bytes"] < 50 * m["word_chars"],
        100 * m["n_stutter"] > 30 * n,
    )
    return sum(f.astype(np.int64) << bit for bit, f in enumerate(failed))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: its id, a hash of the text, the measurements and the failure bits.

    Works row by row on whole texts, without a shuffle. Null texts measure as empty and fail
    ``too_short``; null ids stay null; repeated rows are measured alike; an empty table gives no
    rows. Other columns are not read.
    """

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            m = measure(utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("text_hash"), *[pa.array(m[k]) for k in MEASURES], pa.array(failures(m))], ["doc_id", "text_hash", *MEASURES, "failed"])

    text = F.col(text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text")).mapInArrow(evaluate, LEDGER_SCHEMA)


def text_hash(text: Column) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def write_ledger(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure the texts, write the ledger with the version of its rules, and read it back."""
    ledger(df, id_col, text_col).withColumn("rules", F.lit(RULES_VERSION)).write.parquet(path)
    return read_ledger(df.sparkSession, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A written ledger; ``ValueError`` if it was made by other rules."""
    book = spark.read.schema(f"{LEDGER_SCHEMA}, rules string").parquet(path)
    other = book.filter(F.col("rules") != RULES_VERSION).first()
    if other:
        raise ValueError(f"{path}: made by {other['rules']}, not {RULES_VERSION}")
    return book.drop("rules")


def rejects(policy: Policy, failed: str = "failed") -> Column:
    """Whether a policy rejects a ledger row."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def ablation(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """For each rule of a policy: texts that fail it, texts only it rejects, texts kept without it.

    The ledger is first reduced to its distinct bit patterns (at most 2^rules of them), and the
    rest is arithmetic on those. Rows count whatever their id, repeated ones each; an empty ledger gives no rows.
    """
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    bit = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules]))
    rows = patterns.select("bits", "n", bit.alias("r")).select("bits", "n", "r.*")
    hit, others = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return rows.groupBy(F.lit(policy.version).alias("policy"), "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep_passing(df: DataFrame, policy: Policy = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", book: DataFrame | None = None) -> DataFrame:
    """The rows whose text the policy accepts, with their own columns, by a stored ledger of them.

    ``book`` is the ledger of these rows if there is one; else it is written to the shared folder first. Rows go by id; only where rows of one
    id, or without one, fare differently are they told apart by their texts. Null texts measure as empty, so a policy with ``too_short`` drops
    them; repeated rows are kept or dropped alike; an empty table gives no rows.
    """
    if book is None:
        book = write_ledger(df, scratch_path(df.sparkSession, "ledger"), id_col, text_col)
    marks = book.groupBy("doc_id", F.col("text_hash").alias("key")).agg(F.bool_and(~rejects(policy)).alias("stays"), F.count(F.lit(1)).alias("n"))
    return staying(df, materialise(marks, "marks"), id_col, text_hash(F.col(text_col)), once=False)
