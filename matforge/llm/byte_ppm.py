"""Prediction by partial matching over the bytes of whole texts: contexts of ``order`` bytes and less, across words.

A text is read as its lower-cased words, a space after each, and an end mark. The last ``order`` bytes are asked first (a text
begins after as many spaces); if that context has not seen the next byte, an escape is paid and the context one byte shorter is
asked, down to none, and at last all bytes are alike. At each step the bytes that the longer context has seen are excluded, and a
context's escape has the probability that its symbols give up (see ``ppm.given_up``). Probabilities of all bytes sum to one.

So a byte's probability depends on the run of ``order`` + 1 bytes that it ends. Runs are counted, dealt by the two bytes before their
last one, which all their contexts of two bytes and more end in, and priced there, each distinct run once. Contexts of one byte and none are
256^2 counts. Texts take common runs' prices (``COMMON_RUNS`` at most) from a broadcast; other runs' come through a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matforge.llm import ppm
from matforge.llm.words import chunks, mix, utf8
from matforge.runtime import materialise

#: Bytes of the longest context, and of the longest one that a run's code has room for.
ORDER, MOST_ORDER = 5, 6
#: Runs whose prices are broadcast, at most.
COMMON_RUNS = 1 << 19
#: Bytes whose runs a task holds at once, some 60 bytes of memory for each.
RUN_BYTES = 1 << 19
#: Runs that a task holds before it adds them up, and sums before it sends them on, so many at once.
HELD_RUNS, HELD_SUMS, SENT_RUNS = 1 << 20, 3 << 18, 1 << 16
#: Runs that are priced at once, about; all those after two bytes are.
PRICED_RUNS = 1 << 18


def run_codes(split: list[list[bytes]], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The run that each byte of the texts (as words and end mark) ends, as a number, and the text's place; some ``RUN_BYTES`` at once."""
    held: list[bytes] = []
    own: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = np.frombuffer(b"".join(held), dtype=np.uint8), np.array([len(h) for h in held], dtype=np.int64)
        codes = np.zeros(len(flat) - order, dtype=np.int64)
        for k in range(order + 1):
            codes <<= 8
            codes |= flat[k : len(flat) - order + k]
        inside = np.ones(len(codes), dtype=bool)  # a run over two texts' bytes is none
        inside[((np.cumsum(sizes)[:-1, None] - order) + np.arange(order)).ravel()] = False
        return codes[inside], np.repeat(np.array(own, dtype=np.int64), sizes - order)

    for k, words in enumerate(split):
        spelt = ppm.SPACE * order + ppm.SPACE.join(words)
        for at in range(order, len(spelt), RUN_BYTES):
            held.append(spelt[at - order : at + RUN_BYTES])
            own.append(k)
            size += len(held[-1])
            if size >= RUN_BYTES:
                yield flush()
                held, own, size = [], [], 0
    if held:
        yield flush()


def summed_runs(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """code, trained and everywhere of each run of the texts, added up as far as ``HELD_RUNS`` and ``HELD_SUMS`` let them be.

    A code and whether it is counted in training are one number, so counts are sorted and added up in place of being hashed: a table of
    hashes would take several times the memory of the codes.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def add_up() -> None:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        by = np.argsort(keys)
        keys, n = keys[by], n[by]
        at = _begins(keys)
        held.append((keys[at], np.add.reduceat(n, at)))

    def flush() -> Iterator[pa.RecordBatch]:
        add_up()
        keys, n = held.pop()
        at = _begins(keys >> 1)
        for k in range(0, len(at), SENT_RUNS):
            own = at[k : k + SENT_RUNS]
            end = at[k + SENT_RUNS] if k + SENT_RUNS < len(at) else len(keys)
            part, times = keys[own[0] : end], n[own[0] : end]
            sums = (np.add.reduceat(x, own - own[0]) for x in (times * (part & 1), times))
            yield pa.RecordBatch.from_arrays([pa.array(keys[own] >> 1), *map(pa.array, sums)], ["code", "trained", "everywhere"])

    for part in chunks(batches, "text", RUN_BYTES):
        train = ~ppm.is_held_out(part.column("doc_id"))
        for codes, of in run_codes([ppm.words_of(t) for t in utf8(part.column("text"))], order):
            keys = codes << 1 | train[of]
            keys.sort()
            at = _begins(keys)
            held.append((keys[at], np.diff(at, append=len(keys))))
            rows += len(at)
            if rows > HELD_RUNS:
                add_up()
                rows = len(held[0][0])
                if rows > HELD_SUMS:
                    yield from flush()
                    rows = 0
    if held:
        yield from flush()


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where each of the sorted keys begins."""
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def count_runs(docs: DataFrame, order: int) -> DataFrame:
    """code of each run, trained (count in training texts) and everywhere (count in all texts). A task adds up its own runs first."""
    parts = docs.mapInArrow(lambda batches: summed_runs(batches, order), "code long, trained long, everywhere long")
    return parts.groupBy("code").agg(F.sum("trained").alias("trained"), F.sum("everywhere").alias("everywhere"))


def run_costs(codes: np.ndarray, trained: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each distinct run's last byte after the others.

    ``codes`` holds all runs (or none) whose last byte follows the same two; ``pairs`` the training counts of each byte after each, [256, 256].
    Contexts nest: what one has seen, its shorter one has seen too.
    """
    cost, inside = np.zeros(len(codes)), np.ones(len(codes), dtype=bool)  # runs that no context asked so far has seen
    above = None
    for k in range(order, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        if k > 1:
            seen, at = np.unique(codes & mask, return_inverse=True)
            n = np.bincount(at, weights=trained, minlength=len(seen))
        else:
            seen, n = np.arange(mask + 1), (pairs.ravel() if k else pairs.sum(axis=0)).astype(np.float64)
            at = codes & mask
        contexts, of = np.unique(seen >> 8, return_inverse=True)
        total, kinds = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, weights=n > 0, minlength=len(contexts))
        context = of[at]
        free, others = total[context], kinds[context]
        if above is not None:
            longer, longer_n, longer_of, longer_kinds, longer_context = above
            barred = np.bincount(longer_of, weights=n[np.searchsorted(seen, longer & mask)] * (longer_n > 0), minlength=len(longer_kinds))
            free, others = free - barred[longer_context], others - longer_kinds[longer_context]
        off = ppm.given_up(others) * (kinds[context] < 256)
        hit = inside & (n[at] > 0)
        cost[hit] += np.log10((n[at] - off)[hit] / free[hit])
        inside &= ~hit
        paid = inside & (free > 0)
        cost[paid] += np.log10((off * others)[paid] / free[paid])
        above = seen, n, of, kinds, context
    if inside.any():
        cost[inside] -= np.log10(256 - (pairs.sum(axis=0) > 0).sum())
    return cost


def price_runs(counts: DataFrame, order: int) -> DataFrame:
    """code, everywhere and log10 probability of each run of ``counts`` (a written table)."""
    spark = counts.sparkSession
    found = counts.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("trained").alias("n"), F.count(F.lit(1)).alias("kinds")).toArrow()  # 256^2 rows at most
    pairs = np.zeros(1 << 16)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(pairs.reshape(256, 256))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(found.column("kinds").to_numpy().sum()) // (4 * PRICED_RUNS)))

    def priced(codes: np.ndarray, trained: np.ndarray, everywhere: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(everywhere), pa.array(run_costs(codes, trained, shared.value, order))], ["code", "everywhere", "cost"])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("code", "trained", "everywhere")])
            rows += batch.num_rows
            if rows >= PRICED_RUNS:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                after = _after(whole[0])
                cut = int(np.searchsorted(after, after[-1]))  # those after the last two bytes may go on
                if cut:
                    yield priced(*(x[:cut] for x in whole))
                held, rows = [[x[cut:] for x in whole]], rows - cut
        if rows:
            yield priced(*(np.concatenate(x) for x in zip(*held, strict=True)))

    after = F.shiftrightunsigned("code", 8).bitwiseAND(0xFFFF)
    dealt = counts.withColumn("after", after).repartition(tasks, "after").sortWithinPartitions("after").drop("after")
    return dealt.mapInArrow(price, "code long, everywhere long, cost double")


def _after(codes: np.ndarray) -> np.ndarray:
    return codes >> 8 & 0xFFFF


@dataclass(frozen=True)
class Runs:
    """The model as ``ppm.score_documents`` takes it."""

    order: int

    def fit(self, docs: DataFrame) -> DataFrame:
        """code, everywhere and cost of all runs of the documents."""
        return price_runs(materialise(count_runs(docs, self.order), "runs"), self.order)

    def common(self, priced: DataFrame) -> tuple[Column, int]:
        """Whether a run is common: counted so often, by quarters of powers of two, that ``COMMON_RUNS`` are at most; and how often all others occur."""
        step = F.floor(4 * F.log2("everywhere"))
        rows = sorted(priced.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("everywhere").alias("uses")).collect(), reverse=True)  # some 200 steps at most
        least, n = math.inf, 0
        for row in rows:
            n += row["n"]
            if n > COMMON_RUNS:
                break
            least = row["step"]
        return step >= F.lit(float(least)), sum(row["uses"] for row in rows if row["step"] < least)

    def codes_of(self, split: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return run_codes(split, self.order)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Runs' places among the 64-bit hashes of words, each its own."""
        return mix(codes.view(np.uint64)).view(np.int64)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The columns of ``ppm.score_documents``, ``score`` by contexts of ``order`` bytes and less across words."""
    if not 2 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 2 to {MOST_ORDER}")
    return ppm.score_documents(df, id_col, text_col, Runs(order))
