"""Language-model scores by prediction by partial matching over bytes.

A text is read as its lower-cased words (A-Z only), a space after each, and an end mark. The context of a byte is all of
its word so far; if that context has not seen the byte, an escape is paid and the last two bytes are asked, then the
last one, then none, and at last all bytes are alike. At each step the bytes that a longer context has seen are
excluded. A context's escape has the probability that its symbols give up: ``DISCOUNT`` of an occurrence each, and
``CERTAIN`` where the context has seen one symbol only. Counts come from training texts (pretrained mode) or from the text
itself (adaptive mode). Probabilities of all tokens, seen or not, sum to one.

Contexts begin with the word, so a token's probability is the same wherever it stands. The trie of all words is
therefore walked once per distinct token: tokens are range-partitioned and sorted, which lists the trie depth-first, and
a task walks its stretch level by level in arrays. Only the nodes above the cuts between stretches belong to several
tasks; their counts (a path of at most ``CUT_BYTES`` nodes per cut) are added up first. So the trie grows with
the corpus, while no task and no broadcast holds it. The two-byte contexts are a table of at most 256^3 counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matforge.llm.words import chunks, stretches, utf8, word_hashes
from matforge.runtime import materialise

#: The end mark and the mark behind each word; neither is ever part of a word.
END, SPACE = b"\t", b" "
#: Occurrences that the symbols of a context give up for its escape: each of several, and an only one.
DISCOUNT, CERTAIN = 0.5, 0.1
#: Bytes of text that a task reads at once.
STEP_BYTES = 2 << 20
#: The same where tokens are counted; tokens that a task holds before it adds them up, and names before it sends them on, so many at once.
COUNTED_BYTES = 1 << 20
HELD_TOKENS, HELD_NAMES, SENT_TOKENS = 1 << 19, 1 << 18, 1 << 15
#: Tokens in a stretch of the trie, at least, before another stretch is made; sampled tokens per stretch; bytes of a cut.
STRETCH_TOKENS, SAMPLED, CUT_BYTES = 1 << 20, 64, 64
#: Bytes of distinct tokens in a stretch, about: a task holds some 60 bytes for each.
STRETCH_BYTES = 4 << 20
#: A word is common if it makes up at least this share of all tokens: at most 100,000 words are.
COMMON_SHARE = 1 / 100_000
#: Postings of rare words in a bucket, on average; buckets' tasks at most (a task takes one after the other).
BUCKET_POSTINGS, MOST_TASKS = 1 << 22, 20_000
#: Postings that a task holds before it sends them on, some 70 bytes each while they are dealt.
HELD_POSTINGS = 1 << 20
#: Stands for the training count where a key is a model's code, not a word.
NO_WORD = -1
#: Texts whose sums travel in one row.
SUM_BITS = 9
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(text: bytes | None) -> list[bytes]:
    """The text's words, and the end mark."""
    return [*(text or b"").lower().split(), END]


def spelt(word: bytes) -> bytes:
    """What the model codes for a word or the end mark."""
    return word if word == END else word + SPACE


# --- contexts of two bytes and less


def after_escape(seen: np.ndarray, short: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probability of each symbol once a context has been escaped, [context, symbol].

    ``seen``: what the context has seen, which is excluded; ``short``: counts in its shorter context;
    ``below``: the same probability one level down. Levels nest (what a context has seen, its
    shorter context has seen too), so nothing else needs to be known.
    """
    free = np.where(seen, 0, short)
    total, kinds = free.sum(axis=1, keepdims=True), (free > 0).sum(axis=1, keepdims=True)
    # without a symbol that the shorter context lacks as well, nothing is set aside for an escape
    off = given_up(kinds) * (below.sum(axis=1, keepdims=True) > 0)
    escape = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
    return np.where(seen, 0.0, np.where(short > 0, (free - off) / np.maximum(total, 1), escape * below))


def given_up(kinds: np.ndarray) -> np.ndarray:
    """What each of a context's symbols gives up, by how many the context has seen."""
    return np.where(kinds == 1, CERTAIN, DISCOUNT)


@dataclass(frozen=True)
class Short:
    """Counts of two-byte contexts [context, symbol], probabilities after their escape, and log10 probabilities."""

    counts: np.ndarray
    below: np.ndarray
    log10: np.ndarray

    def __post_init__(self) -> None:
        """Per context: its count, how many symbols it has seen, and whether it lacks any that a shorter one may give."""
        object.__setattr__(self, "total", self.counts.sum(axis=1, dtype=np.float64))
        object.__setattr__(self, "kinds", (self.counts > 0).sum(axis=1))
        object.__setattr__(self, "open", self.below.sum(axis=1) > 0)


def short_contexts(codes: np.ndarray, n: np.ndarray) -> Short:
    """Tables from counts of runs of three bytes; a position before a word's start counts as a space."""
    counts = np.zeros((1 << 16, 256), dtype=np.float32)
    counts.ravel()[codes] = n
    one = counts.reshape(256, 256, 256).sum(axis=0, dtype=np.float64)
    none = one.sum(axis=0, keepdims=True)
    lowest = np.where(none > 0, 0.0, 1.0 / max(1, int((none == 0).sum())))
    below_one = after_escape(one > 0, none, lowest)
    below, log10 = np.empty_like(counts), np.empty_like(counts)
    nothing = np.zeros((256, 256), dtype=bool)
    for first in range(256):  # the contexts that share their first byte, by their second
        own = slice(first << 8, (first + 1) << 8)
        below[own] = after_escape(counts[own] > 0, one, below_one)
        log10[own] = np.log10(np.maximum(after_escape(nothing, counts[own], below[own]), 1e-30))
    return Short(counts, below, log10)


class Tokens:
    """Sorted tokens as they are spelt, in one row of bytes, with the two-byte context of every byte."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        before = np.full((2, len(self.flat)), SPACE[0], dtype=np.int64)
        for back in (1, 2):
            before[back - 1, back:] = self.flat[:-back]
            for k in range(back):
                before[back - 1, (self.begins + k)[self.sizes > k]] = SPACE[0]
        self.context = before[1] * 256 + before[0]


@dataclass
class Level:
    """The trie's nodes at one depth that some token of the stretch goes on from."""

    rows: np.ndarray  # tokens that go on
    child: np.ndarray  # each token's child, as a number
    node: np.ndarray  # each child's node
    byte: np.ndarray  # each child's byte
    n: np.ndarray  # each child's training count
    shared: dict[int, bytes]  # nodes that other stretches have too: number and beginning


def levels(tokens: Tokens, trained: np.ndarray, cuts: tuple[bytes | None, bytes | None]) -> Iterator[Level]:
    """Level by level from the root; ``cuts``: where the stretch begins and where the next one does."""
    rows, node, depth = np.arange(len(tokens.sizes)), np.zeros(len(tokens.sizes), dtype=np.int64), 0
    while len(rows):
        byte = tokens.flat[tokens.begins[rows] + depth]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        at = np.flatnonzero(new)
        child = np.cumsum(new) - 1
        shared = {}
        # tokens are sorted, so what lies on the path to the lower cut comes first, to the upper one last
        for cut, row in zip(cuts, (0, -1), strict=True):
            if cut is not None and len(cut) >= depth and tokens.flat[tokens.begins[rows[row]] :][:depth].tobytes() == cut[:depth]:
                shared[int(node[row])] = cut[:depth]
        yield Level(rows, child, node[at], byte[at], np.add.reduceat(trained[rows], at), shared)
        depth += 1
        on = tokens.sizes[rows] > depth
        if depth > CUT_BYTES:  # a token that is alone below has one way to go on: see alone_from
            on &= np.bincount(child)[child] > 1
        rows, node = rows[on], child[on]
        if len(node):
            node = np.cumsum(np.concatenate(([0], node[1:] != node[:-1])))


def alone_from(tokens: Tokens) -> np.ndarray:
    """Where each token's nodes are no other token's any more: one byte after what it shares with its neighbours, beyond all cuts.

    From there on each context has seen one symbol, as often as the token. So the trie is walked as deep as different tokens agree,
    not as deep as the longest one reaches.
    """
    n = len(tokens.sizes)
    shared, same, at = np.zeros(n + 1, dtype=np.int64), np.arange(1, n), 0
    while len(same):
        same = same[np.minimum(tokens.sizes[same], tokens.sizes[same - 1]) > at]
        same = same[tokens.flat[tokens.begins[same] + at] == tokens.flat[tokens.begins[same - 1] + at]]
        at += 1
        shared[same] = at
    return np.maximum(np.maximum(shared[:-1], shared[1:]) + 1, CUT_BYTES + 1)


def token_costs(tokens: Tokens, trained: np.ndarray, short: Short, cuts: tuple[bytes | None, bytes | None] = (None, None), common: dict[bytes, dict[int, int]] | None = None) -> np.ndarray:
    """log10 probability of each token. ``common``: the children's counts of nodes that several stretches have."""
    plain = np.concatenate(([0.0], np.cumsum(short.log10[tokens.context, tokens.flat], dtype=np.float64)))
    ends = tokens.begins + tokens.sizes
    cost = np.zeros(len(tokens.sizes))
    inside = np.ones(len(tokens.sizes), dtype=bool)  # tokens whose path is in the trie so far
    for depth, level in enumerate(levels(tokens, trained, cuts)):
        nodes = int(level.node[-1]) + 1
        n, seen = level.n.astype(np.float64), level.n > 0
        context = np.zeros(nodes, dtype=np.int64)
        context[level.node[level.child]] = tokens.context[tokens.begins[level.rows] + depth]
        total, kinds = np.bincount(level.node, weights=n, minlength=nodes), np.bincount(level.node, weights=seen, minlength=nodes)
        barred = np.bincount(level.node, weights=short.counts[context[level.node], level.byte] * seen, minlength=nodes)
        for k, prefix in level.shared.items():
            children = (common or {}).get(prefix, {})
            own = np.flatnonzero(level.node == k)
            n[own] = [children.get(int(b), 0) for b in level.byte[own]]
            total[k], kinds[k] = sum(children.values()), len(children)
            barred[k] = sum(float(short.counts[context[k], b]) for b in children)
        off = given_up(kinds) * (kinds < 256)
        here = inside[level.rows]
        rows, child = level.rows[here], level.child[here]
        of = level.node[child]
        hit = n[child] > 0
        cost[rows[hit]] += np.log10((n[child] - off[of])[hit] / total[of][hit])
        lost, k = rows[~hit], of[~hit]
        if len(lost):
            where, byte = context[k], tokens.flat[tokens.begins[lost] + depth]
            free, others = short.total[where] - barred[k], short.kinds[where] - kinds[k]
            less = given_up(others) * short.open[where]
            met = short.counts[where, byte].astype(np.float64)
            chance = np.where(free > 0, np.where(met > 0, met - less, less * others * short.below[where, byte]) / np.maximum(free, 1), short.below[where, byte])
            escape = np.where(total[k] > 0, off[k] * kinds[k] / np.maximum(total[k], 1), 1.0)
            after = tokens.begins[lost] + depth + 1
            cost[lost] += np.log10(np.maximum(escape * chance, 1e-30)) + plain[ends[lost]] - plain[after]
            inside[lost] = False
        if not inside.any():
            break
    rest = np.maximum(tokens.sizes - alone_from(tokens), 0)
    own = inside & (rest > 0)
    cost[own] += rest[own] * np.log10(1 - CERTAIN / trained[own])
    return cost


def adaptive_score(text: bytes | None) -> float:
    """log10 probability of one text whose counts grow as it is read, from none at all."""
    seen: dict[tuple, dict[int, int]] = {}
    total = 0.0
    for word in words_of(text):
        token = spelt(word)
        for at, symbol in enumerate(token):
            last = (SPACE * 2 + token[:at])[-2:]
            contexts = [("word", token[:at]), last, last[1:], b""]
            excluded: set[int] = set()
            chance = 1.0
            for context in contexts:
                node = {s: c for s, c in seen.get((context,), {}).items() if s not in excluded}
                n, kinds = sum(node.values()), len(node)
                off = (CERTAIN if kinds == 1 else DISCOUNT) if len(excluded) + kinds < 256 else 0.0
                if symbol in node:
                    chance *= (node[symbol] - off) / n
                    break
                if kinds:
                    chance *= off * kinds / n
                    excluded |= node.keys()
            else:
                chance /= 256 - len(excluded)
            total += np.log10(chance)
            for context in contexts:
                node = seen.setdefault((context,), {})
                node[symbol] = node.get(symbol, 0) + 1
    return total


def score_adaptively(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of every whole text, each coded from its own counts alone, without a shuffle.

    Null texts are empty: one end token. Null ids stay null, repeated rows are scored alike, an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            texts = utf8(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array([adaptive_score(t) for t in texts], pa.float64())], ["doc_id", "n_tokens", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")


# --- over a corpus


def is_held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids.to_pylist()], dtype=bool)


def summed_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, trained and everywhere of the texts' tokens, added up as far as ``HELD_TOKENS`` and ``HELD_NAMES`` let them be."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def add_up() -> None:
        at, names = pd.factorize(np.concatenate([h[0] for h in held]))
        held[:] = [(names, *(np.bincount(at, weights=np.concatenate([h[k] for h in held]), minlength=len(names)) for k in (1, 2)))]

    def flush() -> Iterator[pa.RecordBatch]:
        add_up()
        names, *sums = held.pop()
        for k in range(0, len(names), SENT_TOKENS):
            own = slice(k, k + SENT_TOKENS)
            yield pa.RecordBatch.from_arrays([pa.array([spelt(w) for w in names[own]], pa.binary()), *(pa.array(s[own].astype(np.int64)) for s in sums)], ["token", "trained", "everywhere"])

    for part in chunks(batches, "text", COUNTED_BYTES):
        split = [words_of(t) for t in utf8(part.column("text"))]
        train = np.repeat(~is_held_out(part.column("doc_id")), [len(ws) for ws in split])
        flat = np.empty(len(train), dtype=object)
        flat[:] = [w for ws in split for w in ws]
        at, names = pd.factorize(flat)
        held.append((names, np.bincount(at, weights=train, minlength=len(names)), np.bincount(at, minlength=len(names)).astype(np.float64)))
        rows += len(names)
        if rows > HELD_TOKENS:
            add_up()
            rows = len(held[0][0])
            if rows > HELD_NAMES:
                yield from flush()
                rows = 0
    if held:
        yield from flush()


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (as it is spelt), trained (count in training texts) and everywhere (count in all texts).

    A task adds up its own tokens first.
    """
    parts = docs.mapInArrow(summed_tokens, "token binary, trained long, everywhere long")
    return parts.groupBy("token").agg(F.sum("trained").alias("trained"), F.sum("everywhere").alias("everywhere"))


def _stretch_cuts(counts: DataFrame, kinds: int) -> list[bytes]:
    """Beginnings of the stretches but the first, of about equal bytes, from a sample of the distinct tokens (bounded by their number)."""
    size = counts.agg(F.coalesce(F.sum(F.length("token")), F.lit(0))).first()[0]
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kinds // STRETCH_TOKENS), -(-size // STRETCH_BYTES))
    every = max(1, kinds // (parts * SAMPLED))
    sample = counts.filter(F.pmod(F.xxhash64("token"), F.lit(every)) == 0).select(F.substring("token", 1, CUT_BYTES).alias("token"), F.length("token").alias("size"))
    rows = sorted((bytes(r["token"]), r["size"]) for r in sample.collect())
    upto = np.cumsum([0, *(size for _, size in rows)])
    places = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts, side="left")
    return sorted({rows[k][0] for k in places if 0 < k < len(rows)})


def _in_stretches(counts: DataFrame, cuts: list[bytes]) -> DataFrame:
    """The tokens dealt by stretch and sorted."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [bisect_right(cuts, t) for t in batch.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], [*batch.schema.names, "stretch"])

    placed = counts.mapInArrow(place, "token binary, trained long, everywhere long, stretch int")
    return placed.repartitionById(len(cuts) + 1, "stretch").sortWithinPartitions("token").select("token", "trained", "everywhere")


def _whole_stretch(batches: Iterator[pa.RecordBatch], cuts: list[bytes]) -> tuple[pa.Table, Tokens, np.ndarray, tuple[bytes | None, bytes | None]] | None:
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return None
    tokens = table.column("token").to_pylist()
    k = bisect_right(cuts, tokens[0])
    return table, Tokens(tokens), table.column("trained").to_numpy(), (cuts[k - 1] if k else None, cuts[k] if k < len(cuts) else None)


def price_tokens(counts: DataFrame, kinds: int) -> DataFrame:
    """hash, trained, everywhere and log10 probability of each distinct token of ``counts`` (a written table)."""
    cuts = _stretch_cuts(counts, kinds)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole_stretch(batches, cuts)
        if whole is None:
            return
        _, tokens, trained, own = whole
        codes, at = np.unique(tokens.context * 256 + tokens.flat, return_inverse=True)
        n = np.bincount(at, weights=np.repeat(trained, tokens.sizes)).astype(np.int64)
        names = [b""] * len(codes)
        codes, n = codes.tolist(), n.tolist()
        for depth, level in enumerate(levels(tokens, trained, own)):
            for k, prefix in level.shared.items():
                for b, count in zip(level.byte[level.node == k].tolist(), level.n[level.node == k].tolist(), strict=True):
                    names.append(prefix + bytes([b]))
                    codes.append(-1)
                    n.append(count)
            if depth >= CUT_BYTES:
                break
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["path", "code", "n"])

    # at most 256^3 runs, and CUT_BYTES * 256 children per cut
    sums = _in_stretches(counts, cuts).mapInArrow(gather, "path binary, code long, n long").groupBy("path", "code").agg(F.sum("n").alias("n")).filter("n > 0").toArrow()
    code, n = sums.column("code").to_numpy(), sums.column("n").to_numpy()
    common: dict[bytes, dict[int, int]] = {}
    for path, count in zip(sums.column("path").filter(pa.array(code < 0)).to_pylist(), n[code < 0].tolist(), strict=True):
        common.setdefault(path[:-1], {})[path[-1]] = count
    shared = counts.sparkSession.sparkContext.broadcast((code[code >= 0], n[code >= 0], common))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole_stretch(batches, cuts)
        if whole is None:
            return
        table, tokens, trained, own = whole
        codes, n, common = shared.value
        cost = token_costs(tokens, trained, short_contexts(codes, n), own, common)
        names = word_hashes([t if t == END else t[:-1] for t in table.column("token").to_pylist()]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(trained), table.column("everywhere").combine_chunks(), pa.array(cost)], ["hash", "trained", "everywhere", "cost"])

    return _in_stretches(counts, cuts).mapInArrow(price, "hash long, trained long, everywhere long, cost double")


def _pack(keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> tuple[list[int], list[list[bytes]]]:
    """Columns cut by the bucket of their keys: the buckets, and each column's parts."""
    bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return bucket[order][np.concatenate(([0], cuts))].tolist(), [[x.tobytes() for x in np.split(c[order], cuts)] for c in columns]


def hash_tokens(counts: DataFrame) -> DataFrame:
    """The columns of ``price_tokens`` at no price, for a model that does not go by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = word_hashes([t if t == END else t[:-1] for t in batch.column("token").to_pylist()]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), batch.column("trained"), batch.column("everywhere"), pa.array(np.zeros(len(names)))], ["hash", "trained", "everywhere", "cost"])

    return counts.mapInArrow(run, "hash long, trained long, everywhere long, cost double")


class Model(Protocol):
    """A model whose price of a text is a sum over codes: what each byte adds, by a number that it has in all texts."""

    def fit(self, docs: DataFrame) -> DataFrame:
        """code, everywhere (how often it occurs) and cost of all codes of the documents."""

    def common(self, priced: DataFrame) -> tuple[Column, int]:
        """Which codes are looked up in a broadcast, and how often all others occur."""

    def codes_of(self, split: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes of texts, given as words and end marks, and the place of each one's text."""

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The codes spread over all 64-bit numbers, each its own."""


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    ``score`` is the log10 probability under the model fitted on the texts whose crc32(id) mod 10 is not 0,
    ``base_score`` that of smoothed word frequencies from the same texts. Common words (a share of
    ``COMMON_SHARE`` or more of all tokens, so a bounded number) are looked up in a broadcast; every other
    word meets its count and probability in a shuffle on its hash, in which no word has more than that share. Words are
    counted and priced by their bytes; only this last lookup goes by 64-bit hashes (the chance that any two of
    ten million distinct words meet is below 1 in 300,000).

    ``model`` gives ``score`` in place of the words' trie; its codes take the same two ways, and no code is another's.

    Null texts are empty: one end token. Null ids count as the empty text for ``held_out`` and stay null.
    Rows with one id are scored apart. An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = materialise(count_tokens(docs), "tokens")
    whole = counts.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.when(F.col("trained") > 0, 1)), F.coalesce(F.sum("everywhere"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, train_kinds, tokens, kinds = whole
    priced = materialise(price_tokens(counts, kinds) if model is None else hash_tokens(counts), "priced")
    norm = float(np.log10(train_tokens + 0.1 * (train_kinds + 1)))
    is_common = F.col("everywhere") >= max(1.0, tokens * COMMON_SHARE)
    common = priced.filter(is_common).toPandas().sort_values("hash")
    shared = spark.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("hash", "trained", "cost")))
    coded, rare_codes = None, 0
    if model is not None:
        coded = materialise(model.fit(docs), "codes")
        is_often, rare_codes = model.common(coded)
        often = coded.filter(is_often).select("code", "cost").toArrow().sort_by("code")
        shared_codes = spark.sparkContext.broadcast((often.column("code").to_numpy(), often.column("cost").to_numpy()))

    def price_codes(split: list[list[bytes]], score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the prices of common codes to the texts' scores; the keys of all others, and each one's text."""
        names, cost = shared_codes.value
        keys, texts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for codes, of in model.codes_of(split):
            which, distinct = pd.factorize(codes)
            at = np.minimum(np.searchsorted(names, distinct), max(0, len(names) - 1))
            hit = names[at] == distinct if len(names) else np.zeros(len(distinct), bool)
            value = np.zeros(len(distinct))
            value[hit] = cost[at[hit]]
            score += np.bincount(of, weights=value[which], minlength=len(score))
            rare = ~hit[which]
            keys.append(model.keys(distinct)[which[rare]])
            texts.append(of[rare])
        return np.concatenate(keys), np.concatenate(texts)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trained, cost = shared.value
        for part in chunks(batches, "text", STEP_BYTES):
            n, ids = part.num_rows, part.column("doc_id")
            split = [words_of(t) for t in utf8(part.column("text"))]
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            codes, distinct = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
            hashes = pd.util.hash_array(distinct, categorize=False).view(np.int64)
            at = np.minimum(np.searchsorted(names, hashes), max(0, len(names) - 1))
            hit = names[at] == hashes if len(names) else np.zeros(len(hashes), bool)
            values = np.zeros((3, len(distinct)))
            values[:, hit] = np.log10(trained[at[hit]] + 0.1), cost[at[hit]], trained[at[hit]] > 0
            text_of = np.repeat(np.arange(n), sizes)
            base, score, known = (np.bincount(text_of, weights=v[codes], minlength=n) for v in values)
            rare = ~hit[codes]
            keys, texts = hashes[codes[rare]], text_of[rare]
            if model is not None:
                more, more_of = price_codes(split, score)
                keys, texts = np.concatenate((keys, more)), np.concatenate((texts, more_of))
                keys = keys[np.argsort(texts, kind="stable")]
            cuts = np.cumsum(np.bincount(texts, minlength=n))[:-1]
            rest = pa.array([x.tobytes() for x in np.split(keys, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("place"), ids, pa.array(is_held_out(ids)), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), rest],
                ["place", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"],
            )

    placed = docs.withColumn("place", F.monotonically_increasing_id())
    found = materialise(placed.mapInArrow(look_up, "place long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare binary"), "scored")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(tokens + rare_codes) // BUCKET_POSTINGS))
    tasks = min(buckets, MOST_TASKS)
    dealt_schema = "bucket long, keys binary, places binary, trained binary, cost binary"

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        places: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            own, packed = _pack(key := np.frombuffer(b"".join(keys), dtype=np.int64), [key, np.concatenate(places)], buckets)
            keys.clear()
            places.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(pa.array(p, pa.binary()) for p in packed), *[pa.nulls(len(own), pa.binary())] * 2], ["bucket", "keys", "places", "trained", "cost"])

        for batch in chunks(batches, "rare", STEP_BYTES):
            raw = batch.column("rare").to_pylist()
            own = np.array([len(r) // 8 for r in raw], dtype=np.int64)
            keys += raw
            places.append(np.repeat(batch.column("place").to_numpy(), own))
            held += int(own.sum())
            if held >= HELD_POSTINGS:
                yield flush()
        if held:
            yield flush()

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, trained, cost = (batch.column(c).to_numpy() for c in ("hash", "trained", "cost"))
                own, packed = _pack(key, [key, trained, cost], buckets)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(packed[0], pa.binary()), pa.nulls(len(own), pa.binary()), *(pa.array(p, pa.binary()) for p in packed[1:])], ["bucket", "keys", "places", "trained", "cost"])

    def rare_codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = model.keys(batch.column("code").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), NO_WORD)), batch.column("cost")], ["hash", "trained", "cost"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch | None:
            join = lambda rows, c, kind: np.frombuffer(b"".join([r[c] for r in rows]), dtype=kind)
            words, texts = [r for r in held if r["places"] is None], [r for r in held if r["places"] is not None]
            held.clear()
            if not texts:
                return None
            names, trained, cost = join(words, "keys", np.int64), join(words, "trained", np.int64), join(words, "cost", np.float64)
            order = np.argsort(names)
            names, trained, cost = names[order], trained[order], cost[order]
            at = np.searchsorted(names, join(texts, "keys", np.int64))
            where, of = np.unique(join(texts, "places", np.int64), return_inverse=True)
            base, score, known = (np.bincount(of, weights=v[at], minlength=len(where)) for v in (np.log10(np.where(trained == NO_WORD, 1.0, trained + 0.1)), cost, (trained > 0).astype(float)))
            cuts = np.flatnonzero(np.diff(where >> SUM_BITS)) + 1  # neighbouring texts share a row
            packed = [pa.array([x.tobytes() for x in np.split(v, cuts)], pa.binary()) for v in (where, base, score, known.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array((where >> SUM_BITS)[np.concatenate(([0], cuts))]), *packed], ["grp", "texts", "base", "score", "known"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[-1]["bucket"] and (done := flush()) is not None:
                    yield done
                held.append(row)
        if held and (done := flush()) is not None:
            yield done

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for grp, texts, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(grp, np.zeros((1 << SUM_BITS, 4)))
                at = np.frombuffer(texts, dtype=np.int64) & ((1 << SUM_BITS) - 1)
                own[at, 0] = 1
                for k, (value, kind) in enumerate(zip(values, (np.float64, np.float64, np.int64), strict=True), 1):
                    own[at, k] += np.frombuffer(value, dtype=kind)
        for grp, own in sums.items():
            at = np.flatnonzero(own[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array((grp << SUM_BITS) + at), pa.array(own[at, 1]), pa.array(own[at, 2]), pa.array(own[at, 3].astype(np.int64))], ["place", "more_base", "more_score", "more_known"])

    rare = priced.filter(~is_common).select("hash", "trained", "cost")
    if coded is not None:
        rare = rare.unionByName(coded.filter(~is_often).select("code", "cost").mapInArrow(rare_codes_of, "hash long, trained long, cost double"))
    dealt = found.select("place", "rare").mapInArrow(postings, dealt_schema).unionByName(rare.mapInArrow(rare_words, dealt_schema))
    dealt = dealt.repartitionById(tasks, (F.col("bucket") % tasks).cast("int")).sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(add_up, "grp long, texts binary, base binary, score binary, known binary").repartition("grp")
    more = sums.mapInArrow(unpack, "place long, more_base double, more_score double, more_known long")
    out = found.drop("rare").join(more, "place", "left")
    n_known = F.col("known") + F.coalesce("more_known", F.lit(0))
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return out.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(int(train_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
