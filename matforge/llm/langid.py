"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces (forward algorithm); a text's is the product
over its words. The language with the highest posterior wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.llm.vocabulary import MARK, byte_trie, default_path, in_parts, longest_piece, occurrences, pieces, zipf_scores
from matforge.llm.words import chunks, crc_mod, utf8

UNKNOWN = "und"
#: Documents that a model is fitted on, at most about this many (chosen by a hash of their id in each language).
TRAIN_DOCS = 20_000
#: Languages at most; a model has a column for each.
MOST_LANGUAGES = 2000
#: Expected counts are summed as whole numbers of this unit, so that no order of addition matters.
UNIT = 1 << 20
#: Words worked on together at most, and what their arrays may hold: bytes of the words, numbers of the tables.
BLOCK, CELLS, NUMBERS = 1 << 14, 1 << 23, 1 << 22
#: A forward value at byte j is held times SCALE^j, and every RESCALE bytes times a power of two, which keeps it inside a double.
SCALE, RESCALE = 256.0, 32
#: A part of more bytes, in which pieces overlap all along, is summed by itself.
OVERLAPPING = 1024


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    #: piece probabilities [piece, language]
    probability: np.ndarray
    vocabulary: str


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Walk:
    """Marked words by falling length, and where the vocabulary's pieces fit in them."""

    def __init__(self, words: list[bytes], vocabulary: str):
        self.moves, self.ends = byte_trie(vocabulary)
        self.single = pieces(vocabulary)[1]
        self.reach = longest_piece(vocabulary)
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.longest = int(self.lengths[0])
        self.grid = np.zeros((len(words), self.longest), dtype=np.uint8)
        self.grid[np.arange(self.longest) < self.lengths[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)

    def beyond(self, i: int) -> int:
        """How many words, the first ones, have more than ``i`` bytes."""
        return int(np.searchsorted(-self.lengths, -i, side="left"))

    def at(self, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, piece ids) of the pieces and byte pieces that begin at byte ``i``, by length."""
        rows = np.arange(self.beyond(i))
        yield 1, rows, self.single[self.grid[rows, i]]
        node, step = np.zeros(len(rows), dtype=np.int32), 0
        while len(rows):
            node = self.moves[node, self.grid[rows, i + step]]
            step += 1
            fits = node > 0
            rows, node = rows[fits], node[fits]
            piece = self.ends[node]
            whole = piece >= 0
            if whole.any():
                yield step, rows[whole], piece[whole]
            on = self.lengths[rows] > i + step
            rows, node = rows[on], node[on]


def blocks(marked: list[bytes], vocabulary: str, per_word: int, per_byte: int = 0) -> Iterator[tuple[np.ndarray, Walk]]:
    """Blocks of marked words by falling length: their places and the walk over them.

    ``per_word`` and ``per_byte`` are the numbers that the caller's tables take for a word and for each of its bytes.
    """
    lengths = np.array([len(w) for w in marked], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        size = max(1, min(BLOCK, CELLS // longest, NUMBERS // (per_word + per_byte * longest)))
        own = order[at : at + size]
        yield own, Walk([marked[k] for k in own], vocabulary)
        at += size


def log_likelihoods(words: list[bytes], probability: np.ndarray, vocabulary: str) -> np.ndarray:
    """Natural log probability of each word in each language, over all segmentations.

    Only the forward values that a piece can still reach back to are held. Long words go in parts that no piece reaches across, whose
    probabilities multiply; a part in which pieces overlap all along, by itself. So the cost of a byte does not grow with its word.
    """
    languages, width = probability.shape[1], longest_piece(vocabulary) + 1
    parts, of = in_parts([MARK.encode() + w for w in words], vocabulary)
    out = np.zeros((len(parts), languages))
    short = [k for k, w in enumerate(parts) if len(w) <= OVERLAPPING]
    for k in set(range(len(parts))) - set(short):
        out[k] = overlapping_likelihood(parts[k], probability, vocabulary)
    for own, walk in blocks([parts[k] for k in short], vocabulary, width * languages):
        own = np.array(short)[own]
        n = len(own)
        forward, exponent = np.zeros((width, n, languages)), np.zeros((n, languages))
        forward[0] = 1.0
        for i in range(walk.longest + 1):
            here = forward[i % width]
            on, ended = walk.beyond(i), walk.beyond(i - 1)
            out[own[on:ended]] = np.log(here[on:ended]) + exponent[on:ended] * np.log(2) - i * np.log(SCALE)
            if not on:
                break
            if i and i % RESCALE == 0:
                power = np.frexp(here[:on])[1]
                forward[:, :on] = np.ldexp(forward[:, :on], -power)
                exponent[:on] += power
            for length, rows, piece in walk.at(i):
                forward[(i + length) % width][rows] += here[rows] * probability[piece] * SCALE**length
            here[:] = 0.0
    return np.stack([np.bincount(of, weights=column, minlength=len(words)) for column in out.T], axis=1) if languages else np.zeros((len(words), 0))


def overlapping_likelihood(word: bytes, probability: np.ndarray, vocabulary: str) -> np.ndarray:
    """Natural log probability of one long word in each language, byte by byte over the pieces that occur in it."""
    raw = np.frombuffer(word, dtype=np.uint8)
    begin, length, piece = occurrences(raw, vocabulary)
    begin, length, piece = (np.concatenate(x) for x in ((begin, np.arange(len(raw))), (length, np.ones(len(raw), np.int64)), (piece, pieces(vocabulary)[1][raw])))
    by = np.argsort(begin, kind="stable")
    first = np.searchsorted(begin[by], np.arange(len(raw) + 1)).tolist()
    end, width = (begin + length)[by].tolist(), longest_piece(vocabulary) + 1
    out = np.zeros(probability.shape[1])
    for language in range(len(out)):
        chance = (probability[piece[by], language] * SCALE ** length[by]).tolist()
        forward, exponent = [0.0] * (len(raw) + width), 0
        forward[0] = 1.0
        for i in range(len(raw)):
            here = forward[i]
            for k in range(first[i], first[i + 1]):
                forward[end[k]] += here * chance[k]
            if i % RESCALE == 0:
                power = np.frexp(forward[i + 1])[1].item()
                forward[i + 1 : i + width] = [x * 2.0**-power for x in forward[i + 1 : i + width]]
                exponent += power
        out[language] = np.log(forward[len(raw)]) + exponent * np.log(2) - len(raw) * np.log(SCALE)
    return out


def expected_counts(words: list[bytes], weight: np.ndarray, probability: np.ndarray, vocabulary: str) -> np.ndarray:
    """Expected piece counts [piece, language] of weighted words [word, language], one E step.

    Long words go in parts as in :func:`log_likelihoods`; here a part in which pieces overlap all along is cut every ``OVERLAPPING`` bytes.
    """
    parts, of = in_parts([MARK.encode() + w for w in words], vocabulary)
    cut = [[p[i : i + OVERLAPPING] for i in range(0, len(p), OVERLAPPING)] for p in parts]
    words, weight = [p for ps in cut for p in ps], weight[np.repeat(of, [len(ps) for ps in cut])]
    out = np.zeros((len(probability), weight.shape[1]))
    width = longest_piece(vocabulary) + 1
    for own, walk in blocks(words, vocabulary, 4, 3):
        n = len(own)
        forward, backward = np.zeros((walk.longest + 1, n)), np.zeros((walk.longest + 1, n))
        # powers of two taken out: of the values that the next steps read, and of each forward value as it was left
        taken, left, back = np.zeros(n, dtype=np.int64), np.zeros(forward.shape, dtype=np.int64), np.zeros(n, dtype=np.int64)

        def rescale(values: np.ndarray, powers: np.ndarray, i: int, on: int) -> None:
            power = np.frexp(values[i, :on])[1]
            values[i : i + width, :on] = np.ldexp(values[i : i + width, :on], -power)
            powers[:on] += power

        forward[0], backward[walk.lengths, np.arange(n)] = 1.0, 1.0
        for i in range(walk.longest):
            on = walk.beyond(i)
            if i and i % RESCALE == 0:
                rescale(forward, taken, i, on)
            left[i, :on] = taken[:on]
            for length, rows, piece in walk.at(i):
                forward[i + length][rows] += forward[i][rows] * probability[piece] * SCALE**length
        total = forward[walk.lengths, np.arange(n)]
        for i in range(walk.longest - 1, -1, -1):
            for length, rows, piece in walk.at(i):
                gain = probability[piece] * SCALE**length * backward[i + length][rows]
                backward[i][rows] += gain
                share = np.ldexp(forward[i][rows] * gain / total[rows], left[i][rows] + back[rows] - taken[rows])
                np.add.at(out, piece, share[:, None] * weight[own[rows]])
            if i and i % RESCALE == 0:
                rescale(backward, back, i, walk.beyond(i))
    return out


def row_limit(sizes: list[int], rows: int) -> float:
    """The most rows that each language may give so that together they give ``rows`` at most (one each at least)."""
    left, limit = float(rows), 1.0
    for k, n in enumerate(sorted(sizes)):
        limit = max(1.0, left / (len(sizes) - k))
        if n > limit:
            return limit
        left -= n
    return float(max(sizes))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on rows whose crc32(id) mod 5 is not 0 and whose language is not null.

    At most about ``train_docs`` of them, chosen by a hash of the id, language by language: all rows of a
    language that has few, equally many of the others, and always the row of the least hash, so every
    labelled language is fitted at every size. One expectation step from Zipf probabilities. Tasks send expected counts per (language, piece), which Spark sums: what
    reaches the driver is bounded by the vocabulary times the languages. No usable row gives a
    model without languages, which answers ``und`` throughout.
    """
    vocabulary = vocabulary or default_path()
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0))
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    found = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("first")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError("the language column holds more values than there are languages")
    sizes = {r["lang"]: r["n"] for r in found}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros(0), np.zeros((0, 0)), vocabulary)
    if sum(sizes.values()) > train_docs:
        limit, top = row_limit(list(sizes.values()), train_docs), (1 << 63) - 1
        up_to = [(r["lang"], top if r["n"] <= limit else max(int(limit / r["n"] * top), r["first"])) for r in found]
        up_to = docs.sparkSession.createDataFrame(up_to, "lang string, up_to long")
        train = train.join(F.broadcast(up_to), "lang").filter(hashed <= F.col("up_to"))
    start = np.exp(zipf_scores(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: k for k, lang in enumerate(languages)}
        total = np.zeros((len(start), len(languages)))
        for part in chunks(batches, "text"):
            lang = np.array([place[x] for x in part.column("lang").to_pylist()])
            split = [t.split() for t in utf8(part.column("text"))]
            flat = [w for ws in split for w in ws]
            if not flat:
                continue
            codes, distinct = pd.factorize(np.array(flat, dtype=object))
            word_lang = np.repeat(lang, [len(ws) for ws in split])
            weight = np.bincount(codes * len(languages) + word_lang, minlength=len(distinct) * len(languages)).reshape(len(distinct), -1)
            total += expected_counts(list(distinct), weight.astype(float), start, vocabulary)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(np.rint(total[piece, lang] * UNIT).astype(np.int64))], ["piece", "lang", "units"])

    sums = train.select("text", "lang").mapInArrow(count, "piece int, lang int, units long").groupBy("piece", "lang").agg(F.sum("units").alias("units")).toPandas()
    counts = np.zeros((len(start), len(languages)))
    counts[sums["piece"], sums["lang"]] = sums["units"] / UNIT
    # a hundredth of the mass follows the common prior, so that no piece is impossible anywhere
    probability = 0.99 * counts / np.maximum(counts.sum(axis=0), 1e-9) + 0.01 * start[:, None]
    prior = np.array([sizes[x] for x in languages], dtype=float)
    return Model(languages, np.log(prior / prior.sum()), probability, vocabulary)


def predict(texts: list[bytes | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; ``und`` and 0 for null texts and those without a letter."""
    split = [t.split() if t else [] for t in texts]
    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    flat = [w for ws in split for w in ws]
    if not flat or not model.languages:
        return labels, scores
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    per_word = log_likelihoods(list(distinct), model.probability, model.vocabulary)
    text_of = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
    logs = np.stack([np.bincount(text_of, weights=per_word[codes, k], minlength=len(texts)) for k in range(len(model.languages))], axis=1) + model.log_prior
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    for k, text in enumerate(texts):
        if has_letter(text):
            labels[k], scores[k] = model.languages[best[k]], odds[k, best[k]]
    return labels, scores


def _shared(df: DataFrame, model: Model):
    """The model as a broadcast value; its size is bounded by vocabulary x languages x 8 bytes."""
    if model.probability.nbytes > 1 << 30:
        raise ValueError("more languages than a broadcast model allows")
    return df.sparkSession.sparkContext.broadcast(model)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text, row by row without a shuffle.

    Null texts, and texts without a letter, are ``und`` with score 0; the posterior of the best
    language is the score otherwise. Null ids count as the empty text for ``held_out``. Repeated
    rows are answered alike, ties go to the first language by name, an empty table gives no rows.
    """
    shared = _shared(df, model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            labels, scores = predict(utf8(part.column("text")), shared.value)
            ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(crc_mod(ids, 5) == 0), pa.array(labels, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(answer, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with a posterior of ``least`` or more, with their own columns.

    Rows with null texts, or texts without a letter, go (``und``). Repeated rows are kept or dropped alike, null ids
    do not matter, an empty table gives no rows.
    """
    shared = _shared(df, model)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            labels, scores = predict(utf8(part.column(text_col)), shared.value)
            yield part.filter(pa.array((np.array(labels, dtype=object) != UNKNOWN) & (scores >= least), pa.bool_()))

    return df.mapInArrow(select, df.schema)
