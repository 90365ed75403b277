"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

Text is marked as SentencePiece does (a word mark for each space and one in front) and cut into
marked words. The distinct words of a batch are sorted, which lists their byte trie depth-first: a word
adds only the nodes beyond its common prefix with the word before it, and every such node takes the
forward scores of its ancestors as they stand. Each trie node is thus scored once, however many words
run through it; the nodes of one depth, which do not depend on each other, are scored together in arrays.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.llm.vocabulary import MARK, WHOLE_BYTES, byte_trie, default_path, in_parts, occurrences, pieces, zipf_scores
from matforge.llm.words import chunks

#: A byte piece costs this much more than the rarest piece, so it is used only where nothing else fits.
BYTE_PENALTY = 10.0
#: Bytes of text encoded together.
STEP_BYTES = 4 << 20
#: Words up to this many bytes are searched together; longer ones with those of up to twice their length.
WIDE = 64
MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
ENCODE_SCHEMA = "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, round_trip boolean"


@functools.lru_cache(maxsize=2)
def scores(path: str) -> tuple[np.ndarray, float]:
    """Score of each piece, and the score of a byte piece."""
    by_piece = zipf_scores(path)
    return by_piece, float(by_piece.min()) - BYTE_PENALTY


@functools.lru_cache(maxsize=2)
def spelling(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' bytes in a row, and where each piece begins (with the end as a last entry)."""
    texts, single = pieces(path)
    raw = [b"" if t is None else t.encode() for t in texts]
    for b, i in enumerate(single):
        raw[int(i)] = bytes([b])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


def ragged(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat``, whose stretch k is ends[k]:ends[k+1], in a row; and their new ends."""
    sizes = np.diff(ends)[which]
    out = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(ends[:-1][which] - out[:-1], sizes) + np.arange(out[-1])], out


def encode_sorted(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of each marked word, in a row, and where each word's begin.

    ``words`` must be sorted, distinct and not empty. The best segmentation has the greatest sum of piece
    scores; of equal sums, the one whose last piece is longest.
    """
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    (moves, ends), (score, byte_score), single = byte_trie(path), scores(path), pieces(path)[1]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    longest = int(lengths.max())
    grid = np.zeros((len(words), longest), dtype=np.uint8)
    grid[np.arange(longest) < lengths[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    # bytes that each word shares with the one before it
    shared = np.zeros(len(words), dtype=np.int64)
    same, at = np.arange(1, len(words)), 0
    while len(same):
        same = same[(grid[same, at] == grid[same - 1, at]) & (np.minimum(lengths[same], lengths[same - 1]) > at)]
        at += 1
        shared[same] = at
        same = same[lengths[same] > at]
    # one entry per depth: the words that own its nodes, and each node's last piece and where that begins
    owners, last, begin = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    best = np.zeros(1)
    # vocabulary walks that are still open at the nodes of a depth, node by node and the longest first:
    # how many each node has, their places in the vocabulary's trie, where they began, and the score there
    walks, place, since, base = np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)
    for depth in range(1, longest + 1):
        own = np.flatnonzero((shared < depth) & (lengths >= depth))
        up = np.searchsorted(owners[-1], own, side="right") - 1
        byte = grid[own, depth - 1]
        # every node goes on with its parent's walks, and one more begins at the parent
        begins = np.cumsum(walks) - walks
        sizes = walks[up]
        offsets = np.cumsum(sizes + 1) - sizes - 1
        old = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(own)), sizes)
        source = np.repeat(begins[up] - (offsets - np.arange(len(own))), sizes) + np.arange(int(sizes.sum()))
        total = int(sizes.sum()) + len(own)
        node = np.repeat(np.arange(len(own)), sizes + 1)
        at_, from_, score_ = np.zeros(total, np.int32), np.full(total, depth - 1, np.int64), np.empty(total)
        at_[old], from_[old], score_[old] = place[source], since[source], base[source]
        score_[offsets + sizes] = best[up]
        at_ = moves[at_, byte[node]]
        on = at_ > 0
        node, place, since, base = node[on], at_[on], from_[on], score_[on]
        walks = np.bincount(node, minlength=len(own))
        now, piece, start = best[up] + byte_score, single[byte], np.full(len(own), depth - 1, np.int64)
        done = np.flatnonzero(ends[place] >= 0)
        if len(done):
            of, ids = node[done], ends[place[done]]
            gain = base[done] + score[ids]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            most = np.maximum.reduceat(gain, first)
            better = most > now[of[first]]
            top = np.zeros(len(own))
            top[of[first]] = most
            hit = np.flatnonzero(gain == top[of])[::-1]  # reversed: of equal ones the first is written last
            choice = np.zeros(len(own), dtype=np.int64)
            choice[of[hit]] = hit
            won = of[first][better]
            now[won], piece[won], start[won] = top[won], ids[choice[won]], since[done[choice[won]]]
        best = now
        owners.append(own)
        last.append(piece)
        begin.append(start)
    # back from each word's end; words wait at the depth that they have come to
    waiting: list[list[np.ndarray]] = [[] for _ in range(longest + 1)]
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        waiting[lengths[group[0]]].append(group)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(longest, 0, -1):
        if not waiting[depth]:
            continue
        word = np.concatenate(waiting[depth])
        node = np.searchsorted(owners[depth], word, side="right") - 1
        start = begin[depth][node]
        found.append((word, np.full(len(word), depth), last[depth][node]))
        by = np.argsort(start, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(start[by])) + 1):
            waiting[start[group[0]]].append(word[group])
    word, depth, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((depth, word))
    return piece[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))


def encode_overlapping(word: bytes, path: str) -> np.ndarray:
    """Ids of the best segmentation of one long word in which pieces overlap all along: byte by byte over the pieces that occur."""
    (score, byte_score), single, raw = scores(path), pieces(path)[1], np.frombuffer(word, dtype=np.uint8)
    begin, length, piece = occurrences(raw, path)
    first = np.searchsorted(begin, np.arange(len(raw) + 1)).tolist()
    end, gain = (begin + length).tolist(), score[piece].tolist()
    best, came = [-np.inf] * (len(raw) + 1), [-1] * (len(raw) + 1)
    best[0] = 0.0
    for i in range(len(raw)):
        here = best[i]
        for k in range(first[i], first[i + 1]):  # of equal sums the one that began first stays
            if here + gain[k] > best[end[k]]:
                best[end[k]], came[end[k]] = here + gain[k], k
        if here + byte_score >= best[i + 1]:
            best[i + 1], came[i + 1] = here + byte_score, -1
    ids, at = [], len(raw)
    while at:
        k = came[at]
        ids.append(int(single[raw[at - 1]]) if k < 0 else int(piece[k]))
        at = at - 1 if k < 0 else int(begin[k])
    return np.array(ids[::-1], dtype=np.int64)


def encode_distinct(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """:func:`encode_sorted` for words in any order, those of like length together, so that arrays are well filled.

    Long words are encoded in parts (see ``vocabulary.parts_of``), so the cost of a byte does not grow with its word.
    """
    parts, of = in_parts(words, path)
    kinds, names = pd.factorize(np.array([*parts, None], dtype=object)[:-1])
    classes = [max(WIDE, len(w) - 1).bit_length() for w in names]
    ids, sizes, order = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for size in sorted(set(classes)):
        own = sorted((k for k, c in enumerate(classes) if c == size), key=names.__getitem__)
        if 1 << (size - 1) > 2 * WHOLE_BYTES:
            found = [encode_overlapping(names[k], path) for k in own]
            flat, ends = np.concatenate(found), np.cumsum([0, *map(len, found)])
        else:
            flat, ends = encode_sorted([names[k] for k in own], path)
        ids.append(flat)
        sizes.append(np.diff(ends))
        order += own
    by = np.argsort(np.array(order, dtype=np.int64), kind="stable")
    flat, ends = ragged(np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), by[kinds])
    return flat, ends[np.searchsorted(of, np.arange(len(words) + 1))]


def marked(text: str) -> list[str]:
    """The text's marked words in order; the empty text has none."""
    return MARKED.findall(MARK + text.replace(" ", MARK)) if text else []


def decode(ids: np.ndarray, path: str) -> str:
    """The text of a sequence of piece ids."""
    flat, _ = ragged(*spelling(path), np.asarray(ids, dtype=np.int64))
    return flat.tobytes().decode("utf-8", "replace").replace(MARK, " ")[1:]


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, their CRC-32 (little-endian unsigned 32-bit) and whether decoding gives the text back.

    Row by row on whole texts, without a shuffle: each batch's distinct words are encoded once. Null
    and empty texts have no pieces. A word mark inside a text decodes as a space, the one case
    in which ``round_trip`` is false. Null ids stay null; repeated rows are encoded alike; an empty table
    gives no rows; other columns are not read.
    """
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            whole = [t or "" for t in part.column("text").to_pylist()]
            split = [marked(t) for t in whole]
            flat = np.empty(sum(map(len, split)), dtype=object)
            flat[:] = [w for ws in split for w in ws]
            codes, distinct = pd.factorize(flat)
            ids, own = ragged(*encode_distinct([w.encode() for w in distinct], path), codes)
            ends = own[np.concatenate(([0], np.cumsum([len(ws) for ws in split])))]
            raw, at = ragged(*spelling(path), ids)
            at, raw = at[ends], raw.tobytes()
            back = [raw[a:b].decode("utf-8", "replace").replace(MARK, " ")[1:] == t for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), whole, strict=True)]
            ids = ids.astype(np.int32)
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())],
                ["doc_id", "n_pieces", "ids", "ids_crc32", "round_trip"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODE_SCHEMA)


def decode_documents(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text from rows with doc_id and ids.

    Null and empty ids decode to the empty text; null doc_ids stay null; repeated rows are decoded alike; an
    empty table gives no rows; other columns are not read.
    """
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(i or [], path) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
