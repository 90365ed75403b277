"""A fixed public vocabulary of pieces as a byte trie in arrays."""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import sentencepiece

MARK = "▁"
PIECES = "piece_bpe_32k.model"


def default_path() -> str:
    return public_tokenizers.path(PIECES)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[list[str | None], np.ndarray]:
    """Piece texts by id (None for control and byte pieces) and the ids of the 256 byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts: list[str | None] = []
    for i in range(model.get_piece_size()):
        special = model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        texts.append(None if special else model.id_to_piece(i))
    return texts, np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)


def zipf_scores(path: str) -> np.ndarray:
    """A log probability for each piece by Zipf's law over its place in the file.

    The file lists pieces by the order of their merges, which follows frequency; its own scores
    are only that order negated, not log probabilities.
    """
    n = len(pieces(path)[0])
    weight = 1.0 / (np.arange(n) + 2.7)
    return np.log(weight / weight.sum())


@functools.lru_cache(maxsize=2)
def byte_trie(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Transitions [node, byte] (0: none; the root is node 0) and the piece that ends at a node or -1."""
    texts, _ = pieces(path)
    nodes: dict[tuple[int, int], int] = {}
    ends: list[int] = [-1]
    for i, text in enumerate(texts):
        if text is None:
            continue
        at = 0
        for b in text.encode():
            if (at, b) not in nodes:
                nodes[at, b] = len(ends)
                ends.append(-1)
            at = nodes[at, b]
        ends[at] = i
    moves = np.zeros((len(ends), 256), dtype=np.int32)
    keys = np.array(list(nodes), dtype=np.int64)
    moves[keys[:, 0], keys[:, 1]] = np.fromiter(nodes.values(), dtype=np.int32, count=len(nodes))
    return moves, np.array(ends, dtype=np.int64)


@functools.lru_cache(maxsize=2)
def longest_piece(path: str) -> int:
    """Bytes of the longest piece."""
    return max(len(t.encode()) for t in pieces(path)[0] if t is not None)


#: Words of up to this many bytes are searched as they are; longer ones are cut into parts of about this many where no piece is cut.
WHOLE_BYTES = 256


def occurrences(word: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, piece) of all pieces in a word's bytes, by begin and length; all begins are followed at once."""
    moves, ends = byte_trie(path)
    at, node, step, found = np.arange(len(word)), np.zeros(len(word), dtype=np.int32), 0, []
    while len(at):
        node = moves[node, word[at + step]]
        step += 1
        at, node = at[node > 0], node[node > 0]
        whole = ends[node] >= 0
        found.append((at[whole], np.full(int(whole.sum()), step), ends[node[whole]]))
        on = at + step < len(word)
        at, node = at[on], node[on]
    begin, length, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    by = np.lexsort((length, begin))
    return begin[by], length[by], piece[by]


def parts_of(word: bytes, path: str) -> list[bytes]:
    """The word in parts of at least ``WHOLE_BYTES`` bytes, cut only where no piece that occurs in it reaches across.

    Every segmentation of the word has its cuts there, so the best one of the word is that of its parts, and the sum over all
    is the product of the parts' sums. A part may be longer, up to the whole word, if pieces overlap all along.
    """
    raw = np.frombuffer(word, dtype=np.uint8)
    begin, length, _ = occurrences(raw, path)
    across = np.zeros(len(raw) + 2, dtype=np.int64)
    np.add.at(across, begin + 1, 1)
    np.add.at(across, begin + length, -1)
    free = np.flatnonzero(np.cumsum(across)[: len(raw)] == 0)
    cuts, last = [0], 0
    while last < len(raw):
        k = int(np.searchsorted(free, last + WHOLE_BYTES))
        if k == len(free):
            break
        last = int(free[k])
        cuts.append(last)
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]


def in_parts(words: list[bytes], path: str) -> tuple[list[bytes], np.ndarray]:
    """Words with the long ones in their parts, and the place of the word that each belongs to."""
    split = [[w] if len(w) <= 2 * WHOLE_BYTES else parts_of(w, path) for w in words]
    return [p for ps in split for p in ps], np.repeat(np.arange(len(words)), [len(ps) for ps in split])
