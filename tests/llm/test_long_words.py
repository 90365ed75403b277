"""Words without white space for kilobytes and more: the same results as word by word, at a cost per byte that does not grow."""

import base64
import random
import time

import numpy as np
import pytest

from matforge.llm import langid, near_dup, ppm, sentencepiece_viterbi, vocabulary
from matforge.llm.vocabulary import MARK, default_path, pieces

PATH = default_path()
RNG = random.Random(5)
LONG = [
    base64.b64encode(RNG.randbytes(1500)),
    b"=" * 2000,
    "".join(chr(0x4E00 + RNG.randrange(3000)) for _ in range(700)).encode(),
    b"thesheed" * 250,
    "".join(RNG.choice(["stein", "lich", "ung", "ä", "-", "9"]) for _ in range(500)).encode(),
    bytes(RNG.randrange(33, 127) for _ in range(2000)),
]


@pytest.fixture()
def whole(monkeypatch):
    """Words are searched as they are."""

    def use(on):
        monkeypatch.setattr(vocabulary, "WHOLE_BYTES", 1 << 30 if on else 64)
        monkeypatch.setattr(sentencepiece_viterbi, "WHOLE_BYTES", 1 << 30 if on else 64)
        monkeypatch.setattr(langid, "OVERLAPPING", 1 << 30 if on else 128)

    return use


def test_parts_are_cut_where_no_piece_reaches_across(whole):
    whole(False)
    for word in LONG:
        parts = vocabulary.parts_of(word, PATH)
        assert b"".join(parts) == word and all(len(p) >= 64 for p in parts[:-1])
        begin, length, _ = vocabulary.occurrences(np.frombuffer(word, np.uint8), PATH)
        for cut in np.cumsum([len(p) for p in parts])[:-1]:
            assert not ((begin < cut) & (begin + length > cut)).any()
    assert len(vocabulary.parts_of(LONG[0], PATH)) > 5 and vocabulary.parts_of(LONG[1], PATH) == [LONG[1]]


def test_segmentations_are_the_same(whole):
    words = [MARK.encode() + w for w in LONG] + [b"short", MARK.encode() + LONG[0]]
    whole(True)
    want, ends = sentencepiece_viterbi.encode_distinct(words, PATH)
    whole(False)
    got, cuts = sentencepiece_viterbi.encode_distinct(words, PATH)
    assert got.tolist() == want.tolist() and cuts.tolist() == ends.tolist()


def test_sums_over_segmentations_are_the_same(whole):
    chance = np.random.default_rng(2).random((len(pieces(PATH)[0]), 3))
    chance /= chance.sum(0)
    whole(True)
    want = langid.log_likelihoods([*LONG, b"short"], chance, PATH)
    whole(False)
    assert np.allclose(langid.log_likelihoods([*LONG, b"short"], chance, PATH), want, rtol=1e-9)
    assert np.allclose(langid.overlapping_likelihood(MARK.encode() + LONG[3], chance, PATH), want[3], rtol=1e-9)


def test_expected_counts_are_the_same_where_words_can_be_cut(whole):
    chance = np.random.default_rng(2).random((len(pieces(PATH)[0]), 1))
    chance /= chance.sum(0)
    weight = np.array([[2.0, 1.0], [1.0, 0.5]])
    whole(True)
    want = langid.expected_counts([LONG[0], LONG[2]], weight, chance[:, 0], PATH)
    whole(False)
    assert np.allclose(langid.expected_counts([LONG[0], LONG[2]], weight, chance[:, 0], PATH), want, rtol=1e-6, atol=1e-9)


def test_prices_of_long_tokens_are_the_same(monkeypatch):
    words = sorted({w.lower() + b" " for w in [*LONG, LONG[0][:900] + b"tail", LONG[0][:900] + b"tails", LONG[1][:1500], b"abc", b"abd"]} | {ppm.END})
    trained = np.array([k % 4 for k in range(len(words))])
    tokens = ppm.Tokens(words)
    code, n = np.unique(tokens.context * 256 + tokens.flat, return_inverse=True)
    counts = np.bincount(n, weights=np.repeat(trained, tokens.sizes))
    short = ppm.short_contexts(code[counts > 0], counts[counts > 0])
    got = ppm.token_costs(tokens, trained, short)
    monkeypatch.setattr(ppm, "CUT_BYTES", 1 << 30)
    assert np.allclose(got, ppm.token_costs(tokens, trained, short), rtol=1e-9)


def test_a_megabyte_in_one_word_takes_seconds():
    word = base64.b64encode(RNG.randbytes(750_000))
    chance = np.full((len(pieces(PATH)[0]), 4), 1.0 / len(pieces(PATH)[0]))
    tokens = ppm.Tokens(sorted([word + b" ", word[:50_000] + b" ", b"abc "]))
    trained = np.array([1, 0, 2])
    short = ppm.short_contexts(np.unique(tokens.context * 256 + tokens.flat), np.ones(len(np.unique(tokens.context * 256 + tokens.flat))))
    for work in (lambda: sentencepiece_viterbi.encode_distinct([MARK.encode() + word], PATH), lambda: langid.log_likelihoods([word], chance, PATH), lambda: ppm.token_costs(tokens, trained, short)):
        began = time.time()
        work()
        assert time.time() - began < 20  # some one or two on a machine that does nothing else


def test_probability_jaccard_of_long_texts():
    """By running sums what one sum per shared element gives, and in a time that does not grow with the square."""

    def plain(a, b):
        keys = sorted(a.keys() | b.keys())
        x, y = (np.array([d.get(k, 0) for k in keys], dtype=float) for d in (a, b))
        return sum(1.0 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero((x > 0) & (y > 0)))

    for n in (0, 1, 5, 60, 400):
        a, b = ({RNG.randrange(n + 1): RNG.randint(1, 5) for _ in range(n)} for _ in range(2))
        assert abs(near_dup.probability_jaccard(a, b) - plain(a, b)) < 1e-12
    same = {k: 1 + k % 3 for k in range(200_000)}
    began = time.time()
    assert abs(near_dup.probability_jaccard(same, same) - 1) < 1e-9 and time.time() - began < 10
