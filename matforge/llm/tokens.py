"""Byte-level BPE token ids from the fixed public vocabulary."""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

RANKS, FULL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
END = "<|endoftext|>"
#: Id that closes a document.
CLOSE = 0


@functools.lru_cache(maxsize=1)
def fast() -> tiktoken.Encoding:
    """The vocabulary in the faster of the two libraries that read it."""
    with open(public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def full() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(FULL))


def token_ids(text: str | None) -> np.ndarray:
    """Ids of a text and the closing id; a null text is empty. Texts that spell the special token
    go through the full tokenizer, which gives it its own id; for all others both agree."""
    if not text:
        return np.array([CLOSE], dtype=np.uint32)
    ids = full().encode(text, add_special_tokens=False).ids if END in text else fast().encode_ordinary(text)
    return np.array([*ids, CLOSE], dtype=np.uint32)
