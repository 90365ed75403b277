"""Words, checksums and batches shared by the text operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a Python task; bounds its memory, not the work.
CHUNK_BYTES = 2 << 20


def utf8(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Runs of anything but space, tab, LF, VT, FF and CR: what ``bytes.split`` splits on."""
    return text.split() if text else []


def chunks(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), dtype=np.int64)
        start = taken = 0
        for i, size in enumerate(sizes):
            if i > start and taken + size > limit:
                yield batch.slice(start, i - start)
                start, taken = i, 0
            taken += size
        if batch.num_rows > start:
            yield batch.slice(start)


def word_hashes(flat: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word, equal for equal words in every process."""
    if not flat:
        return np.empty(0, dtype=np.uint64)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    return pd.util.hash_array(distinct, categorize=False)[codes]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_mod(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``modulus``; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids.to_pylist()], dtype=np.int64)




def stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (sizes[0] numbers), then the same for the next, and so on."""
    sizes = np.asarray(sizes, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
