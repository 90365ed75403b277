"""Keyed Feistel permutation with cycle walking, as column expressions.

The domain is the grid ``a x b`` with ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``, so it
exceeds ``n`` by less than ``a`` points. A round adds a keyed hash of one coordinate to the
other, modulo that coordinate's size, which is a bijection whatever the hash is. A point that
lands at or above ``n`` is permuted again (cycle walking) until it falls inside.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
PRIME = 2147483647  # 2^31 - 1; products of two residues stay below 2^62
WALK = 64


def round_keys(key: str, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three residues per round, drawn from SHA-256 of the key and the round number."""
    out = []
    for i in range(rounds):
        digest = hashlib.sha256(f"{key}/{i}".encode()).digest()
        a, b, c = (int.from_bytes(digest[8 * j : 8 * j + 8], "big") % (PRIME - 1) + 1 for j in range(3))
        out.append((a, b, c))
    return out


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least ``n`` cells."""
    a = max(1, math.isqrt(n))
    a += a * a < n
    return a, max(1, -(-n // a))


def one_pass(value: Column, n: int, keys: list[tuple[int, int, int]]) -> Column:
    """The permutation of the whole grid, before walking."""
    a, b = (F.lit(x).cast("long") for x in grid(n))
    # the fold over the round keys keeps each round's input from being expanded again
    right = value % b
    state = F.struct((((value - right) / b).cast("long")).alias("l"), right.alias("r"))
    if n >= 2**52:  # doubles no longer hold the quotient
        raise ValueError("domains of 2^52 rows and more are not supported")
    steps = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"k{j}") for j, x in enumerate(k)], F.lit(i % 2).alias("side")) for i, k in enumerate(keys)])

    def step(acc: Column, k: Column) -> Column:
        p = F.lit(PRIME).cast("long")

        def h(v: Column) -> Column:
            x = (v * k["k0"] + k["k1"]) % p
            x = (x.bitwiseXOR(F.shiftright(x, 15)) * k["k2"]) % p
            return x.bitwiseXOR(F.shiftright(x, 13))

        return F.struct(
            F.when(k["side"] == 0, (acc["l"] + h(acc["r"])) % a).otherwise(acc["l"]).alias("l"),
            F.when(k["side"] == 0, acc["r"]).otherwise((acc["r"] + h(acc["l"])) % b).alias("r"),
        )

    return F.aggregate(steps, state, step, lambda s: s["l"] * b + s["r"])


def permute(value: Column, n: int, key: str, rounds: int = ROUNDS) -> Column:
    """Image of ``value`` (0 <= value < n) under the keyed permutation of 0..n-1.

    Fewer than ``sqrt(n) + 1`` grid points lie outside, so a walk of more than ``WALK`` steps is
    impossible up to 4096 rows and has a chance below n^-31 beyond; it would fail the job, never
    give a wrong slot.
    """
    keys = round_keys(key, rounds)
    if n <= 1:
        return value
    again = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        one_pass(value, n, keys),
        lambda acc, _: F.when(acc >= F.lit(n), one_pass(acc, n, keys)).otherwise(acc),
        lambda acc: F.when(acc < F.lit(n), acc).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")),
    )
    return again


def permute_local(value: int, n: int, key: str, rounds: int = ROUNDS) -> int:
    """The same permutation in plain Python, for readers that look up single slots and for tests."""
    if n <= 1:
        return value
    a, b = grid(n)
    while True:
        left, right = divmod(value, b)
        for i, (k0, k1, k2) in enumerate(round_keys(key, rounds)):
            v = right if i % 2 == 0 else left
            x = (v * k0 + k1) % PRIME
            x = ((x ^ (x >> 15)) * k2) % PRIME
            x ^= x >> 13
            if i % 2 == 0:
                left = (left + x) % a
            else:
                right = (right + x) % b
        value = left * b + right
        if value < n:
            return value


def permute_array(values: np.ndarray, n: int, key: str, rounds: int = ROUNDS) -> np.ndarray:
    """The same permutation over an array of int64, all in 0..n-1."""
    out = values.astype(np.int64)
    if n <= 1:
        return out
    a, b = grid(n)
    todo = np.arange(len(out))
    while len(todo):
        left, right = np.divmod(out[todo], b)
        for i, (k0, k1, k2) in enumerate(round_keys(key, rounds)):
            x = ((right if i % 2 == 0 else left) * k0 + k1) % PRIME
            x = ((x ^ (x >> 15)) * k2) % PRIME
            x ^= x >> 13
            if i % 2 == 0:
                left = (left + x) % a
            else:
                right = (right + x) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out
