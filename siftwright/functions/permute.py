"""Numbers that look random but are computed alike everywhere: a 32-bit mixer and permutations of 0 to n - 1 by it.

A permutation is a Feistel network over two digits of a number, in bases a and b with a * b just over n: every round adds
to one digit a mixed form of the other, which can be undone, so the network is a bijection of 0 to a * b - 1. A result
of n or more is permuted again until it is below n; that happens to about one number in the square root of n. So the
place of a row in a shuffle of n rows is computed from its rank alone, without a sort.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
#: Both under 2 ** 31, so that products fit into a signed 64-bit number.
FACTORS = (0x7FEB352D, 0x5BD1E995)
ROUNDS = 6


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (as int64) that changes about half the bits for each changed bit."""
    x = x ^ (x >> 16)
    x = (x * FACTORS[0]) & MASK
    x = x ^ (x >> 15)
    x = (x * FACTORS[1]) & MASK
    return x ^ (x >> 16)


def mix32_sql(x: str) -> str:
    """mix32 of an SQL expression of a number under 2 ** 32; the expression is repeated, so it should be a name."""
    shifted = lambda c, n: f"xor({c}, {c} >> {n})"
    one = f"(({shifted(x, 16)}) * {FACTORS[0]} & {MASK})"
    two = f"(({shifted(one, 15)}) * {FACTORS[1]} & {MASK})"
    return shifted(two, 16)


def round_key(seed: int, r: int) -> int:
    """The key of a round, a 32-bit number."""
    return int(mix32(np.array([(seed * ROUNDS + r + 1) & MASK], np.int64))[0])


def bases(n: int) -> tuple[int, int]:
    """(a, b): the digits' bases for a permutation of n numbers, a * b >= n."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a) if n else 1


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of numbers below n in the permutation of a seed."""
    a, b = bases(n)
    x = x.astype(np.int64).copy()
    todo = np.arange(len(x))
    while len(todo):
        low, high = x[todo] % a, x[todo] // a
        for r in range(ROUNDS):
            key = round_key(seed, r)
            if r % 2:
                high = (high + mix32(low ^ key)) % b
            else:
                low = (low + mix32(high ^ key)) % a
        x[todo] = high * a + low
        todo = todo[x[todo] >= n]
    return x


def shuffled_place(x: Column, n: Column, seed: int) -> Column:
    """The place, from 0, of number x in a shuffle of n numbers; null for null."""

    @F.arrow_udf("long")
    def run(xs: pa.Array, ns: pa.Array) -> pa.Array:
        known = pc.and_(pc.is_valid(xs), pc.is_valid(ns)).to_numpy(zero_copy_only=False)
        value, of = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (xs, ns))
        out = np.zeros(len(xs), np.int64)
        for size in np.unique(of[known]).tolist():
            rows = np.flatnonzero(known & (of == size))
            if ((value[rows] < 0) | (value[rows] >= size)).any():
                raise ValueError(f"a number to permute is not between 0 and {size - 1}")
            out[rows] = permuted(value[rows], size, seed)
        return pa.array(out, mask=~known)

    return run(x.cast("long"), n.cast("long"))


def shuffled_sql(rows: str, keys: str, seed: int) -> str:
    """CTE text: `walked` (keys, x, n, p) from a relation of (keys, x, n), p the place of x; needs WITH RECURSIVE."""
    network = f"SELECT {keys}, x, n, a, b, p % a AS low, p // a AS high FROM {{source}}"
    for r in range(ROUNDS):
        key, (changed, other, base) = round_key(seed, r), (("high", "low", "b") if r % 2 else ("low", "high", "a"))
        mixed = f"(SELECT *, xor({other}, {key}::BIGINT) AS v FROM ({network}))"
        kept = "low" if changed == "high" else "high"
        network = f"SELECT {keys}, x, n, a, b, {kept}, ({changed} + {mix32_sql('v')}) % {base} AS {changed} FROM {mixed}"
    step = f"SELECT {keys}, x, n, a, b, high * a + low AS p FROM ({network})"
    based = f"SELECT *, (n + a - 1) // a AS b FROM (SELECT {keys}, x, n, x AS p, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM {rows})"
    return f"""
walk AS (
  {step.format(source=f'({based})')}
  UNION ALL {step.format(source='walk WHERE p >= n')}),
walked AS (SELECT {keys}, x, n, p FROM walk WHERE p < n)"""
