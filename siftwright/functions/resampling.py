"""How often a bootstrap draws each segment, computed from the segment's number: exact multinomial counts, no draws.

The counts of n draws over segments are a chain of binomials: of the draws that are left, a segment takes each with the
chance of one in the segments that are left. Blocks of segments take theirs first, by a seeded generator; inside a
block, the binomial is read off its distribution at a mixed number of seed, resample and segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siftwright.functions.permute import MASK, mix32, mix32_sql

BLOCK = 16_384
#: Blocks at most, which bounds the numbers that are decided for all blocks at once; with more segments blocks are larger.
MOST_BLOCKS = 4096


def block_size(n: int, block: int = BLOCK) -> int:
    """Segments of a block for n segments."""
    return max(block, -(-n // MOST_BLOCKS))


def block_draws(n: int, resamples: int, seed: int, block: int = BLOCK) -> np.ndarray:
    """[block, resample] draws that fall to each block of segments; every resample has n in all."""
    sizes = np.diff(np.append(np.arange(0, n, block), n)) if n else np.zeros(0, np.int64)
    if len(sizes) < 2:
        return np.full((len(sizes), resamples), n, np.int64)
    return np.random.Generator(np.random.PCG64(seed)).multinomial(n, sizes / n, size=resamples).T.astype(np.int64)


def uniform(resample: np.ndarray, segment: int, seed: int) -> np.ndarray:
    """Numbers above 0 and below 1 for resamples and a segment."""
    x = mix32(mix32(resample.astype(np.int64) ^ (seed & MASK)) ^ (segment & MASK))
    return (x + 0.5) / 4294967296.0


def binomial(u: np.ndarray, draws: np.ndarray, p: float) -> np.ndarray:
    """The least k with P(Binomial(draws, p) <= k) >= u."""
    if p >= 1:
        return draws.copy()
    mass = np.power(1.0 - p, draws.astype(np.float64))
    total, k = mass.copy(), np.zeros(len(u), np.int64)
    todo = np.flatnonzero((total < u) & (k < draws))
    while len(todo):
        k[todo] += 1
        mass[todo] = mass[todo] * (draws[todo] - k[todo] + 1) / k[todo] * (p / (1.0 - p))
        total[todo] += mass[todo]
        todo = todo[(total[todo] < u[todo]) & (k[todo] < draws[todo])]
    return k


def multiplicities(first: int, size: int, draws: np.ndarray, seed: int):
    """For each of `size` segments from `first` on, how often each resample draws it; `draws` of the resamples in all."""
    left, resample = draws.copy(), np.arange(len(draws))
    for j in range(size):
        taken = binomial(uniform(resample, first + j, seed), left, 1.0 / (size - j))
        left -= taken
        yield taken


def block_sums(draws, resamples: int, seed: int, n: int, block: int):
    """A group function: the segments (block, i, d) of one block -> (r, s), the block's sum in every resample."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        i = table.column("i").to_numpy()
        order = np.argsort(i)
        d = np.nan_to_num(table.column("d").to_numpy()[order])
        size = min(block, n - number * block)
        if len(i) != size or not (i[order] == number * block + np.arange(size)).all():
            raise ValueError("segments are not numbered from 0 without gaps")
        sums = np.zeros(resamples)
        for value, taken in zip(d.tolist(), multiplicities(number * block, size, draws.value[number], seed), strict=True):
            sums += value * taken
        return pa.table({"r": pa.array(np.arange(resamples, dtype=np.int32)), "s": pa.array(sums)})

    return run


def multiplicities_sql(n_of: str, resamples: int, seed: int) -> str:
    """CTE text: `drawn` (r, i, c, n), how often resample r draws segment i, for up to BLOCK segments; needs WITH RECURSIVE.

    `n_of` is a relation of one row (n).
    """
    most = 20  # a segment is drawn once on average; more than twenty times in one draw of 10 ** 19
    masses = ", ".join(["pow(1 - p, rest) AS m0", "m0 AS t0", *[f"m{k - 1} * (rest - {k - 1}) / {k} * (p / (1 - p)) AS m{k}, t{k - 1} + m{k} AS t{k}" for k in range(1, most)]])
    count = " + ".join(f"(t{k} < u)::BIGINT" for k in range(most))
    return f"""
sized AS (SELECT n::BIGINT AS n FROM {n_of}),
walk AS (
  SELECT r::BIGINT AS r, -1::BIGINT AS i, 0::BIGINT AS c, n AS rest, n FROM sized, (SELECT unnest(range({resamples})) AS r)
  UNION ALL
  SELECT r, i, c, rest - c, n FROM (
    SELECT r, i, rest, n, CASE WHEN i = n - 1 THEN rest ELSE least(rest, {count}) END AS c FROM (
      SELECT r, i, rest, n, u, {masses} FROM (
        SELECT r, i, rest, n, CASE WHEN i = n - 1 THEN 0.5 ELSE 1.0::DOUBLE / (n - i) END AS p, ({mix32_sql("w")} + 0.5::DOUBLE) / 4294967296 AS u FROM (
          SELECT *, xor({mix32_sql("v")}, i) AS w FROM (SELECT r, i + 1 AS i, rest, n, xor(r, {seed & MASK}::BIGINT) AS v FROM walk WHERE i < n - 1)))))),
drawn AS (SELECT r, i, c, n FROM walk WHERE i >= 0)"""
