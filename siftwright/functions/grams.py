"""Counting n-grams by 64-bit hashes, a part of a batch at a time: memory is bounded by the part or its one
long text, no gram becomes a string."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwright.functions.loops import parts

OVERLAPS = "array<struct<n:int,matched:bigint,hyp:bigint,ref:bigint>>"


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and for each the index of its text; null texts have none."""
    known = [t or "" for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    return np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.repeat(np.arange(len(known)), sizes)


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all lists of numbers in a row, and for each the index of its list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(lists)), sizes)


def _windows(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every n values in a row of one owner, mixed with the owner; and the owner."""
    many = len(values) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = owner[:many] == owner[n - 1 :]
    with np.errstate(over="ignore"):
        h = owner[:many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(n):
            h ^= values[i : i + many]
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return h[inside], owner[:many][inside]


def _overlaps(hyp: tuple, ref: tuple, rows: int, orders: range) -> pa.Array:
    """For each row and order the sizes of both multisets of n-grams and of their intersection."""
    counts = np.zeros((rows, len(orders), 3), np.int64)
    for k, n in enumerate(orders):
        (a, of_a), (b, of_b) = _windows(*hyp, n), _windows(*ref, n)
        found, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        in_a, in_b = np.bincount(at[: len(a)], minlength=len(found)), np.bincount(at[len(a) :], minlength=len(found))
        row = np.zeros(len(found), np.int64)
        row[at] = np.concatenate([of_a, of_b])
        counts[:, k, 0] = np.bincount(row, np.minimum(in_a, in_b), rows)
        counts[:, k, 1], counts[:, k, 2] = np.bincount(of_a, minlength=rows), np.bincount(of_b, minlength=rows)
    flat = counts.reshape(-1, 3)
    each = pa.StructArray.from_arrays([pa.array(np.tile(np.array(orders, np.int32), rows)), *[pa.array(flat[:, i]) for i in range(3)]], names=["n", "matched", "hyp", "ref"])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(orders)), each)


def _by_parts(hyp: pa.Array, ref: pa.Array, values: Callable[[pa.Array], tuple], most: int) -> pa.Array:
    """_overlaps of the orders up to most of two columns, of which values() takes the elements and their rows."""
    orders = range(1, most + 1)
    found = [_overlaps(values(h), values(r), len(h), orders) for h, r in parts(hyp, ref)]
    return pa.concat_arrays(found) if found else _overlaps(values(hyp), values(ref), 0, orders)


def character_overlaps(hyp: Column, ref: Column, most: int) -> Column:
    """Array of (n, matched, hyp, ref) of the character n-grams of two texts, n from 1 to most."""

    @F.arrow_udf(OVERLAPS)
    def run(h: pa.Array, r: pa.Array) -> pa.Array:
        return _by_parts(h, r, _points, most)

    return run(hyp, ref)


def word_overlaps(hyp: Column, ref: Column, most: int) -> Column:
    """As character_overlaps, of two arrays of words."""

    @F.arrow_udf(OVERLAPS)
    def run(h: pa.Array, r: pa.Array) -> pa.Array:
        return _by_parts(h, r, _numbers, most)

    return run(F.transform(hyp, lambda w: F.xxhash64(w)), F.transform(ref, lambda w: F.xxhash64(w)))


def repeated_share(text: Column, n: int) -> Column:
    """Share of a text's character n-grams that repeat an earlier one; 0 without any, null for null."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        shares = np.zeros(len(texts))
        for i, t in enumerate(texts):
            points = np.frombuffer((t.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            h = np.sort(_windows(points, np.zeros(len(points), np.int64), n)[0])
            shares[i] = np.count_nonzero(h[1:] == h[:-1]) / max(len(h), 1)
        return pa.array(shares, mask=np.array([not t.is_valid for t in texts], bool))

    return run(text)
