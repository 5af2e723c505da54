"""Words of many texts at once, from their UTF-8 bytes: places, 64-bit hashes and the runs that they stand in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Classes of bytes: part of a word, blank between words, cut that ends a run of words.
WORD, BLANK, CUT = 0, 1, 2
#: Bytes of text that are worked on at once.
SLICE = 4 << 20
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words in order: their bytes are data[start:end] in lower case (A-Z only); equal `run` means no cut between them."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    run: np.ndarray
    part: np.ndarray
    own: np.ndarray


def byte_classes(words: str, cuts: str = "") -> np.ndarray:
    """The class of each byte, from the patterns of one word character and of one cut character (ASCII decides alone)."""
    table = np.zeros(256, np.uint8)
    for b in range(128):
        table[b] = CUT if cuts and re.fullmatch(cuts, chr(b)) else WORD if re.fullmatch(words, chr(b)) else BLANK
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that changes about half the bits for each changed bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _K1
        h = (h ^ (h >> np.uint64(29))) * _K2
        return h ^ (h >> np.uint64(32))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes a round; no two words of up to eight bytes and one length share it."""
    size = (end - start).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    with np.errstate(over="ignore"):
        h = mix(size * _K3 + np.uint64(seed))
    todo, at = np.arange(len(start)), 0
    while len(todo):
        eight = padded[(start[todo] + at)[:, None] + np.arange(8)].view(np.uint64).ravel()
        left = np.minimum(size[todo] - np.uint64(at), np.uint64(8))
        eight &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        h[todo] = mix(h[todo] ^ eight)
        at += 8
        todo = todo[size[todo] > at]
    return h


def parts_of(text: bytes, classes: np.ndarray, ahead: int = 0, size: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """Cut a long text between words: (bytes, how many of them are its own); the rest are the next `ahead` words."""
    a = 0
    while len(text) - a > size:
        b = a + size
        while b < len(text) and not (gap := classes[np.frombuffer(text, np.uint8, min(4096, len(text) - b), b)] != WORD).any():
            b += 4096
        b = min(len(text), b + int(np.argmax(gap)) if b < len(text) else b)
        e = b
        for _ in range(ahead):
            found = _TOKEN.search(text, e)
            e = found.end() if found else len(text)
        yield text[a:e], b - a
        a = b
    yield text[a:], len(text) - a


_TOKEN = re.compile(rb"[^\x20\x09]+")


def slices(texts: list[bytes], classes: np.ndarray, ahead: int = 0, size: int = SLICE) -> Iterator[list[tuple[int, bytes, int]]]:
    """Lists of (text number, bytes, own bytes) of about `size` bytes each."""
    ready, room = [], 0
    for i, text in enumerate(texts):
        for part, own in parts_of(text, classes, ahead, size):
            ready.append((i, part, own))
            room += len(part)
            if room >= size:
                yield ready
                ready, room = [], 0
    if ready:
        yield ready


def find_words(parts: list[tuple[int, bytes, int]], classes: np.ndarray, seed: int = 0) -> Words:
    """The words of one slice; `part` is the text number, `own` whether a word starts in its part's own bytes."""
    data = _LOWER[np.frombuffer(b"\n".join(p for _, p, _ in parts) + b"\n", np.uint8)]
    kind = classes[data]
    edges = np.flatnonzero(np.diff(kind == WORD, prepend=False))
    start, end = edges[0::2], edges[1::2]
    sizes = np.array([len(p) + 1 for _, p, _ in parts])
    begins = np.cumsum(sizes) - sizes
    of = np.searchsorted(begins, start, "right") - 1
    own = start - begins[of] < np.array([n for *_, n in parts])[of]
    run = np.cumsum((kind == CUT), dtype=np.int32)[start] + of  # the byte between two parts may be no cut
    return Words(data, start, end, hash_words(data, start, end, seed), run, np.array([i for i, *_ in parts])[of], own)


def spelled(words: Words, which: np.ndarray) -> pa.Array:
    """The bytes of some of the words, as an Arrow array of binaries."""
    start, size = words.start[which], (words.end - words.start)[which]
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(words.data[at])])


def heads(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns that are ordered by group."""
    new = np.zeros(len(sorted_[0]), bool)
    for column in sorted_:
        new[1:] |= column[1:] != column[:-1]
    new[:1] = True
    return np.flatnonzero(new)
