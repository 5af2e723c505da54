"""Replacing the entries of a dictionary in texts: a trie in three arrays, walked from all places at once.

A batch of texts is one array of characters. From every place the trie is walked as deep as its text goes on matching,
all places together, and the deepest entry is remembered. The entries that a reader from the left would take, longest
first, are then picked: those that no earlier entry reaches into at once, the few others cluster by cluster. So a text
takes time in proportion to its length and to the entries' lengths, whatever the size of the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from siftwright.functions.loops import chunks
from siftwright.functions.shipped import Shipped

#: A step of a trie reads so many bits of a letter's number: a node has 64 places for children.
STEP = 6


class Trie:
    """A trie whose nodes are 16 bytes each: a node's bits tell which children it has, and they follow each other from `first` on.

    Letters are numbered; with more than 64 of them a letter is two steps or more.
    """

    def __init__(self, entries: Iterable[str]):
        self.entries = sorted({e for e in entries if e})
        points = np.frombuffer("".join(self.entries).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters = np.unique(points)
        steps = max(1, -(-(max(len(self.letters), 1) - 1).bit_length() // STEP))
        self.shifts = [STEP * i for i in range(steps)][::-1]
        self._build(np.searchsorted(self.letters, points), np.fromiter(map(len, self.entries), np.int64, len(self.entries)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"entries": None}  # what is shipped finds entries by number

    def _build(self, numbers: np.ndarray, sizes: np.ndarray) -> None:
        """Level by level: entries are in order, so those that share a node follow each other."""
        at = np.cumsum(sizes) - sizes
        live, node = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        low, high = 0, 1
        bits, first, value = [], [], [np.full(1, -1, np.int32)]
        while len(live):
            for shift in self.shifts:
                key = (node - low) << STEP | (numbers[at[live]] >> shift) & ((1 << STEP) - 1)
                new = np.concatenate([[True], key[1:] != key[:-1]])
                child = key[new]
                heads = np.flatnonzero(np.concatenate([[True], child[1:] >> STEP != child[:-1] >> STEP]))
                has, begins = np.zeros(high - low, np.uint64), np.zeros(high - low, np.int32)
                has[child[heads] >> STEP] = np.bitwise_or.reduceat(np.uint64(1) << (child & ((1 << STEP) - 1)).astype(np.uint64), heads)
                begins[child[heads] >> STEP] = high + heads
                bits.append(has), first.append(begins), value.append(np.full(len(child), -1, np.int32))
                low, high = high, high + len(child)
                node = low + np.cumsum(new) - 1
            sizes, at[live] = sizes.copy(), at[live] + 1
            sizes[live] -= 1
            done = sizes[live] == 0
            value[-1][node[done] - low] = live[done]
            live, node = live[~done], node[~done]
        self.bits, self.first = np.concatenate([*bits, np.zeros(high - low, np.uint64)]), np.concatenate([*first, np.zeros(high - low, np.int32)])
        self.value = np.concatenate(value)

    def matches(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, entries) of all entries that begin at each place, by ascending length."""
        if not len(self.letters):
            return
        letter = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        letter = np.where(self.letters[letter] == points, letter, -1).astype(np.int32)
        place = np.flatnonzero(letter >= 0)
        state, depth = np.zeros(len(place), np.int32), 0
        while len(place):
            for shift in self.shifts:
                bit = np.uint64(1) << ((letter[place] >> shift) & ((1 << STEP) - 1)).astype(np.uint64)
                has = self.bits[state]
                on = (has & bit) != 0
                place, state, has, bit = place[on], state[on], has[on], bit[on]
                state = self.first[state] + np.bitwise_count(has & (bit - np.uint64(1)))
            depth += 1
            ends = self.value[state]
            found = ends >= 0
            if found.any():
                yield depth, place[found] + 1 - depth, ends[found]
            inside = place + 1 < len(points)
            place, state = place[inside] + 1, state[inside]
            known = letter[place] >= 0
            place, state = place[known], state[known]

    def longest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, entry) of the longest entry that begins at each place; length 0 without one."""
        length, entry = np.zeros(len(points), np.int32), np.full(len(points), -1, np.int32)
        for depth, place, found in self.matches(points):
            length[place], entry[place] = depth, found
        return length, entry


def leftmost(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the spans, in order of start, a reader takes who goes on behind each span that was taken."""
    if not len(starts):
        return np.zeros(0, np.int64)
    reach = np.maximum.accumulate(ends)
    heads = np.flatnonzero(np.concatenate([[True], starts[1:] >= reach[:-1]]))
    cluster_ends = np.append(heads[1:], len(starts))
    taken, at, stop = [heads], heads, cluster_ends
    while len(at):
        at = np.searchsorted(starts, ends[at])
        at, stop = at[at < stop], stop[at < stop]
        taken.append(at)
    return np.sort(np.concatenate(taken))


class Replacer(Shipped):
    """Replaces the entries of a dictionary {from: to} in texts, from the left, of several the longest."""

    def __init__(self, words: dict[str, str]):
        self.trie = Trie(words)
        targets = [words[e] for e in self.trie.entries]
        self.sizes = np.fromiter(map(len, targets), np.int64, len(targets))
        self.points = np.frombuffer("".join(targets).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def spans(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, entry) of what is replaced."""
        length, entry = self.trie.longest(points)
        starts = np.flatnonzero(length)
        starts = starts[leftmost(starts, starts + length[starts])]
        return starts, length[starts], entry[starts]

    def replace(self, texts: list[str | None]) -> list[str | None]:
        out: list[str | None] = []
        for _, part in chunks([t or "" for t in texts]):
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            # the place between two texts has a number that no character has
            points = np.frombuffer("\0".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            stops = np.cumsum(sizes)
            points[stops - 1] = 1 << 31
            starts, length, entry = self.spans(points)
            if not len(starts):
                out += part
                continue
            many = np.ones(len(points), np.int64)
            covered = np.repeat(starts, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            many[covered] = 0
            many[starts] = self.sizes[entry]
            ends = np.cumsum(many)
            made = np.zeros(ends[-1], np.uint32)
            same = np.ones(len(points), bool)
            same[covered] = False
            made[(ends - many)[same]] = points[same]
            sizes_of = self.sizes[entry]
            inside = np.arange(sizes_of.sum()) - np.repeat(np.cumsum(sizes_of) - sizes_of, sizes_of)
            made[np.repeat((ends - many)[starts], sizes_of) + inside] = self.points[np.repeat(self.begins[entry], sizes_of) + inside]
            cuts = ends[stops - 1]
            begins = np.concatenate([[0], cuts[:-1]])
            out += [made[a : b - 1].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(begins.tolist(), cuts.tolist(), strict=True)]
        return [None if t is None else x for t, x in zip(texts, out, strict=True)]
