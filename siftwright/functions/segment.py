"""Words of texts without blanks: the cheapest path through the lattice of all dictionary words.

Every dictionary word that stands in a text is an edge from its first character to behind its last, with the word's
cost; a character alone is an edge too, at the cost of the unknown. The cheapest path is found place by place, all texts
of a part of a batch at once. Of paths of equal cost the one whose last word is longest is taken, and so on from the end. Costs
are whole numbers, so sums are exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.loops import by_parts, chunks, joined_points
from siftwright.functions.shipped import Shipped

#: Runs that are words as they stand. Blanks always part words.
WHOLE = r"[A-Za-z0-9]+"
LARGEST = 2_000_000
FAR = np.int64(1) << 60


def _further(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings that are longer by one character."""
    with np.errstate(over="ignore"):
        h = (h ^ points) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of one length and their costs, in the order of their hashes, with their characters to tell equal hashes apart."""

    def __init__(self, words: list[str], costs: list[int]):
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
        h = np.zeros(len(words), np.uint64)
        for i in range(points.shape[1]):
            h = _further(h, points[:, i])
        order = np.argsort(h, kind="stable")
        self.hashes, self.points, self.costs = h[order], points[order], np.array(costs, np.int64)[order]
        self.same = int(np.unique(h, return_counts=True)[1].max())
        self.shift = np.uint64(64 - min(24, 3 + len(words).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[h >> self.shift] = True

    def find(self, h: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, costs) of the words in a text with these hashes from each place on."""
        places = np.flatnonzero(self.seen[h >> self.shift])
        first, size = np.searchsorted(self.hashes, h[places]), self.points.shape[1]
        hits, costs = [], []
        for k in range(self.same):
            at = np.minimum(first + k, len(self.hashes) - 1)
            on = self.hashes[at] == h[places]
            for i in range(size):
                on[on] = self.points[at[on], i] == points[places[on] + i]
            hits.append(places[on])
            costs.append(self.costs[at[on]])
        return np.concatenate(hits), np.concatenate(costs)


class Segmenter(Shipped):
    """Cuts texts into words by a dictionary {word: cost}."""

    def __init__(self, costs: dict[str, int], unknown: int, whole: str | None = WHOLE):
        sizes: dict[int, list[str]] = {}
        for w in costs:
            if w:
                sizes.setdefault(len(w), []).append(w)
        self.words = {m: Words(ws, [costs[w] for w in ws]) for m, ws in sizes.items()}
        self.longest = max(sizes, default=1)
        self.unknown, self.whole = unknown, whole
        self.parts = re.compile(rf"\s+|({whole})" if whole else r"\s+")

    def edges(self, points: np.ndarray) -> np.ndarray:
        """Cost of the word of m characters at each place, [m, place]; FAR where there is none."""
        out = np.full((self.longest + 1, len(points)), FAR, np.int64)
        out[1] = self.unknown
        h = np.zeros(len(points), np.uint64)
        for m in range(1, min(self.longest, len(points)) + 1):
            n = len(points) - m + 1
            h = _further(h[:n], points[m - 1 :])
            if m in self.words:
                place, costs = self.words[m].find(h, points)
                out[m, place] = np.minimum(out[m, place], costs) if m == 1 else costs
        return out

    def _paths(self, pieces: list[str]) -> list[list[str]]:
        points, begins = joined_points(pieces)
        cost = self.edges(points)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        begins_, sizes_ = begins[order], sizes[order]
        best, back = np.zeros(len(points) + 1, np.int64), np.zeros(len(points) + 1, np.int32)
        for t in range(1, int(sizes_[0]) + 1 if len(sizes_) else 1):
            at = begins_[: np.searchsorted(-sizes_, -t, "right")] + t
            least, by = np.full(len(at), FAR, np.int64), np.ones(len(at), np.int32)
            for m in range(min(self.longest, t), 0, -1):
                through = best[at - m] + cost[m, at - m]
                less = through < least
                least[less], by[less] = through[less], m
            best[at], back[at] = least, by
        out = []
        for piece, begin in zip(pieces, begins.tolist(), strict=True):
            at, words = len(piece), []
            while at:
                m = int(back[begin + at])
                words.append(piece[at - m : at])
                at -= m
            out.append(words[::-1])
        return out

    def segment(self, texts: list[str | None]) -> list[list[str] | None]:
        """The words of each text; None for None."""
        out: list[list[str] | None] = [None if t is None else [] for t in texts]
        pieces, owner = [], []
        for i, t in enumerate(texts):
            at = 0
            for m in self.parts.finditer(t or ""):
                pieces.append((t[at : m.start()], False)), pieces.append((m.group(1) or "" if self.whole else "", True))
                owner += [i, i]
                at = m.end()
            pieces.append(((t or "")[at:], False))
            owner.append(i)
        cut = [(k, p) for k, (p, whole) in enumerate(pieces) if p and not whole]
        words: list[list[str]] = [[p] if whole and p else [] for p, whole in pieces]
        for first, part in chunks([p for _, p in cut]):
            for (k, _), found in zip(cut[first:], self._paths(part), strict=False):
                words[k] = found
        for i, found in zip(owner, words, strict=True):
            if out[i] is not None:
                out[i] += found
        return out


def read_costs(entries: DataFrame, word: str = "word", cost: str = "cost") -> dict[str, int]:
    """{word: cost}; too large a dictionary is an error, of a word given twice the lower cost counts."""
    rows = entries.groupBy(word).agg(F.min(cost).cast("long").alias("_cost")).limit(LARGEST + 1).toArrow()
    if len(rows) > LARGEST:
        raise ValueError(f"a dictionary for segmentation has at most {LARGEST:,} words")
    return {w: c for w, c in zip(rows[word].to_pylist(), rows["_cost"].to_pylist(), strict=True) if w}


def word_costs(counts: DataFrame, word: str = "word", n: str = "n", scale: int = 1000) -> DataFrame:
    """(word, cost) from (word, n): the negative logarithm of a word's share, in whole thousandths."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(word, F.floor(scale * F.log(F.col("_total") / F.col(n))).cast("long").alias("cost"))


def tokens_lattice(text: Column, segmenter: Segmenter) -> Column:
    """Array of the words of a text; null for null."""
    cut = segmenter.shared()

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return by_parts(cut.value.segment, texts, pa.list_(pa.string()))

    return run(text)
