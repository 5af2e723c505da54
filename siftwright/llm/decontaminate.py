"""Benchmark decontamination by SimHash over item-sized windows.

The benchmark is the stated query set: it is read in blocks of about `BLOCK_WORDS` words, each block becomes an index
of bounded size that is sent to the workers once, and every document meets every block. With several blocks each is a
pass of its own, and the driver holds one at a time. For a document, windows as long as an item slide over its words;
each window's SimHash is looked up in a multi-index Hamming table, whose blocks and balls return every item
fingerprint within the radius, and exact weighted-shingle similarity (shared shingles with their counts, over all)
verifies the candidates. Only windows that hold at least one of the item's shingles are fingerprinted: all others have
similarity zero. Windows are worked off `SPAN` words at a time, so memory beside the text itself stays bounded.

Words are split at white space, lower-cased, and stripped of what is neither letter nor digit at both ends; characters
of scripts without blanks are words of their own. Shingles are five words; items with fewer words have one shingle,
the whole item. A match has similarity 0.8 or more.

Defined cases: null or blank texts and items match nothing; an item that occurs more often in a document is reported
once, at its most similar (then first) window; a text with fewer words than an item is one window as a whole; items
that repeat under several ids are reported under each; null item ids are reported as null; ids keep their type; very
long texts are scanned whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import spaced, stage_table
from siftwright.llm.simhash import text_digest

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
SEGMENTS = 7
BLOCK_WORDS = 500_000
SPAN = 1 << 15
CACHED_WORDS = 400_000
MATCHES = "array<struct<item:bigint,similarity:double,start_word:bigint,n_words:bigint,distance:int>>"
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def normal_words(text: str) -> list[str]:
    """Words in lower case without what is neither letter nor digit at their ends."""
    out = []
    for token in spaced(text.lower()).split():
        if not (token[0].isalnum() and token[-1].isalnum()):
            a, b = 0, len(token)
            while a < b and not token[a].isalnum():
                a += 1
            while b > a and not token[b - 1].isalnum():
                b -= 1
            token = token[a:b]
        if token:
            out.append(token)
    return out


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out += (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29))) * np.uint64(MIX[i])
            out = (out << np.uint64(23)) | (out >> np.uint64(41))
        out ^= out >> np.uint64(31)
        out *= np.uint64(MIX[1])
        out ^= out >> np.uint64(29)
    return out


def _signs(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.int32) * 2 - 1


def _simhash(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class _Seen(dict):
    """Token -> number of its word in the index's vocabulary: 0 for other words, -1 for no word at all."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        word = normal_words(token)
        self[token] = found = self.vocabulary.get(word[0], 0) if word else -1
        return found


class ItemIndex:
    """The benchmark items of one block, with their shingles, fingerprints and Hamming tables."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = []
        for item_id, text in items:
            words = normal_words(text or "")
            if words:
                hashes = _word_hashes(words)
                self.items.append((item_id, len(words), _shingles(hashes, min(SHINGLE, len(words))), words))
        self.vocabulary: dict[str, int] = {}
        for *_, words in self.items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.sizes = sorted({min(SHINGLE, n) for _, n, *_ in self.items})
        owners: dict[int, dict[int, list[int]]] = {k: defaultdict(list) for k in self.sizes}
        numbers: dict[int, set[int]] = {k: set() for k in self.sizes}
        for j, (_, n, shingles, words) in enumerate(self.items):
            k = min(SHINGLE, n)
            for s in set(shingles.tolist()):
                owners[k][s].append(j)
            ids = np.array([self.vocabulary[w] for w in words], np.uint64)
            numbers[k].update(_shingles(ids, k).tolist())
        self.owners = {k: dict(v) for k, v in owners.items()}
        self.numbers = {k: np.array(sorted(v), np.uint64) for k, v in numbers.items()}
        self.counts = [Counter(s.tolist()) for _, _, s, _ in self.items]
        self.prints = np.concatenate([_simhash(_signs(s).sum(axis=0, keepdims=True)) for _, _, s, _ in self.items]) if self.items else np.zeros(0, np.uint64)
        self.tables: dict[tuple[int, int], list] = {}
        edges = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
        self.segments = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        each = RADIUS // SEGMENTS
        self.balls = [np.array([m for m in range(1 << w) if m.bit_count() <= each], np.uint64) for _, w in self.segments]
        self.items = [(i, n, s) for i, n, s, _ in self.items]
        self.seen = None

    def __getstate__(self):
        return self.__dict__ | {"seen": None}

    def _table(self, k: int, n: int) -> list:
        """For items of n words: for each segment the items by segment value, as (start of each value, items)."""
        if (k, n) not in self.tables:
            own = np.array([j for j, (_, m, _) in enumerate(self.items) if m == n], np.int64)
            made = []
            for shift, width in self.segments:
                value = (self.prints[own] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                order = np.argsort(value, kind="stable")
                made.append((np.searchsorted(value[order], np.arange((1 << width) + 1, dtype=np.uint64)), own[order]))
            self.tables[k, n] = made
        return self.tables[k, n]

    def _candidates(self, k: int, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius, from the Hamming tables."""
        pairs = []
        for (shift, width), ball, (starts, own) in zip(self.segments, self.balls, self._table(k, n), strict=True):
            value = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            probe = (value[:, None] ^ ball[None, :]).astype(np.int64)
            first, many = starts[probe], starts[probe + 1] - starts[probe]
            window = np.repeat(np.arange(len(prints)), many.sum(axis=1))
            many, first = many.ravel(), first.ravel()
            at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            pairs.append(window * len(self.items) + own[at])
        both = np.unique(np.concatenate(pairs))
        window, item = both // len(self.items), both % len(self.items)
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        near = distance <= RADIUS
        return window[near], item[near], distance[near]

    def search(self, text: str | None) -> list[dict]:
        """The items that a text holds."""
        if not text or not self.items:
            return []
        if self.seen is None:
            self.seen = _Seen(self.vocabulary)
        tokens = spaced(text).split()
        ids = np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))
        ids = ids[ids >= 0]
        hit = {}
        for k in self.sizes:
            n = len(ids) - k + 1
            if n <= 0:
                continue
            known = ids[:n] > 0
            for i in range(1, k):
                known &= ids[i : i + n] > 0
            at = np.flatnonzero(known)
            if len(at):
                runs = np.stack([ids[at + i] for i in range(k)]).astype(np.uint64)
                keys = np.array([_shingles(runs[:, c].copy(), k)[0] for c in range(runs.shape[1])], np.uint64) if len(at) < 8 else _columns(runs)
                spot = np.searchsorted(self.numbers[k], keys)
                spot[spot == len(self.numbers[k])] = 0
                at = at[self.numbers[k][spot] == keys]
            if len(at):
                hit[k] = at
        if not hit:
            return []
        hashes = _word_hashes(normal_words(text))
        best: dict[int, tuple] = {}
        for k, at in hit.items():
            shingles = _shingles(hashes, k)
            at = at[at < len(shingles)]
            starts_of: dict[int, list[int]] = defaultdict(list)
            for p in at.tolist():
                for n in {self.items[j][1] for j in self.owners[k].get(int(shingles[p]), ())}:
                    starts_of[n].append(p)
            for n, spots in starts_of.items():
                size = min(n, len(hashes))  # a text shorter than the item is its own one window
                last, inside = len(hashes) - size, size - k + 1
                if inside < SIMILARITY * (n - k + 1):
                    continue
                spots, edges = np.array(spots), np.zeros(last + 2, np.int32)
                np.add.at(edges, np.clip(spots - inside + 1, 0, last + 1), 1)
                np.add.at(edges, np.minimum(spots, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edges) > 0)
                for part in np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1):
                    for a in range(0, len(part), 2048):
                        at_once = part[a : a + 2048]
                        near = shingles[at_once[0] : at_once[-1] + inside]
                        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(near), axis=0, dtype=np.int32)])
                        spot = at_once - at_once[0]
                        prints = _simhash(sums[spot + inside] - sums[spot])
                        for w, j, d in zip(*map(np.ndarray.tolist, self._candidates(k, n, prints)), strict=True):
                            s = int(at_once[w])
                            own = Counter(shingles[s : s + inside].tolist())
                            shared = sum((own & self.counts[j]).values())
                            like = shared / (n - k + 1 + inside - shared)
                            if like >= SIMILARITY and (-like, s) < best.get(j, (0, 0))[:2]:
                                best[j] = (-like, s, size, d)
        return [{"item": self.items[j][0], "similarity": -like, "start_word": s, "n_words": n, "distance": d} for j, (like, s, n, d) in sorted(best.items())]


def _columns(runs: np.ndarray) -> np.ndarray:
    """As _shingles, for words that stand in the rows of runs."""
    out = np.zeros(runs.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for i, h in enumerate(runs):
            out += (h ^ (h >> np.uint64(29))) * np.uint64(MIX[i])
            out = (out << np.uint64(23)) | (out >> np.uint64(41))
        out ^= out >> np.uint64(31)
        out *= np.uint64(MIX[1])
        out ^= out >> np.uint64(29)
    return out


def item_blocks(benchmark: DataFrame, text_col: str = "text", number_col: str = "_item", block_words: int = BLOCK_WORDS) -> Iterator[ItemIndex]:
    """Indexes of all items, each of about block_words words or one item; one block at a time is in the driver."""
    block, room = [], 0
    for row in benchmark.select(F.col(number_col).alias("n"), F.col(text_col).cast("string").alias("text")).orderBy("n").toLocalIterator():
        size = len(spaced(row["text"] or "").split())
        if block and room + size > block_words:
            yield ItemIndex(block)
            block, room = [], 0
        block.append((row["n"], row["text"]))
        room += size
    if block:
        yield ItemIndex(block)


def numbered_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(_item, _item_id, text): the items with a number each; the ids themselves stay in the table."""
    items = benchmark.select(F.col(id_col).alias("_item_id"), F.col(text_col).cast("string").alias("text"))
    return stage_table(items.withColumn("_item", F.monotonically_increasing_id()), "benchmark-items")


def matches(spark: SparkSession, text: Column, index: ItemIndex) -> Column:
    """Array of the items of a block that a text holds."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        fields = [("item", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32())]
        return pa.array([shared.value.search(t.as_py()) for t in texts], pa.list_(pa.struct(fields)))

    return run(text)


def _passes(items: DataFrame, block_words: int, work) -> DataFrame | None:
    """work(index) of every block together; of several blocks each is written before the next is read."""
    out, waiting = None, None
    for index in item_blocks(items, block_words=block_words):
        if waiting is not None:
            made = stage_table(work(waiting), "decontamination-block")
            out = made if out is None else out.unionByName(made)
        waiting = index
    if waiting is None:
        return None
    return work(waiting) if out is None else out.unionByName(stage_table(work(waiting), "decontamination-block"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): a row for each item that a document holds."""
    items = numbered_items(benchmark)

    def work(index: ItemIndex | None) -> DataFrame:
        found = F.array().cast(MATCHES) if index is None else matches(docs.sparkSession, F.col(text_col), index)
        return docs.select(F.col(id_col).alias("doc_id"), found.alias("m")).select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")

    found = _passes(items, block_words, work)
    found = (work(None) if found is None else found).join(items.select("_item", "_item_id"), F.col("item") == F.col("_item"))
    return found.select("doc_id", F.col("_item_id").alias("item_id"), "similarity", "start_word", "n_words", "distance")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns."""
    items, spark = numbered_items(benchmark), docs.sparkSession
    blocks = item_blocks(items, block_words=block_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return docs if first is None else docs.filter(F.size(matches(spark, F.col(text_col), first)) == 0)
    del blocks, first, second
    held = _passes(items, block_words, lambda index: docs.filter(F.size(matches(spark, F.col(text_col), index)) > 0).select(text_digest(F.col(text_col)).alias("held")))
    return docs.join(held.distinct(), text_digest(docs[text_col]) == F.col("held"), "left_anti")
