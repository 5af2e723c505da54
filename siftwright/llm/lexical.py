"""Ranked lexical search by a bit-sliced impact index.

The items are the stated query set: they are read in blocks of about `BLOCK_BYTES` bytes of text, and every document
meets every block. For a block:

1. Documents are cut into terms once; of the terms that the block asks for, places and counts are written, with the
   number of all terms. Document frequencies and lengths are counted over all documents.
2. A term's impact in a document is a whole number. For up to `DOCS` documents at a time, in order of id, an impact bit
   of a term is a bitmap over them, held as the 64-bit words that any document of the term stands in.
3. The impacts of an item's terms are added with bitwise carries, all items of a group side by side, so that a slice of
   the sums is a bitmap as well. A term that an item repeats is added shifted, once for each bit of its count.
4. The slices of the sums are descended from the most significant: documents that have the bit go ahead while they are
   more than k, else they are taken. What is equal in all slices is taken in order of id.
5. A task keeps the k best of each item over its documents; the k best of all tasks are ranked by Spark.

Every document is indexed and every score is exact; nothing is pruned or approximated.

Defined cases: null and termless texts rank nowhere; documents with a score of 0 are not reported; null or termless
items get no rows; an item of a repeated or null id is searched and reported on its own; documents with equal scores
rank by id, null ids last, and rows of one id each on its own; very long texts are read in slices; empty tables give no
rows; ids keep their types; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.bytewords import byte_classes, find_words, hash_words, heads, slices, spelled
from siftwright.llm.common import release, stage_table, type_of
from siftwright.llm.decontaminate import numbered_items

K = 10
K1, B = 8, 75
DOCS = 8192
ITEMS = 256
BLOCK_BYTES = 8 << 20
CLASSES = byte_classes(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    found = [find_words(part, CLASSES) for part in slices([(text or "").encode()], CLASSES)]
    return [t for words in found for t in spelled(words, np.arange(len(words.start))).to_pylist()]


class Vocabulary:
    """The terms that the items of a block ask for, findable by hash and verified by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.n, seed = len(terms), 0
        data = np.frombuffer(b"".join(terms), np.uint8)
        end = np.cumsum([len(t) for t in terms], dtype=np.int64)
        start = np.concatenate([[0], end[:-1]]).astype(np.int64)
        while len(np.unique(hashes := hash_words(data, start, end, seed))) < self.n:
            seed += 1
        order = np.argsort(hashes)
        self.seed, self.data, self.hashes, self.term = seed, data, hashes[order], order
        self.start, self.size = start, end - start
        self.some = np.zeros(1 << 16, bool)
        self.some[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words, their terms) for all words that are terms of the block."""
        which = np.flatnonzero(self.some[(words.hash >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, words.hash[which]), self.n - 1)
        which, term = which[self.hashes[at] == words.hash[which]], self.term[at[self.hashes[at] == words.hash[which]]]
        size = self.size[term]
        same = (words.end - words.start)[which] == size
        which, term, size = which[same], term[same], size[same]
        if not len(which):
            return which, term
        begins = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(begins, size)
        equal = words.data[np.repeat(words.start[which], size) + inside] == self.data[np.repeat(self.start[term], size) + inside]
        same = np.logical_and.reduceat(equal, begins)
        return which[same], term[same]


def _postings(vocabulary: Vocabulary):
    """Rows (id, text) -> (id, n, term, tf) of every text with terms: its number of terms, and the block's terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1).cast(pa.binary())]
            n, keys, counts = np.zeros(rows, np.int64), [], []
            for part in slices(texts, CLASSES):
                words = find_words(part, CLASSES, vocabulary.seed)
                n += np.bincount(words.part, minlength=rows)
                which, term = vocabulary.find(words)
                key, tf = np.unique(words.part[which] * vocabulary.n + term, return_counts=True)
                keys.append(key)
                counts.append(tf)
            keys, counts = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(counts or [np.zeros(0, np.int64)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            if len(keys):  # a very long text has counts from several slices
                first = heads(keys)
                keys, counts = keys[first], np.add.reduceat(counts, first)
            kept = np.flatnonzero(n)
            ends = np.searchsorted(keys, (np.arange(rows + 1)) * vocabulary.n)
            offsets = pa.array(np.append(ends[kept], ends[-1]).astype(np.int32))  # texts without terms have no postings
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % vocabulary.n, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(n[kept]), *lists], names=["id", "n", "term", "tf"])

    return run


def _frequencies(n_terms: int):
    """Rows (term) of arrays -> (term, df), once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df).astype(np.int32)), pa.array(df[df > 0])], names=["term", "df"])

    return run


def impact_slices(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, places, slices) from postings in order of term and document: bit s of the impacts of 64 documents is slices[s]."""
    key = term * width + (doc >> 6)
    first = heads(key)
    bit = np.uint64(1) << (doc & 63).astype(np.uint64)
    made = np.empty((int(impact.max()).bit_length(), len(first)), np.uint64)
    for s in range(len(made)):
        made[s] = np.bitwise_or.reduceat(np.where(impact >> s & 1, bit, np.uint64(0)), first)
    return key[first] // width, key[first] % width, made


def add_slices(sums: np.ndarray, at: np.ndarray, slices_: np.ndarray, shift: int) -> None:
    """Add numbers to the bit-sliced sums at different places, times 2 ** shift, by a ripple of carries."""
    carry = np.zeros(len(at), np.uint64)
    for s, b in enumerate(slices_, shift):
        a = sums[s, at]
        x = a ^ b
        sums[s, at] = x ^ carry
        carry = (a & b) | (x & carry)
    s = shift + len(slices_)
    while carry.any():
        a = sums[s, at]
        sums[s, at] = a ^ carry
        carry &= a
        s += 1


def top_slices(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, sum) of the k largest sums above 0 of each item, equal ones in order of document; sums[slice, item, word]."""
    open_ = np.bitwise_or.reduce(sums, axis=0)
    taken = np.zeros_like(open_)
    for b in sums[::-1]:
        ahead = taken | (open_ & b)
        many = (np.bitwise_count(ahead).sum(axis=1, dtype=np.int64) > k)[:, None]
        taken = np.where(many, taken, ahead)
        open_ &= np.where(many, b, ~b)
    bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
    room = k - np.bitwise_count(taken).sum(axis=1, dtype=np.int64)
    ties = bits(open_)
    ties &= np.cumsum(ties, axis=1, dtype=np.int32) <= room[:, None]
    item, doc = np.nonzero(bits(taken) | ties)
    value = np.zeros(len(item), np.int64)
    for s, b in enumerate(sums):
        value |= (b[item, doc >> 6] >> (doc & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << s
    return item, doc, value


class Query:
    """The items of a block in groups, their terms by count bit, and the weights of the terms."""

    def __init__(self, items: list[tuple[int, dict[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int):
        self.groups = [items[a : a + ITEMS] for a in range(0, len(items), ITEMS)]
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms
        self.steps = [self._steps(g) for g in self.groups]
        self.repeats = [max(sum(c.values()) for _, c in g) for g in self.groups]

    @staticmethod
    def _steps(group: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(shift, items, terms): in each step an item has one term at most, so that its places are different."""
        steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for q, (_, counts) in enumerate(group):
            used: Counter = Counter()
            for term, many in counts.items():
                for shift in range(many.bit_length()):
                    if many >> shift & 1:
                        steps.setdefault((shift, used[shift]), []).append((q, term))
                        used[shift] += 1
        return [(shift, *np.array(pairs).T) for (shift, _), pairs in sorted(steps.items())]

    def impacts(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        sizes, of = np.unique(n, return_inverse=True)
        m = np.array([100 - B + (B * x * self.n_docs) // self.n_terms for x in sizes.tolist()], np.int64)[of]
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + K1 * m[doc]))

    def search(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, documents, scores) over up to DOCS documents, of which each has its part of term and tf."""
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = self.impacts(n, doc, term, tf)
        kept = np.flatnonzero(impact)
        kept = kept[np.lexsort((doc[kept], term[kept]))]
        if not len(kept):
            return
        width = -(-len(n) // 64)
        terms, places, slices_ = impact_slices(term[kept], doc[kept], impact[kept], width)
        for group, steps, repeats in zip(self.groups, self.steps, self.repeats, strict=True):
            sums = np.zeros(((int(impact.max()) * repeats).bit_length(), len(group) * width), np.uint64)
            for shift, item, wanted in steps:
                a, b = np.searchsorted(terms, wanted), np.searchsorted(terms, wanted, "right")
                many = b - a
                cols = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
                if len(cols):
                    add_slices(sums, np.repeat(item, many) * width + places[cols], slices_[:, cols], shift)
            item, found, score = top_slices(sums.reshape(len(sums), len(group), width), k)
            edges = np.searchsorted(item, np.arange(len(group) + 1))
            for q, (number, _) in enumerate(group):
                if edges[q] < edges[q + 1]:
                    yield number, found[edges[q] : edges[q + 1]], score[edges[q] : edges[q + 1]]


def _search(query: Query, k: int):
    """Rows (id, n, term, tf) -> (item, id, score): the k best of each item in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        kind = pa.null()
        for whole in batches:
            kind = whole.column(0).type
            for a in range(0, whole.num_rows, DOCS):
                batch = whole.slice(a, DOCS)
                batch = batch.take(pc.array_sort_indices(batch.column(0), null_placement="at_end"))
                sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                term, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                for number, docs, scores in query.search(batch.column(1).to_numpy(zero_copy_only=False), sizes, term, tf, k):
                    ids = batch.column(0).take(pa.array(docs)).to_pylist()
                    new = [(-s, i is None, 0 if i is None else i) for s, i in zip(scores.tolist(), ids, strict=True)]
                    best[number] = heapq.nsmallest(k, best.get(number, []) + new)
        rows = [(number, None if none else i, -s) for number, found in best.items() for s, none, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "id", "score"])

    return run


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, Counter]]]:
    """The terms of all items with their counts, in blocks of about block_bytes or one item; one block is in the driver."""
    block, room = [], 0
    for row in items.select("_item", "text").orderBy("_item").toLocalIterator():
        terms = Counter(terms_of(row["text"]))
        size = sum(len(t) for t in terms)
        if block and room + size > block_bytes:
            yield block
            block, room = [], 0
        if terms:
            block.append((row["_item"], terms))
            room += size
    if block:
        yield block


def _ranked_block(docs: DataFrame, block: list[tuple[int, Counter]], k: int) -> DataFrame | None:
    """(item, id, score): the k best of each item of a block in each task's part of the documents (id, text)."""
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for _, counts in block for t in counts))}
    kind = type_of(docs, "id")
    postings = stage_table(docs.mapInArrow(_postings(Vocabulary(list(terms))), f"{kind}, n long, term array<int>, tf array<int>"), "lexical-postings")
    size = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not size["docs"]:
        release(postings)
        return None
    df = np.zeros(len(terms), np.int64)
    for row in postings.select("term").mapInArrow(_frequencies(len(terms)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
        df[row["term"]] = row["df"]
    weights = np.floor(1000 * np.log((2 * size["docs"] + 2) / (2 * df + 1))).astype(np.int64)
    query = Query([(number, {terms[t]: c for t, c in counts.items()}) for number, counts in block], weights, size["docs"], size["terms"])
    found = stage_table(postings.mapInArrow(_search(query, k), f"item long, {kind}, score long"), "lexical-found")
    release(postings)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    numbered = numbered_items(items, item_col, item_text_col)
    found = docs.sparkSession.createDataFrame([], f"item long, {type_of(rows, 'id')}, score long")
    for block in item_blocks(numbered, block_bytes):
        part = _ranked_block(rows, block, k)
        found = found if part is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("_item", "_item_id"), F.col("item") == F.col("_item")).select(F.col("_item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


ORACLE = f"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, w, len(w) AS n FROM terms WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
counts AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM counts, total GROUP BY term),
impacts AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + {K1} * ({100 - B} + (({B} * n * n_docs) // n_terms)))) AS impact
  FROM counts JOIN weights USING (term), total),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
scores AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {K}
"""
