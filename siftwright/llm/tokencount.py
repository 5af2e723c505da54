"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A text is cut into pre-tokens by the tokenizer's pattern; the byte-pair encoder never crosses them, so a text's count
is the sum of theirs. Leaves of the tree hold `LEAF` pre-tokens in a row, inner nodes the characters and tokens below
them. An edit descends by character sums to the leaves it touches, matches the pattern again from the last pre-token
that could not see the edit (two characters of look-ahead) until a match starts where an old pre-token started behind
the edit, and from there on all is as before. Only those pre-tokens are encoded: the leaves keep the count of every
pre-token, so what lies beside the edit keeps its own. Sums change on the paths above.

Counts of single pre-tokens are remembered up to a bound. The vocabulary file is a parameter and is read where the
work runs.

Defined cases: null texts are empty and count 0; edits are applied in order, each to the text that the last one left;
positions beyond the text are cut back to its end, a null list of edits is none; strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import type_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 32
SIGHT = 2
REMEMBERED = 400_000


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, pieces: list[str]) -> list[int]:
        """The tokens of each pre-token; `encoded` adds up for how many this was asked."""
        self.encoded += len(pieces)
        known, out = self.known, []
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = len(self.encoding.encode_ordinary(p))
                if len(p) <= 64:
                    known[p] = n
            out.append(n)
        return out


class TokenTree:
    """The pre-tokens of one text, with sums of characters and tokens for every subtree."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.pieces(text)
        self._build(pieces, counter.count(pieces))

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [pieces[a : a + LEAF] for a in range(0, len(pieces), LEAF)] or [[]]
        self.counts = [counts[a : a + LEAF] for a in range(0, len(counts), LEAF)] or [[]]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i] = sum(map(len, leaf))
            self.tokens[self.size + i] = sum(self.counts[i])
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join("".join(leaf) for leaf in self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), start

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf], self.counts[leaf] = pieces, counts
        node = self.size + leaf
        chars = sum(map(len, pieces)) - self.chars[node]
        tokens = sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) by new."""
        n = self.n_chars
        start = min(max(0, start), n)
        end = min(max(start, end), n)
        first, at = self._leaf_at(max(0, start - SIGHT))
        while first > 0 and (at + len(self.leaves[first][0] if self.leaves[first] else "") + SIGHT > start):
            first -= 1
            at -= self.chars[self.size + first]
        keep, place = 0, at
        for piece in self.leaves[first]:
            if place + len(piece) + SIGHT > start:
                break
            keep += 1
            place += len(piece)
        # the old text from place on, up to the leaf that holds the end of the edit; places of old pre-tokens behind the edit
        bounds: dict[int, tuple[int, int]] = {}
        last, edge, parts = first, at, []

        def read(leaf: int) -> None:
            nonlocal edge
            for k, piece in enumerate(self.leaves[leaf]):
                if edge >= end:
                    bounds[edge] = (leaf, k)
                edge += len(piece)

        read(first)
        parts += self.leaves[first][keep:]
        while edge < end and last + 1 < len(self.leaves):
            last += 1
            read(last)
            parts += self.leaves[last]
        old = "".join(parts)
        head, rest = old[: start - place], old[end - place :]
        shift = len(new) - (end - start)
        fresh: list[str] = []
        spot, step, resume = 0, 1, None  # spot: in the new text from place on
        while True:
            whole = last + 1 >= len(self.leaves)
            region = head + new + rest
            for m in self.counter.pattern.finditer(region, spot):
                before = place + m.start() - shift
                if m.start() >= len(head) + len(new) and before in bounds:
                    resume = bounds[before]
                    break
                if not whole and m.end() + SIGHT > len(region):
                    break
                fresh.append(m.group())
                spot = m.end()
            if resume is not None or whole:
                break
            more: list[str] = []
            for _ in range(step):  # twice as many each time, so that a long pre-token is not matched again leaf by leaf
                if last + 1 < len(self.leaves):
                    last += 1
                    read(last)
                    more += self.leaves[last]
            rest += "".join(more)
            step *= 2
        pieces, counts = self.leaves[first][:keep] + fresh, self.counts[first][:keep] + self.counter.count(fresh)
        if resume is not None:
            leaf, k = resume
            for i in range(leaf, last + 1):
                pieces += self.leaves[i][k:]
                counts += self.counts[i][k:]
                k = 0
        for leaf in range(first + 1, last + 1):
            self._set(leaf, [], [])
        self._set(first, pieces, counts)
        if len(pieces) > 16 * LEAF:
            self._build([p for leaf in self.leaves for p in leaf], [c for leaf in self.counts for c in leaf])


@lru_cache(maxsize=2)
def counter_for(vocabulary: str, pattern: str) -> Counter:
    return Counter(vocabulary, pattern)


def count_with_edits(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, n_pieces, n_tokens_edited, n_chars_edited, n_reencoded) for every row of docs.

    edits is an array of structs (start, end, text) in characters; n_reencoded counts the pre-tokens that the edits
    had encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(vocabulary, pattern)
        for batch in batches:
            rows = []
            for text, changes in zip(batch.column(1), batch.column(2), strict=True):
                tree = TokenTree(text.as_py() or "", counter)
                before, pieces = tree.n_tokens, sum(map(len, tree.leaves))
                counter.encoded = 0
                for e in changes.as_py() or ():
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append((before, pieces, tree.n_tokens, tree.n_chars, counter.encoded))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "n_pieces", "n_tokens_edited", "n_chars_edited", "n_reencoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), edits.cast("array<struct<start:bigint,end:bigint,text:string>>").alias("edits"))
    return rows.mapInArrow(run, f"{type_of(rows, 'doc_id')}, n_tokens long, n_pieces long, n_tokens_edited long, n_chars_edited long, n_reencoded long")
