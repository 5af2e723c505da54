"""Language identification with language-bitmask n-gram filters.

Training counts the character n-grams (orders 1 to 4, over lower-cased letters with one blank between words) of every
labelled row, keeps for each language those that are typical of it, and inserts them into bit-sliced Bloom filters:
slot s holds one bit for each language, so the bitwise AND over an n-gram's slots gives at once the set of languages
that (may) contain it. A text's hits are popcounted per language and corrected for each filter's false-positive
rate; the share of its n-grams that a language explains decides.

An n-gram is typical of a language if its relative frequency there is at least `typical` times the highest among the
languages; at most `profile` n-grams a language and order are kept, by frequency. A language without any typical
n-gram keeps those that come nearest. These bounds make the filter's size independent of the corpus; the counts
themselves cover all training rows. One slot holds 64 languages; more of them take further slot arrays.

Defined cases: null texts and texts without a letter give `und` with score 0; a text whose n-grams no language holds,
like any tie, goes to the language that sorts first; rows with null lang train nothing; with no training rows at all
every prediction is `und`; texts are read in pieces of `CHUNK` characters, so memory does not grow with their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import stage_table, type_of

ORDERS = (1, 2, 3, 4)
HASHES = 4
CHUNK = 1 << 19
GROUP = 64


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> lower-cased letter, or 0 for what is no letter. A table made from Python's own rules."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, two blanks (0) around each, and for each point its text's index."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    points = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.int32)
    points, owner = _folding()[points], np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
    return points[keep], owner[keep]


def _grams(points: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each n-gram inside a text that holds a letter at its middle, and the text's index."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    h = np.full(n, np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    with np.errstate(over="ignore"):
        for i in range(order):
            h ^= points[i : i + n].astype(np.uint64)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    whole = (owner[:n] == owner[order - 1 :]) & (points[order // 2 : order // 2 + n] != 0)
    return h[whole], owner[:n][whole]


def _chunks(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pieces of all texts, about CHUNK characters at a time, with the index of each piece's text."""
    parts, of, room = [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text)), CHUNK):
            part = text[a : a + CHUNK]
            if parts and room + len(part) > CHUNK:
                yield parts, np.array(of)
                parts, of, room = [], [], 0
            parts.append(part)
            of.append(i)
            room += len(part)
    if parts:
        yield parts, np.array(of)


@dataclass(frozen=True)
class LanguageFilters:
    """slots: for every 64 languages an array with one integer for each Bloom position, bit l set for their language l."""

    languages: tuple[str, ...]
    slots: tuple[np.ndarray, ...]
    false_rate: np.ndarray

    def lookup(self, grams: np.ndarray, group: int = 0) -> np.ndarray:
        """The bitmask of a group's languages for each n-gram hash."""
        slots = self.slots[group]
        mask, size = None, np.uint64(len(slots))
        step = (grams >> np.uint64(17)) | np.uint64(1)
        at = grams.copy()
        with np.errstate(over="ignore"):
            for _ in range(HASHES):
                got = slots[(at % size).astype(np.int64)]
                mask = got if mask is None else mask & got
                at += step
        return mask

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters by text, n-grams by order and text, hits by order, text and language)."""
        n = len(texts)
        letters, total, hits = np.zeros(n, np.int64), np.zeros((len(ORDERS), n)), np.zeros((len(ORDERS), n, len(self.languages)))
        for parts, of in _chunks(texts):
            points, owner = _joined(parts)
            letters += np.bincount(of[owner[points != 0]], minlength=n)
            for k, order in enumerate(ORDERS):
                grams, part = _grams(points, owner, order)
                text = of[part]
                total[k] += np.bincount(text, minlength=n)
                for group in range(len(self.slots)):
                    mask = self.lookup(grams, group)
                    for l in range(group * GROUP, min(len(self.languages), (group + 1) * GROUP)):
                        hits[k, :, l] += np.bincount(text[(mask >> np.array(l % GROUP, mask.dtype)) & 1 == 1], minlength=n)
        return letters, total, hits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        letters, total, hits = self.counts([t or "" for t in texts])
        f = self.false_rate
        true = np.maximum(hits - total[:, :, None] * f, 0) / np.maximum(1e-9, 1 - f)
        explained = (np.array(ORDERS)[:, None, None] * true / np.maximum(total, 1)[:, :, None]).sum(axis=0)
        best, all_ = explained.argmax(axis=1), explained.sum(axis=1)
        for i in np.flatnonzero(letters):
            names[i] = self.languages[best[i]]
            scores[i] = explained[i, best[i]] / all_[i] if all_[i] > 0 else 0.0
        return names, scores


def make_filters(grams: dict[str, np.ndarray], bits: int = 18) -> LanguageFilters:
    """Filters that hold the given n-gram hashes of each language."""
    languages, size = tuple(sorted(grams)), 1 << bits
    while size < 12 * max(map(len, grams.values()), default=0):
        size *= 2
    slots, rates = [], []
    for first in range(0, len(languages), GROUP):
        own = languages[first : first + GROUP]
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(own) <= 8 * k().itemsize)
        made = np.zeros(size, kind)
        for l, lang in enumerate(own):
            step, at = (grams[lang] >> np.uint64(17)) | np.uint64(1), grams[lang].copy()
            with np.errstate(over="ignore"):
                for _ in range(HASHES):
                    made[(at % np.uint64(size)).astype(np.int64)] |= kind(1 << l)
                    at += step
        slots.append(made)
        rates += [((made >> kind(l)) & kind(1)).mean() ** HASHES for l in range(len(own))]
    return LanguageFilters(languages, tuple(slots), np.array(rates))


def fit_filters(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", typical: float = 0.5, profile: int = 20_000, bits: int = 18) -> LanguageFilters:
    """Filters from all rows with a language. To the driver come at most `profile` n-grams a language and order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                found: dict[int, list] = {o: [] for o in ORDERS}
                for parts, _ in _chunks(own):
                    points, owner = _joined(parts)
                    for order in ORDERS:
                        found[order].append(np.unique(_grams(points, owner, order)[0], return_counts=True))
                for order, each in found.items():
                    keys, back = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate([c for _, c in each])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([order] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "ord", "gram", "n"])

    known = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = stage_table(known.mapInArrow(count, "lang string, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    totals = counts.groupBy("lang", "ord").agg(F.sum("n").alias("total"))
    share = counts.join(totals, ["lang", "ord"]).withColumn("p", F.col("n") / F.col("total"))
    peak = share.groupBy("ord", "gram").agg(F.max("p").alias("peak"))
    near = share.join(peak, ["ord", "gram"]).withColumn("near", F.col("p") / F.col("peak"))

    def first(chosen: DataFrame, by: str) -> list:
        # the top `profile` of each part first, so that no task sorts all of a language
        order = [F.desc(by), F.col("gram")]
        salted = chosen.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64)))
        some = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "ord", "salt").orderBy(*order))).filter(F.col("r") <= profile)
        return some.withColumn("r", F.row_number().over(Window.partitionBy("lang", "ord").orderBy(*order))).filter(F.col("r") <= profile).select("lang", "gram").toPandas()

    found = first(near.filter(F.col("near") >= typical), "p")
    grams = {lang: own.to_numpy().view(np.uint64) for lang, own in found.groupby("lang")["gram"]}
    lost = [r["lang"] for r in totals.select("lang").distinct().collect() if r["lang"] not in grams]
    if lost:
        more = first(near.filter(F.col("lang").isin(lost)), "near")
        grams |= {lang: own.to_numpy().view(np.uint64) for lang, own in more.groupby("lang")["gram"]}
    return make_filters(grams, bits)


def detect_languages(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.false_rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageFilters(*shared.value)
        for batch in batches:
            names, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{type_of(rows, 'doc_id')}, lang_pred string, score double")
