"""Collocations by contiguous pattern growth: the pointers of every frequent prefix are projected and grown to the right.

1. Words are counted by language; the counts are the prefixes of one word, and the table of hashes and words.
2. Every occurrence of a word is a pointer into the text. Workers project it to what follows in its piece, at most
   `max_words - 1` words, as 64-bit hashes; equal projections of a slice of text are one with a count. The pointers of a
   prefix (language, first word) meet in one task, in order of prefix, a prefix at a time.
3. There a prefix is extended depth first: its pointers are divided by the next word, words with too few pointers are
   left, and each of the others is a longer prefix with its part of the pointers.
4. A first word with more than `bound` pointers is dealt to several tasks by what follows it. Its longest phrases are
   still whole in one task; of the shorter ones every task gives its part, and the parts are added up.
5. Cuts, scores and longer phrases meet by joins on the hashes of the parts. Words are spelled out only for phrases that
   can be among the first `top` of their language, ties included.

No two words of a corpus may share a hash: this is verified on the word table, and another seed taken if they do.

Defined cases: null texts are empty; a null language is `und` and one with documents that say so; texts without words
give nothing; repeated rows count each; an empty table gives no rows; very long texts are read in slices, with the words
that follow a slice; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.bytewords import byte_classes, find_words, heads, mix, slices, spelled
from siftwright.llm.common import stage_table

LEAST = 10
MAX_WORDS = 3
TOP = 2000
#: Per cent of a phrase's occurrences that lie inside one longer phrase, from which the phrase is dropped.
INSIDE = 50
#: Pointers of a prefix in one task; with more than a million times as many words, a millionth of the words.
BOUND = 100_000
#: Parts in which the phrases of a language are ranked before they are ranked together.
PARTS = 64
CLASSES = byte_classes(r"[^\x20\x09]", r"[.,;:!?\x0A-\x0D]")
NONE = np.uint64(0)


def _texts(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """(languages, language number of each row, texts) of a batch (lang, text)."""
    langs = batch.column(0).dictionary_encode()
    return langs.dictionary, langs.indices.to_numpy(), [t.as_buffer().to_pybytes() for t in batch.column(1).cast(pa.binary())]


def _hashes(words) -> np.ndarray:
    return np.maximum(words.hash, np.uint64(1))


def _word_counts(seed: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, of, texts = _texts(batch)
            for part in slices(texts, CLASSES):
                found = find_words(part, CLASSES, seed)
                if not len(found.start):
                    continue
                h, lang = _hashes(found), of[found.part]
                order = np.argsort(mix(h + lang.astype(np.uint64)))
                first = heads(h[order], lang[order])
                which = order[first]
                many = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[which])), pa.array(h[which].view(np.int64)), spelled(found, which).cast(pa.string()), pa.array(many)], names=["lang", "h", "word", "f"])

    return count


def _project(seed: int, max_words: int, hot: tuple[np.ndarray, np.ndarray], bound: int):
    """Rows (lang, h, salt, ahead, many): what follows a word, `max_words - 1` hashes each, and how often (null: once each).

    The salt is -1, or for words of `hot` (sorted keys of language and word, occurrences) one of several by what follows.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = hot
        for batch in batches:
            langs, of, texts = _texts(batch)
            marks = np.array([lang_mark(x) for x in langs.to_pylist()], np.uint64)
            for part in slices(texts, CLASSES, max_words - 1):
                found = find_words(part, CLASSES, seed)
                h, n = _hashes(found), len(found.start)
                ahead = np.zeros((n, max_words - 1), np.uint64)
                for k in range(1, max_words):
                    if n > k:
                        ahead[: n - k, k - 1] = np.where(found.run[k:] == found.run[:-k], h[k:], NONE)
                rows = np.flatnonzero(found.own & (ahead[:, 0] != NONE))
                if not len(rows):
                    continue
                h, ahead, lang = h[rows], ahead[rows], of[found.part[rows]]
                rest = np.zeros(len(rows), np.uint64)
                for k in range(max_words - 1):
                    rest = mix(rest + ahead[:, k])
                key = mix(h ^ marks[lang])
                salt = np.full(len(rows), -1, np.int32)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hits = np.flatnonzero(keys[at] == key)
                    salt[hits] = (rest[hits] >> np.uint64(33)) % (-(-often[at[hits]] // bound)).astype(np.uint64)
                order = np.argsort((mix(key + salt.astype(np.uint64)) >> np.uint64(32) << np.uint64(32)) | (rest >> np.uint64(32)))
                h, ahead, lang, salt = h[order], ahead[order], lang[order], salt[order]
                entry = heads(h, lang, salt, *ahead.T)
                many = np.diff(np.append(entry, len(order))).astype(np.int32)
                h, ahead, lang, salt = h[entry], ahead[entry], lang[entry], salt[entry]
                group = heads(h, lang, salt)
                ends = np.append(group, len(entry))
                offsets = pa.py_buffer((ends * 8 * (max_words - 1)).astype(np.int32))
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(group), [None, offsets, pa.py_buffer(np.ascontiguousarray(ahead))])
                counted = np.maximum.reduceat(many, group) > 1
                kept = np.repeat(counted, np.diff(ends))
                sizes = np.where(counted, np.diff(ends), 0)
                counts = pa.BinaryArray.from_buffers(pa.binary(), len(group), [pa.py_buffer(np.packbits(counted, bitorder="little")), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)), pa.py_buffer(many[kept])])
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[group])), pa.array(h[group].view(np.int64)), pa.array(salt[group]), blobs, counts], names=["lang", "h", "salt", "ahead", "many"])

    return project


def lang_mark(lang: str) -> int:
    """A number for a language, the same in all tasks."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def grow(prefix: tuple[int, ...], pointers: np.ndarray, ahead: np.ndarray, many: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(phrase, occurrences) of every frequent phrase that extends the prefix to the right, depth first."""
    depth = len(prefix) - 1
    following = ahead[pointers, depth]
    pointers = pointers[following != NONE]
    if not len(pointers):
        return
    following = ahead[pointers, depth]
    order = np.argsort(following, kind="stable")
    pointers, following = pointers[order], following[order]
    first = heads(following)
    total = np.add.reduceat(many[pointers], first)
    ends = np.append(first[1:], len(pointers))
    for i in np.flatnonzero(total >= least):
        longer = (*prefix, int(following[first[i]]))
        yield longer, int(total[i])
        if depth + 1 < ahead.shape[1]:
            yield from grow(longer, pointers[first[i] : ends[i]], ahead, many, least)


def parts_of_hot(head: int, ahead: np.ndarray, many: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """The same for a task that has only some pointers of a prefix: shorter phrases as parts, the longest whole."""
    width = ahead.shape[1]
    for k in range(1, width):
        order = np.lexsort(ahead[:, :k].T[::-1])
        inside = order[ahead[order, k - 1] != NONE]
        if len(inside):
            first = heads(*ahead[inside, :k].T)
            for i, n in zip(inside[first].tolist(), np.add.reduceat(many[inside], first).tolist(), strict=True):
                yield (head, *ahead[i, :k].tolist()), n
    for phrase, n in grow((head,), np.arange(len(ahead)), ahead, many, least):
        if len(phrase) == width + 1:
            yield phrase, n


def _grown(max_words: int, least: int):
    """Rows of _project in order of prefix -> (lang, key, a): the key is the hashes of a phrase's words, big-endian."""
    width = max_words - 1

    def one(lang: str, h: int, salt: int, ahead: list, many: list, out: list) -> None:
        ahead, many = np.concatenate(ahead), np.concatenate(many)
        if salt < 0:
            if many.sum() < least:
                return
            found = grow((h,), np.arange(len(ahead)), ahead, many, least)
        else:
            found = parts_of_hot(h, ahead, many, least)
        out.extend((lang, b"".join(x.to_bytes(8, "big") for x in phrase), n) for phrase, n in found)

    def table(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], names=["lang", "key", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column(0)
            h, salt = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            codes = langs.dictionary_encode().indices.to_numpy()
            group = heads(codes, h, salt)
            ends = np.append(group[1:], batch.num_rows)
            offsets = np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset :][: batch.num_rows + 1] // (8 * width)
            data = batch.column(3).buffers()[2]
            entries = np.frombuffer(data, np.uint64, offsets[-1] * width).reshape(-1, width) if data is not None else np.zeros((0, width), np.uint64)
            many = np.ones(len(entries), np.int64)
            counted = np.flatnonzero(pc.is_valid(batch.column(4)).to_numpy(zero_copy_only=False))
            if len(counted):
                sizes = (offsets[1:] - offsets[:-1])[counted]
                at = np.repeat(offsets[:-1][counted] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                many[at] = np.frombuffer(b"".join(batch.column(4).filter(pc.is_valid(batch.column(4))).to_pylist()), np.int32)
            total = np.add.reduceat(many, offsets[group])
            last = len(group) - 1
            for i in range(len(group)):
                a, b = offsets[group[i]], offsets[ends[i]]
                if 0 < i < last and salt[group[i]] < 0 and total[i] < least:
                    continue
                key = (langs[int(group[i])].as_py(), int(h[group[i]]), int(salt[group[i]]))
                if open_ is not None and open_[0] != key:
                    one(*open_[0], open_[1], open_[2], out)
                    open_ = None
                if open_ is None:
                    open_ = (key, [], [])
                open_[1].append(entries[a:b])
                open_[2].append(many[a:b])
            # the open prefix goes on in the next batch: keep its pointers, not the batch
            open_ = (open_[0], [np.concatenate(open_[1])], [np.concatenate(open_[2])])
            if len(out) > 20_000:
                yield table(out)
                out = []
        if open_ is not None:
            one(*open_[0], open_[1], open_[2], out)
        if out:
            yield table(out)

    return run


def word_table(rows: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(lang, h, word, f) of rows (lang, text), and a seed with which no two words share a hash."""
    while True:
        counted = rows.mapInArrow(_word_counts(seed), "lang string, h long, word string, f long")
        words = stage_table(counted.groupBy("lang", "h", "word").agg(F.sum("f").alias("f")), "phrase-words")
        if words.groupBy("h").agg((F.min("word") != F.max("word")).alias("shared")).filter("shared").isEmpty():
            return words, seed
        seed += 1


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, max_words: int = MAX_WORDS, bound: int = BOUND, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(lang, key, a) of all phrases of one to max_words words with `least` occurrences or more, and the word table."""
    if max_words < 2:
        raise ValueError("a phrase has two words or more")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, seed = word_table(rows, seed)
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    bound = max(bound, total // 1_000_000)
    hot = words.filter(F.col("f") > bound).select("lang", "h", "f").collect()  # at most a million rows
    keys = mix(np.array([x["h"] for x in hot], np.int64).view(np.uint64) ^ np.array([lang_mark(x["lang"]) for x in hot], np.uint64))
    order = np.argsort(keys)
    hot = (keys[order], np.array([x["f"] for x in hot], np.int64)[order])
    projected = rows.mapInArrow(_project(seed, max_words, hot, bound), "lang string, h long, salt int, ahead binary, many binary")
    dealt = projected.repartition("lang", "h", "salt").sortWithinPartitions("lang", "h", "salt")
    grown = dealt.mapInArrow(_grown(max_words, least), "lang string, key binary, a long")
    grown = grown.groupBy("lang", "key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    single = words.filter(F.col("f") >= least).select("lang", F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("key"), F.col("f").alias("a"))
    return stage_table(grown.unionByName(single), "phrases"), words


def _n_words(key):
    return (F.length(key) / 8).cast("int")


def scored_phrases(phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, key, a, l, r, score) of (lang, key, a): phrases of several words by their lowest cut, without those inside longer ones."""
    several = phrases.filter(F.length("key") > 8)
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), _n_words(F.col("key")) - 1)))
    cuts = cuts.withColumn("first", F.expr("substring(key, 1, 8 * k)")).withColumn("rest", F.expr("substring(key, 8 * k + 1)"))
    left = phrases.select("lang", F.col("key").alias("first"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("key").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    square = (whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).alias("square")
    cuts = cuts.withColumn("square", square).withColumn("product", whole("l") * whole("r")).withColumn("score", F.expr("square div product"))
    best = cuts.groupBy("lang", "key").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "key", "best.*")
    longer = several.filter(F.length("key") > 16).withColumn("at", F.explode(F.expr("flatten(transform(sequence(2, cast(length(key) / 8 as int) - 1), m -> transform(sequence(0, cast(length(key) / 8 as int) - m), i -> struct(i, m))))")))
    longer = longer.select("lang", F.expr("substring(key, 8 * at.i + 1, 8 * at.m)").alias("key"), F.col("a").alias("around")).groupBy("lang", "key").agg(F.max("around").alias("around"))
    return best.join(longer, ["lang", "key"], "left").filter(F.coalesce(F.lit(100) * F.col("around") < F.lit(inside) * F.col("a"), F.lit(True))).select("lang", "key", "a", "l", "r", "score")


def mine_collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, max_words: int = MAX_WORDS, inside: int = INSIDE, top: int = TOP, bound: int = BOUND) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of every language, by score, a and phrase."""
    phrases, words = frequent_phrases(docs, lang_col, text_col, least, max_words, bound)
    ahead = scored_phrases(phrases, inside).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):  # first among a part of a language's phrases, so that no task ranks them all
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"))
        ahead = ahead.withColumn("place", F.rank().over(order)).filter(F.col("place") <= top).drop("place")
    ahead = stage_table(ahead.drop("part"), "phrases-ahead")
    each = ahead.select("lang", "key", F.explode(F.sequence(F.lit(0), _n_words(F.col("key")) - 1)).alias("i"))
    each = each.withColumn("part", F.expr("substring(key, 8 * i + 1, 8)"))
    spell = words.select("lang", F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("part"), "word")
    spelled_ = each.join(spell, ["lang", "part"]).groupBy("lang", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = ahead.join(spelled_, ["lang", "key"]).withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grown AS (SELECT lang, w, i, unnest([1, 2, 3]) AS m FROM spots),
f AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, any_value(w[i:i + m - 1]) AS w, count(*) AS a
  FROM grown WHERE i + m - 1 <= len(w) GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, p.a AS l, q.a AS r, CAST((1000000::HUGEINT * c.a * c.a) // (p.a::HUGEINT * q.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1) c
  JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, sub, max(a) AS around FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub FROM f WHERE len(w) = 3)
  GROUP BY lang, sub),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.sub = best.phrase WHERE around IS NULL OR 100 * around < {INSIDE} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= {TOP}
"""
