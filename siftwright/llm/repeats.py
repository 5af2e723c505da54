"""Exact removal of long repeated byte strings by suffix sorting with bucket-pointer refinement.

A byte goes if a string of `LENGTH` bytes that covers it starts at some other place too, in the same document or in
another. Sorting all suffixes of a corpus would move every byte many times; here only places that can be equal meet:

1. Equal texts are one distinct text (key: 128 bits of SHA-256). Copies of LENGTH bytes or more are covered wholly.
2. Every window of LENGTH bytes has an anchor, its least hashed GRAM (leftmost of equals). Windows in a row with the
   same anchor are one segment. Equal windows have equal anchors, so an anchor hash seen once clears its windows.
3. Segments of the other anchors are cut from the texts. Segments with equal bytes are one content; a content that
   occurs more than once is covered wholly, and only contents of one anchor can share other windows.
4. The contents are dealt by anchor and their windows suffix-sorted: buckets of equal 8-byte grams first, each then
   refined by sorting on the bucket pointers of a later offset; refined pointers serve the next round, so the depth
   doubles to LENGTH in five rounds. Windows left in one bucket are equal. Only buckets of several are sorted again.
5. An anchor with more than `CROWD` different contents (the edges of a passage in very many documents) would be one
   large group: its windows are dealt by 128-bit digests of their bytes and counted instead, as many tasks as wished.

Defined cases: null texts are empty; texts shorter than LENGTH keep all bytes; rows that repeat a text are places of
their own; null or repeated doc_ids stay as they are; other columns are not read. Groups in a task are sorted in
batches of `BATCH` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import stage_table

LENGTH = 200
GRAM = 24
PIECE = 1 << 20
BATCH = 1_500_000
CROWD = 20_000
POSITION_BITS = 22


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; the last 7 places are left out."""
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    eight = _words8(data)
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += eight[8 : 8 + n]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h += eight[16 : 16 + n]
        h *= np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, anchor hash, first window, number of windows) of every segment, in order."""
    out: list[tuple] = []
    pieces: list[tuple[int, int, bytes]] = []
    room = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(p for *_, p in pieces), np.uint8)
        sizes = np.array([len(p) for *_, p in pieces])
        h = _gram_hashes(data)
        key = (h >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_least(key, LENGTH - GRAM + 1) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
        valid = np.arange(len(at)) <= (ends - LENGTH)[owner]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        spots = np.flatnonzero(valid)
        first = spots[new[spots] | np.concatenate([[True], ~valid[spots[1:] - 1]])] if len(spots) else spots
        if not len(first):
            return
        run = np.cumsum(np.isin(spots, first, assume_unique=True)) - 1
        count = np.bincount(run, minlength=len(first))
        of = owner[first]
        out.append((np.array([i for i, *_ in pieces])[of], h[at[first]].view(np.int64), first - begins[of] + np.array([s for _, s, _ in pieces])[of], count))

    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - LENGTH + 1), PIECE):
            part = t[a : a + PIECE + LENGTH - 1]
            if pieces and room + len(part) > 2 * PIECE:
                flush()
                pieces, room = [], 0
            pieces.append((i, a, part))
            room += len(part)
    if pieces:
        flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows data[s : s + length] occur at another of the starts too, by bucket-pointer refinement."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = _words8(data)
    n = len(keys)
    order = np.argsort(keys)
    sorted_ = keys[order]
    head = np.ones(n, bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    pointer = np.empty(n, np.int64)
    pointer[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        last = depth + step == length
        if last:
            active = starts
            size = np.bincount(pointer[starts], minlength=n)
        else:
            active, size = np.arange(n - step), np.bincount(pointer, minlength=n)
        active = active[size[pointer[active]] > 1]
        if not len(active):
            return np.zeros(len(starts), bool)
        pair = pointer[active] << 32 | pointer[active + step]
        order = np.argsort(pair)
        pair, who = pair[order], active[order]
        bucket = pair >> 32
        fresh = np.ones(len(pair), bool)
        fresh[1:] = bucket[1:] != bucket[:-1]
        split = np.ones(len(pair), bool)
        split[1:] = pair[1:] != pair[:-1]
        index = np.arange(len(pair))
        base = np.maximum.accumulate(np.where(fresh, index, 0))
        inner = np.maximum.accumulate(np.where(split, index, 0))
        if last:
            many = np.bincount(inner, minlength=len(pair))[inner] > 1
            flags = np.zeros(n, bool)
            flags[who[many]] = True
            return flags[starts]
        pointer = pointer.copy()
        pointer[who] = bucket + (inner - base)
        depth += step
    return np.bincount(pointer[starts], minlength=n)[pointer[starts]] > 1


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [c.as_buffer().to_pybytes() for c in batch.column(2)]
        own, h, start, n = anchor_segments(texts)
        offsets = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h, start.astype(np.int32), n.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["key", "n_bytes", "h", "start", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment; its bytes only where this task has not just given the same content."""
    seen: set[bytes] = set()
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_buffer().to_pybytes()
            parts = batch.column(2)[row].values
            hs, starts, ns = (parts.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            contents, data = [], []
            for s, n in zip(starts.tolist(), ns.tolist(), strict=True):
                part = text[s : s + n + LENGTH - 1]
                content = hashlib.blake2b(part, digest_size=16).digest()
                contents.append(content)
                data.append(None if content in seen else part)
                seen.add(content)
            if len(seen) > 300_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(starts), pa.binary()), pa.array(hs), pa.array(starts), pa.array(contents, pa.binary()), pa.array(data, pa.binary())], names=["key", "h", "start", "content", "data"])


def _sort_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents in order of anchor -> for each that occurs once, the part of it that other windows repeat."""
    group: list[tuple[bytes, bytes, int]] = []
    ready: list[tuple[bytes, bytes, int]] = []
    last, room = None, 0

    def sort() -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(d for _, d, _ in ready), np.uint8)
        sizes = np.array([len(d) for _, d, _ in ready])
        begins, windows = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(ready)), windows)
        inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        found = repeated_windows(data, begins[owner] + inside)
        found &= np.array([n == 1 for *_, n in ready])[owner]
        own, spot = owner[found], inside[found]
        if len(own):
            heads = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            tails = np.concatenate([heads[1:] - 1, [len(own) - 1]])
            yield pa.RecordBatch.from_arrays([pa.array([ready[i][0] for i in own[heads].tolist()], pa.binary()), pa.array(spot[heads].astype(np.int32)), pa.array((spot[tails] + LENGTH).astype(np.int32))], names=["content", "a", "b"])

    for batch in batches:
        for h, content, data, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if h != last:
                if len(group) > 1 and any(x[2] == 1 for x in group):
                    ready += group
                    room += sum(len(x[1]) for x in group)
                    if room >= BATCH:
                        yield from sort()
                        ready, room = [], 0
                group, last = [], h
            group.append((content, data, n))
    if len(group) > 1 and any(x[2] == 1 for x in group):
        ready += group
    if ready:
        yield from sort()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of crowded contents by the digest of its bytes."""
    for batch in batches:
        for content, data, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            many = len(data) - LENGTH + 1
            digests = [hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest() for i in range(many)]
            yield pa.RecordBatch.from_arrays([pa.array([content] * many, pa.binary()), pa.array(digests, pa.binary()), pa.array(np.arange(many, dtype=np.int32)), pa.array(np.full(many, n))], names=["content", "window", "spot", "n"])


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, text): one row for each distinct text of at least LENGTH bytes."""
    rows = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text")).filter(F.length("text") >= LENGTH)
    return rows.groupBy("key").agg(F.first("text").alias("text"))


def repeated_spans(docs: DataFrame, text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(key, copies, n_bytes, spans): for each distinct text that loses bytes, its covered parts as array of (a, b).

    The parts of a text may overlap; a text that occurs more than once has none and is covered wholly.
    """
    rows = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text")).withColumn("n_bytes", F.length("text").cast("long")).filter(F.col("n_bytes") >= LENGTH)
    anchors = rows.select("key", "n_bytes", "text").mapInArrow(_anchors, "key binary, n_bytes long, h array<long>, start array<int>, n array<int>")
    folded = anchors.groupBy("key").agg(F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies"), F.first(F.arrays_zip("h", "start", "n")).alias("segments"))
    folded = stage_table(folded, "repeat-anchors")
    each = folded.select("key", F.explode("segments").alias("s")).select("key", "s.*")
    # aggregates that join their own input are written first, so that a join may split a value that very many rows share
    often = stage_table(each.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1").select("h"), "repeat-often")
    places = each.join(often, "h").groupBy("key").agg(F.collect_list(F.struct("h", "start", "n")).alias("segments"))
    cut = distinct_texts(docs, text_col).join(stage_table(places, "repeat-places"), "key")
    cut = stage_table(cut.select("key", "text", "segments").mapInArrow(_cut, "key binary, h long, start int, content binary, data binary"), "repeat-segments")
    contents = stage_table(cut.groupBy("content", "h").agg(F.first("data", ignorenulls=True).alias("data"), F.count("*").alias("n")), "repeat-contents")
    crowded = stage_table(contents.groupBy("h").agg(F.count("*").alias("many")).filter(F.col("many") > crowd).select("h"), "repeat-crowded")
    sorted_ = contents.join(crowded, "h", "left_anti").select("h", "content", "data", "n").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_contents, "content binary, a int, b int")
    windows = contents.join(crowded, "h", "left_semi").select("content", "data", "n").mapInArrow(_windows, "content binary, window binary, spot int, n long")
    twice = stage_table(windows.groupBy("window").agg(F.sum("n").alias("many")).filter("many > 1").select("window"), "repeat-twice")
    dealt = windows.filter("n = 1").join(twice, "window").groupBy("content").agg(F.min("spot").alias("a"), (F.max("spot") + LENGTH).alias("b"))
    whole = contents.filter("n > 1").select("content", F.lit(0).alias("a"), F.length("data").alias("b"))
    covered = stage_table(sorted_.unionByName(dealt).unionByName(whole), "repeat-covered")
    spans = cut.select("key", "start", "content").join(covered, "content").select("key", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("span"))
    spans = spans.groupBy("key").agg(F.collect_list("span").alias("spans"))
    found = folded.select("key", "n_bytes", "copies").join(spans, "key", "left").filter("copies > 1 or spans is not null")
    return stage_table(found, "repeat-spans")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            text, merged = batch.column(1)[row].as_buffer().to_pybytes(), []
            parts = batch.column(2)[row].values
            for a, b in sorted(zip(parts.field(0).to_pylist(), parts.field(1).to_pylist(), strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([[{"a": a, "b": b} for a, b in merged]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([b"".join(kept)], pa.binary())], names=["key", "spans", "kept"])


def _cleaned(docs: DataFrame, spans: DataFrame, text_col: str) -> DataFrame:
    """(key, spans, kept) of each distinct text that loses bytes without being repeated as a whole."""
    parts = spans.filter("copies = 1").select("key", "spans")
    return distinct_texts(docs, text_col).join(parts, "key").select("key", "text", "spans").mapInArrow(_keep, "key binary, spans array<struct<a:int,b:int>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, spans, kept): for every row the removed byte ranges, merged and in order, and the bytes that remain."""
    spans = repeated_spans(docs, text_col, crowd)
    cleaned = _cleaned(docs, spans, text_col).unionByName(spans.filter("copies > 1").select("key", F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b"))).alias("spans"), F.lit(b"").alias("kept")))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), text.alias("own"))
    return rows.join(cleaned, "key", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"), F.coalesce("kept", "own").alias("kept"))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; only digests meet the rows, never bytes."""
    spans = repeated_spans(docs, text_col, crowd)
    cleaned = _cleaned(docs, spans, text_col).select("key", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    copies = spans.filter("copies > 1").select("key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    found = stage_table(cleaned.unionByName(copies), "repeat-digests")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    rows = rows.withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    return rows.join(found, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
