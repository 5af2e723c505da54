"""SimHash near-duplicates by multi-index hashing.

Every text becomes a 64-bit fingerprint. The 64 bits are cut into three segments; two fingerprints within four bits
differ by at most one bit in some segment, so each fingerprint probes the ball of radius one around each of its
segments, the segment tables return the fingerprints that match a probe, and the whole distance is verified.
Equal fingerprints are folded into one class first, so that a group of exact copies is one node.

A segment value that more than `DENSE_BUCKET` different fingerprints share is not probed. What could be lost by that
lies between fingerprints that both hold such a value; these go to finer tables: of eight segments four are equal if
at most four bits differ, so the tables' keys are all choices of four. Fingerprints that crowd there as well are
linked by midpoints: two of them lie within four bits if and only if some point is within two bits of both. A point
has 2,081 others within two bits, so no group of this step can be larger, whatever the data. No step forms all pairs
of a group of unbounded size, and the links stay exact. Parts are joined by large-star and small-star steps.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; null
doc_ids keep their row and are ignored when a component's smallest id is taken (null if it has no other); repeated
rows are returned as often as they come; other columns of the input are not read; ids may be of any type that has an
order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import release, stage_table, type_of

SEED = 42
#: Different fingerprints in one bucket of a table up to which its members are compared directly.
DENSE_BUCKET = 64
#: Segments of the finer tables.
FINE = 8


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): one row per row of docs; fp holds the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in batch.column(1).cast(pa.binary())]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{type_of(rows, 'doc_id')}, fp long")


def _segments(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` bits."""
    return [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _longs(values: list[int]) -> Column:
    """A constant array of 64-bit numbers."""
    return F.split(F.lit(",".join(str(v - (1 << 64) if v >> 63 else v) for v in values)), ",").cast("array<long>")


def _first_equal(x: Column, segments: list[tuple[int, int]], many: int) -> Column:
    """The bits of the first `many` segments in which x is zero; of fewer, if x is zero in fewer."""
    masks, zero = [(1 << width) - 1 << shift for shift, width in segments], F.lit(0)
    for i, mask in enumerate(masks):
        zero = zero.bitwiseOR(F.when(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")) == 0, 1 << i).otherwise(0))
    # looked up by which segments are zero: as nested conditions it would stand in the plan once for each pair of segments
    chosen = [sum([m for i, m in enumerate(masks) if found >> i & 1][:many]) for found in range(1 << len(masks))]
    return F.element_at(_longs(chosen), zero + 1)


def _lookup(table: DataFrame, probes: DataFrame, radius: int, dense: int, also: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs (u, v) within the radius that meet in a bucket of at most `dense`, fingerprints (fp) of larger buckets).

    also is a further condition on a pair (fp, other) in a bucket.
    """
    by = ["seg", "key"]
    heavy = stage_table(table.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > dense).select(*by), "simhash-heavy")
    near = (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    near = near if also is None else near & also
    # sizes of exploded rows are estimated far too low, so neither side may be broadcast
    pairs = probes.hint("merge").join(table.join(heavy, by, "left_anti").hint("merge"), by).filter(near).select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v")).distinct()
    return pairs, table.join(heavy, by, "left_semi").select("fp").distinct()


def midpoint_stars(points: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of points (column fp, all different) within the radius, and no others."""
    low, high = radius // 2, radius - radius // 2
    near = points.select("fp", F.explode(_longs(_ball(64, high))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"), (F.bit_count("mask") <= low).alias("close"))
    # at most as many fingerprints as the ball has points stand around one midpoint; all are within the radius of a close one
    met = near.groupBy("mid").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("centre"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    edges = met.select("centre", F.explode("all").alias("fp")).filter(F.col("fp") != F.col("centre"))
    return edges.select(F.greatest("fp", "centre").alias("u"), F.least("fp", "centre").alias("v")).distinct()


def links(classes: DataFrame, radius: int = 4, parts: int = 3, dense: int = DENSE_BUCKET) -> DataFrame:
    """Edges (u, v), u > v, that connect whatever fingerprints (column fp, all different) lie within the radius."""
    segments, each = _segments(parts), radius // parts
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = classes.select("fp").repartition(tasks, "fp")  # each row becomes many
    value = lambda shift, width: F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))
    each_of = lambda *entries: F.explode(F.array(*entries)).alias("t")
    entry = lambda i, key: F.struct(F.lit(i).alias("seg"), key.alias("key"))
    table = own.select("fp", each_of(*[entry(i, value(*s)) for i, s in enumerate(segments)])).select("fp", "t.*")
    probes = own.select("fp", each_of(*[F.struct(F.lit(i).alias("seg"), value(*s).alias("value"), _longs(_ball(s[1], each)).alias("ball")) for i, s in enumerate(segments)]))
    probes = probes.select(F.col("fp").alias("other"), "t.seg", "t.value", F.explode("t.ball").alias("mask")).select("other", "seg", F.col("value").bitwiseXOR(F.col("mask")).alias("key"))
    # every table's pairs are written before the next is searched: one plan of all of them fills the driver's heap
    found, crowd = _lookup(table, probes, radius, dense)
    found, crowd = stage_table(found, "simhash-pairs"), stage_table(crowd, "simhash-crowd")
    if crowd.isEmpty():
        return found
    sums = [sum((1 << w) - 1 << s for s, w in chosen) for chosen in combinations(_segments(FINE), FINE - radius)]
    fine = crowd.repartition(tasks, "fp").select("fp", F.posexplode(_longs(sums)).alias("seg", "mask")).select("fp", "seg", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # a pair counts in the first choice on which it agrees, once; if that bucket is crowded, both go on
    once = (F.col("fp") > F.col("other")) & (F.col("mask") == _first_equal(F.col("fp").bitwiseXOR(F.col("other")), _segments(FINE), FINE - radius))
    more, rest = _lookup(fine, fine.select(F.col("fp").alias("other"), "seg", "key"), radius, dense, once)
    found, rest = found.unionByName(stage_table(more, "simhash-pairs")), stage_table(rest, "simhash-rest")
    return found if rest.isEmpty() else found.unionByName(stage_table(midpoint_stars(rest.repartition(tasks, "fp"), radius), "simhash-stars"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of node's part; nodes that are roots themselves are left out.

    Alternates large-star and small-star steps until nothing changes; each round is a written table.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    now = stage_table(edges.filter("u > v").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        # the least neighbours are written first, so that a join may split a node that very many others neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage_table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = stage_table(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large-star")
        first = stage_table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(first, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct()
        then = stage_table(small, "edges")
        release(now, least, large, first)
        now, mark_now = then, mark(then)
        if mark_now == seen:
            break
        seen = mark_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, parts: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; fingerprint is 16 hex digits."""
    rows = stage_table(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    classes = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    roots = connected(links(classes, radius, parts)).withColumnRenamed("node", "fp")
    of = classes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = stage_table(of.join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_digest(text: Column) -> Column:
    """128 bits that name a text; null is empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of groups (c, root): c is the digest of a text, root names the group it is in.

    The row with the smallest id stays, rows without an id come last; of several with that id the least digest; of
    rows that agree in both, any one.
    """
    digest = text_digest(F.col(text_col))
    named = docs.select(F.col(id_col).alias("id"), digest.alias("c")).groupBy("id", "c").agg(F.lit(0).alias("_"))
    first = named.join(groups, "c").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "c")).alias("f"))
    row_key = lambda id_, c: F.unhex(F.md5(F.concat(c, F.coalesce(F.encode(id_.cast("string"), "utf-8"), F.lit(b"")), F.when(id_.isNull(), b"\x01").otherwise(b"\x00"))))
    keep = stage_table(first.select(row_key(F.col("f.id"), F.col("f.c")).alias("_key_of_row")), "keep")
    # copies of a row fold before and in the one exchange of the rows; what is kept grows with them, so the join is the same at every size
    rows = docs.withColumn("_key_of_row", row_key(F.col(id_col), digest)).dropDuplicates(["_key_of_row"])
    return rows.join(keep.hint("merge"), "_key_of_row", "left_semi").drop("_key_of_row")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs, with all columns, for each group of texts whose fingerprints are linked; see keep_first."""
    texts = docs.select(text_digest(F.col(text_col)).alias("c"), F.col(text_col).cast("string").alias("text")).groupBy("c").agg(F.first("text").alias("text"))
    found = simhash_components(texts, "c", "text", shingle, radius)
    return keep_first(docs, stage_table(found.select(F.col("doc_id").alias("c"), F.col("component_id").alias("root")), "simhash-groups"), id_col, text_col)
