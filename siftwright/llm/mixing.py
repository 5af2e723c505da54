"""Mixing sources to target weights by distributed prefix sums, in DataFrame operations alone.

Every document gets a hash-random key of its id and text. Within each source the keys are cut into ranges, the word
counts of each range are summed, and a prefix sum over the ranges tells in which of them the source's budget ends.
Only that range is cut into finer ranges, and only the last of these is sorted by key: its prefix sum finds the exact
cut. A source takes whole epochs, then the documents before the cut, and of the document at the cut what is left of
the budget. The rows themselves never move: each compares its key with its source's cut, so a source with a third of
all rows needs no task of its own.

Targets: sources in code-point order (null last) have the weights 5, 2, 1, repeating, and share all words; a target
stops at three times its source's words and the excess is shared again by weight among the others. The fixed point of
that is computed in closed form: with sources sorted by cap / weight, a source is capped exactly if its cap is under
its weight times the level that the sources after it would share. This step ranks one row for each source in one task.

Defined cases: null texts have size 0; a source without words has target 0; a document of size 0 takes 0; rows that
repeat both id and text are copies with one key: where the cut falls on them they share the rest evenly, and of their
source less than one word a copy stays untaken; an empty table gives no rows; columns in `keep` may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import stage_table, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Keys are the first 60 bits of a digest; ranges are their first 10 bits, finer ones their first 20.
KEY_BITS = 60
RANGE_BITS, FINE_BITS = 10, 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    found = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    # the first source that is not capped sets the level of all that follow
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(Window.partitionBy())
    return found.withColumn("shared", shared["level"]).select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("shared")).alias("target"))


def _ends(parts: DataFrame, rests: DataFrame) -> DataFrame:
    """Of parts (source, part, words) the one of each source in which its rest (s, rest) ends, and what is left of the rest there."""
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    placed = starts.join(rests.select("s", "rest"), F.col("source").eqNullSafe(F.col("s"))).withColumn("rest", F.col("rest") - F.col("start"))
    return placed.filter("rest >= 0 and rest < words").select("s", "part", "rest")


def source_cuts(rows: DataFrame) -> DataFrame:
    """(s, source_size, target, epochs, cut, share) for each source of rows (source, key, text).

    `epochs` whole passes, then every key below `cut`, and `share` words of each row with the key `cut`.
    """
    coarse, fine = F.shiftright("key", KEY_BITS - RANGE_BITS), F.shiftright("key", KEY_BITS - FINE_BITS)
    words = F.sum(word_count(F.col("text"))).alias("words")
    ranges = stage_table(rows.groupBy("source", coarse.alias("part")).agg(words), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    targets = targets.withColumn("epochs", F.expr("if(source_size > 0, floor(target) div source_size, 0)"))
    targets = stage_table(targets.select(F.col("source").alias("s"), "source_size", "target", "epochs", (F.floor("target") - F.col("epochs") * F.col("source_size")).alias("rest")), "mix-targets")
    ends = stage_table(_ends(ranges, targets), "mix-ends")
    inside = lambda table, part: table.join(ends.select("s", "part"), F.col("source").eqNullSafe(F.col("s")) & (part == F.col("part")), "left_semi")
    keys = stage_table(inside(rows, coarse).groupBy("source", "key").agg(words, F.count("*").alias("copies")), "mix-keys")
    ends = stage_table(_ends(keys.groupBy("source", fine.alias("part")).agg(F.sum("words").alias("words")), ends), "mix-fine-ends")
    last = _ends(inside(keys, fine).withColumn("part", F.col("key")), ends).withColumnRenamed("s", "source").join(keys.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("key")))
    cuts = last.select(F.col("of").alias("cut_s"), F.col("key").alias("cut"), F.expr("rest div copies").alias("share"))
    found = targets.join(cuts, F.col("s").eqNullSafe(F.col("cut_s")), "left")
    return stage_table(found.select("s", "source_size", "target", "epochs", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("share", F.lit(0)).alias("share")), "mix-cuts")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, plus the columns in keep) for every row of docs."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    key = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    source = F.col(source_col).cast("string")
    cuts = source_cuts(docs.select(source.alias("source"), key.alias("key"), F.col(text_col).alias("text")))
    names = keep or []
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("_source"), word_count(F.col(text_col)).alias("size"), key.alias("_key"), F.struct(F.lit(0).alias("_"), *names).alias("_keep"))
    kept = [f"_keep.`{f}`" for f in rows.schema["_keep"].dataType.names[1:]]
    placed = rows.join(cuts, F.col("_source").eqNullSafe(F.col("s")))
    rest = F.when(F.col("_key") < F.col("cut"), F.col("size")).when(F.col("_key") == F.col("cut"), F.least("share", "size")).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + rest).cast("long").alias("taken"), *kept)


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, {KEY_BITS // 4}) AS BIGINT) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * {MAX_EPOCHS} AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= w * level THEN cap::DOUBLE
    ELSE w * (SELECT arg_min(level, (cap / w, source IS NULL, source)) FROM levels WHERE cap > w * level) END AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT r.*, b.source_size, b.target, b.epochs, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size
    - coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    count(*) OVER (PARTITION BY r.source, key) AS copies
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(rest AS BIGINT) // copies)) AS BIGINT) AS taken
FROM placed
"""
