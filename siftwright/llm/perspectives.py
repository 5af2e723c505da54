"""Multi-party perspective rotation of dialogues, in DataFrame operations alone.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; system messages stay system messages and no one takes their place. The mask lists the character spans
(start-end, end exclusive) that a model is trained on: the assistant's own words and the mark that ends them.

A long conversation is rendered in parts of `part_turns` consecutive turn numbers, so no row and no group grows with
the length of a conversation; `part` counts them and offsets in a mask are those of its part. A later part begins with
the conversation's first system message and with the last `context_turns` turn numbers of the part before it, so that
every turn is seen in its dialogue; what a part repeats is rendered but in no mask, so each turn is trained on once.

Defined cases: null or blank roles are the speaker `unknown`; null texts are empty messages; messages without a turn
number have no place in a dialogue and are dialogues of one message (part null), as are rows without a conversation;
rows that repeat a message (same conversation, turn, speaker and text) are one message; a
conversation of system messages only has no participant and gives no row; `<|` inside texts and names is written
`< |`, and a double quote in a name as a single one, so that no text can forge a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", part_turns: int = 64, context_turns: int = 8) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_context, n_trained, rendered, mask)."""
    speaker = F.trim(F.coalesce(F.col(speaker_col), F.lit("")))
    base = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(speaker == "", "unknown").otherwise(speaker).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).distinct()
    base = base.withColumn("lone", F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.xxhash64("turn", "speaker", "text")))
    first = F.min(F.when(F.col("speaker") == system, F.struct(F.col("turn").isNull(), "turn", "speaker", "text")))
    people = base.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_set(F.when(F.col("speaker") != system, F.col("speaker")))).alias("people"), first.alias("head"))
    people = people.select(F.col("conv_id").alias("c"), F.col("lone").alias("l"), "people", "head")
    part = F.floor(F.col("turn") / part_turns)
    own, again = F.struct(part.alias("part"), F.lit(True).alias("fresh")), F.struct((part + 1).alias("part"), F.lit(False).alias("fresh"))
    base = base.withColumn("to", F.explode(F.when(F.pmod("turn", F.lit(part_turns)) >= part_turns - context_turns, F.array(own, again)).otherwise(F.array(own))))
    said = F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "speaker", "text", F.col("to.fresh").alias("fresh"))
    parts = base.groupBy("conv_id", "lone", F.col("to.part").alias("part")).agg(F.array_sort(F.collect_list(said)).alias("turns"), F.max("to.fresh").alias("any")).filter("any")
    both = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("lone").eqNullSafe(F.col("l")))
    earlier = F.col("head.turn") < F.col("part") * part_turns - context_turns
    head = F.array(F.struct(F.col("head.turn").alias("turn"), F.col("head.speaker").alias("speaker"), F.col("head.text").alias("text"), F.lit(False).alias("fresh")))
    both = both.withColumn("turns", F.when(F.coalesce(earlier, F.lit(False)), F.concat(head, "turns")).otherwise(F.col("turns")))
    rows = both.select("conv_id", "part", "turns", F.explode("people").alias("perspective"))

    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))

    def message(m):
        own = m["speaker"] == F.col("perspective")
        name = F.replace(safe(m["speaker"]), F.lit('"'), F.lit("'"))
        head = F.when(m["speaker"] == system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit('<|user name="'), name, F.lit('"|>\n')))
        return F.struct(head.alias("head"), F.concat(safe(m["text"]), F.lit(END)).alias("body"), (own & m["fresh"]).alias("own"), m["fresh"].alias("fresh"))

    rows = rows.withColumn("messages", F.transform("turns", message))

    def step(state, m):
        start = state["at"] + F.length(m["head"])
        end = start + F.length(m["body"])
        span = F.concat(F.when(state["mask"] == "", F.lit("")).otherwise(F.lit(",")), start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.concat(state["mask"], F.when(m["own"], span).otherwise(F.lit(""))).alias("mask"))

    mask = F.aggregate("messages", F.struct(F.lit(0).alias("at"), F.lit("").alias("mask")), step, lambda s: s["mask"])
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "")
    return rows.select("conv_id", "perspective", "part", F.size(F.filter("messages", lambda m: m["fresh"])).cast("long").alias("n_turns"), F.size(F.filter("messages", lambda m: ~m["fresh"])).cast("long").alias("n_context"), F.size(F.filter("messages", lambda m: m["own"])).cast("long").alias("n_trained"), rendered.alias("rendered"), mask.alias("mask"))


ORACLE = """
WITH base AS (
  SELECT DISTINCT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker, coalesce(text, '') AS text
  FROM conversations),
placed AS (SELECT *, CAST(floor(turn / 64.0) AS BIGINT) AS part FROM base),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
parts AS (SELECT DISTINCT conv_id, part FROM placed),
heads AS (SELECT DISTINCT ON (conv_id) conv_id, turn, speaker, text FROM base WHERE speaker = 'system' ORDER BY conv_id, turn, text),
dealt AS (
  SELECT conv_id, part, turn, speaker, text, true AS fresh FROM placed
  UNION ALL SELECT conv_id, p.part, turn, speaker, text, false FROM placed b JOIN parts p USING (conv_id) WHERE p.part = b.part + 1 AND turn >= 64 * p.part - 8
  UNION ALL SELECT conv_id, part, turn, speaker, text, false FROM heads JOIN parts USING (conv_id) WHERE turn < 64 * part - 8),
said AS (
  SELECT p.conv_id, w.perspective, p.part, p.turn, p.speaker, p.text, p.fresh, p.speaker = w.perspective AND p.fresh AS own,
    CASE WHEN p.speaker = 'system' THEN '<|system|>' || chr(10) WHEN p.speaker = w.perspective THEN '<|assistant|>' || chr(10)
      ELSE '<|user name="' || replace(replace(p.speaker, '<|', '< |'), '"', '''') || '"|>' || chr(10) END AS head,
    replace(p.text, '<|', '< |') || '<|end|>' AS body
  FROM dealt p JOIN people w ON p.conv_id = w.conv_id),
located AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, speaker, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM said)
SELECT conv_id, perspective, part, count(*) FILTER (WHERE fresh) AS n_turns, count(*) FILTER (WHERE NOT fresh) AS n_context, count(*) FILTER (WHERE own) AS n_trained,
  string_agg(head || body || chr(10), '' ORDER BY turn, speaker, text) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn, speaker, text), '') AS mask
FROM located GROUP BY conv_id, perspective, part
"""
