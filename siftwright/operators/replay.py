"""Instruction data from conversation trees, prompt tables and chat logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.functions import text as T
from siftwright.operators.curate import hash_ranks

LANG_OF_CODE = {"en": "en", "zh": "zhtw", "ja": "ja"}
LANG_OF_NAME = {"English": "en", "Japanese": "ja", "Chinese": "zhtw"}


def _mapped(value: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def best_replies(nodes: DataFrame, order: str = "ord", langs: dict[str, str] | None = None) -> DataFrame:
    """(message_id, lang, prompt, reply_id, reply): each live prompt's live reply of the least rank; null ranks are 99, ties keep the first.

    The least of (rank, order, id, text) is an aggregate that combines before the shuffle, so a prompt with very many
    replies costs no sort.
    """
    prompts = nodes.filter((F.col("role") == "prompter") & ~F.col("deleted"))
    prompts = prompts.select("message_id", _mapped(F.substring_index(F.coalesce("lang", F.lit("")), "-", 1), langs or LANG_OF_CODE).alias("lang"), F.col("text").alias("prompt")).filter("lang is not null")
    replies = nodes.filter((F.col("role") == "assistant") & ~F.col("deleted") & F.col("parent_id").isNotNull())
    best = replies.groupBy(F.col("parent_id").alias("message_id")).agg(F.min(F.struct(F.coalesce("rank", F.lit(99)).alias("rank"), F.col(order).alias("ord"), F.col("message_id").alias("id"), F.col("text").alias("text"))).alias("b"))
    return prompts.join(best, "message_id").select("message_id", "lang", "prompt", F.col("b.id").alias("reply_id"), F.col("b.text").alias("reply"))


def prompt_table(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(lang, prompt, reply) from (language, inputs, targets); unknown languages are left out."""
    return rows.select(_mapped(F.col("language"), names or LANG_OF_NAME).alias("lang"), F.col("inputs").alias("prompt"), F.col("targets").alias("reply")).filter("lang is not null")


def turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, prompt, reply): a user (or prompter) turn followed by an assistant turn."""
    w = Window.partitionBy(conv).orderBy(turn)
    marked = turns.withColumn("_role", F.lead(role).over(w)).withColumn("_reply", F.lead(text).over(w))
    return marked.filter(F.col(role).isin("user", "prompter") & (F.col("_role") == "assistant")).select(conv, turn, F.col(text).alias("prompt"), F.col("_reply").alias("reply"))


def array_turn_pairs(rows: DataFrame, messages: str = "conversations") -> DataFrame:
    """(prompt, reply) from an array of (role, content), inside each row."""
    m = F.col(messages)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(m) - 1, F.lit(1))), lambda i: F.struct(F.get(m, i - 1).alias("q"), F.get(m, i).alias("a")))
    good = F.filter(pairs, lambda p: p["q"]["role"].isin("user", "prompter") & (p["a"]["role"] == "assistant"))
    return rows.select(F.explode(good).alias("p")).select(F.col("p.q.content").alias("prompt"), F.col("p.a.content").alias("reply"))


def clean_reply(text: Column, lang: Column, convert: Callable[[Column], Column] | None = None, simplified: Callable[[Column], Column] | None = None) -> Column:
    """Cleaned text, or null: 10 to 4000 characters, with the script of its language, without simplified rest."""
    t = T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), K.LINE_SEPARATORS, "\n"))
    sized = F.length(t).between(10, 4000)
    zh = convert(t) if convert else t
    fits = ~simplified(zh) if simplified else F.lit(True)
    return F.when(~sized, None).when(lang == "zhtw", F.when(fits & zh.rlike(f"[{K.HAN_BASIC}]"), zh)).when(lang == "ja", F.when(t.rlike(f"[{K.KANA}]"), t)).otherwise(t)


def emit(pairs: DataFrame, convert=None, simplified=None) -> DataFrame:
    """(lang, prompt, reply) with `reason` (kept, drop_translation_prompt, drop_clean), cleaned sides and messages."""
    asked = F.coalesce(F.col("prompt").rlike(K.TRANSLATION_PROMPT), F.lit(False))
    out = pairs.withColumn("_asked", asked).withColumn("prompt", clean_reply(F.col("prompt"), F.col("lang"), convert, simplified)).withColumn("reply", clean_reply(F.col("reply"), F.col("lang"), convert, simplified))
    out = out.withColumn("reason", F.when(F.col("_asked"), "drop_translation_prompt").when(F.col("prompt").isNull() | F.col("reply").isNull(), "drop_clean").otherwise("kept")).drop("_asked")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return out.withColumn("messages", F.array(message("user", "prompt"), message("assistant", "reply")))


def distinct_prompts(rows: DataFrame, order: Column, most: int | None = None, seed: int = K.SEED) -> DataFrame:
    """The first row of each (lang, prompt) by order; then at most `most` of each language in hashed order."""
    firsts = rows.withColumn("_o", order).groupBy("lang", "prompt").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("lang", "prompt")]), "_o").alias("_r"))
    firsts = firsts.select("lang", "prompt", "_r.*")
    if most is None:
        return firsts
    return hash_ranks(firsts, seed, F.col("prompt"), "lang", name="_n").filter(F.col("_n") <= most).drop("_n")


def replay_counts(emitted: DataFrame) -> DataFrame:
    """(lang, seen, kept, distinct_prompts): what emit kept, before and after equal prompts are folded."""
    kept = F.col("reason") == "kept"
    return emitted.groupBy("lang").agg(F.count("*").alias("seen"), F.count_if(kept).alias("kept"), F.countDistinct(F.when(kept, F.col("prompt"))).alias("distinct_prompts"))


def usable(text: Column, simplified: Callable[[Column], Column] | None = None) -> Column:
    """Whether a translated reply can be used: 5 to 4000 characters, with Han, without simplified rest. Null is not."""
    fits = F.length(text).between(5, 4000) & text.rlike(f"[{K.HAN_BASIC}]")
    return F.coalesce(fits & ~simplified(text) if simplified else fits, F.lit(False))


def english_only(records: DataFrame, *order: str, most: int | None = None, longest: int = 1200, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """Records without Han on either side whose reply has at most `longest` characters; the first `most` by order."""
    rows = records.filter(~F.concat(F.coalesce(prompt, F.lit("")), F.coalesce(reply, F.lit(""))).rlike(f"[{K.HAN_BASIC}]") & (F.length(F.coalesce(reply, F.lit(""))) <= longest))
    return rows if most is None else rows.orderBy(*order).limit(most)


def simplified_residue(records: DataFrame, simplified: Callable[[Column], Column], *by: str, prompt: str = "prompt", reply: str = "reply", head: int = 30) -> DataFrame:
    """(by..., targets, residue): records whose prompt's first characters name a Chinese target, and those with a simplified reply."""
    named = F.left(prompt, F.lit(head)).rlike("|".join(K.CHINESE_TARGETS))
    rows = records.filter(named)
    return rows.groupBy(*by).agg(F.count("*").alias("targets"), F.count_if(simplified(F.col(reply))).alias("residue"))
