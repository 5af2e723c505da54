"""Text expressions: Column in, Column out, inside the plan; only NFC crosses to Python, and only for rows that need it."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftwright.functions import constants as K


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Canonical composition. Characters below U+0300 never change by it; rows of them alone cross as nulls and keep their own value."""
    other = text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.coalesce(_nfc(F.when(other, text)), text)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def close_wide_gaps(text: Column) -> Column:
    """Without blanks between two wide (CJK, kana, full-width) characters."""
    return F.regexp_replace(text, rf"(?<=[{K.WIDE}])[ \t\u3000]+(?=[{K.WIDE}])", "")


def normalize(text: Column, compose: bool = True) -> Column:
    """NFC, without control and invisible characters, white space folded, wide gaps closed."""
    composed = nfc(text) if compose else text
    return close_wide_gaps(strip(F.regexp_replace(F.regexp_replace(composed, K.DELETED, ""), r"(?U)\s+", " ")))


def strip_speaker_marks(text: Column) -> Column:
    """Without leading speaker notes, tags and dashes, up to three deep. Further passes change nothing, so three run."""
    once = lambda t: reduce(lambda x, p: F.regexp_replace(x, p, ""), (K.SPEAKER_IN_PARENTHESES, K.SPEAKER_TAG, K.LEADING_DASH), t)
    return strip(once(once(once(text))))


def detokenize(text: Column) -> Column:
    """Without the blanks that tokenization left beside marks."""
    return close_wide_gaps(F.regexp_replace(F.regexp_replace(text, K.BLANK_BEFORE_MARK, "$1"), K.BLANK_AFTER_MARK, "$1"))


def terminated(text: Column) -> Column:
    """Whether the last character is a terminal mark."""
    return (text != "") & F.lit(K.TERMINAL).contains(F.right(text, F.lit(1)))


def restore_end(text: Column, lang: Column) -> Column:
    """With the language's full stop where the text is a whole sentence without one; otherwise as it is."""
    letter = text.rlike(rf"(?U)[\p{{Alnum}}{K.HAN}{K.KANA}]$")
    whole = F.when(lang == "ja", text.rlike(K.JA_ENDS) & ~text.rlike(K.JA_CONTINUES)).when(lang == "zhtw", ~text.rlike(K.ZH_CONTINUES)).otherwise(lang == "en")
    return F.when((text == "") | terminated(text) | ~letter | ~whole, text).otherwise(F.concat(text, F.when(lang == "en", ".").otherwise("。")))


def restore_pair(a: Column, b: Column, lang_a: Column, lang_b: Column) -> Column:
    """Struct (a, b) with a missing end restored on one side; null if both ends are missing."""
    ends_a, ends_b = terminated(a), terminated(b)
    side_a = F.when(ends_a, a).otherwise(restore_end(a, lang_a))
    side_b = F.when(ends_b, b).otherwise(restore_end(b, lang_b))
    return F.when(ends_a | ends_b, F.struct(side_a.alias("a"), side_b.alias("b")))


def preprocess(corpus: Column, a: Column, b: Column, lang_a: Column, lang_b: Column) -> Column:
    """Struct (a, b) after the preprocessor of the corpus family; null where it rejects the row."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    family = F.substring_index(corpus, ".", 1)
    both_sides = lambda pattern: a.rlike(pattern) | b.rlike(pattern)
    note = lambda t: strip(F.regexp_replace(t, K.BRACKET_NOTE, ""))
    return (
        F.when(family == "ted2020", restore_pair(a, b, lang_a, lang_b))
        .when(family == "kde4", F.when(~both_sides(K.PLACEHOLDER), pair(detokenize(a), detokenize(b))))
        .when(family == "globalvoices", F.when(~both_sides(K.FRAGMENT_END), pair(a, b)))
        .when(corpus.isin("opensub.en-ja.tsv", "opensub.en-zhtw.tsv"), pair(note(a), note(b)))
        .otherwise(pair(a, b))
    )


def effective_length(text: Column) -> Column:
    """Characters, with Han and kana counted twice."""
    return F.length(text) + F.length(F.regexp_replace(text, rf"[^{K.HAN}{K.KANA}]", ""))


def valid_language(text: Column, lang: Column) -> Column:
    """Whether the script fits the language; an unknown language is an error."""
    han, kana = text.rlike(f"[{K.HAN}]"), text.rlike(f"[{K.KANA}]")
    ascii_share = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.length(text)
    unknown = F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce(lang, F.lit("null")))).cast("boolean")
    return F.when(lang == "en", ~han & ~kana & (ascii_share > 0.8)).when(lang == "ja", kana).when(lang == "zhtw", han & ~kana).otherwise(unknown)


def language_of(text: Column) -> Column:
    """ja with kana, else zhtw with Han, else en."""
    return F.when(text.rlike(f"[{K.KANA}]"), "ja").when(text.rlike(f"[{K.HAN_BASIC}]"), "zhtw").otherwise("en")


def noisy_pair(a: Column, b: Column) -> Column:
    """A music mark on either side, or a side that says the same thing twice."""
    half = lambda t: (F.length(t) / 2).cast("int")
    twice = lambda t: (F.length(t) >= 6) & (F.length(t) % 2 == 0) & (F.left(t, half(t)) == F.right(t, half(t)))
    return a.rlike(K.MUSIC) | b.rlike(K.MUSIC) | twice(a) | twice(b)


def let(value: Column, body) -> Column:
    """body(value) with value computed once. Inside a lambda an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def character_grams(text: Column, n: int) -> Column:
    """Array of the n-character windows of a text, in one pass: a look-ahead takes the window, one character is consumed."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def repeats(values: Column) -> Column:
    """How many elements of an array repeat another one (size less different ones); by sorting, without a set."""
    pairs = lambda v: F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.size(v)), lambda x, y: x == y)
    return let(F.sort_array(values), lambda v: F.size(F.filter(pairs(v), lambda same: same)))


def numeric_form(text: Column) -> Column:
    """Full-width digits as ASCII, without separators and blanks."""
    return F.translate(text, "０１２３４５６７８９,， ", "0123456789")


def h32(*parts) -> Column:
    """The first 32 bits of a SHA-256 over the joined parts, as a number that SQL engines agree on."""
    joined = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long")


def hash_order(*parts) -> Column:
    """A seeded order: the whole SHA-256 over the joined parts."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def upper_median(values: Column) -> Column:
    """The element at position n // 2 of the sorted array (null if empty)."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def split_chunks(text: Column, most: int = 280) -> Column:
    """Paragraphs as they are up to `most` characters; longer ones packed sentence by sentence; leftovers cut hard.

    The packing is a fold over the sentences: it carries the open chunk and the closed ones.
    """
    empty = F.array().cast("array<string>")

    def pack(paragraph: Column) -> Column:
        sentences = F.filter(F.transform(F.split(paragraph, r"(?U)(?<=[。！？.!?\n])\s*"), strip), lambda s: s != "")

        def step(state, s):
            joined = F.concat(state["open"], F.when(state["open"].rlike(r"[。！？.!?\n]$"), "").otherwise(" "), s)
            fits = F.length(state["open"]) + 1 + F.length(s) <= most
            closed = F.when((state["open"] == "") | fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
            opened = F.when(state["open"] == "", s).when(fits, joined).otherwise(s)
            return F.struct(opened.alias("open"), closed.alias("done"))

        start = F.struct(F.lit("").alias("open"), empty.alias("done"))
        return F.aggregate(sentences, start, step, lambda st: F.when(st["open"] == "", st["done"]).otherwise(F.concat(st["done"], F.array(st["open"]))))

    def cut(unit: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(unit)), F.lit(most))
        return F.when(F.length(unit) <= 2 * most, F.array(unit)).otherwise(F.transform(starts, lambda i: F.substring(unit, i, F.lit(most))))

    paragraphs = F.filter(F.transform(F.split(strip(text), r"(?U)\n\s*\n"), strip), lambda p: p != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(pack(p))))
    return F.flatten(F.transform(units, cut))


def parse_cli_output(raw: Column, echoed: Column) -> Column:
    """The answer in a command-line log: from the line of the prompt to the statistics line, without the echoed lines."""
    lines = F.split(raw, "\n")
    first = F.array_position(F.transform(lines, lambda x: x.startswith("> ")), True)
    last = F.array_position(F.transform(lines, lambda x: x.startswith("[ Prompt:")), True)
    body = F.filter(F.transform(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")), strip), lambda x: x != "")
    rest = F.slice(body, (echoed + 1).cast("int"), F.greatest(F.size(body) - echoed, F.lit(0)).cast("int"))
    return F.when((first > 0) & (last > 0), F.array_join(rest, " ")).otherwise("")
