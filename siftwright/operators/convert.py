"""Script conversion with dictionaries that are inputs: phrases by longest match, then single characters.

A dictionary goes whole to every Python worker, once; its size is checked before that.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.functions import text as T
from siftwright.functions.automaton import Replacer
from siftwright.functions.loops import by_parts

LARGEST_DICTIONARY = 2_000_000


def read_dictionary(entries: DataFrame) -> dict[str, str]:
    """{from: to} from (source, target); too large a dictionary is an error."""
    rows = entries.select("source", "target").limit(LARGEST_DICTIONARY + 1).toArrow()
    if len(rows) > LARGEST_DICTIONARY:
        raise ValueError(f"a conversion dictionary has at most {LARGEST_DICTIONARY:,} entries")
    return {s: t for s, t in zip(rows["source"].to_pylist(), rows["target"].to_pylist(), strict=True) if s}


def converter(characters: dict[str, str], phrases: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A conversion expression. Without phrases it is one translate(); with them an automaton takes the longest of each place."""
    if not phrases:
        source = "".join(characters)
        target = "".join(characters.values())
        if any(len(k) != 1 or len(v) != 1 for k, v in characters.items()):
            return converter({}, characters)
        return lambda text: F.translate(text, source, target)
    replacer = Replacer({**characters, **phrases})

    def converted(text: Column) -> Column:
        sent = replacer.shared()

        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            return by_parts(sent.value.replace, texts, pa.string())

        return run(text)

    return converted


def changed_by(convert: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Whether a conversion changes a text."""
    return lambda text: convert(text) != text


def simplified_only(to_simplified: dict[str, str], to_traditional: dict[str, str], allowed: str = K.TAIWAN_VARIANTS) -> str:
    """Characters that are simplified already and have another traditional form, without the allowed ones."""
    return "".join(sorted(c for c, t in to_traditional.items() if len(c) == 1 and t != c and to_simplified.get(c, c) == c and c not in allowed))


def leak_by_set(rows: DataFrame, characters: str, *by: str, hyp: str = "hyp") -> DataFrame:
    """(by..., leak_pct): share of segments with a simplified-only character."""
    return rows.groupBy(*by).agg((F.avg(F.col(hyp).rlike(f"[{characters}]").cast("double")) * 100).alias("leak_pct"))


def leak_by_line(rows: DataFrame, convert: Callable[[Column], Column], *by: str, hyp: str = "hyp") -> DataFrame:
    """(by..., n_lines, leak_pct): share of non-blank lines that a conversion changes."""
    lines = rows.select(*by, F.explode(F.split(F.col(hyp), "\n")).alias("line")).filter(T.strip(F.col("line")) != "")
    return lines.groupBy(*by).agg(F.count("*").alias("n_lines"), (F.avg((convert(F.col("line")) != F.col("line")).cast("double")) * 100).alias("leak_pct"))


def rescored(old: DataFrame, new: DataFrame, *keys: str, least: float = 1e-9) -> DataFrame:
    """(keys..., old, new, delta) of the leak shares that differ by more than `least`."""
    joined = old.select(*keys, F.col("leak_pct").alias("old")).join(new.select(*keys, F.col("leak_pct").alias("new")), list(keys))
    return joined.withColumn("delta", F.col("new") - F.col("old")).filter(F.coalesce(F.abs("delta") > least, F.col("old").isNull()))
