"""The ordered reason chain over bitext rows: every dropped row is counted under the first reason that holds.

The chain is one expression; as separate filters the optimizer could reorder it and the counts would shift. Input
columns are corpus, lineno, line (a raw tab-separated line), lang_a and lang_b.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.functions import text as T

#: Bytes of distinct evaluation lines (with an overhead for each) up to which the set is broadcast; beyond, the joins shuffle.
BROADCAST_BYTES, LINE_OVERHEAD = 64 << 20, 64
SALTS = 64


def split_lines(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """(keep..., lineno, line) for every line of a text column; lineno starts at 0."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("lineno", "line"))


def _bounded(lines: DataFrame, bound: int | None = None) -> DataFrame:
    """The lines (one column) with a broadcast hint if their bytes are within the bound."""
    size = lines.agg(F.sum(F.octet_length(lines.columns[0]) + LINE_OVERHEAD)).first()[0] or 0
    return F.broadcast(lines) if size <= (BROADCAST_BYTES if bound is None else bound) else lines


def mark_contaminated(rows: DataFrame, evaluation: DataFrame, *sides: str, line_col: str = "line") -> DataFrame:
    """Adds boolean `contaminated`: any of the sides is a line of the evaluation set. An empty set is an error of the caller."""
    lines = evaluation.select(F.col(line_col).alias("_line")).filter("_line is not null").distinct()
    lines = _bounded(lines)
    out = rows
    for i, side in enumerate(sides):
        out = out.join(lines.select(F.col("_line").alias(f"_eval{i}")), F.col(side) == F.col(f"_eval{i}"), "left")
    hit = F.lit(False)
    for i in range(len(sides)):
        hit = hit | F.col(f"_eval{i}").isNotNull()
    return out.withColumn("contaminated", hit).drop(*[f"_eval{i}" for i in range(len(sides))])


def clean_bitext(rows: DataFrame, evaluation: DataFrame, convert: Callable[[Column], Column] | None = None, simplified: Callable[[Column], Column] | None = None, compose: bool = True) -> DataFrame:
    """rows with cleaned sides a and b, `converted` (the zh side was rewritten) and `reason` (kept, or why not)."""
    parts = F.split(F.regexp_replace(F.col("line"), "\n+$", ""), "\t")
    split = rows.withColumn("_bad", (F.size(parts) != 2) | F.col("line").isNull())
    side = lambda i: T.strip_speaker_marks(T.normalize(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), compose))
    sides = split.select("*", side(0).alias("_a"), side(1).alias("_b"))
    done = sides.withColumn("_pair", T.preprocess(F.col("corpus"), F.col("_a"), F.col("_b"), F.col("lang_a"), F.col("lang_b")))
    done = done.withColumn("a", F.coalesce("_pair.a", "_a")).withColumn("b", F.coalesce("_pair.b", "_b"))
    la, lb = T.effective_length(F.col("a")), T.effective_length(F.col("b"))
    early = (
        F.when(F.col("_bad"), "bad_format")
        .when(F.col("_pair").isNull(), "preproc_dropped")
        .when((F.col("a") == "") | (F.col("b") == ""), "empty")
        .when(F.col("a") == F.col("b"), "identical")
        .when(T.noisy_pair(F.col("a"), F.col("b")), "subtitle_noise")
        .when(T.terminated(F.col("a")) != T.terminated(F.col("b")), "punct_asymmetric")
        .when(F.col("a").rlike(K.STRAY_BLANK) | F.col("b").rlike(K.STRAY_BLANK), "stray_space")
        .when((F.least(la, lb) < 3) | (F.greatest(la, lb) > 1000), "length")
        .when(F.greatest(la, lb) / F.least(la, lb) > 3.0, "ratio")
    )
    done = done.withColumn("_early", early)
    if convert is not None and simplified is not None:
        needs = F.col("_early").isNull() & (F.col("lang_b") == "zhtw") & simplified(F.col("b"))
        done = done.withColumn("converted", F.coalesce(needs, F.lit(False))).withColumn("b", F.when(F.col("converted"), convert(F.col("b"))).otherwise(F.col("b")))
        residue = F.col("converted") & simplified(F.col("b"))
    else:
        done, residue = done.withColumn("converted", F.lit(False)), F.lit(False)
    done = mark_contaminated(done, evaluation, "a", "b")
    late = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(residue, "simplified_residue")
        .when(~(T.valid_language(F.col("a"), F.col("lang_a")) & T.valid_language(F.col("b"), F.col("lang_b"))), "lang_mismatch")
        .when(F.col("contaminated"), "eval_contaminated")
    )
    done = done.withColumn("_late", late)
    # The first accepted row of a pair stays. Rows with a reason stand in groups of their own. A pair with very many
    # copies is first thinned in SALTS groups, so that its last ranking sees one row of each.
    own = F.when(F.col("_late").isNotNull(), F.col("lineno")).alias("own")
    thin = Window.partitionBy("corpus", "a", "b", own, F.pmod("lineno", F.lit(SALTS))).orderBy("lineno")
    done = done.withColumn("_first", F.row_number().over(thin))
    apart = F.when(F.col("_late").isNotNull() | (F.col("_first") > 1), F.col("lineno")).alias("apart")
    rank = F.row_number().over(Window.partitionBy("corpus", "a", "b", apart).orderBy("lineno"))
    done = done.withColumn("_rn", F.when(F.col("_first") > 1, F.col("_first")).otherwise(rank))
    reason = F.when(F.col("_late").isNotNull(), F.col("_late")).when(F.col("_rn") > 1, "dup").otherwise("kept")
    return done.withColumn("reason", reason).drop("_bad", "_a", "_b", "_pair", "_early", "_late", "_first", "_rn", "contaminated")


def reason_counts(cleaned: DataFrame, *by: str) -> DataFrame:
    """(by..., reason, n): the counts; total minus all reasons but `kept` is the number kept."""
    keys = by or ("corpus",)
    return cleaned.groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def clean_lines(lines: DataFrame, evaluation: DataFrame, *by: str) -> DataFrame:
    """One-sided chain over (by..., lineno, line): empty, eval_contaminated, dup (first of `by` wins), kept."""
    marked = mark_contaminated(lines, evaluation, "line")
    early = F.when(F.trim("line") == "", "empty").when(F.col("contaminated"), "eval_contaminated")
    return marked.withColumn("_early", early)


def pair_reasons(pairs: DataFrame) -> DataFrame:
    """The script-free part of the chain over columns a and b: empty to ratio, else kept."""
    a, b = F.col("a"), F.col("b")
    la, lb = T.effective_length(a), T.effective_length(b)
    reason = (
        F.when((a == "") | (b == ""), "empty")
        .when(a == b, "identical")
        .when(T.noisy_pair(a, b), "subtitle_noise")
        .when(T.terminated(a) != T.terminated(b), "punct_asymmetric")
        .when(a.rlike(K.STRAY_BLANK) | b.rlike(K.STRAY_BLANK), "stray_space")
        .when((F.least(la, lb) < 3) | (F.greatest(la, lb) > 1000), "length")
        .when(F.greatest(la, lb) / F.least(la, lb) > 3.0, "ratio")
        .otherwise("kept")
    )
    return pairs.withColumn("reason", reason)
