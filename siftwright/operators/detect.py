"""Text-quality detectors as expressions, and the audit that counts their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.functions import grams as G
from siftwright.functions import text as T
from siftwright.functions.loops import LEAST_STATS, loop_report, repetition_loop


def _hits(*pairs: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def invented_labels(src: Column, tgt: Column) -> Column:
    """A/...: labels at the target's start that the source's first line has no kind of."""
    own = first_line(src).rlike(K.SOURCE_LABEL)
    return _hits(*[(f"A/{name}", tgt.rlike(pattern) & ~own) for name, pattern in K.INVENTED_LABELS])


def proper_nouns(text: Column) -> Column:
    names = F.array_distinct(_all(text, K.NAMES))
    return F.filter(names, lambda x: ~x.isin(*K.NAME_STOP) & (F.length(x) >= 2))


def strict_names(text: Column) -> Column:
    names = F.array_distinct(_all(text, K.STRICT_NAMES))
    return F.filter(names, lambda x: ~F.upper(x).isin(*K.STRICT_STOP) & (F.length(x) >= 2))


def all_names_lost(src: Column, tgt: Column) -> Column:
    names = proper_nouns(src)
    return (F.size(names) > 0) & F.forall(names, lambda x: ~tgt.contains(x))


def any_strict_lost(src: Column, tgt: Column) -> Column:
    return F.exists(strict_names(src), lambda x: ~tgt.contains(x))


def ghost_years(src: Column, tgt: Column, pattern: str = K.YEARS_WIDE) -> Column:
    """Years of the target that the source does not have."""
    return F.array_except(_all(tgt, pattern), _all(src, pattern))


def lines_flattened(src: Column, tgt: Column) -> Column:
    return T.strip(src).contains("\n") & ~T.strip(tgt).contains("\n")


def audit_hits(src: Column, tgt: Column) -> Column:
    """All hits of a pair, A to D."""
    return F.concat(
        invented_labels(src, tgt),
        _hits(("B/專名全失", all_names_lost(src, tgt)), ("B/型名遺失", any_strict_lost(src, tgt)), ("C/憑空年份", F.size(ghost_years(src, tgt)) > 0), ("D/多行壓扁", lines_flattened(src, tgt))),
    )


def direction_of(user: Column) -> Column:
    """Struct (src_lang, tgt_lang, body) of a translation request; null if its first line is no known instruction."""
    head = T.strip(first_line(user))
    target = F.lit(None).cast("string")
    for lang, options in K.TEMPLATES.items():
        target = F.when(head.isin(*options), lang).otherwise(target)
    at = F.instr(user, "\n")
    body = F.when(at > 0, F.substring(user, at + 1, F.length(user))).otherwise("")
    return F.when(target.isNotNull(), F.struct(T.language_of(body).alias("src_lang"), target.alias("tgt_lang"), body.alias("body")))


def target_of(direction: Column) -> Column:
    """The target of a direction such as en2ja: what follows the first 2; null without one."""
    return F.when(direction.contains("2"), F.regexp_replace(direction, r"^[^2]*2", ""))


def tag_prefix(src: Column, out: Column) -> Column:
    """The first kind of label that the output starts with and the source does not."""
    return F.coalesce(*[F.when(out.rlike(p) & ~src.rlike(p), F.lit(n)) for n, p in K.TAG_PREFIXES])


def defects(src: Column, out: Column, keep: Column, low: float = 0.3, high: float = 3.0) -> Column:
    """Defects of an output: an empty one has only that; length bounds are parameters, since scripts differ."""
    nonblank = F.size(F.filter(F.split(out, "\n"), lambda x: T.strip(x) != ""))
    lines = F.size(F.split(src, "\n"))
    ghosts = F.array_sort(ghost_years(src, out, K.YEARS_NARROW))
    ratio = F.length(out) / F.length(src)
    tag = tag_prefix(src, out)
    found = F.concat(
        F.transform(F.filter(F.coalesce(keep, F.array().cast("array<string>")), lambda k: ~out.contains(k)), lambda k: F.concat(F.lit("keep:"), k)),
        _hits(("lines", (lines > 1) & (nonblank < lines)), ("loop", repetition_loop(out).isNotNull()), ("echo", out == T.strip(src))),
        F.array_compact(F.array(F.concat(F.lit("tag:"), tag), F.when(F.size(ghosts) > 0, F.concat(F.lit("year:"), F.array_join(ghosts, ","))), F.when((ratio < low) | (ratio > high), F.concat(F.lit("len:"), F.format_number(ratio, 1))))),
    )
    return F.when(F.coalesce(out, F.lit("")) == "", F.array(F.lit("empty"))).otherwise(found)


def loop_stats(text: Column, least: int = LEAST_STATS) -> Column:
    """Struct of repetition statistics of a text; texts under `least` characters have none, and of null the length is null."""

    def report(x):
        short = F.coalesce(F.length(text) < least, F.lit(True))
        flag = (x["sentence_n"] >= 4) | (x["window_n"] >= 8) | (x["blocks"] > 0) | x["long_sentence"]
        worst = F.when(x["sentence_n"] >= x["window_n"], x["sentence"]).otherwise(x["window"])
        return F.struct(
            F.when(short, 0).otherwise(F.greatest(x["sentence_n"], x["window_n"])).alias("max_phrase_count"),
            F.when(short, "").otherwise(F.coalesce(F.left(worst, F.lit(80)), F.lit(""))).alias("worst_phrase"),
            F.when(short, 1.0).otherwise(x["different_lines"] / F.greatest(x["lines"], F.lit(1))).alias("unique_line_ratio"),
            F.when(short, False).otherwise(F.coalesce(flag, F.lit(False))).alias("loop_flag"),
            F.length(text).alias("chars"),
            F.when(short, 0).otherwise(x["sentence_n"]).alias("max_sentence_count"),
            F.when(short, 0).otherwise(x["window_n"]).alias("max_window20_count"),
            F.when(short, 0).otherwise(x["blocks"]).alias("regex_multi_repeat"),
        )

    return T.let(loop_report(text), report)


def repeat_ratio(text: Column, n: int = 8) -> Column:
    """Share of character n-grams that repeat an earlier one."""
    return G.repeated_share(text, n)


def mere_translation(prompt: Column, answer: Column) -> Column:
    """Whether an answer looks like the prompt translated instead of answered."""
    p, a = T.strip(prompt), T.strip(answer)
    ratio = F.length(a) / F.greatest(F.length(p), F.lit(1))
    count = lambda t, cls: F.length(F.regexp_replace(t, f"[^{cls}]", ""))
    letters = count(a, K.HAN_BASIC) + count(a, K.KANA) + count(a, "A-Za-z")
    signature = lambda t: F.struct(t.rlike(f"[{K.KANA}]"), t.rlike(f"[{K.HAN_BASIC}]"), count(t, "A-Za-z") > F.length(t) * 0.3)
    return ratio.between(0.4, 2.5) & (letters >= 5) & ((signature(p) != signature(a)) | a.endswith("？") | a.endswith("?"))


def audit_counts(pairs: DataFrame, *by: str, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """(by..., hit, n): how often each pattern hits."""
    return pairs.select(*by, F.explode(audit_hits(F.col(src), F.col(tgt))).alias("hit")).groupBy(*by, "hit").agg(F.count("*").alias("n"))


def report_order(counts: DataFrame, *by: str, n: str = "n", name: str = "hit") -> DataFrame:
    """Counts in the order of a report: by group, the most frequent first, names in order among equals."""
    return counts.orderBy(*by, F.desc(n), name)


def audit_denominators(pairs: DataFrame, *by: str, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """(by..., n, with_names, with_strict, multi_line): how many pairs have what a hit's share refers to."""
    s = F.col(src)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.size(proper_nouns(s)) > 0).alias("with_names"), F.count_if(F.size(strict_names(s)) > 0).alias("with_strict"), F.count_if(T.strip(s).contains("\n")).alias("multi_line")
    )


def audit_samples(pairs: DataFrame, key: str, n: int = 10, cut: int = 300, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """(hit, key, src, tgt): the first n pairs of each pattern by key, texts cut for display."""
    hits = pairs.select(F.col(key), F.col(src).alias("_s"), F.col(tgt).alias("_t"), F.explode(audit_hits(F.col(src), F.col(tgt))).alias("hit"))
    rows = hits.select("hit", key, F.left("_s", F.lit(cut)).alias("src"), F.left("_t", F.lit(cut)).alias("tgt"))
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(key))).filter(F.col("_n") <= n)
    # the first n of each of 64 parts, so that no task sorts all hits of a pattern
    return first(first(rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64))), "hit", "_part"), "hit").drop("_n", "_part")


def both_orientations(pairs: DataFrame, a: str = "a", b: str = "b", lang_a: str = "lang_a", lang_b: str = "lang_b") -> DataFrame:
    """Every row twice: a to b with the language of b as target, and b to a."""
    rest = [c for c in pairs.columns if c not in (a, b, lang_a, lang_b)]
    one = pairs.select(*rest, F.col(a).alias("src"), F.col(b).alias("tgt"), F.col(lang_b).alias("tgt_lang"))
    return one.unionByName(pairs.select(*rest, F.col(b).alias("src"), F.col(a).alias("tgt"), F.col(lang_a).alias("tgt_lang")))


def defect_summary(rows: DataFrame, found: str = "found", keep: str = "keep") -> DataFrame:
    """One row of counts over graded outputs: cases, cases with defects, defects, each class, and the share of kept words."""
    f = F.col(found)
    some = lambda prefix: F.count_if(F.exists(f, lambda x: x.startswith(prefix)))
    lost = F.sum(F.size(F.filter(f, lambda x: x.startswith("keep:"))))
    asked = F.sum(F.size(F.coalesce(F.col(keep), F.array().cast("array<string>"))))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.size(f) > 0).alias("with_defects"), F.sum(F.size(f)).alias("defects"), some("tag:").alias("labels"), lost.alias("lost_words"), some("year:").alias("ghost_years"),
        some("lines").alias("lines"), some("loop").alias("loops"), some("len:").alias("lengths"), F.when(asked > 0, (asked - lost) * 100 / asked).alias("kept_pct"),
    )
