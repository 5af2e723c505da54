"""Corpus metrics: chrF++, BLEU, document alignment, multiple choice, bootstrap, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import grams as G
from siftwright.functions import resampling
from siftwright.functions import text as T

#: Marks that stand apart from words in chrF++ word n-grams. Fixed value.
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def character_stream(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def chrf_words(text: Column) -> Column:
    """Words with one punctuation mark at the end, else at the start, split off."""
    tokens = F.filter(F.split(T.strip(text), r"(?U)\s+"), lambda w: w != "")
    apart = lambda w: F.when(F.length(w) == 1, F.array(w)).when(w.rlike(f"[{PUNCTUATION}]$"), F.array(F.substring(w, F.lit(1), F.length(w) - 1), F.right(w, F.lit(1)))).when(w.rlike(f"^[{PUNCTUATION}]"), F.array(F.left(w, F.lit(1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(F.array(w))
    return F.flatten(F.transform(tokens, apart))


def _totals(rows: DataFrame, by: tuple[str, ...], overlaps: dict[str, Column]) -> DataFrame:
    """(by..., kind, n, matched, hyp, ref): n-gram totals over the corpus. Counts combine before the shuffle.

    Each segment's grams are counted where they are; what moves are partial sums.
    """
    each = rows.select(*by, *[c.alias(kind) for kind, c in overlaps.items()])
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("o")) for kind in overlaps])
    flat = each.select(*by, F.explode(kinds).alias("k")).select(*by, "k.kind", F.explode("k.o").alias("o")).select(*by, "kind", "o.*")
    return flat.groupBy(*by, "kind", "n").agg(F.sum("matched").alias("matched"), F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"))


def chrf(rows: DataFrame, *by: str, hyp: str = "hyp", ref: str = "ref", chars: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """(by..., chrf): corpus chrF++ from counts summed over segments; precision and recall averaged over orders that have grams."""
    overlaps = {"_c": G.character_overlaps(character_stream(F.col(hyp)), character_stream(F.col(ref)), chars), "_w": G.word_overlaps(chrf_words(F.col(hyp)), chrf_words(F.col(ref)), words)}
    totals = _totals(rows, by, overlaps)
    both = (F.col("hyp") > 0) & (F.col("ref") > 0)
    scored = totals.groupBy(*by).agg(F.avg(F.when(both, F.col("matched") / F.col("hyp"))).alias("p"), F.avg(F.when(both, F.col("matched") / F.col("ref"))).alias("r"))
    square = beta * beta
    return scored.select(*by, F.when(F.coalesce(F.col("p") + F.col("r"), F.lit(0.0)) > 0, 100 * (1 + square) * F.col("p") * F.col("r") / (square * F.col("p") + F.col("r"))).otherwise(0.0).alias("chrf"))


def bleu(rows: DataFrame, *by: str, hyp: str = "hyp_tokens", ref: str = "ref_tokens", most: int = 4) -> DataFrame:
    """(by..., bleu): corpus BLEU over token arrays; orders without a match are smoothed by halving. A score of 0 stays 0."""
    totals = _totals(rows, by, {"_t": G.word_overlaps(F.col(hyp), F.col(ref), most)})
    wide = totals.groupBy(*by).agg(*[F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in range(1, most + 1) for c in ("matched", "hyp", "ref")])
    zeros = [sum((F.when(F.col(f"matched{k}") == 0, 1).otherwise(0) for k in range(1, n + 1)), F.lit(0)) for n in range(1, most + 1)]
    logs = [F.when(F.col(f"hyp{n}") == 0, F.lit(None)).when(F.col(f"matched{n}") == 0, -F.log(F.pow(F.lit(2.0), zeros[n - 1]) * F.col(f"hyp{n}"))).otherwise(F.log(F.col(f"matched{n}") / F.col(f"hyp{n}"))) for n in range(1, most + 1)]
    total = logs[0]
    for x in logs[1:]:
        total = total + x
    brevity = F.when(F.col("hyp1") >= F.col("ref1"), 1.0).otherwise(F.exp(1 - F.col("ref1") / F.col("hyp1")))
    score = F.when((F.col("hyp1") == 0) | (F.col("matched1") == 0), 0.0).otherwise(100 * brevity * F.exp(total / most))
    return wide.select(*by, F.coalesce(score, F.lit(0.0)).alias("bleu"))


def tokens_13a(text: Column) -> Column:
    """Western tokens: marks apart, periods and commas apart unless between digits."""
    t = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"([\{-~\[-` -&\(-+:-@/])", " $1 ")
    t = F.regexp_replace(F.regexp_replace(t, r"([^0-9])([.,])", "$1 $2 "), r"([.,])([^0-9])", " $1 $2")
    return F.filter(F.split(F.regexp_replace(t, r"([0-9])(-)", "$1 $2 "), r"(?U)\s+"), lambda w: w != "")


def tokens_zh(text: Column) -> Column:
    """Every Han character apart, the rest as western tokens."""
    return tokens_13a(F.regexp_replace(text, r"([㐀-䶵一-鿿豈-龎＀-￯⺀-⿟　-〿])", " $1 "))


def upper_median(column: str) -> Column:
    """The element at position n // 2 of a group's values in order; null values do not count.

    From above, that is the discrete median. Equal values are counted before the shuffle, no group is collected.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def document_alignment(rows: DataFrame, *by: str, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(by..., line_ratio_median, tail_ratio_median): upper medians of line counts and of the characters of the last third."""
    h, r = F.split(F.col(hyp), "\n"), F.split(F.col(ref), "\n")
    low = F.floor(2 * F.size(r) / 3).cast("int")
    tail = lambda a: F.aggregate(F.slice(a, low + 1, F.greatest(F.size(a) - low, F.lit(0))), F.lit(0), lambda s, x: s + F.length(x))
    own = tail(r)
    each = rows.select(*by, (F.size(h) / F.greatest(F.size(r), F.lit(1))).alias("l"), F.when((F.size(r) >= 3) & (own > 0), tail(h) / own).alias("t"))
    return each.groupBy(*by).agg(upper_median("l").alias("line_ratio_median"), upper_median("t").alias("tail_ratio_median"))


def document_scores(rows: DataFrame, repeat: Column, *by: str, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(by..., completeness_median, truncated_pct, bloated_pct, repetitive_pct)."""
    ratio = F.length(hyp) / F.greatest(F.length(ref), F.lit(1))
    each = rows.select(*by, ratio.alias("x"), repeat.alias("rep"))
    share = lambda c: F.avg(c.cast("double")) * 100
    return each.groupBy(*by).agg(upper_median("x").alias("completeness_median"), share(F.col("x") < 0.5).alias("truncated_pct"), share(F.col("x") > 2.0).alias("bloated_pct"), share(F.col("rep") > 0.3).alias("repetitive_pct"))


def accuracy(rows: DataFrame, by: str, passed: Column) -> DataFrame:
    """(by, n, passed, pct) for each value and, with a null value, for all."""
    return rows.rollup(by).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), (F.avg(passed.cast("double")) * 100).alias("pct"))


def rotations(items: DataFrame, options: str = "options", gold: str = "gold") -> DataFrame:
    """Every item four times, its options turned left by 0 to 3 and the right answer's place with them."""
    o = F.col(options)
    turned = items.withColumn("rotation", F.explode(F.array(*map(F.lit, range(4)))))
    r = F.col("rotation")
    return turned.withColumn(options, F.concat(F.slice(o, r + 1, F.size(o) - r), F.slice(o, F.lit(1), r))).withColumn(gold, F.pmod(F.col(gold) - r, F.lit(4)))


def choice_prompt(question: Column, options: Column, passage: Column | None = None) -> Column:
    """Passage, question and lettered options, a line each."""
    lettered = F.array_join(F.transform(options, lambda o, i: F.concat(F.element_at(F.array(*map(F.lit, "ABCD")), i + 1), F.lit(". "), o)), "\n")
    return F.concat_ws("\n", passage if passage is not None else F.lit(None), question, lettered)


def choice_scores(picks: DataFrame, by: str = "lang") -> DataFrame:
    """(by, n, correct, acc, max_letter_share) from (by, pick, gold)."""
    letters = picks.groupBy(by, "pick").agg(F.count("*").alias("m"), F.count_if(F.col("pick") == F.col("gold")).alias("c"))
    n = F.sum("m")
    return letters.groupBy(by).agg(n.alias("n"), F.sum("c").alias("correct"), (F.sum("c") * 100 / n).alias("acc"), (F.max("m") / n).alias("max_letter_share"))


#: Segments (16 bytes each) up to which the bootstrap broadcasts them.
BROADCAST_SEGMENTS = 2_000_000


def paired_bootstrap(diffs: DataFrame, resamples: int = 1000, seed: int = 42, index: str = "i", diff: str = "diff") -> DataFrame:
    """One row (n, delta, ci_lo, ci_hi, p_b_better, crosses_zero); both systems share every draw.

    diffs has (i, diff) with i from 0 to n - 1. Draw r, k takes segment h32(seed, r, k) mod n. Up to BROADCAST_SEGMENTS
    segments go to the tasks that make the draws, and what moves is one partial sum for each resample and task; beyond,
    the draws move to the segments.
    """
    n = diffs.count()
    segments = diffs.select(index, diff)
    draws = diffs.sparkSession.range(resamples * n).select(F.expr(f"id div {max(n, 1)}").alias("r"), F.expr(f"id % {max(n, 1)}").alias("k"), F.lit(n).cast("long").alias("n"))
    draws = draws.select("r", "n", F.pmod(T.h32(seed, F.col("r"), F.col("k")), F.col("n")).alias(index))
    segments = F.broadcast(segments) if n <= BROADCAST_SEGMENTS else segments
    means = draws.join(segments, index).groupBy("r", "n").agg((F.sum(diff) / F.first("n") * 100).alias("d"))
    low, high = int(0.025 * resamples) + 1, int(0.975 * resamples) + 1
    sorted_ = F.array_sort(F.collect_list("d"))
    out = means.groupBy("n").agg(sorted_.alias("s"), F.avg((F.col("d") > 0).cast("double")).alias("p_b_better"))
    delta = diffs.agg((F.sum(diff) / F.count("*") * 100).alias("delta"))
    out = out.crossJoin(F.broadcast(delta)).select("n", "delta", F.element_at("s", low).alias("ci_lo"), F.element_at("s", high).alias("ci_hi"), "p_b_better")
    return out.withColumn("crosses_zero", (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0))


def multinomial_bootstrap(diffs: DataFrame, resamples: int = 1000, seed: int = 42, index: str = "i", diff: str = "diff", block: int = resampling.BLOCK) -> DataFrame:
    """One row (n, delta, ci_lo, ci_hi, p_b_better, crosses_zero), from one pass over the segments.

    diffs has (i, diff) with i from 0 to n - 1. How often a segment is drawn in every resample is computed from its
    number, so no draw is a row and nothing is joined to the segments: how many draws fall to a block of `block`
    segments is decided for all blocks at once (blocks times resamples numbers), and inside a block each segment takes
    its part of what the ones before it left. A block gives one vector of sums, and the vectors are added up.
    """
    spark, n = diffs.sparkSession, diffs.count()
    block = resampling.block_size(n, block)
    draws = spark.sparkContext.broadcast(resampling.block_draws(n, resamples, seed, block))  # 8 bytes a block and resample, of at most 4,096 blocks
    rows = diffs.select((F.floor(F.col(index) / block)).cast("long").alias("block"), F.col(index).cast("long").alias("i"), F.col(diff).cast("double").alias("d"))
    sums = rows.groupBy("block").applyInArrow(resampling.block_sums(draws, resamples, seed, n, block), "r int, s double")
    means = sums.groupBy("r").agg((F.sum("s") / n * 100).alias("d"))
    low, high = int(0.025 * resamples) + 1, int(0.975 * resamples) + 1
    out = means.agg(F.array_sort(F.collect_list("d")).alias("s"), F.avg((F.col("d") > 0).cast("double")).alias("p_b_better"))  # as many as resamples
    delta = diffs.agg(F.count("*").alias("n"), (F.sum(diff) / F.count("*") * 100).alias("delta"))
    out = out.crossJoin(F.broadcast(delta)).select("n", "delta", F.try_element_at("s", F.lit(low)).alias("ci_lo"), F.try_element_at("s", F.lit(high)).alias("ci_hi"), "p_b_better")
    return out.withColumn("crosses_zero", (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0))


def paired_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """(seg_id, diff) of two systems' scored segments; different sources or references are an error.

    Both have (seg_id, src, ref, score).
    """
    joined = a.select("seg_id", "src", "ref", F.col("score").alias("_a")).join(b.select("seg_id", F.col("src").alias("_src"), F.col("ref").alias("_ref"), F.col("score").alias("_b")), "seg_id", "full")
    same = F.col("src").eqNullSafe(F.col("_src")) & F.col("ref").eqNullSafe(F.col("_ref"))
    return joined.select("seg_id", F.when(same, F.col("_b") - F.col("_a")).otherwise(F.raise_error(F.lit("the two systems differ in source or reference")).cast("double")).alias("diff"))


def positional(values: Column, share: float) -> Column:
    """The element at position int(share * n) of the sorted array."""
    return F.try_element_at(F.array_sort(values), F.floor(F.size(values) * F.lit(share)).cast("int") + 1)


def length_statistics(rows: DataFrame, length: Column, total: int | None = None) -> DataFrame:
    """(n, mean, p50, p95, longest, estimated_total) with positional quantiles by exact counting of lengths.

    Lengths are counted first, so what is sorted are different lengths, not rows.
    """
    from pyspark.sql import Window

    counted = rows.groupBy(length.alias("len")).agg(F.count("*").alias("m"))
    upto = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("m").over(Window.partitionBy())
    placed = counted.withColumn("upto", F.sum("m").over(upto)).withColumn("n", n)
    at = lambda s: F.min(F.when(F.col("upto") > F.floor(F.col("n") * s), F.col("len")))
    out = placed.agg(F.max("n").alias("n"), (F.sum(F.col("len") * F.col("m")) / F.sum("m")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("len").alias("longest"))
    return out.withColumn("estimated_total", F.col("mean") * (F.lit(total) if total is not None else F.col("n")))


def against_reference_system(hyps: DataFrame, base: str, leak: Column | None = None, system: str = "system", seg: str = "seg_id", hyp: str = "hyp") -> DataFrame:
    """(system, n, empty, leak_pct, same_pct): each system's outputs beside those of the base system."""
    own = hyps.filter(F.col(system) == base).select(F.col(seg).alias("_seg"), F.col(hyp).alias("_base"))
    joined = hyps.join(own, F.col(seg) == F.col("_seg"), "left")
    pct = lambda c: F.avg(c.cast("double")) * 100
    return joined.groupBy(system).agg(F.count("*").alias("n"), F.count_if(T.strip(F.col(hyp)) == "").alias("empty"), (pct(leak) if leak is not None else F.lit(None).cast("double")).alias("leak_pct"), pct(F.coalesce(F.col(hyp) == F.col("_base"), F.lit(False))).alias("same_pct"))


def length_ratio_probe(rows: DataFrame, *by: str, hyp: str = "hyp", ref: str = "ref", short: float = 0.75) -> DataFrame:
    """(by..., n, median_ratio, n_short): the ordinary median of length ratios and how many are short."""
    ratio = F.length(hyp) / F.greatest(F.length(ref), F.lit(1))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.median(ratio).alias("median_ratio"), F.count_if(ratio < short).alias("n_short"))


def score_summary(rows: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """(by..., n, median_score, under_60, under_70)."""
    s = F.col(score)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.median(s).alias("median_score"), F.avg((s < 0.60).cast("double")).alias("under_60"), F.avg((s < 0.70).cast("double")).alias("under_70"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def system_scores(segments: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """(by..., n, system_score): the mean segment score times a hundred."""
    return segments.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(score) * 100).alias("system_score"))


def same_outputs(a: DataFrame, b: DataFrame, key: str = "seg_id", hyp: str = "hyp") -> DataFrame:
    """(key, same): whether two runs gave the same text, by digest; a missing text is never the same."""
    digest = lambda rows, name: rows.select(key, F.sha2(hyp, 256).alias(name))
    return digest(a, "_a").join(digest(b, "_b"), key, "full").select(key, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))
