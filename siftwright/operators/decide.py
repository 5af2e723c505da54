"""Decisions over metric tables: scoreboard, gate, candidate ranking, merges of result tables.

A missing metric is NULL and becomes MISSING; it is never 0 and never a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import constants as K

NAMES = tuple(f"{s}->{t}" for s, t in K.DIRECTIONS)
LEAK_NAMES = ("en->zhtw", "ja->zhtw")
LANGS = ("zhtw", "ja", "en")


def verdict(cand: Column, bound: Column, mode: Column, band: Column | None = None) -> Column:
    """PASS, TIE?, FAIL, or MISSING without a candidate or a bound."""
    inside = F.lit(False) if band is None else F.coalesce(cand >= bound - band, F.lit(False))
    at_least = F.when(cand >= bound, "PASS").when(inside, "TIE?").otherwise("FAIL")
    return F.when(cand.isNull() | bound.isNull(), "MISSING").when(mode == "max", F.when(cand <= bound, "PASS").otherwise("FAIL")).otherwise(at_least)


def gate_plan(spark) -> DataFrame:
    """The cells of the gate: (ord, grp, item, metric, mode, relative, offset, band). Relative bounds add offset to the baseline."""
    cells = [("leak", d, "simplified_leak_pct", "max", True, K.LEAK_TOLERANCE, None) for d in LEAK_NAMES]
    cells += [("comet", d, "comet", "min", True, 0.0, K.SCORE_BAND) for d in NAMES]
    cells += [(g, lang, "acc", "min", True, -K.BENCH_TOLERANCE, None) for g in ("belebele", "knowledge") for lang in LANGS]
    cells += [("doc_tail", d, "tail_ratio_median", "min", False, K.TAIL_MIN, None) for d in NAMES]
    cells += [("doc_truncated", d, "truncated_pct", "max", False, K.TRUNCATED_MAX, None) for d in NAMES]
    cells += [("mere_translation", "all", "mere_translation_pct", "max", False, K.MERE_TRANSLATION_MAX, None)]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "ord int, grp string, item string, metric string, mode string, relative boolean, offset double, band double")


def gate(metrics: DataFrame, intervals: DataFrame, candidate: str, baseline: str, bench_baseline: str | None = None) -> DataFrame:
    """(ord, grp, item, base, cand, bound, mode, verdict, note) for every cell.

    metrics is (tag, grp, item, value); intervals is (a, b, direction, ci_lo, ci_hi, crosses_zero). A tie is settled by
    its interval: across zero passes, not across zero fails on whichever side it lies, none is MISSING. Of several
    values for one cell the table is wrong, and that is an error.
    """
    plan = gate_plan(metrics.sparkSession)
    one = metrics.groupBy("tag", "grp", "item").agg(F.count("*").alias("_n"), F.max("value").alias("value"))
    one = one.withColumn("value", F.when(F.col("_n") > 1, F.raise_error(F.lit("a metric is given twice")).cast("double")).otherwise(F.col("value"))).drop("_n")
    base_tag = F.when(F.col("grp").isin("belebele", "knowledge"), bench_baseline or baseline).otherwise(baseline)
    cand = one.filter(F.col("tag") == candidate).select("grp", "item", F.col("value").alias("cand"))
    base = one.filter(F.col("tag") == base_tag).select("grp", "item", F.col("value").alias("base"))
    rows = plan.join(cand, ["grp", "item"], "left").join(base, ["grp", "item"], "left")
    bound = F.when(F.col("relative"), F.col("base") + F.col("offset")).otherwise(F.col("offset"))
    rows = rows.withColumn("base", F.when(F.col("relative"), F.col("base"))).withColumn("bound", bound)
    rows = rows.withColumn("first", verdict(F.col("cand"), F.col("bound"), F.col("mode"), F.col("band")))
    ci = intervals.filter((F.col("a") == baseline) & (F.col("b") == candidate)).select(F.col("direction").alias("item"), F.lit("comet").alias("grp"), "ci_lo", "ci_hi", "crosses_zero")
    rows = rows.join(ci, ["grp", "item"], "left")
    tie = F.when(F.col("crosses_zero").isNull(), "MISSING").when(F.col("crosses_zero"), "PASS").otherwise("FAIL")
    note = F.when(F.col("first") == "TIE?", F.when(F.col("crosses_zero").isNull(), "no interval").when(F.col("crosses_zero"), "tie").otherwise("interval beside zero")).otherwise("")
    return rows.select("ord", "grp", "item", "base", "cand", "bound", "mode", F.when(F.col("first") == "TIE?", tie).otherwise(F.col("first")).alias("verdict"), note.alias("note"))


def gate_status(cells: DataFrame) -> DataFrame:
    """One row (n_pass, n_fail, n_missing, status): 1 with any FAIL, else 2 with any MISSING, else 0."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return cells.agg(count("PASS").alias("n_pass"), count("FAIL").alias("n_fail"), count("MISSING").alias("n_missing")).withColumn("status", F.when(F.col("n_fail") > 0, 1).when(F.col("n_missing") > 0, 2).otherwise(0))


def rank_candidates(cells: DataFrame, metrics: DataFrame, baseline: str = "baseline_ship", leak_tolerance: float = K.SEARCH_LEAK_TOLERANCE, drop_tolerance: float = K.SEARCH_DROP_TOLERANCE) -> DataFrame:
    """(id, ok, reasons, mean, max_leak, place): place 1 wins; without an eligible candidate no row has a place.

    cells is (id, loop_flag); metrics is (id, direction, chrf, leak). The order is: highest mean, lowest leak, the
    baseline, then ids descending. A missing baseline is an error.
    """
    base = metrics.filter(F.col("id") == baseline).select("direction", F.col("chrf").alias("_chrf"), F.col("leak").alias("_leak"))
    has = cells.agg(F.max((F.col("id") == baseline).cast("int")).alias("_has"))
    to_zh = F.col("direction").endswith("->zhtw")
    each = metrics.join(base, "direction", "left")
    leaks = F.when(to_zh & (F.col("leak") > F.col("_leak") + leak_tolerance), F.concat(F.lit("leak:"), F.col("direction")))
    drops = F.when(F.col("chrf") < F.col("_chrf") - drop_tolerance, F.concat(F.lit("drop:"), F.col("direction")))
    summed = each.groupBy("id").agg(F.array_sort(F.array_compact(F.concat(F.collect_list(leaks), F.collect_list(drops)))).alias("found"), F.avg("chrf").alias("mean"), F.max(F.when(to_zh, F.col("leak"))).alias("max_leak"))
    rows = cells.join(summed, "id", "left").crossJoin(F.broadcast(has))
    rows = rows.withColumn("reasons", F.concat(F.when(F.coalesce("loop_flag", F.lit(False)), F.array(F.lit("loop"))).otherwise(F.array().cast("array<string>")), F.coalesce("found", F.array().cast("array<string>"))))
    rows = rows.withColumn("reasons", F.when(F.coalesce("_has", F.lit(0)) == 0, F.raise_error(F.lit("no baseline cell")).cast("array<string>")).otherwise(F.col("reasons")))
    rows = rows.withColumn("ok", F.size("reasons") == 0).withColumn("max_leak", F.coalesce("max_leak", F.lit(0.0)))
    order = Window.partitionBy("ok").orderBy(F.desc_nulls_last(F.round("mean", 4)), "max_leak", F.desc((F.col("id") == baseline).cast("int")), F.desc("id"))
    return rows.select("id", "ok", "reasons", "mean", "max_leak", F.when(F.col("ok"), F.row_number().over(order)).alias("place"))


def winner_matches(shipped: DataFrame, winner: DataFrame) -> DataFrame:
    """One row (same): decode, beams and length penalty agree; a null penalty is 1.0. Without a winner: false."""
    s = shipped.select(F.col("decode").alias("d"), F.col("beams").alias("b"), F.coalesce("length_penalty", F.lit(1.0)).alias("l"))
    w = winner.select("decode", "beams", F.coalesce("length_penalty", F.lit(1.0)).alias("p"))
    return s.join(w, (F.col("d") == F.col("decode")) & (F.col("b") == F.col("beams")) & (F.col("l") == F.col("p"))).agg((F.count("*") > 0).alias("same"))


def scoreboard(metrics: DataFrame, metric: str, tags: list[str]) -> DataFrame:
    """(direction, a column for each benchmark): values of one tag, or last minus first of two; missing stays NULL."""
    rows = metrics.filter((F.col("metric") == metric) & F.col("tag").isin(tags[0], tags[-1]))
    value = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("value")))
    cell = value(tags[0]) if len(tags) == 1 else value(tags[-1]) - value(tags[0])
    return rows.groupBy("direction").pivot("bench", list(K.BENCHES)).agg(cell)


def secondary_cell(bench: Column, direction: Column) -> Column:
    """Whether a score rests on converted references."""
    return bench.isin(*K.SIMPLIFIED_BENCHES) & direction.endswith("->zhtw")


def merge_results(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with new's rows in place of those with the same keys; all others stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_back(results: DataFrame, scores: DataFrame, column: str, *keys: str) -> DataFrame:
    """results with a column set from scores; rows without a score keep what they have."""
    joined = results.join(scores.select(*keys, F.col("score").alias("_score")), list(keys), "left")
    old = F.col(column) if column in results.columns else F.lit(None).cast("double")
    return joined.withColumn(column, F.coalesce("_score", old)).drop("_score")


def strategy_verdicts(runs: DataFrame, order: str = "ord") -> DataFrame:
    """(strategy, passed, recommended): passed if no critical case loops; the first that passed is recommended."""
    rows = runs.groupBy("strategy").agg(F.min(order).alias("ord"), F.every(~F.col("loop_flag") | ~F.col("critical")).alias("passed"))
    first = Window.partitionBy("passed").orderBy("ord")
    return rows.select("strategy", "passed", (F.col("passed") & (F.row_number().over(first) == 1)).alias("recommended"))
