"""Sinks: pairs, records, statistics, segments, results. Writers leave folders of part files, as Spark does."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import text as T


def tsv_side(text: Column) -> Column:
    """Without carriage returns, tabs as blanks, trimmed."""
    return T.strip(F.regexp_replace(F.regexp_replace(text, "\t", " "), "\r", ""))


def write_pairs(pairs: DataFrame, path: str, a: str = "a", b: str = "b", mode: str = "overwrite") -> None:
    """Two tab-separated columns, unquoted; pairs with an empty side are left out."""
    rows = pairs.select(tsv_side(F.col(a)).alias("a"), tsv_side(F.col(b)).alias("b")).filter("a <> '' and b <> ''")
    rows.select(F.concat_ws("\t", F.regexp_replace("a", "\n", " "), F.regexp_replace("b", "\n", " ")).alias("value")).write.mode(mode).text(path)


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record a line, non-ASCII as it is."""
    records.write.mode(mode).json(path)


def statistics_json(counts: DataFrame, key: Column, n: str = "n") -> DataFrame:
    """One row (json): an object of counts by key."""
    return counts.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(n).alias("v")))))).alias("json"))


def write_segments(rows: DataFrame, path: str, column: str, seg: str = "seg_id", mode: str = "overwrite") -> None:
    """One segment a line in order, line ends inside as blanks."""
    rows.orderBy(seg).select(F.regexp_replace(column, r"\s*[\r\n]+\s*", " ").alias("value")).write.mode(mode).text(path)


def write_documents(rows: DataFrame, path: str, column: str, key: str = "doc_id", separator: str = "<<<DOC>>>", mode: str = "overwrite") -> None:
    """Documents in order, a separator line after each."""
    rows.orderBy(key).select(F.concat(F.col(column), F.lit(f"\n{separator}")).alias("value")).write.mode(mode).text(path)


def write_evaluation_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sorted distinct lines."""
    lines.select("line").distinct().orderBy("line").write.mode(mode).text(path)


def write_scores(scores: DataFrame, path: str, force: bool = False) -> None:
    """A score table; one that is there stays unless forced."""
    scores.write.mode("overwrite" if force else "ignore").partitionBy("corpus").parquet(path)


def scoreboard_markdown(board: DataFrame, title: str) -> str:
    """A small pivoted board as a Markdown table; missing cells are dashes."""
    rows = board.collect()
    head = "| " + " | ".join(board.columns) + " |\n|" + "---|" * len(board.columns)
    body = ["| " + " | ".join("-" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return f"### {title}\n\n{head}\n" + "\n".join(body) + "\n"


def _object(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row (o): an object of the values by key, in order of the keys; a report's rows are few."""
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    return rows.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))), by_key)).alias("o"))


def write_json(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of one row (json) as one file below path."""
    document.select("json").coalesce(1).write.mode(mode).text(path)


def write_report(document: DataFrame, path: str) -> None:
    """A report of one row (json) as a file of just this name, so that a reader finds it by its name."""
    spark, aside = document.sparkSession, f"{path}.{uuid.uuid4().hex}"
    document.select("json").coalesce(1).write.text(aside)
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(of(aside)) if f.getPath().getName().startswith("part-"))
    fs.delete(of(path), False)
    fs.rename(part, of(path))
    fs.delete(of(aside), True)


def write_manifests(cases: DataFrame, path: str, by: Column, mode: str = "overwrite") -> None:
    """Cases (case_id, source, targets) as JSON documents, one a line for each value of `by`, which bounds their size."""
    cases.groupBy(by.alias("_by")).agg(F.array_sort(F.collect_list(F.struct("case_id", "source", "targets"))).alias("cases")).select("cases").write.mode(mode).json(path)


def run_result(scores: DataFrame, tag: str, benchmark: str, n: int, model: str | None = None, adapter: str | None = None, gen: dict | None = None, defaults: dict | None = None) -> DataFrame:
    """One row (json) of a run's result from scores (direction, metric, value): what was run and each direction's metrics."""
    by_direction = scores.groupBy("direction").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    head = [F.lit(tag).alias("tag"), F.lit(benchmark).alias("benchmark"), F.lit(model).alias("model"), F.lit(adapter).alias("adapter"), F.lit(n).alias("n")]
    options = [F.from_json(F.lit(json.dumps(v or {})), "map<string,string>" if k == "gen" else "map<string,map<string,string>>").alias(k) for k, v in (("gen", gen), ("decode_defaults", defaults))]
    return _object(by_direction, F.col("direction"), F.col("m")).select(F.to_json(F.struct(*head, *options, F.col("o").alias("results")), {"ignoreNullFields": "false"}).alias("json"))


def bootstrap_records(intervals: DataFrame) -> DataFrame:
    """(name, json) from (a, b, direction, n, delta, ci_lo, ci_hi, p_b_better, crosses_zero and more): one record for each comparison, named by it."""
    verdict = F.when(F.col("ci_lo") > 0, "b").when(F.col("ci_hi") < 0, "a").otherwise("none")
    rounded = {c: F.round(c, 4) for c in ("delta", "ci_lo", "ci_hi")}
    return intervals.withColumns(rounded).withColumn("better", verdict).select(F.concat_ws("__", "a", "b", "direction").alias("name"), F.to_json(F.struct(*intervals.columns, "better")).alias("json"))


def write_named(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records (name, json), one folder for each name, so that a reader finds a record by its name."""
    records.write.mode(mode).partitionBy("name").text(path)


def ranking_report(ranking: DataFrame, cells: DataFrame, key: str = "candidate") -> DataFrame:
    """One row (json): the candidates in order of rank with all their columns, and each candidate's metrics (key, metric, value)."""
    metrics = cells.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    order = ranking.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in ranking.columns if c != "rank"]))).alias("ranking"))
    return order.crossJoin(_object(metrics, F.col(key), F.col("m"))).select(F.to_json(F.struct("ranking", F.col("o").alias("cells"))).alias("json"))


def audit_report(counts: DataFrame, denominators: DataFrame, samples: DataFrame, raw: DataFrame | None = None, by: str = "direction", skipped: int = 0) -> DataFrame:
    """One row (json) of an audit: totals and counts by group, what shares refer to, samples by hit, and counts of the raw rows if given."""
    nested = lambda c: c.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hit", "n")))).alias("m"))
    parts = {
        "totals": _object(denominators, F.col(by), F.col("n")),
        "counts": _object(nested(counts), F.col(by), F.col("m")),
        "denominators": _object(denominators, F.col(by), F.struct("with_names", "with_strict", "multi_line")),
        "samples": _object(samples.groupBy("hit").agg(F.array_sort(F.collect_list(F.struct(*[c for c in samples.columns if c != "hit"]))).alias("s")), F.col("hit"), F.col("s")),
    }
    if raw is not None:
        parts["raw"] = _object(nested(raw), F.col(by), F.col("m"))
    out = None
    for name, part in parts.items():  # one row each
        part = part.withColumnRenamed("o", name)
        out = part if out is None else out.crossJoin(part)
    return out.select(F.to_json(F.struct(*parts, F.lit(skipped).alias("replay_skipped"))).alias("json"))


def write_defects(summary: DataFrame, rows: DataFrame, path: str, key: str = "id") -> None:
    """A summary as one file, and below it every case as a JSON line, in order of its key; no row holds several cases."""
    write_report(summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")), f"{path}/summary.json")
    rows.orderBy(key).write.mode("overwrite").json(f"{path}/cases")
