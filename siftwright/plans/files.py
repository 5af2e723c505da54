"""Queries that write what the tables hold to files, in the layouts of the sinks, and read it back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.operators import curate, detect, metrics, replay
from siftwright.plans.base import Catalog, table
from siftwright.plans.corpus import PAIRS
from siftwright.sources import readers, writers
from siftwright.sources.shared import new_path

CATALOG = Catalog()
query = CATALOG.query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "prompt", "reply")


@query("""
SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS lineno, line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
""")
def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as lines and read back with their line numbers."""
    path = new_path(spark, "lines")
    table(spark, sf_dir, "documents").orderBy("doc_id").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return readers.numbered_lines(spark, path)


@query("""
SELECT lineno, a, b FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS lineno, left(replace(text, chr(10), ' '), 60) AS a, lang || ' ' || doc_id AS b FROM documents)
""")
def aligned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of as many lines, read back as pairs of the lines at one place."""
    docs = table(spark, sf_dir, "documents").orderBy("doc_id")
    a, b = new_path(spark, "aligned-a"), new_path(spark, "aligned-b")
    docs.select(F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(60)).alias("value")).write.text(a)
    docs.select(F.concat("lang", F.lit(" "), F.col("doc_id").cast("string")).alias("value")).write.text(b)
    return readers.line_aligned(readers.numbered_lines(spark, a), readers.numbered_lines(spark, b))


#: A side as the pair writer leaves it; line ends are blanks in the file.
SIDE = "regexp_replace(trim(replace(replace({c}, chr(9), ' '), chr(13), ''), ' ' || chr(10)), chr(10), ' ', 'g')"


@query(f"SELECT {SIDE.format(c='prompt')} AS source, {SIDE.format(c='reply')} AS target FROM ({PAIRS}) WHERE {SIDE.format(c='prompt')} <> '' AND {SIDE.format(c='reply')} <> '' AND {SIDE.format(c='prompt')} <> {SIDE.format(c='reply')}")
def pairs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as two columns, read as a file of three with a number in front, and as many of them as differ."""
    path, three = new_path(spark, "pairs"), new_path(spark, "triples")
    writers.write_pairs(_pairs(spark, sf_dir), path, "prompt", "reply")
    lines = readers.bitext_file(spark, path, "c", "en", "ja")
    lines.select(F.concat_ws("\t", F.col("lineno").cast("string"), "line").alias("value")).write.text(three)
    return readers.three_columns(readers.numbered_lines(spark, three).select("line")).select(F.col("target").alias("source"), F.col("source").alias("target"))


@query(f"SELECT md5(prompt) AS prompt, reply, 2 AS n FROM ({PAIRS})")
def records_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records as JSON lines, read back and cut into prompt and completion."""
    path = new_path(spark, "records")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    writers.write_records(_pairs(spark, sf_dir).select(F.array(message("user", "prompt"), message("assistant", "reply")).alias("messages")), path)
    cut = curate.prompt_completion(readers.jsonl(spark, path))
    return cut.select(F.md5(F.element_at("prompt", 1)["content"]).alias("prompt"), F.element_at("completion", 1)["content"].alias("reply"), (F.size("prompt") + F.size("completion")).alias("n"))


FLAT = "regexp_replace({c}, '\\s*[\\r\\n]+\\s*', ' ', 'g')"


@query(f"""
SELECT lineno, {FLAT.format(c='prompt')} AS src, {FLAT.format(c="reply || '!'")} AS ref, {FLAT.format(c='reply')} AS hyp FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS lineno FROM ({PAIRS})) WHERE lineno < 200
""")
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, reference and output as three files of segments, read back by line; the first two hundred."""
    rows = _pairs(spark, sf_dir).withColumn("seg_id", F.col("conv_id") * 100_000 + F.col("turn")).withColumn("ref", F.concat("reply", F.lit("!")))
    read = {}
    for name, column in (("src", "prompt"), ("ref", "ref"), ("hyp", "reply")):
        path = new_path(spark, f"segments-{name}")
        writers.write_segments(rows, path, column)
        read[name] = readers.numbered_lines(spark, path)
    return readers.hypothesis_triples(read["src"], read["ref"], read["hyp"], 200)


@query("SELECT doc_id, md5(text || chr(10)) AS digest FROM documents WHERE text IS NOT NULL AND NOT contains(text, '<<<DOC>>>')")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with separator lines, read back: what stands between two separators is a document again."""
    path = new_path(spark, "documents")
    docs = table(spark, sf_dir, "documents").filter("text is not null and not contains(text, '<<<DOC>>>')")
    writers.write_documents(docs, path, "text")
    read = spark.read.option("lineSep", "<<<DOC>>>\n").text(path)
    digests = docs.select("doc_id", F.md5(F.concat("text", F.lit("\n"))).alias("digest"))
    return digests.join(read.select(F.md5("value").alias("digest")).distinct(), "digest").select("doc_id", "digest")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), e AS (SELECT DISTINCT line FROM l WHERE doc_id % 50 = 0 AND length(line) > 20)
SELECT doc_id, count(*) AS n FROM l WHERE line IN (SELECT line FROM e) GROUP BY doc_id
""")
def evaluation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every fiftieth document as the evaluation file, and how many lines of each document are in it."""
    path = new_path(spark, "evaluation")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    writers.write_evaluation_lines(lines.filter("doc_id % 50 = 0 and length(line) > 20"), path)
    return lines.join(readers.evaluation_lines(spark, path), "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""
SELECT 'v1' AS tag, source AS bench, lang || '->x' AS direction, metric, value FROM (
  SELECT source, lang, unnest(['chars', 'docs']) AS metric, unnest([round(avg(n_chars), 3), count(*)::DOUBLE]) AS value FROM documents WHERE source IN ('src0', 'src1', 'src2') AND lang IS NOT NULL GROUP BY source, lang)
""")
def result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents, one file for each benchmark below a folder, found by tag and read as cells."""
    folder = new_path(spark, "results")
    docs = table(spark, sf_dir, "documents").filter("source in ('src0', 'src1', 'src2') and lang is not null")
    scores = docs.groupBy("source", F.concat("lang", F.lit("->x")).alias("direction")).agg(F.round(F.avg("n_chars"), 3).alias("chars"), F.count("*").cast("double").alias("docs")).unpivot(["source", "direction"], ["chars", "docs"], "metric", "value")
    for bench in ("src0", "src1", "src2"):
        writers.write_report(writers.run_result(scores.filter(F.col("source") == bench).drop("source"), "v1", bench, 3), f"{folder}/{bench}/v1-{bench}.json")
    return readers.result_files(spark, folder, "v1")


@query("SELECT 'c' || conv_id AS case_id, min(text) AS source, unnest(list_sort(list_distinct(list(role)))) AS target FROM conversations GROUP BY conv_id")
def manifest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each conversation with its roles as targets, written as manifests and read as rows."""
    path = new_path(spark, "manifests")
    cases = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("text").alias("source"), F.array_sort(F.collect_set("role")).alias("targets"))
    cases = cases.select(F.floor(F.col("conv_id") / 1000).alias("thousand"), F.concat(F.lit("c"), "conv_id").alias("case_id"), "source", "targets")
    writers.write_manifests(cases, path, F.col("thousand"))
    return readers.case_manifest(spark, path, one_document=False)


@query("SELECT text AS en, text || '!' AS zh FROM documents WHERE lang = 'en' AND text <> ''")
def parquet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a Parquet file, without those that lack a side."""
    path = new_path(spark, "parquet-pairs")
    table(spark, sf_dir, "documents").select(F.col("text").alias("sourceString"), F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).alias("targetString")).write.parquet(path)
    return readers.complete_rows(readers.parquet_pairs(spark, path), "en", "zh")


@query(f"""
SELECT 'translation' AS layout, count(*) AS n, sum(length(prompt) + 2 * length(reply)) AS chars FROM ({PAIRS})
UNION ALL SELECT 'columns', count(*), sum(length(prompt) + 2 * length(reply)) FROM ({PAIRS})
UNION ALL SELECT 'judged', count(*) FILTER (WHERE turn % 4 = 0 AND conv_id % 2 = 0), sum(length(prompt) + 2 * length(reply)) FILTER (WHERE turn % 4 = 0 AND conv_id % 2 = 0) FROM ({PAIRS})
UNION ALL SELECT 'turns', count(*), sum(length(prompt) + 2 * length(reply)) FROM ({PAIRS})
""")
def pair_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs as nested translations, as columns named after languages, with two judges, and as lists of turns."""
    p = _pairs(spark, sf_dir)
    nested = readers.translation_struct(p.select(F.struct(F.col("prompt").alias("en"), F.col("reply").alias("zh")).alias("translation")), "en", "zh")
    named = readers.inferred_english(p.select(F.col("reply").alias("chinese"), F.col("prompt").alias("text_en")))
    judged = readers.judged_pairs(p.select(F.col("prompt").alias("english"), F.col("reply").alias("japanese"), (F.col("turn") % 4 == 0).alias("model1_accepted"), (F.col("conv_id") % 2 == 0).alias("model2_accepted")))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    turns = replay.array_turn_pairs(p.select(F.array(turn("user", "prompt"), turn("assistant", "reply")).alias("conversations")))
    layouts = {"translation": nested.toDF("a", "b"), "columns": named.toDF("a", "b"), "judged": judged, "turns": turns.select(F.col("prompt").alias("a"), F.col("reply").alias("b"))}
    out = None
    for name, rows in layouts.items():
        part = rows.agg(F.count("*").alias("n"), F.sum(F.length("a") + 2 * F.length("b")).alias("chars")).select(F.lit(name).alias("layout"), "n", "chars")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH s AS (SELECT lang, count(*) AS n, avg(n_chars % 20 - 9.0) AS m, stddev_pop(n_chars % 20) / sqrt(count(*)) AS e FROM documents WHERE lang IS NOT NULL GROUP BY lang),
i AS (SELECT lang, n, round(m, 4) AS delta, round(m - 2 * e, 4) AS ci_lo, round(m + 2 * e, 4) AS ci_hi FROM s)
SELECT 'base__v1__' || lang || '2ja' AS name, n, delta, ci_lo, ci_hi, CASE WHEN ci_lo > 0 THEN 'b' WHEN ci_hi < 0 THEN 'a' ELSE 'none' END AS better FROM i
""")
def bootstrap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each language, written under their names and found by them."""
    path, x = new_path(spark, "bootstrap"), F.col("n_chars") % 20
    stats = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.avg(x - 9.0).alias("delta"), (F.stddev_pop(x) / F.sqrt(F.count("*"))).alias("e"))
    intervals = stats.select(F.lit("base").alias("a"), F.lit("v1").alias("b"), F.concat("lang", F.lit("2ja")).alias("direction"), "n", "delta", (F.col("delta") - 2 * F.col("e")).alias("ci_lo"), (F.col("delta") + 2 * F.col("e")).alias("ci_hi"))
    writers.write_named(writers.bootstrap_records(intervals), path)
    return readers.named_records(spark, path, "n long, delta double, ci_lo double, ci_hi double, better string")


@query("""
WITH s AS (SELECT source AS candidate, round(avg(n_chars), 2) AS chars, count(*)::DOUBLE AS docs FROM documents WHERE source IS NOT NULL GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY chars DESC, candidate) AS rank FROM s)
SELECT candidate, CAST(rank AS INT) AS rank, metric, value FROM (SELECT candidate, rank, unnest(['chars', 'docs']) AS metric, unnest([chars, docs]) AS value FROM r)
""")
def ranking_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as candidates: the ranking and every candidate's metrics in one report, read back as cells."""
    path = f"{new_path(spark, 'ranking')}/ranking.json"
    wide = table(spark, sf_dir, "documents").filter("source is not null").groupBy(F.col("source").alias("candidate")).agg(F.round(F.avg("n_chars"), 2).alias("chars"), F.count("*").cast("double").alias("docs"))
    ranking = wide.select(F.row_number().over(Window.orderBy(F.desc("chars"), "candidate")).alias("rank"), "candidate")  # one row a candidate
    writers.write_report(writers.ranking_report(ranking, wide.unpivot("candidate", ["chars", "docs"], "metric", "value")), path)
    read = spark.read.schema("ranking array<struct<rank:int,candidate:string>>, cells map<string,map<string,double>>").json(path)
    cells = read.select("ranking", F.explode("cells").alias("candidate", "m"))
    placed = cells.select("candidate", F.filter("ranking", lambda r: r["candidate"] == F.col("candidate"))[0]["rank"].alias("rank"), F.explode("m").alias("metric", "value"))
    return placed.select("candidate", "rank", "metric", "value")


@query(f"""
WITH o AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 8 = 0 THEN '' ELSE left(reply, 15) END AS o FROM ({PAIRS})),
f AS (SELECT id, CASE WHEN o = '' THEN ['empty'] WHEN NOT contains(o, 'la') THEN ['keep:la'] ELSE [] END AS found FROM o)
SELECT id, found, (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM f WHERE len(found) > 0) AS with_defects FROM f
""")
def defect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of two kinds of defects, written one a line beside their summary, and read back."""
    path = new_path(spark, "defects")
    out = F.when(F.col("turn") % 8 == 0, "").otherwise(F.left("reply", F.lit(15)))
    keep = F.array(F.lit("la"))
    rows = _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), keep.alias("keep"), F.filter(detect.defects(F.col("prompt"), out, keep), lambda x: (x == "empty") | x.startswith("keep")).alias("found"))
    writers.write_defects(detect.defect_summary(rows), rows, path)
    summary, cases = readers.stored_defects(spark, path, "n long, with_defects long", "id long, found array<string>")
    return cases.crossJoin(F.broadcast(summary))  # of one row


@query("""
WITH b AS (SELECT lang, round(avg(n_chars) FILTER (WHERE source = 'src0'), 1) AS a, round(avg(n_chars) FILTER (WHERE source = 'src1'), 1) AS b FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT 'lines' AS part, count(*) + 4 AS n FROM b UNION ALL SELECT 'dashes', count(*) FILTER (WHERE a IS NULL) + count(*) FILTER (WHERE b IS NULL) FROM b
UNION ALL SELECT 'chars', sum(length('| ' || lang || ' | ' || coalesce(printf('%.1f', a), '-') || ' | ' || coalesce(printf('%.1f', b), '-') || ' |'))::BIGINT FROM b
""")
def scoreboard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board of two sources by language as text: its lines, its missing cells and the length of its rows."""
    value = lambda s: F.round(F.avg(F.when(F.col("source") == s, F.col("n_chars"))), 1).alias(s)
    board = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(value("src0"), value("src1"))
    path = f"{new_path(spark, 'board')}/board.md"
    writers.write_report(spark.createDataFrame([(writers.scoreboard_markdown(board, "Characters"),)], "json string"), path)
    lines = readers.numbered_lines(spark, path).filter("line <> '' or lineno < 4")
    body = lines.filter("lineno >= 4")
    parts = {"lines": lines.filter("lineno < 4 or line <> ''").agg(F.count("*").alias("n")), "dashes": body.agg(F.sum(F.regexp_count("line", F.lit(r"\| - "))).cast("long").alias("n")), "chars": body.agg(F.sum(F.length("line")).alias("n"))}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id AS seg_id, round((doc_id * 7 % 100 - n_chars % 100) / 100.0, 6) AS diff FROM documents WHERE text IS NOT NULL")
def paired_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two systems' scores on the same segments; other sources or references would be an error."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("seg_id"), F.left("text", F.lit(20)).alias("src"), F.col("lang").alias("ref"), "n_chars")
    a, b = docs.withColumn("score", (F.col("n_chars") % 100) / 100), docs.withColumn("score", (F.col("seg_id") * 7 % 100) / 100)
    return metrics.paired_segments(a.drop("n_chars"), b.drop("n_chars")).withColumn("diff", F.round("diff", 6))


@query("SELECT lang AS key, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def statistics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language as one statistics document, written and read back."""
    path = f"{new_path(spark, 'statistics')}/stats.json"
    counts = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    writers.write_report(writers.statistics_json(counts, F.col("lang")), path)
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("key", "n"))
