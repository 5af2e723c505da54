"""Sources with explicit schemas: numbered lines, pairs, multiparallel texts, conversation trees, result files.

Line numbers are physical. A task reads the lines of a split in their order, so a line's place in its split is its
distance from the split's first row; splits are counted, and prefix sums of the counts tell where each begins. Lines
never leave the JVM and are not sorted; what is joined to them is one row for each split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.functions import constants as K

NODE = "message_id string, parent_id string, role string, text string, lang string, rank int, deleted boolean, ord long"
RECORD = "messages array<struct<role:string,content:string>>"
ALIGNMENT = "corpus string, lineno long, score float"


def corpora(spark: SparkSession) -> DataFrame:
    """(corpus, lang_a, lang_b, domain, one_way_src, documents): the registry as a table."""
    rows = [(c, a, b, K.DOMAIN_OF_FAMILY[c.split(".")[0]], K.ONE_WAY.get(c, (None, None))[0], c in K.DOCUMENT_CORPORA) for c, a, b in K.CORPORA]
    return spark.createDataFrame(rows, "corpus string, lang_a string, lang_b string, domain string, one_way_src string, documents boolean")


def numbered_files(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """(file, lineno, line) of all text files at a path, numbered from 0 by file, or with by=() over all files in order of
    their paths. Lines end at line feeds only; a carriage return or another separator belongs to its line."""
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    return lines.join(splits, ["file", "_split"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("lineno"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(lineno, line) of a text file, or of the part files of a folder one after the other, in order from 0."""
    return numbered_files(spark, path).select("lineno", "line")


def bitext_file(spark: SparkSession, path: str, corpus: str, lang_a: str, lang_b: str) -> DataFrame:
    """(corpus, lineno, line, lang_a, lang_b); malformed lines stay and get their reason later."""
    return numbered_lines(spark, path).select(F.lit(corpus).alias("corpus"), "lineno", "line", F.lit(lang_a).alias("lang_a"), F.lit(lang_b).alias("lang_b"))


def line_aligned(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
    """(lineno, a, b) of two numbered files; a line without its partner is an error."""
    a, b = names or ("a", "b")
    joined = left.select("lineno", F.col("line").alias(a)).join(right.select("lineno", F.col("line").alias(b), F.lit(True).alias("_r")), "lineno", "full")
    lone = F.col(a).isNull() | F.col("_r").isNull()
    return joined.select("lineno", F.when(lone, F.raise_error(F.lit("the files differ in length"))).otherwise(F.col(a)).alias(a), b)


def three_columns(lines: DataFrame) -> DataFrame:
    """(source, target) as (third, second) column of lines with exactly three columns that differ."""
    p = F.split("line", "\t")
    return lines.filter((F.size(p) == 3) & (F.get(p, F.lit(1)) != F.get(p, F.lit(2)))).select(F.get(p, F.lit(2)).alias("source"), F.get(p, F.lit(1)).alias("target"))


def inferred_english(rows: DataFrame) -> DataFrame:
    """(en, other): the first column whose name has "en" in it, and the first of the others."""
    english = next(c for c in rows.columns if "en" in c.lower())
    other = next(c for c in rows.columns if c != english)
    return rows.select(F.col(english).alias("en"), F.col(other).alias("other"))


def translation_struct(rows: DataFrame, a: str, b: str, column: str = "translation") -> DataFrame:
    return rows.select(F.col(f"{column}.{a}").alias("a"), F.col(f"{column}.{b}").alias("b"))


def judged_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) that both judges accepted."""
    return rows.filter(F.col("model1_accepted") & F.col("model2_accepted")).select(F.col("english").alias("a"), F.col("japanese").alias("b"))


def evaluation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of the evaluation set. A missing file is an error: the gate is not optional."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line")).distinct()


def jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records split at line feeds only; other Unicode line separators belong to their record."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def parquet_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(en, zh) from a Parquet file with sourceString and targetString."""
    return spark.read.parquet(path).select(F.col("sourceString").alias("en"), F.col("targetString").alias("zh"))


def complete_rows(rows: DataFrame, *langs: str) -> DataFrame:
    """Rows in which every language has a text."""
    keep = F.lit(True)
    for lang in langs:
        keep = keep & F.coalesce(F.col(lang) != "", F.lit(False))
    return rows.filter(keep)


def first_segments(rows: DataFrame, limit: int | None, seg: str = "seg_id") -> DataFrame:
    """Segments below the limit in every language, which keeps them aligned."""
    return rows if limit is None else rows.filter(F.col(seg) < limit)


def all_directions(segments: DataFrame, convert_zh: Column | None = None, bench: str = "bench", seg: str = "seg_id") -> DataFrame:
    """(bench, seg_id, src_lang, tgt_lang, src, tgt) for the known directions of a multiparallel table (bench, seg_id, lang, text)."""
    spark = segments.sparkSession
    text = F.when(F.col("lang") == "zhtw", convert_zh).otherwise(F.col("text")) if convert_zh is not None else F.col("text")
    own = segments.select(bench, seg, "lang", text.alias("text"))
    ways = F.broadcast(spark.createDataFrame(list(K.DIRECTIONS), "src_lang string, tgt_lang string"))
    src = own.select(bench, seg, F.col("lang").alias("src_lang"), F.col("text").alias("src")).join(ways, "src_lang")
    tgt = own.select(bench, seg, F.col("lang").alias("tgt_lang"), F.col("text").alias("tgt"))
    return src.join(tgt, [bench, seg, "tgt_lang"]).select(bench, seg, "src_lang", "tgt_lang", "src", "tgt")


def segment_documents(zh: DataFrame, ja: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """(document_id, n, en, zh, ja): documents whose segments both configurations have, texts joined by line ends."""
    joined = zh.filter("not is_bad_source").select("document_id", "segment_id", F.col("source").alias("en"), F.col("target").alias("zh"))
    joined = joined.join(ja.filter("not is_bad_source").select("document_id", "segment_id", F.col("target").alias("ja")), ["document_id", "segment_id"])
    docs = joined.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "en", "zh", "ja"))).alias("s")).filter(F.size("s") >= least)
    text = lambda c: F.array_join(F.transform("s", lambda x: x[c]), "\n").alias(c)
    out = docs.select("document_id", F.size("s").alias("n"), text("en"), text("zh"), text("ja"))
    return out if most is None else out.orderBy("document_id").limit(most)


def reading_items(rows: DataFrame) -> DataFrame:
    """(question, passage, options, gold) with gold from 0."""
    return rows.select("question", F.col("flores_passage").alias("passage"), F.array(*[f"mc_answer{i}" for i in range(1, 5)]).alias("options"), (F.col("correct_answer_num").cast("int") - 1).alias("gold"))


def knowledge_items(lettered: DataFrame | None = None, listed: DataFrame | None = None, capital: DataFrame | None = None) -> DataFrame:
    """(question, options, gold) from the three layouts: letters, a list with a number, capital names."""
    letter = lambda c: F.instr(F.lit("ABCD"), F.upper(F.trim(c))) - 1
    parts = []
    if lettered is not None:
        parts.append(lettered.select("question", F.array("A", "B", "C", "D").alias("options"), letter(F.col("answer")).alias("gold")))
    if listed is not None:
        parts.append(listed.select("question", F.col("choices").alias("options"), F.col("answer").cast("int").alias("gold")))
    if capital is not None:
        parts.append(capital.select(F.col("Question").alias("question"), F.array("A", "B", "C", "D").alias("options"), letter(F.col("Answer")).alias("gold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def result_files(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """(tag, bench, direction, metric, value) from <tag>-<bench>.json below a folder; two files of one name are an error."""
    schema = "results map<string,map<string,string>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{tag}-*.json").json(folder)
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), f"^{tag}-", "").alias("bench"), "results")
    cells = named.select("path", "bench", F.explode("results").alias("direction", "metrics")).select("path", "bench", "direction", F.explode("metrics").alias("metric", "value"))
    one = cells.groupBy("bench", "direction", "metric").agg(F.count("*").alias("n"), F.max(F.col("value").try_cast("double")).alias("value"))
    return one.select(F.lit(tag).alias("tag"), "bench", "direction", "metric", F.when(F.col("n") > 1, F.raise_error(F.lit("a result is found in two files")).cast("double")).otherwise(F.col("value")).alias("value"))


def hypothesis_triples(src: DataFrame, ref: DataFrame, hyp: DataFrame, first: int | None = None) -> DataFrame:
    """(lineno, src, ref, hyp) of three numbered files of equal length; with `first`, that many lines must be there."""
    out = line_aligned(line_aligned(src, ref, "src", "ref").select("lineno", F.col("src").alias("line"), "ref"), hyp, "src", "hyp").join(ref.select("lineno", F.col("line").alias("ref")), "lineno")
    if first is None:
        return out
    return out.filter(F.col("lineno") < first).withColumn("_n", F.lit(first)).drop("_n")


def log_series(log: DataFrame, key: str) -> DataFrame:
    """(step, value) of the entries that have the key."""
    return log.filter(F.col(key).isNotNull()).select("step", F.col(key).alias("value"))


def case_manifest(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """(case_id, source, target): one row for each target of each case, of files that are one document or one a line."""
    raw = spark.read.schema("cases array<struct<case_id:string,source:string,targets:array<string>>>").option("multiLine", one_document).json(path)
    return raw.select(F.explode("cases").alias("c")).select("c.case_id", "c.source", F.explode("c.targets").alias("target"))


def stored_defects(spark: SparkSession, path: str, summary: str, cases: str) -> tuple[DataFrame, DataFrame]:
    """(summary, cases) of a folder of write_defects, with their schemas."""
    return spark.read.schema(summary).json(f"{path}/summary.json"), jsonl(spark, f"{path}/cases", cases)


def named_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(name, fields...) of a folder of write_named."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("name", F.from_json("value", schema).alias("r")).select("name", "r.*")
