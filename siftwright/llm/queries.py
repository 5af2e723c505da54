"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import collocations, lexical, mixing, perspectives, urlrules
from siftwright.llm.common import read_documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.toxicity import THRESHOLD, fit, labelled_sample, score_documents

    docs, labels = read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    network = fit(*labelled_sample(docs.filter(~held_out), labels))
    scored = score_documents(docs, network)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.langid import detect_languages, fit_filters

    docs = read_documents(spark, sf_dir)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    filters = fit_filters(docs.filter(~held_out))
    return detect_languages(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.tokencount import count_with_edits

    n = F.length("text")
    edit = lambda start, end, text: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(text).alias("text"))
    middle, quarter = F.floor(n / 2), F.floor(n / 4)
    edits = F.array(edit(middle, middle + 16, "edited 2024 text"), edit(quarter, quarter, " an inserted remark, "), edit(n - F.floor(n / 8), n, ""))
    return count_with_edits(read_documents(spark, sf_dir), edits)


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.simhash import simhash_components

    return simhash_components(read_documents(spark, sf_dir))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.repeats import repeat_digests

    return repeat_digests(read_documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.mixing import mix_sources

    return mix_sources(read_documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.secrets import example_findings, scan_secrets, train_forest

    return scan_secrets(read_documents(spark, sf_dir), train_forest(example_findings(spark)))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.perspectives import rotate_perspectives

    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.telephony import audio_digests

    return audio_digests(read_documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.decontaminate import contaminated

    return contaminated(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.lexical import rank_documents

    return rank_documents(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, verdict string")
    return urlrules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwright.llm.collocations import mine_collocations

    return mine_collocations(read_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op11_lexical_search, op12_url_rules, op13_collocations, op1_toxicity, op2_language_id, op3_secret_scan, op4_chat_perspectives, op5_token_counts, op6_simhash_neardup, op7_telephony_audio, op8_decontaminate, op9_suffix_repeats, op10_mix_sources)
}
ORACLE_SQL: dict[str, str] = {"op4_chat_perspectives": perspectives.ORACLE, "op10_mix_sources": mixing.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_url_rules": urlrules.ORACLE, "op13_collocations": collocations.ORACLE}
