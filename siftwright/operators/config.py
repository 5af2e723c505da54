"""Run configuration as tables: archives to fetch, decode settings by target language, the grid of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: archives as (corpus, version, pair in the archive, file made of it) ---
ARCHIVES = (
    ("TED2020", "v1", "en-zh_tw", "ted2020.en-zhtw.tsv"), ("TED2020", "v1", "ja-zh_tw", "ted2020.ja-zhtw.tsv"), ("OpenSubtitles", "v2018", "ja-zh_tw", "opensub.ja-zhtw.tsv"), ("WikiMatrix", "v1", "ja-zh", "wikimatrix.ja-zh.tsv"),
    ("WikiMatrix", "v1", "en-ja", "wikimatrix.en-ja.tsv"), ("TED2020", "v1", "en-ja", "ted2020.en-ja.tsv"), ("Tatoeba", "v2023-04-12", "en-ja", "tatoeba.en-ja.tsv"), ("News-Commentary", "v16", "en-ja", "newscomm.en-ja.tsv"),
    ("News-Commentary", "v16", "ja-zh", "newscomm.ja-zh.tsv"), ("GlobalVoices", "v2018q4", "en-zht", "globalvoices.en-zhtw.tsv"), ("GlobalVoices", "v2018q4", "jp-zht", "globalvoices.ja-zhtw.tsv"), ("KDE4", "v2", "en-zh_TW", "kde4.en-zhtw.tsv"),
    ("KDE4", "v2", "ja-zh_TW", "kde4.ja-zhtw.tsv"), ("KFTT", "v1.0", "en-ja", "kftt.en-ja.tsv"), ("OpenSubtitles", "v2024", "en-ja", "opensub.en-ja.tsv"), ("OpenSubtitles", "v2018", "en-zh_tw", "opensub.en-zhtw.tsv"),
)
# --- Fixed values: shipped decode settings ---
PENALTY, GRAM = "repetition_penalty", "no_repeat_ngram_size"
DECODE = {"ja": {PENALTY: 1.1, GRAM: 4.0}, "en": {PENALTY: 1.1, GRAM: 4.0}, "zhtw": {GRAM: 4.0}}
BEAMS, LENGTH_PENALTY = 4, 1.2
#: Candidates of a search: (id, beams, length penalty, what they set in place of the shipped settings). Fixed values.
GRID = (
    ("baseline_ship", 4, 1.2, {}),
    ("greedy_ship_decode", 1, None, {}),
    ("b4_nrng0", 4, 1.2, {"ja": {PENALTY: 1.1}, "en": {PENALTY: 1.1}, "zhtw": {}}),
    ("b4_en_nrng0", 4, 1.2, {"en": {PENALTY: 1.1}}),
    ("b4_all_nrng3", 4, 1.2, {"ja": {PENALTY: 1.1, GRAM: 3.0}, "en": {PENALTY: 1.1, GRAM: 3.0}, "zhtw": {GRAM: 3.0}}),
    ("b4_all_nrng6", 4, 1.2, {"ja": {PENALTY: 1.1, GRAM: 6.0}, "en": {PENALTY: 1.1, GRAM: 6.0}, "zhtw": {GRAM: 6.0}}),
    ("b4_rep1.0", 4, 1.2, {"ja": {GRAM: 4.0}, "en": {GRAM: 4.0}, "zhtw": {GRAM: 4.0}}),
    ("b4_en_nrng3", 4, 1.2, {"en": {PENALTY: 1.1, GRAM: 3.0}}),
    ("b4_lp1.0", 4, 1.0, {}),
    ("b2_ship_decode", 2, 1.2, {}),
)


def archives(spark: SparkSession) -> DataFrame:
    """(corpus, version, pair, lang_a, lang_b, file): what there is to fetch."""
    rows = spark.createDataFrame(list(ARCHIVES), "corpus string, version string, pair string, file string")
    return rows.select("corpus", "version", "pair", F.substring_index("pair", "-", 1).alias("lang_a"), F.substring_index("pair", "-", -1).alias("lang_b"), "file")


def search_grid(spark: SparkSession) -> DataFrame:
    """(id, beams, length_penalty, lang, decode map): every candidate's settings for each target language."""
    rows = [(name, beams, penalty, lang, changed.get(lang, DECODE[lang])) for name, beams, penalty, changed in GRID for lang in DECODE]
    return spark.createDataFrame(rows, "id string, beams int, length_penalty double, lang string, decode map<string,double>")


def resolved_options(grid: DataFrame, override: dict[str, float] | None = None) -> DataFrame:
    """grid with `options`: the decode map, a run's overrides, and beams with their length penalty; the last of a name wins."""
    own = F.create_map(*[x for k, v in (override or {}).items() for x in (F.lit(k), F.lit(float(v)))]).cast("map<string,double>")
    penalty = F.when((F.col("beams") > 1) & F.col("length_penalty").isNotNull(), F.create_map(F.lit("length_penalty"), F.col("length_penalty"))).otherwise(F.create_map().cast("map<string,double>"))
    parts = (F.col("decode"), own, F.create_map(F.lit("num_beams"), F.col("beams").cast("double")), penalty)
    merged = parts[0]
    for part in parts[1:]:
        merged = F.map_concat(_without_keys(merged, part), part)
    return grid.withColumn("options", merged)


def _without_keys(left, right):
    return F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
