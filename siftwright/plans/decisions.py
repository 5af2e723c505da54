"""Queries of the decision layer over metrics that the tables give: gates, ranking, scoreboards, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.operators import config, decide
from siftwright.plans.base import Catalog, table, values

CATALOG = Catalog()
query = CATALOG.query

#: The gate's cells in order; documents stand for measurements of the cell that their number gives.
PLAN = [
    *[("leak", d, "max", True, K.LEAK_TOLERANCE, None) for d in decide.LEAK_NAMES], *[("comet", d, "min", True, 0.0, K.SCORE_BAND) for d in decide.NAMES],
    *[(g, lang, "min", True, -K.BENCH_TOLERANCE, None) for g in ("belebele", "knowledge") for lang in decide.LANGS],
    *[("doc_tail", d, "min", False, K.TAIL_MIN, None) for d in decide.NAMES], *[("doc_truncated", d, "max", False, K.TRUNCATED_MAX, None) for d in decide.NAMES],
    ("mere_translation", "all", "max", False, K.MERE_TRANSLATION_MAX, None),
]
CELLS = [(i, g, d) for i, (g, d, *_) in enumerate(PLAN)]
N = len(CELLS)
TAGS = "CASE doc_id // 40 % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'cand' ELSE 'small' END"
GATE_SQL = f"""
WITH cells AS (SELECT * FROM {values(CELLS, 'ord, grp, item')}),
-- of one in nine cells the candidate has no measurement
m AS (SELECT {TAGS} AS tag, grp, item, round(avg(n_chars % 8), 1) AS value FROM documents JOIN cells ON ord = doc_id % 40 WHERE NOT (ord % 9 = 4 AND doc_id // 40 % 3 = 1) GROUP BY ALL),
ci AS (SELECT item AS direction, sum(n_chars) % 2 = 0 AS crosses_zero FROM documents JOIN cells ON ord = doc_id % 40 AND grp = 'comet' GROUP BY item HAVING sum(n_chars) % 5 <> 0),
plan AS (SELECT * FROM {values(PLAN, 'grp, item, mode, relative, off, band')}),
j AS (SELECT p.*, c.value AS cand, CASE WHEN relative THEN b.value + off ELSE off END AS bound, ci.crosses_zero FROM plan p
  LEFT JOIN m c ON c.tag = 'cand' AND c.grp = p.grp AND c.item = p.item
  LEFT JOIN m b ON b.tag = CASE WHEN p.grp IN ('belebele', 'knowledge') THEN 'small' ELSE 'base' END AND b.grp = p.grp AND b.item = p.item
  LEFT JOIN ci ON ci.direction = p.item AND p.grp = 'comet'),
v AS (SELECT grp, item, CASE WHEN cand IS NULL OR bound IS NULL THEN 'MISSING' WHEN mode = 'max' THEN CASE WHEN cand <= bound THEN 'PASS' ELSE 'FAIL' END WHEN cand >= bound THEN 'PASS'
  WHEN band IS NOT NULL AND cand >= bound - band THEN CASE WHEN crosses_zero IS NULL THEN 'MISSING' WHEN crosses_zero THEN 'PASS' ELSE 'FAIL' END ELSE 'FAIL' END AS verdict FROM j)
"""


def _gate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.createDataFrame(CELLS, "ord int, grp string, item string")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(cells), F.col("ord") == F.col("doc_id") % 40)
    turn = F.floor(F.col("doc_id") / 40) % 3
    measured = docs.filter(~((F.col("ord") % 9 == 4) & (turn == 1))).groupBy(F.when(turn == 0, "base").when(turn == 1, "cand").otherwise("small").alias("tag"), "grp", "item").agg(F.round(F.avg(F.col("n_chars") % 8), 1).alias("value"))
    sums = docs.filter("grp = 'comet'").groupBy("item").agg(F.sum("n_chars").alias("s")).filter("s % 5 <> 0")
    intervals = sums.select(F.lit("base").alias("a"), F.lit("cand").alias("b"), F.col("item").alias("direction"), F.lit(0.0).alias("ci_lo"), F.lit(0.0).alias("ci_hi"), (F.col("s") % 2 == 0).alias("crosses_zero"))
    return decide.gate(measured, intervals, "cand", "base", "small")


@query(GATE_SQL + "SELECT * FROM v")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every gate cell."""
    return _gate_cells(spark, sf_dir).select("grp", "item", "verdict")


@query(GATE_SQL + "SELECT count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE verdict = 'FAIL') AS n_fail, count(*) FILTER (WHERE verdict = 'MISSING') AS n_missing, CASE WHEN count(*) FILTER (WHERE verdict = 'FAIL') > 0 THEN 1 WHEN count(*) FILTER (WHERE verdict = 'MISSING') > 0 THEN 2 ELSE 0 END AS status FROM v")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of verdicts and the exit status."""
    return decide.gate_status(_gate_cells(spark, sf_dir))


WAYS = "CASE lang WHEN 'en' THEN 'en->zhtw' WHEN 'fr' THEN 'ja->zhtw' ELSE 'ja->en' END"


@query(f"""
WITH d AS (SELECT CASE WHEN source = 'src0' THEN 'baseline_ship' ELSE source END AS id, {WAYS} AS direction, n_chars FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
c AS (SELECT id, max(n_chars) % 7 = 0 AS loop_flag FROM d GROUP BY id),
m AS (SELECT id, direction, round(30 + avg(n_chars % 5), 2) AS chrf, CASE WHEN direction LIKE '%->zhtw' THEN round(avg(n_chars % 3) / 2, 2) END AS leak FROM d GROUP BY id, direction),
j AS (SELECT m.*, b.chrf AS bc, b.leak AS bl FROM m LEFT JOIN m b ON b.id = 'baseline_ship' AND b.direction = m.direction),
s AS (SELECT id, avg(chrf) AS mean, coalesce(max(leak) FILTER (WHERE direction LIKE '%->zhtw'), 0.0) AS max_leak,
  bool_or(coalesce(direction LIKE '%->zhtw' AND leak > bl + 0.3, FALSE)) OR bool_or(coalesce(chrf < bc - 1.5, FALSE)) AS bad FROM j GROUP BY id),
e AS (SELECT c.id, NOT coalesce(loop_flag, FALSE) AND NOT bad AS ok, mean, max_leak FROM c JOIN s USING (id))
SELECT id, ok, round(mean, 6) AS mean, max_leak, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY round(mean, 4) DESC, max_leak, (id = 'baseline_ship')::INT DESC, id DESC) END AS place FROM e
""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as candidates of a search: which meet the constraints of the first, in order."""
    direction = F.when(F.col("lang") == "en", "en->zhtw").when(F.col("lang") == "fr", "ja->zhtw").otherwise("ja->en")
    docs = table(spark, sf_dir, "documents").filter("source is not null and lang is not null").select(F.when(F.col("source") == "src0", "baseline_ship").otherwise(F.col("source")).alias("id"), direction.alias("direction"), "n_chars")
    cells = docs.groupBy("id").agg((F.max("n_chars") % 7 == 0).alias("loop_flag"))
    leak = F.when(F.col("direction").endswith("->zhtw"), F.round(F.avg(F.col("n_chars") % 3) / 2, 2)).alias("leak")
    found = docs.groupBy("id", "direction").agg(F.round(30 + F.avg(F.col("n_chars") % 5), 2).alias("chrf"), leak)
    return decide.rank_candidates(cells, found).select("id", "ok", F.round("mean", 6).alias("mean"), "max_leak", "place")


BENCH = f"({list(K.BENCHES)})[CAST(doc_id % {len(K.BENCHES) + 1} + 1 AS INT)]"
BOARD = f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS tag, {BENCH} AS bench, {WAYS} AS direction, 'comet' AS metric, round(avg(n_chars % 50), 1) AS value FROM documents WHERE doc_id % {len(K.BENCHES) + 1} < {len(K.BENCHES)} GROUP BY ALL"


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    benches = F.array(*map(F.lit, K.BENCHES))
    direction = F.when(F.col("lang") == "en", "en->zhtw").when(F.col("lang") == "fr", "ja->zhtw").otherwise("ja->en")
    docs = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % (len(K.BENCHES) + 1)).filter(F.col("k") < len(K.BENCHES))
    return docs.groupBy(F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("tag"), F.element_at(benches, (F.col("k") + 1).cast("int")).alias("bench"), direction.alias("direction"), F.lit("comet").alias("metric")).agg(F.round(F.avg(F.col("n_chars") % 50), 1).alias("value"))


@query(f"""
WITH m AS ({BOARD}), d AS (SELECT direction, bench, max(value) FILTER (WHERE tag = 'new') - max(value) FILTER (WHERE tag = 'old') AS v FROM m GROUP BY ALL)
SELECT direction, {', '.join(f"round(max(v) FILTER (WHERE bench = '{b}'), 6) AS {b}" for b in K.BENCHES)} FROM d GROUP BY direction
""")
def scoreboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two tags by direction and benchmark."""
    board = decide.scoreboard(_board(spark, sf_dir), "comet", ["old", "new"])
    return board.select("direction", *[F.round(b, 6).alias(b) for b in K.BENCHES])


@query(f"WITH m AS ({BOARD}) SELECT DISTINCT bench, direction, bench IN {tuple(K.SIMPLIFIED_BENCHES)} AND direction LIKE '%->zhtw' AS secondary FROM m")
def secondary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose references are converted."""
    return _board(spark, sf_dir).select("bench", "direction", decide.secondary_cell(F.col("bench"), F.col("direction")).alias("secondary")).distinct()


@query("""
WITH r AS (SELECT 's' || conv_id % 7 AS strategy, min(conv_id % 7)::INT AS ord, bool_and(NOT (length(text) % 13 = 0) OR NOT (turn % 3 = 0)) AS passed FROM conversations GROUP BY conv_id % 7)
SELECT strategy, passed, passed AND row_number() OVER (PARTITION BY passed ORDER BY ord) = 1 AS recommended FROM r
""")
def strategy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs of seven strategies: those whose critical turns do not loop, and the first of them."""
    group = F.col("conv_id") % 7
    runs = table(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), group.cast("string")).alias("strategy"), group.cast("int").alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("case_id"), (F.col("turn") % 3 == 0).alias("critical"), (F.length("text") % 13 == 0).alias("loop_flag"))
    return decide.strategy_verdicts(runs)


@query("""
WITH s AS (SELECT source, count(*) AS n, sum(n_chars) AS c FROM documents WHERE source IS NOT NULL GROUP BY source),
most AS (SELECT source, n FROM s ORDER BY n DESC, source LIMIT 1), longest AS (SELECT source, n FROM s ORDER BY c DESC, source LIMIT 1)
SELECT (SELECT source FROM most) = (SELECT source FROM longest) AND (SELECT n % 8 FROM most) = (SELECT n % 8 FROM longest) AS same
""")
def winner_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the source with most documents, as shipped settings, is the one with most text; a null penalty is 1.0."""
    by_source = table(spark, sf_dir, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    first = lambda order, penalty: by_source.orderBy(F.desc(order), "source").limit(1).select(F.col("source").alias("decode"), (F.col("n") % 8).cast("int").alias("beams"), F.lit(penalty).cast("double").alias("length_penalty"))
    return decide.winner_matches(first("n", 1.0), first("c", None))


#: Languages of the tables and the target languages whose settings they get.
TARGETS = {"en": "en", "fr": "ja", "de": "zhtw"}
GRID = [(name, beams, penalty, lang, changed.get(lang, config.DECODE[lang]).get(config.PENALTY)) for name, beams, penalty, changed in config.GRID for lang in config.DECODE]


@query(f"""
WITH g AS (SELECT * FROM {values(GRID, 'id, beams, length_penalty, lang, repetition')}), d AS (SELECT CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'ja' WHEN 'de' THEN 'zhtw' END AS lang, n_chars FROM documents)
SELECT id, lang, count(*) AS n, max(beams)::DOUBLE AS num_beams, max(CASE WHEN n_chars > 4000 THEN 6.0 ELSE 5.0 END)::DOUBLE AS grams, max(CASE WHEN beams > 1 THEN length_penalty END)::DOUBLE AS length_penalty, max(repetition)::DOUBLE AS repetition FROM d JOIN g USING (lang) GROUP BY id, lang
""")
def decode_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings that the documents of each language get under every candidate, with a run's override for long ones."""
    grid = config.search_grid(spark)
    resolve = lambda n: config.resolved_options(grid, {"no_repeat_ngram_size": n}).select("id", "lang", F.lit(n).alias("size"), "options")
    target = F.when(F.col("lang") == "en", "en").when(F.col("lang") == "fr", "ja").when(F.col("lang") == "de", "zhtw")
    docs = table(spark, sf_dir, "documents").select(target.alias("lang"), F.when(F.col("n_chars") > 4000, 6).otherwise(5).alias("size"))
    each = docs.join(F.broadcast(resolve(5).unionByName(resolve(6))), ["lang", "size"])
    value = lambda k: F.max(F.try_element_at("options", F.lit(k)))
    return each.groupBy("id", "lang").agg(F.count("*").alias("n"), value("num_beams").alias("num_beams"), value("no_repeat_ngram_size").alias("grams"), value("length_penalty").alias("length_penalty"), value("repetition_penalty").alias("repetition"))


ARCHIVED = [(i, a[0], a[2]) for i, a in enumerate(config.ARCHIVES)]


@query(f"SELECT corpus, count(*) AS n, count(DISTINCT pair) AS pairs, sum(n_chars)::BIGINT AS chars FROM documents JOIN {values(ARCHIVED, 'k, corpus, pair')} ON k = CAST(replace(source, 'src', '') AS INT) GROUP BY corpus")
def archive_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as archives of the registry: documents, pairs and characters of each corpus."""
    numbered = spark.createDataFrame([(i, a[3]) for i, a in enumerate(config.ARCHIVES)], "k int, file string")
    registry = config.archives(spark).join(numbered, "file")
    docs = table(spark, sf_dir, "documents").select(F.replace("source", F.lit("src"), F.lit("")).cast("int").alias("k"), "n_chars")
    return docs.join(F.broadcast(registry), "k").groupBy("corpus").agg(F.count("*").alias("n"), F.countDistinct("pair").alias("pairs"), F.sum("n_chars").alias("chars"))
