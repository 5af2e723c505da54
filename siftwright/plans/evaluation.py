"""Queries of detectors, audits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import text as T
from siftwright.operators import curate, detect, metrics, replay
from siftwright.plans.base import Catalog, h32_sql, table
from siftwright.plans.corpus import PAIRS

CATALOG = Catalog()
query = CATALOG.query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("prompt").alias("src"), F.col("reply").alias("tgt"))


@query(f"""
WITH p AS (SELECT conv_id, turn, prompt AS src, reply AS tgt FROM ({PAIRS})), y AS (SELECT *, regexp_extract_all(tgt, '(?:1[89]|20)[0-9]{{2}}') AS yt, regexp_extract_all(src, '(?:1[89]|20)[0-9]{{2}}') AS ys FROM p)
SELECT conv_id, turn FROM y WHERE len(list_filter(yt, lambda x: NOT list_contains(ys, x))) > 0
""")
def ghost_year_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn pairs with such years."""
    return _pairs(spark, sf_dir).filter(F.size(detect.ghost_years(F.col("src"), F.col("tgt"))) > 0).select("conv_id", "turn")


@query(f"SELECT conv_id, turn FROM ({PAIRS}) WHERE contains(trim(prompt, ' ' || chr(10)), chr(10)) AND NOT contains(trim(reply, ' ' || chr(10)), chr(10))")
def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose many-line prompt has a reply of one line."""
    return _pairs(spark, sf_dir).filter(detect.lines_flattened(F.col("src"), F.col("tgt"))).select("conv_id", "turn")


@query("""
WITH g AS (SELECT doc_id, n_chars, unnest(range(1, greatest(length(text) - 19, 0) + 1)) AS i, text FROM documents WHERE n_chars >= 12),
w AS (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, substr(text, i, 20) AS s, count(*) AS c FROM g GROUP BY ALL) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
u AS (SELECT doc_id, count(DISTINCT line) / count(*) AS ratio FROM l WHERE trim(line) <> '' GROUP BY doc_id)
SELECT d.doc_id, d.n_chars AS chars, CASE WHEN d.n_chars < 12 THEN 0 ELSE coalesce(w.m, 0) END AS window20, round(CASE WHEN d.n_chars < 12 THEN 1.0 ELSE coalesce(u.ratio, 0) END, 6) AS unique_lines
FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN u USING (doc_id)
""")
def loop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window counts and line shares of every document; all inside the row, nothing is shuffled."""
    s = detect.loop_stats(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.col("s.chars").cast("long").alias("chars"), F.col("s.max_window20_count").cast("long").alias("window20"), F.round("s.unique_line_ratio", 6).alias("unique_lines"))


@query("""
WITH g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(text) - 7, 0) + 1), lambda i: substr(text, i, 8))) AS s FROM documents),
r AS (SELECT doc_id, 1 - count(DISTINCT s) / count(*) AS ratio FROM g GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(r.ratio, 0), 6) AS ratio FROM documents d LEFT JOIN r USING (doc_id)
""")
def repeat_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of repeated 8-grams of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(detect.repeat_ratio(F.col("text")), 6).alias("ratio"))


@query(f"""
WITH p AS (SELECT string_split(prompt, chr(10)) AS r, string_split(reply, chr(10)) AS h FROM ({PAIRS})),
v AS (SELECT len(h) / len(r) AS l, CASE WHEN len(r) >= 3 AND length(array_to_string(r[2 * len(r) // 3 + 1 :], '')) > 0
  THEN length(array_to_string(h[2 * len(r) // 3 + 1 :], '')) / length(array_to_string(r[2 * len(r) // 3 + 1 :], '')) END AS t FROM p)
SELECT round(list_sort(list(l))[len(list(l)) // 2 + 1], 6) AS line_ratio, round(list_sort(list(t) FILTER (WHERE t IS NOT NULL))[count(t) // 2 + 1], 6) AS tail_ratio FROM v
""")
def alignment_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians of line ratio and tail ratio of replies beside prompts."""
    out = metrics.document_alignment(_pairs(spark, sf_dir), hyp="tgt", ref="src")
    return out.select(F.round("line_ratio_median", 6).alias("line_ratio"), F.round("tail_ratio_median", 6).alias("tail_ratio"))


@query(f"""
WITH p AS (SELECT length(reply) / greatest(length(prompt), 1) AS x FROM ({PAIRS}))
SELECT round(list_sort(list(x))[count(*) // 2 + 1], 6) AS completeness, round(100.0 * avg((x < 0.5)::INT), 6) AS truncated, round(100.0 * avg((x > 2.0)::INT), 6) AS bloated FROM p
""")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of replies beside prompts."""
    rows = _pairs(spark, sf_dir)
    out = metrics.document_scores(rows, detect.repeat_ratio(F.col("tgt")), hyp="tgt", ref="src")
    return out.select(F.round("completeness_median", 6).alias("completeness"), F.round("truncated_pct", 6).alias("truncated"), F.round("bloated_pct", 6).alias("bloated"))


PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


@query(f"""
WITH p AS (SELECT row_number() OVER () AS id, reply AS h, prompt AS r FROM ({PAIRS})),
side AS (SELECT id, 'h' AS side, h AS t FROM p UNION ALL SELECT id, 'r', r FROM p),
chars AS (SELECT id, side, regexp_replace(t, '\\s+', '', 'g') AS c FROM side),
cg AS (SELECT id, side, 'c' AS kind, n, substr(c, i, n) AS g FROM (SELECT *, unnest(range(1, greatest(length(c) - n + 1, 0) + 1)) AS i FROM (SELECT *, unnest(range(1, 7)) AS n FROM chars))),
ws AS (SELECT id, side, list_filter(string_split_regex(trim(t), '\\s+'), lambda x: x <> '') AS w FROM side),
sp AS (SELECT id, side, flatten(list_transform(w, lambda x: CASE WHEN length(x) = 1 THEN [x] WHEN regexp_matches(right(x, 1), '{PUNCT}') THEN [left(x, length(x) - 1), right(x, 1)] WHEN regexp_matches(left(x, 1), '{PUNCT}') THEN [left(x, 1), substr(x, 2)] ELSE [x] END)) AS w FROM ws),
wg AS (SELECT id, side, 'w' AS kind, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM (SELECT *, unnest(range(1, 3)) AS n FROM sp))),
counts AS (SELECT id, kind, n, g, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr FROM (SELECT * FROM cg UNION ALL SELECT * FROM wg) GROUP BY ALL),
tot AS (SELECT kind, n, sum(least(ch, cr)) AS m, sum(ch) AS h, sum(cr) AS r FROM counts GROUP BY ALL),
f AS (SELECT avg(m / h) FILTER (WHERE h > 0 AND r > 0) AS p, avg(m / r) FILTER (WHERE h > 0 AND r > 0) AS r FROM tot)
SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM f
""")
def chrf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrF++ of replies beside prompts."""
    return metrics.chrf(_pairs(spark, sf_dir), hyp="tgt", ref="src").select(F.round("chrf", 6).alias("chrf"))


@query(f"""
WITH p AS (SELECT row_number() OVER () AS id, list_filter(string_split_regex(trim(reply), '\\s+'), lambda x: x <> '') AS h, list_filter(string_split_regex(trim(prompt), '\\s+'), lambda x: x <> '') AS r FROM ({PAIRS})),
side AS (SELECT id, 'h' AS side, h AS w FROM p UNION ALL SELECT id, 'r', r FROM p),
g AS (SELECT id, side, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM (SELECT *, unnest(range(1, 5)) AS n FROM side))),
counts AS (SELECT id, n, g, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr FROM g GROUP BY ALL),
t AS (SELECT n, sum(least(ch, cr)) AS m, sum(ch) AS h, sum(cr) AS r FROM counts GROUP BY n),
z AS (SELECT *, sum((m = 0)::INT) OVER (ORDER BY n) AS zeros FROM t),
b AS (SELECT avg(CASE WHEN m = 0 THEN -ln(pow(2, zeros) * h) ELSE ln(m / h) END) AS l, max(h) FILTER (WHERE n = 1) AS h1, max(r) FILTER (WHERE n = 1) AS r1 FROM z)
SELECT round(100 * CASE WHEN h1 >= r1 THEN 1.0 ELSE exp(1 - r1 / h1) END * exp(l), 6) AS bleu FROM b
""")
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of replies beside prompts over blank-separated tokens."""
    rows = _pairs(spark, sf_dir)
    tokens = lambda c: F.filter(F.split(T.strip(F.col(c)), r"(?U)\s+"), lambda w: w != "")
    return metrics.bleu(rows.select(tokens("tgt").alias("hyp_tokens"), tokens("src").alias("ref_tokens"))).select(F.round("bleu", 6).alias("bleu"))


@query(f"""
WITH s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, (quality - {h32_sql("'b'", 'doc_id')} % 1000 / 1000.0) / 10 AS diff FROM labels),
n AS (SELECT count(*) AS n FROM s),
d AS (SELECT r, k, {h32_sql('42', 'r', 'k')} % n AS i, n FROM (SELECT unnest(range(200)) AS r), (SELECT n, unnest(range(n)) AS k FROM n)),
m AS (SELECT r, sum(diff) / max(n) * 100 AS d FROM d JOIN s USING (i) GROUP BY r)
SELECT (SELECT n FROM n) AS n, round((SELECT avg(diff) * 100 FROM s), 6) AS delta, round(list_sort(list(d))[6], 6) AS ci_lo, round(list_sort(list(d))[196], 6) AS ci_hi, avg((d > 0)::INT) AS p_b_better, list_sort(list(d))[6] <= 0 AND list_sort(list(d))[196] >= 0 AS crosses_zero FROM m
""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap over differences made from labels."""
    labels = curate.ranks(table(spark, sf_dir, "labels"), F.col("doc_id"), F.floor(F.col("doc_id") / 1024))
    diffs = labels.select((F.col("rn") - 1).alias("i"), ((F.col("quality") - F.pmod(T.h32("b", F.col("doc_id")), F.lit(1000)) / 1000.0) / 10).alias("diff"))
    out = metrics.paired_bootstrap(diffs, 200)
    return out.select("n", F.round("delta", 6).alias("delta"), F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"), "p_b_better", "crosses_zero")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS passed, round(100.0 * avg(quality), 6) AS pct FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rate by language and in all."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.accuracy(rows, "lang", F.col("quality") == 1).withColumn("pct", F.round("pct", 6))


@query("""
WITH s AS (SELECT n_chars AS x, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT max(n) AS n, round(avg(x), 6) AS mean, max(x) FILTER (WHERE k = n // 2) AS p50, max(x) FILTER (WHERE k = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(x) AS longest FROM s
""")
def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional quantiles of document lengths."""
    return metrics.length_statistics(table(spark, sf_dir, "documents"), F.col("n_chars")).select("n", F.round("mean", 6).alias("mean"), "p50", "p95", "longest")


@query(f"""
WITH h AS (SELECT unnest(['f16', 'q8', 'q4']) AS system, conv_id, turn, reply FROM ({PAIRS})),
o AS (SELECT system, conv_id, turn, CASE WHEN system = 'q8' AND turn % 4 = 0 THEN '' WHEN system = 'q4' AND conv_id % 2 = 0 THEN upper(reply) ELSE reply END AS hyp FROM h)
SELECT a.system, count(*) AS n, count(*) FILTER (WHERE trim(a.hyp) = '') AS empty, round(100.0 * avg((a.hyp = b.hyp)::INT), 6) AS same_pct FROM o a JOIN o b ON b.system = 'f16' AND a.conv_id = b.conv_id AND a.turn = b.turn GROUP BY a.system
""")
def quant_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of systems beside those of a base system."""
    rows = _pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("seg_id"), "conv_id", "turn", "tgt", F.explode(F.array(*map(F.lit, ("f16", "q8", "q4")))).alias("system"))
    hyp = F.when((F.col("system") == "q8") & (F.col("turn") % 4 == 0), "").when((F.col("system") == "q4") & (F.col("conv_id") % 2 == 0), F.upper("tgt")).otherwise(F.col("tgt"))
    out = metrics.against_reference_system(rows.withColumn("hyp", hyp), "f16")
    return out.select("system", "n", "empty", F.round("same_pct", 6).alias("same_pct"))


@query(f"""SELECT CAST(conv_id % 3 AS BIGINT) AS variant, count(*) AS n, round(median(length(reply) / greatest(length(prompt), 1)), 6) AS median_ratio, count(*) FILTER (WHERE length(reply) / greatest(length(prompt), 1) < 0.75) AS n_short FROM ({PAIRS}) GROUP BY ALL""")
def instruction_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length ratios of each variant."""
    out = metrics.length_ratio_probe(_pairs(spark, sf_dir).withColumn("variant", F.col("conv_id") % 3), "variant", hyp="tgt", ref="src")
    return out.withColumn("median_ratio", F.round("median_ratio", 6))


@query("SELECT label, count(*) AS n, round(median(s), 6) AS median_score, round(avg((s < 0.6)::INT), 6) AS under_60, round(avg((s < 0.7)::INT), 6) AS under_70 FROM (SELECT label, embedding[1]::DOUBLE / 2 + 0.6 AS s FROM embeddings) GROUP BY label")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and shares under two bounds, by label."""
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("embedding")[0].cast("double") / 2 + 0.6).alias("score"))
    out = metrics.score_summary(rows, "label")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("median_score", "under_60", "under_70")])


@query("SELECT event_type, count(*) FILTER (WHERE json_exists(props, '$.k')) AS n FROM events GROUP BY event_type")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties have a key."""
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    ok = F.size(F.array_except(F.array(F.lit("k")), keys)) == 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(ok & keys.isNotNull()).alias("n"))


@query("SELECT l.quality, count(*) AS n, round(avg(d.n_chars / 1000.0) * 100, 6) AS system_score FROM labels l JOIN documents d USING (doc_id) GROUP BY l.quality")
def system_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of segment scores (made from lengths) by group."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("score")), "doc_id")
    return metrics.system_scores(rows, "quality").withColumn("system_score", F.round("system_score", 6))


@query("SELECT doc_id AS seg_id, lang = 'en' AS same FROM documents WHERE upper(lang) <> ''")
def same_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two runs gave the same text; the second changes what is not English."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seg_id"), F.col("text").alias("hyp"), "lang")
    b = a.withColumn("hyp", F.when(F.col("lang") == "en", F.col("hyp")).otherwise(F.concat("hyp", F.lit("!"))))
    return metrics.same_outputs(a, b)
