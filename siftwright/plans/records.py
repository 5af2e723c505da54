"""Queries of record selection, audit samples, tokenised BLEU and report documents, over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.operators import convert, curate, detect, metrics, replay
from siftwright.plans.base import Catalog, literal, table
from siftwright.plans.corpus import PAIRS
from siftwright.sources import writers

CATALOG = Catalog()
query = CATALOG.query

#: Simplified characters and their traditional forms, a small dictionary for the queries.
FORMS = {"国": "國", "马": "馬", "龙": "龍"}
#: The tables hold no Han, so the queries put some in by row number.
MARKED = "CASE turn % 3 WHEN 0 THEN '國家 ' || text WHEN 1 THEN '国家 ' || text ELSE text END"


def _simplified(text: Column) -> Column:
    return convert.changed_by(convert.converter(FORMS))(text)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "prompt", "reply")


@query(f"""
WITH t AS (SELECT conv_id, turn, {MARKED} AS t FROM conversations)
SELECT conv_id, turn, length(t) BETWEEN 5 AND 4000 AND regexp_matches(t, '[一-鿿]') AND NOT regexp_matches(t, '[国马龙]') AS usable FROM t
""")
def usable_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages could be used as translated replies."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(MARKED).alias("t"))
    return rows.select("conv_id", "turn", replay.usable(F.col("t"), _simplified).alias("usable"))


@query(f"""
WITH p AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '國' || prompt ELSE prompt END AS prompt, CASE WHEN conv_id % 5 = 0 THEN reply || '國' ELSE reply END AS reply FROM ({PAIRS}))
SELECT conv_id, turn, length(reply) AS n FROM p WHERE NOT regexp_matches(prompt, '[一-鿿]') AND NOT regexp_matches(reply, '[一-鿿]') AND length(reply) <= 1200 ORDER BY conv_id, turn LIMIT 1000
""")
def english_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand records without Han whose reply is not too long."""
    p = _pairs(spark, sf_dir)
    p = p.withColumn("prompt", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("國"), "prompt")).otherwise(F.col("prompt"))).withColumn("reply", F.when(F.col("conv_id") % 5 == 0, F.concat("reply", F.lit("國"))).otherwise(F.col("reply")))
    return replay.english_only(p, "conv_id", "turn", most=1000).select("conv_id", "turn", F.length("reply").cast("long").alias("n"))


@query("""
WITH w AS (SELECT lang, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE n <= 1408) AS kept, count(*) FILTER (WHERE n > 1408) AS dropped FROM w GROUP BY lang
""")
def fitting_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents fit into the longest record, by words; none is cut."""
    return curate.fitting_counts(table(spark, sf_dir, "documents"), F.regexp_count("text", F.lit(r"[^ \t\n\r]+")), "lang")


@query("SELECT doc_id, CASE WHEN contains(d, '2') THEN substr(d, strpos(d, '2') + 1) END AS target FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang ELSE lang || '2' || source || doc_id END AS d FROM documents)")
def direction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of directions made from language and source."""
    d = F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.concat("lang", F.lit("2"), "source", F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", detect.target_of(d).alias("target"))


YEARS = "(?:1[89]|20)[0-9]{2}"
#: Hits of the two patterns that SQL can express, for pairs (k, s, t).
HITS = f"""SELECT *, 'D/多行壓扁' AS hit FROM p WHERE contains(trim(s, ' ' || chr(10)), chr(10)) AND NOT contains(trim(t, ' ' || chr(10)), chr(10))
  UNION ALL SELECT *, 'C/憑空年份' FROM p WHERE len(list_filter(regexp_extract_all(t, '{YEARS}'), lambda y: NOT list_contains(regexp_extract_all(s, '{YEARS}'), y))) > 0"""
IN_SQL = ("D/多行壓扁", "C/憑空年份")


@query(f"""
WITH p AS (SELECT conv_id * 1000 + turn AS k, prompt AS s, reply || CASE WHEN turn % 4 = 0 THEN ' 1987' ELSE '' END AS t FROM ({PAIRS})), h AS ({HITS})
SELECT hit, k, left(s, 40) AS src, left(t, 40) AS tgt FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY k) AS rn FROM h) WHERE rn <= 10
""")
def audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten pairs of each pattern."""
    p = _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("prompt").alias("src"), F.concat("reply", F.when(F.col("turn") % 4 == 0, " 1987").otherwise("")).alias("tgt"))
    return detect.audit_samples(p, "k", 10, 40).filter(F.col("hit").isin(*IN_SQL)).select("hit", "k", "src", "tgt")


@query(f"""
WITH q AS (SELECT prompt || CASE WHEN turn % 6 = 0 THEN ' 1901' ELSE '' END AS a, reply AS b FROM ({PAIRS})),
p AS (SELECT 'ja' AS tgt_lang, a AS s, b AS t FROM q UNION ALL SELECT 'en', b, a FROM q), h AS ({HITS})
SELECT tgt_lang, hit, count(*) AS n FROM h GROUP BY ALL
""")
def audit_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of raw pairs, each read in both directions."""
    raw = _pairs(spark, sf_dir).select(F.concat("prompt", F.when(F.col("turn") % 6 == 0, " 1901").otherwise("")).alias("a"), F.col("reply").alias("b"), F.lit("en").alias("lang_a"), F.lit("ja").alias("lang_b"))
    return detect.report_order(detect.audit_counts(detect.both_orientations(raw), "tgt_lang").filter(F.col("hit").isin(*IN_SQL)), "tgt_lang")


@query(f"""
WITH p AS (SELECT conv_id % 4 AS g, CASE conv_id % 3 WHEN 0 THEN '翻譯成繁體中文：' WHEN 1 THEN 'Translate to Traditional Chinese: ' ELSE 'Translate to English: ' END || prompt AS q,
  CASE WHEN turn % 4 = 0 THEN reply || '国' ELSE reply || '國' END AS a FROM ({PAIRS}))
SELECT g, count(*) AS targets, count(*) FILTER (WHERE regexp_matches(a, '[国马龙]')) AS residue FROM p WHERE regexp_matches(left(q, 30), '繁體|Traditional|繁体字') GROUP BY g
""")
def simplified_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a Chinese target, and how many have a simplified rest."""
    head = F.when(F.col("conv_id") % 3 == 0, "翻譯成繁體中文：").when(F.col("conv_id") % 3 == 1, "Translate to Traditional Chinese: ").otherwise("Translate to English: ")
    p = _pairs(spark, sf_dir).select((F.col("conv_id") % 4).alias("g"), F.concat(head, "prompt").alias("prompt"), F.concat("reply", F.when(F.col("turn") % 4 == 0, "国").otherwise("國")).alias("reply"))
    return replay.simplified_residue(p, _simplified, "g")


#: The western tokens in SQL: the same four steps.
T13A = r"""list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || {t} || ' ', '([{{-~\[-` -&(-+:-@/])', ' \1 ', 'g'), '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda w: w <> '')"""
BLEU = """
side AS (SELECT id, 'h' AS side, h AS w FROM p UNION ALL SELECT id, 'r', r FROM p),
g AS (SELECT id, side, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM (SELECT *, unnest(range(1, 5)) AS n FROM side))),
counts AS (SELECT id, n, g, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr FROM g GROUP BY ALL),
t AS (SELECT n, sum(least(ch, cr)) AS m, sum(ch) AS h, sum(cr) AS r FROM counts GROUP BY n),
z AS (SELECT *, sum((m = 0)::INT) OVER (ORDER BY n) AS zeros FROM t),
b AS (SELECT avg(CASE WHEN m = 0 THEN -ln(pow(2, zeros) * h) ELSE ln(m / h) END) AS l, max(h) FILTER (WHERE n = 1) AS h1, max(r) FILTER (WHERE n = 1) AS r1 FROM z)
SELECT round(100 * CASE WHEN h1 >= r1 THEN 1.0 ELSE exp(1 - r1 / h1) END * exp(l), 6) AS bleu FROM b"""


@query(f"WITH p AS (SELECT row_number() OVER () AS id, {T13A.format(t='reply')} AS h, {T13A.format(t='prompt')} AS r FROM ({PAIRS})),{BLEU}")
def bleu_western(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of replies beside prompts over western tokens."""
    rows = _pairs(spark, sf_dir).select(metrics.tokens_13a(F.col("reply")).alias("hyp_tokens"), metrics.tokens_13a(F.col("prompt")).alias("ref_tokens"))
    return metrics.bleu(rows).select(F.round("bleu", 6).alias("bleu"))


HAN_APART = "regexp_replace({t}, '([一-鿿　-〿])', ' \\1 ', 'g')"


@query(f"WITH q AS (SELECT replace(reply, 'e', '的') AS h, replace(prompt, 'e', '的') AS r FROM ({PAIRS})), p AS (SELECT row_number() OVER () AS id, {T13A.format(t=HAN_APART.format(t='h'))} AS h, {T13A.format(t=HAN_APART.format(t='r'))} AS r FROM q),{BLEU}")
def bleu_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU over Chinese tokens of replies and prompts that a rule gave Han characters."""
    han = lambda c: F.replace(F.col(c), F.lit("e"), F.lit("的"))
    rows = _pairs(spark, sf_dir).select(metrics.tokens_zh(han("reply")).alias("hyp_tokens"), metrics.tokens_zh(han("prompt")).alias("ref_tokens"))
    return metrics.bleu(rows).select(F.round("bleu", 6).alias("bleu"))


@query("""
SELECT 'run' AS tag, 'flores' AS benchmark, lang || '->' || source AS direction, metric, value FROM (
  SELECT lang, source, unnest(['chars', 'docs']) AS metric, unnest([round(avg(n_chars), 3), count(*)]) AS value FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY lang, source)
""")
def run_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's result document, read back as rows."""
    docs = table(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    scores = docs.groupBy(F.concat("lang", F.lit("->"), "source").alias("direction")).agg(F.round(F.avg("n_chars"), 3).alias("chars"), F.count("*").cast("double").alias("docs"))
    scores = scores.unpivot("direction", ["chars", "docs"], "metric", "value")
    document = writers.run_result(scores, "run", "flores", 3, gen={"num_beams": 4})
    parsed = document.select(F.from_json("json", "tag string, benchmark string, results map<string,map<string,double>>").alias("j")).select("j.*")
    return parsed.select("tag", "benchmark", F.explode("results").alias("direction", "m")).select("tag", "benchmark", "direction", F.explode("m").alias("metric", "value"))


@query(f"""
WITH p AS (SELECT 'd' || conv_id % 3 AS direction, prompt AS s, reply || CASE WHEN turn % 4 = 0 THEN ' 1987' ELSE '' END AS t FROM ({PAIRS})), h AS ({HITS})
SELECT direction, hit, n, total FROM (SELECT direction, hit, count(*) AS n FROM h GROUP BY ALL) JOIN (SELECT direction, count(*) AS total FROM p GROUP BY ALL) USING (direction)
""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit's document, read back as rows."""
    p = _pairs(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("direction"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("prompt").alias("src"), F.concat("reply", F.when(F.col("turn") % 4 == 0, " 1987").otherwise("")).alias("tgt"))
    document = writers.audit_report(detect.audit_counts(p, "direction"), detect.audit_denominators(p, "direction"), detect.audit_samples(p, "k", 3))
    parsed = document.select(F.from_json("json", "totals map<string,bigint>, counts map<string,map<string,bigint>>").alias("j")).select("j.*")
    cells = parsed.select("totals", F.explode("counts").alias("direction", "m")).select("direction", F.explode("m").alias("hit", "n"), F.expr("totals[direction]").alias("total"))
    return cells.filter(F.col("hit").isin(*IN_SQL)).select("direction", "hit", "n", "total")


@query("SELECT lang, count(*) AS n, count(source) AS with_source FROM (SELECT lang, source FROM documents UNION ALL SELECT 'all', NULL FROM documents) GROUP BY lang")
def united_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of different columns as one."""
    docs = table(spark, sf_dir, "documents")
    return curate.unite(docs.select("lang", "source"), docs.select(F.lit("all").alias("lang"))).groupBy("lang").agg(F.count("*").alias("n"), F.count("source").alias("with_source"))


#: Whole words that look like names: a pattern between word boundaries is a maximal run of word characters.
WORDS = "string_split(regexp_replace({t}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), ' ')"
NAME_WORDS = f"list_filter({WORDS}, lambda w: length(w) >= 2 AND regexp_full_match(w, '[A-Z][a-zA-Z]*[0-9]+[a-zA-Z0-9]*|[A-Z]{{{{2,}}}}[0-9]*|[A-Z][a-z]{{{{2,}}}}') AND NOT list_contains({literal(list(K.NAME_STOP))}, w))"
STRICT_WORDS = f"list_filter({WORDS}, lambda w: length(w) >= 2 AND regexp_full_match(w, '[A-Z]{{{{2,}}}}[0-9]*|[A-Za-z]{{{{1,10}}}}[0-9]+[a-zA-Z]*') AND NOT list_contains({literal(list(K.STRICT_STOP))}, upper(w)))"
NAMED = f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'The RTX4090 and GPT4. ' WHEN 2 THEN 'OK NASA, ' ELSE '' END || prompt AS s, CASE WHEN conv_id % 2 = 0 THEN 'RTX4090, NASA: ' ELSE '' END || reply AS t FROM ({PAIRS})"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("turn") % 4 == 0, "The RTX4090 and GPT4. ").when(F.col("turn") % 4 == 2, "OK NASA, ").otherwise("")
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.concat(mark, "prompt").alias("s"), F.concat(F.when(F.col("conv_id") % 2 == 0, "RTX4090, NASA: ").otherwise(""), "reply").alias("t"))


@query(f"""
WITH p AS ({NAMED}), n AS (SELECT *, {NAME_WORDS.format(t='s')} AS names, {STRICT_WORDS.format(t='s')} AS strict FROM p)
SELECT conv_id, turn, len(names) > 0 AND len(list_filter(names, lambda x: contains(t, x))) = 0 AS all_lost, len(list_filter(strict, lambda x: NOT contains(t, x))) > 0 AS strict_lost FROM n
""")
def lost_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all names, or any strict name, of a prompt are missing in the reply."""
    s, t = F.col("s"), F.col("t")
    return _named(spark, sf_dir).select("conv_id", "turn", detect.all_names_lost(s, t).alias("all_lost"), detect.any_strict_lost(s, t).alias("strict_lost"))


@query(f"""
WITH p AS ({NAMED}) SELECT conv_id % 4 AS g, count(*) AS n, count(*) FILTER (WHERE len({NAME_WORDS.format(t='s')}) > 0) AS with_names, count(*) FILTER (WHERE len({STRICT_WORDS.format(t='s')}) > 0) AS with_strict,
  count(*) FILTER (WHERE contains(trim(s, ' ' || chr(10)), chr(10))) AS multi_line FROM p GROUP BY conv_id % 4
""")
def name_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many prompts have names, strict names and several lines."""
    return detect.audit_denominators(_named(spark, sf_dir).withColumn("g", F.col("conv_id") % 4), "g", src="s", tgt="t")


LABELS = ("說明：", "註：", "Note: ", "1. ", "圖 3. ", "選擇：", "據報導，", "", "答：")
LABELLED = f"SELECT conv_id, turn, CASE WHEN turn % 6 = 0 THEN 'Note: ' ELSE '' END || prompt AS s, ({literal(list(LABELS))})[CAST((conv_id + turn) % {len(LABELS)} + 1 AS INT)] || reply AS t FROM ({PAIRS})"


@query(f"""
WITH p AS ({LABELLED}) SELECT conv_id, turn, unnest(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, {literal(pattern.replace('(?U)', ''))}) THEN 'A/{name}' END" for name, pattern in K.INVENTED_LABELS)}], lambda x: x IS NOT NULL)) AS hit
FROM p WHERE NOT regexp_matches(string_split(s, chr(10))[1], {literal(K.SOURCE_LABEL.replace('(?iuU)', '(?i)'))})
""")
def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that replies have and their prompts have not, over pairs that a rule labelled."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("conv_id") + F.col("turn")) % len(LABELS) + 1).cast("int"))
    p = _pairs(spark, sf_dir).select("conv_id", "turn", F.concat(F.when(F.col("turn") % 6 == 0, "Note: ").otherwise(""), "prompt").alias("s"), F.concat(label, "reply").alias("t"))
    return p.select("conv_id", "turn", F.explode(detect.invented_labels(F.col("s"), F.col("t"))).alias("hit"))


@query(f"""
WITH p AS (SELECT conv_id, turn, prompt AS s, CASE turn % 8 WHEN 0 THEN '' WHEN 2 THEN trim(prompt, ' ' || chr(10)) WHEN 4 THEN reply || ' 1987' ELSE left(reply, 40) END AS o FROM ({PAIRS})),
f AS (SELECT *, CASE WHEN o = '' THEN ['empty'] ELSE list_filter([
  CASE WHEN NOT contains(o, 'la') THEN 'keep' END,
  CASE WHEN len(string_split(s, chr(10))) > 1 AND len(list_filter(string_split(o, chr(10)), lambda x: trim(x) <> '')) < len(string_split(s, chr(10))) THEN 'lines' END,
  CASE WHEN o = trim(s, ' ' || chr(10)) THEN 'echo' END,
  CASE WHEN len(list_filter(regexp_extract_all(o, '(?:19|20)[0-9]{{2}}'), lambda y: NOT list_contains(regexp_extract_all(s, '(?:19|20)[0-9]{{2}}'), y))) > 0 THEN 'year' END,
  CASE WHEN length(o) / length(s) < 0.3 OR length(o) / length(s) > 3.0 THEN 'len' END], lambda x: x IS NOT NULL) END AS found FROM p)
SELECT conv_id, turn, found FROM f
""")
def defect_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of defects of replies that a rule changed, but for loops, whose pattern the other engine lacks."""
    stripped = F.trim(F.regexp_replace("prompt", "^[ \n]+|[ \n]+$", ""))
    out = F.when(F.col("turn") % 8 == 0, "").when(F.col("turn") % 8 == 2, stripped).when(F.col("turn") % 8 == 4, F.concat("reply", F.lit(" 1987"))).otherwise(F.left("reply", F.lit(40)))
    p = _pairs(spark, sf_dir).select("conv_id", "turn", F.col("prompt").alias("s"), out.alias("o"))
    found = detect.defects(F.col("s"), F.col("o"), F.array(F.lit("la")))
    classes = F.transform(F.filter(found, lambda x: ~x.startswith("loop") & ~x.startswith("tag")), lambda x: F.substring_index(x, ":", 1))
    return p.select("conv_id", "turn", classes.alias("found"))


REQUEST = "(['Translate to English:', '翻譯成日文：', 'Translate to Traditional Chinese (Taiwan):', 'Tell me:'])[CAST(turn % 4 + 1 AS INT)] || chr(10) || (['', '漢', 'かな'])[CAST(conv_id % 3 + 1 AS INT)] || text"


@query(f"""
WITH r AS (SELECT conv_id, turn, {REQUEST} AS u FROM conversations), h AS (SELECT *, string_split(u, chr(10))[1] AS head, substr(u, strpos(u, chr(10)) + 1) AS body FROM r),
d AS (SELECT *, CASE {' '.join(f"WHEN list_contains({literal(list(options))}, head) THEN '{lang}'" for lang, options in K.TEMPLATES.items())} END AS tgt_lang FROM h)
SELECT conv_id, turn, CASE WHEN tgt_lang IS NOT NULL THEN CASE WHEN regexp_matches(body, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(body, '[一-鿿]') THEN 'zhtw' ELSE 'en' END END AS src_lang, tgt_lang FROM d
""")
def request_direction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of requests made of every message."""
    head = F.element_at(F.array(*map(F.lit, ("Translate to English:", "翻譯成日文：", "Translate to Traditional Chinese (Taiwan):", "Tell me:"))), (F.col("turn") % 4 + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, ("", "漢", "かな"))), (F.col("conv_id") % 3 + 1).cast("int"))
    d = detect.direction_of(F.concat(head, F.lit("\n"), mark, "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", d["src_lang"].alias("src_lang"), d["tgt_lang"].alias("tgt_lang"))


@query(f"""
WITH p AS (SELECT conv_id, turn, prompt AS q, CASE turn % 3 WHEN 0 THEN '漢' || reply WHEN 1 THEN reply || '?' ELSE reply END AS a FROM ({PAIRS})),
t AS (SELECT *, trim(q, ' ' || chr(10)) AS p, trim(a, ' ' || chr(10)) AS r FROM p),
c AS (SELECT *, length(r) / greatest(length(p), 1) AS ratio, length(regexp_replace(r, '[^A-Za-z一-鿿぀-ヿ]', '', 'g')) AS letters,
  [regexp_matches(p, '[一-鿿]'), length(regexp_replace(p, '[^A-Za-z]', '', 'g')) > length(p) * 0.3] AS sp, [regexp_matches(r, '[一-鿿]'), length(regexp_replace(r, '[^A-Za-z]', '', 'g')) > length(r) * 0.3] AS sr FROM t)
SELECT conv_id, turn, ratio BETWEEN 0.4 AND 2.5 AND letters >= 5 AND (sp <> sr OR ends_with(r, '？') OR ends_with(r, '?')) AS mere FROM c
""")
def mere_translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that only look like their prompt translated."""
    a = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("漢"), "reply")).when(F.col("turn") % 3 == 1, F.concat("reply", F.lit("?"))).otherwise(F.col("reply"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", detect.mere_translation(F.col("prompt"), a).alias("mere"))
