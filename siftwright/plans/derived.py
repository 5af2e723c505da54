"""Queries of operators on single rows and of small layouts, over rows that the tables give."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.functions import text as T
from siftwright.operators import clean, curate, detect, graders, metrics, replay
from siftwright.operators.panels import GENERAL, INSTRUCTIONS
from siftwright.plans.base import Catalog, literal, table, values
from siftwright.plans.corpus import PAIRS
from siftwright.sources import readers

CATALOG = Catalog()
query = CATALOG.query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "prompt", "reply")


# --- multiple choice: the first characters of a document are its question and options ---
ITEMS = "(SELECT doc_id AS item_id, lang, left(t, 20) AS question, [substr(t, 1, 5), substr(t, 6, 5), substr(t, 11, 5), substr(t, 16, 5)] AS options, doc_id % 4 AS gold FROM (SELECT doc_id, lang, replace(text, chr(10), ' ') AS t FROM documents WHERE length(text) >= 20))"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.length("text") >= 20).withColumn("t", F.replace("text", F.lit("\n"), F.lit(" ")))
    return docs.select(F.col("doc_id").alias("item_id"), "lang", F.left("t", F.lit(20)).alias("question"), F.array(*[F.substring("t", i, 5) for i in (1, 6, 11, 16)]).alias("options"), (F.col("doc_id") % 4).cast("int").alias("gold"))


@query(f"""
WITH i AS (SELECT *, unnest(range(4)) AS rotation FROM {ITEMS})
SELECT item_id, rotation, list_concat(options[rotation + 1 :], options[: rotation]) AS options, CASE WHEN gold - rotation < 0 THEN gold - rotation + 4 ELSE gold - rotation END AS gold FROM i
""")
def mcq_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item in its four rotations."""
    return metrics.rotations(_items(spark, sf_dir)).select("item_id", "rotation", "options", "gold")


@query(f"""
WITH i AS (SELECT lang, (item_id + r) % 4 AS pick, (gold - r + 4) % 4 AS gold FROM (SELECT *, unnest(range(4)) AS r FROM {ITEMS}) WHERE item_id % 5 <> 0 OR r < 2),
l AS (SELECT lang, pick, count(*) AS m, count(*) FILTER (WHERE pick = gold) AS c FROM i GROUP BY ALL)
SELECT lang, sum(m)::BIGINT AS n, sum(c)::BIGINT AS correct, round(sum(c) * 100 / sum(m), 6) AS acc, round(max(m) / sum(m), 6) AS max_letter_share FROM l GROUP BY lang
""")
def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and share of the most picked letter."""
    picks = metrics.rotations(_items(spark, sf_dir)).filter("item_id % 5 <> 0 or rotation < 2").withColumn("pick", (F.col("item_id") + F.col("rotation")) % 4)
    return metrics.choice_scores(picks).withColumn("acc", F.round("acc", 6)).withColumn("max_letter_share", F.round("max_letter_share", 6))


@query(f"SELECT item_id, md5(question || chr(10) || 'A. ' || options[1] || chr(10) || 'B. ' || options[2] || chr(10) || 'C. ' || options[3] || chr(10) || 'D. ' || options[4]) AS prompt FROM {ITEMS}")
def mcq_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lettered prompts, by their digest."""
    return _items(spark, sf_dir).select("item_id", F.md5(metrics.choice_prompt(F.col("question"), F.col("options"))).alias("prompt"))


@query(f"SELECT question, options, CASE WHEN item_id % 4 = 0 THEN item_id // 4 % 4 ELSE gold END::INT AS gold FROM {ITEMS}")
def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading and knowledge items of four layouts in one table."""
    items = _items(spark, sf_dir)
    of = lambda n: items.filter(F.col("item_id") % 4 == n)
    option = lambda i: F.element_at("options", i + 1)
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), F.col("gold") + 1)
    reading = of(0).select("question", F.lit("p").alias("flores_passage"), *[option(i).alias(f"mc_answer{i + 1}") for i in range(4)], (F.floor(F.col("item_id") / 4) % 4 + 1).cast("string").alias("correct_answer_num"))
    lettered = of(1).select("question", *[option(i).alias(c) for i, c in enumerate("ABCD")], F.lower(letter).alias("answer"))
    listed = of(2).select("question", F.col("options").alias("choices"), F.col("gold").alias("answer"))
    capital = of(3).select(F.col("question").alias("Question"), *[option(i).alias(c) for i, c in enumerate("ABCD")], letter.alias("Answer"))
    return readers.reading_items(reading).drop("passage").unionByName(readers.knowledge_items(lettered, listed, capital))


# --- texts ---
@query(f"""
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 4 THEN '' ELSE array_to_string(list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') END AS answer FROM ({PAIRS})
""")
def parse_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in command-line logs that show a prompt's first line, a reply and the statistics, or no statistics."""
    end = F.when(F.col("conv_id") % 5 == 4, "").otherwise("\n[ Prompt: 3 t/s ]\n")
    log = F.concat(F.lit("loading\n> "), F.substring_index("prompt", "\n", 1), F.lit("\n\n"), F.col("reply"), end)
    return _pairs(spark, sf_dir).select("conv_id", "turn", T.parse_cli_output(log, F.lit(1)).alias("answer"))


@query("""
WITH RECURSIVE paragraphs AS MATERIALIZED (
  SELECT doc_id, j, trim(p, ' ' || chr(9) || chr(10) || chr(13)) AS p FROM (SELECT doc_id, unnest(q) AS p, unnest(range(len(q))) AS j FROM (SELECT doc_id, string_split_regex(trim(replace(text, '. ', '.' || chr(10) || chr(10)), ' ' || chr(9) || chr(10) || chr(13)), '\\n\\s*\\n') AS q FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\n\\s*\\n') FROM documents WHERE doc_id % 2 = 1)) WHERE trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
sentences AS MATERIALIZED (
  SELECT doc_id, j, list_filter(list_transform(string_split(regexp_replace(p, '([。！？.!?\\n])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS ss FROM paragraphs WHERE length(p) > 280),
each AS MATERIALIZED (SELECT doc_id, j, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS k FROM sentences),
-- the open chunk after each sentence, and whether it began a new one
walk AS (
  SELECT doc_id, j, 1::BIGINT AS k, s AS open, TRUE AS fresh, 0::BIGINT AS c FROM each WHERE k = 1
  UNION ALL
  SELECT w.doc_id, w.j, w.k + 1, CASE WHEN length(open) + 1 + length(s) <= 280 THEN open || CASE WHEN regexp_matches(open, '[。！？.!?\\n]$') THEN '' ELSE ' ' END || s ELSE s END,
    length(open) + 1 + length(s) > 280, c + (length(open) + 1 + length(s) > 280)::BIGINT FROM walk w JOIN each e ON e.doc_id = w.doc_id AND e.j = w.j AND e.k = w.k + 1),
units AS (SELECT doc_id, j, c, arg_max(open, k) AS u FROM walk GROUP BY doc_id, j, c UNION ALL SELECT doc_id, j, 0, p FROM paragraphs WHERE length(p) <= 280),
cut AS (SELECT doc_id, j, c, i, substr(u, i, 280) AS chunk FROM (SELECT *, unnest(range(1, greatest(1, length(u)) + 1, 280)) AS i FROM units WHERE length(u) > 560) UNION ALL SELECT doc_id, j, c, 1, u FROM units WHERE length(u) <= 560)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j, c, i) - 1 AS INT) AS pos, md5(chunk) AS chunk FROM cut
""")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and sentences of every document packed into chunks; every second one's sentences are paragraphs."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(". "), F.lit(".\n\n"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_chunks(text)).alias("pos", "chunk")).withColumn("chunk", F.md5("chunk"))


@query("SELECT doc_id, md5(translate(text, ' ,，', '')) AS form, contains(translate(text, ' ,，', ''), '20') AS has FROM documents")
def numeric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric form of every document with its digits made wide."""
    form = T.numeric_form(F.translate("text", "0123456789", "０１２３４５６７８９"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(form).alias("form"), form.contains("20").alias("has"))


@query("SELECT event_id AS step, value FROM events WHERE event_type = 'click' AND value IS NOT NULL")
def log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training log: the steps that have a loss."""
    loss, other = F.when(F.col("event_type") == "click", F.col("value")), F.when(F.col("event_type") != "click", F.col("value"))
    return readers.log_series(table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), loss.alias("loss"), other.alias("eval_loss")), "loss")


# --- pairs and layouts ---
SEGMENTS = "SELECT source AS bench, doc_id // 3 AS seg_id, (['en', 'ja', 'zhtw'])[CAST(doc_id % 3 + 1 AS INT)] AS lang, left(text, 30) AS text FROM (SELECT 'b' AS source, doc_id, text FROM documents)"


@query(f"""
WITH s AS ({SEGMENTS})
SELECT a.bench, a.seg_id, a.lang AS src_lang, b.lang AS tgt_lang, a.text AS src, CASE WHEN b.lang = 'zhtw' THEN translate(b.text, 'e', 'E') ELSE b.text END AS tgt
FROM (SELECT bench, seg_id, lang, CASE WHEN lang = 'zhtw' THEN translate(text, 'e', 'E') ELSE text END AS text FROM s) a JOIN s b ON a.bench = b.bench AND a.seg_id = b.seg_id AND a.lang <> b.lang
WHERE a.seg_id < 250
""")
def multiparallel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All directions of segments that three documents make, with a conversion of the Chinese side; the first 250."""
    lang = F.element_at(F.array(*map(F.lit, ("en", "ja", "zhtw"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.lit("b").alias("bench"), F.floor(F.col("doc_id") / 3).alias("seg_id"), lang.alias("lang"), F.left("text", F.lit(30)).alias("text"))
    return readers.all_directions(readers.first_segments(rows, 250), F.translate("text", "e", "E"))


@query(f"SELECT CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' ELSE 'zhtw' END AS lang, prompt, reply FROM ({PAIRS}) WHERE conv_id % 4 <> 3")
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completion rows of the known languages."""
    language = F.element_at(F.array(*map(F.lit, ("English", "Japanese", "Chinese", "French"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return replay.prompt_table(_pairs(spark, sf_dir).select(language.alias("language"), F.col("prompt").alias("inputs"), F.col("reply").alias("targets")))


ENDS = "(['.', '', ',', '!'])[CAST(conv_id % 4 + 1 AS INT)]"
TAILS = "(['造船', '造船。', '因為', '終わります', '終わるから', '終わります。'])[CAST(turn // 2 % 6 + 1 AS INT)]"
BODY = "regexp_replace(left(prompt, 20), '[^A-Za-z]+', ' ', 'g') || 'x'"


@query(f"""
WITH p AS (SELECT conv_id, turn, {BODY} || {ENDS} AS x, '話' || {TAILS} AS y, {ENDS} AS e, turn // 2 % 6 AS k FROM ({PAIRS})),
-- the end of each side as it is, and restored: a clause that goes on gets no mark, and without any end there is no pair
r AS (SELECT *, CASE WHEN e = '' THEN x || '.' ELSE x END AS rx, CASE k WHEN 0 THEN y || '。' WHEN 3 THEN y || '。' ELSE y END AS ry, e IN ('.', '!') AS ex, k IN (1, 5) AS ey FROM p)
SELECT conv_id, turn, CASE WHEN ex AND ey THEN x WHEN ex THEN x WHEN ey THEN rx END AS a, CASE WHEN ex AND ey THEN y WHEN ex THEN ry WHEN ey THEN y END AS b FROM r
""")
def restore_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing sentence ends restored where the other side has one."""
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (n + 1).cast("int"))
    half = F.floor(F.col("turn") / 2) % 6
    x = F.concat(F.regexp_replace(F.left("prompt", F.lit(20)), "[^A-Za-z]+", " "), F.lit("x"), pick((".", "", ",", "!"), F.col("conv_id") % 4))
    y = F.concat(F.lit("話"), pick(("造船", "造船。", "因為", "終わります", "終わるから", "終わります。"), half))
    pair = T.restore_pair(x, y, F.lit("en"), F.when(half >= 3, "ja").otherwise("zhtw"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", pair["a"].alias("a"), pair["b"].alias("b"))


#: Lines with a number in both sides, so that no two are copies, and the reason that each shape gets.
SHAPES = [
    ("jparacrawl.en-ja.tsv", "en", "ja", "The weather is fine today # times.\t今日は#回天気がいいです。", "kept"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "only one column #", "bad_format"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "\t#空です。", "empty"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "Same text #.\tSame text #.", "identical"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "♪ La la la #.\tラララ#。", "subtitle_noise"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "He left early #\t彼は早く#帰った。", "punct_asymmetric"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "Open the file API_ KEY # now.\t今すぐ鍵の#ファイルを開いて。", "stray_space"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "The museum # opens at nine.\tThe museum # is open.", "lang_mismatch"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "Held out sentence.\t取り置きの文です#。", "eval_contaminated"),
    ("kde4.en-zhtw.tsv", "en", "zhtw", "Press %1 to go on #.\t按下#按鈕繼續。", "preproc_dropped"),
    ("kde4.en-zhtw.tsv", "en", "zhtw", "Open the window # ( main ) .\t開啟 視窗# （ 主要 ） 。", "kept"),
    ("globalvoices.en-zhtw.tsv", "en", "zhtw", "When the rain # came,\t當大雨#來臨時，", "preproc_dropped"),
    ("ted2020.en-zhtw.tsv", "en", "zhtw", "We build # small boats.\t我們造#小船", "kept"),
    ("coct.en-zhtw.tsv", "en", "zhtw", "The horse runs # times.\t马跑得快#次。", "kept"),
    ("coct.en-zhtw.tsv", "en", "zhtw", "The dragon sleeps # times.\t龙睡了#次。", "simplified_residue"),
]


@query(f"""
WITH s AS (SELECT * FROM {values([(i, r[0], r[4]) for i, r in enumerate(SHAPES)], 'k, corpus, reason')}),
-- a document that comes twice, by a number that ten thousand documents share, is a copy of the first
d AS (SELECT doc_id % {len(SHAPES)} AS k, row_number() OVER (PARTITION BY doc_id % {len(SHAPES)}, n_chars ORDER BY doc_id) AS rn FROM documents)
SELECT corpus, CASE WHEN reason = 'kept' AND rn > 1 THEN 'dup' ELSE reason END AS reason, count(*) AS n FROM d JOIN s USING (k) GROUP BY ALL
""")
def pair_filter_chain_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over lines of every shape, as many as documents, with the documents' lengths in them."""
    shapes = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(SHAPES)], "k long, corpus string, lang_a string, lang_b string, shape string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lineno"), (F.col("doc_id") % len(SHAPES)).alias("k"), F.col("n_chars").cast("string").alias("n"))
    rows = docs.join(F.broadcast(shapes), "k").select("corpus", "lineno", F.replace("shape", F.lit("#"), "n").alias("line"), "lang_a", "lang_b")
    evaluation = spark.createDataFrame([("Held out sentence.",), ("something else",)], "line string")
    cleaned = clean.clean_bitext(rows, evaluation, convert=lambda t: F.translate(t, "马", "馬"), simplified=lambda t: t.rlike("[马龙]"))
    return clean.reason_counts(cleaned, "corpus")


POOLS = [(0, "coct.en-zhtw.tsv", 200), (1, "globalvoices.en-zhtw.tsv", 5), (2, "ted2020.en-zhtw.tsv", 90), (3, "kde4.en-zhtw.tsv", 40), (4, "opus100.en-zh.tsv", 300)]
CAPS = [(c, cap) for c, cap in K.RECIPES["en", "zhtw"]]


@query(f"""
WITH RECURSIVE pools AS (SELECT corpus, count(*) * factor AS n FROM documents JOIN {values(POOLS, 'k, corpus, factor')} ON k = doc_id % 5 GROUP BY corpus, factor),
c AS (SELECT corpus, least(coalesce(cap, 80000 - floor(80000 * {K.DOC_SHARE})), floor((80000 - floor(80000 * {K.DOC_SHARE})) * {K.MAX_SHARE}), coalesce(n, 0))::BIGINT AS ceiling, ord FROM {values([(c, cap, i) for i, (c, cap) in enumerate(CAPS)], 'corpus, cap, ord')} LEFT JOIN pools USING (corpus)),
o AS (SELECT *, row_number() OVER (ORDER BY ceiling, ord) AS k, count(*) OVER () AS m FROM c),
f AS (
  SELECT 0::BIGINT AS k, (80000 - floor(80000 * {K.DOC_SHARE}))::BIGINT AS rest, NULL::VARCHAR AS corpus, 0::BIGINT AS take
  UNION ALL
  SELECT o.k, rest - greatest(0, least(rest // (m - o.k + 1), ceiling)), o.corpus, greatest(0, least(rest // (m - o.k + 1), ceiling)) FROM f JOIN o ON o.k = f.k + 1)
SELECT corpus, take FROM f WHERE k > 0
""")
def recipe_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of one direction's recipe under a limit of 80,000, with pools that documents stand for."""
    factors = spark.createDataFrame([(k, "en", "zhtw", c, f) for k, c, f in POOLS], "k long, src_lang string, tgt_lang string, corpus string, factor long")
    pools = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("k")).join(F.broadcast(factors), "k").groupBy("src_lang", "tgt_lang", "corpus").agg(F.sum("factor").alias("n"))
    recipe = curate.recipe_table(spark, limit=80_000).filter("src_lang = 'en' and tgt_lang = 'zhtw'")
    return curate.waterfill(curate.quota_ceilings(recipe, pools), "src_lang", "tgt_lang", budget="sent_budget").select("corpus", "take")


@query(f"""
WITH p AS (SELECT prompt AS s, CASE turn % 8 WHEN 0 THEN '' WHEN 2 THEN trim(left(prompt, 14)) WHEN 4 THEN left(reply, 9) || ' 1987' ELSE left(reply, 15) END AS o FROM ({PAIRS})),
f AS (SELECT *, list_filter(regexp_extract_all(o, '(?:19|20)[0-9]{{2}}'), lambda y: NOT list_contains(regexp_extract_all(s, '(?:19|20)[0-9]{{2}}'), y)) AS ghosts, length(o) / length(s) AS x,
  len(string_split(s, chr(10))) > 1 AND len(list_filter(string_split(o, chr(10)), lambda x: trim(x) <> '')) < len(string_split(s, chr(10))) AS flat FROM p),
g AS (SELECT *, CASE WHEN o = '' THEN ['empty'] ELSE list_filter([CASE WHEN NOT contains(o, 'la') THEN 'keep:la' END, CASE WHEN flat THEN 'lines' END, CASE WHEN o = trim(s, ' ' || chr(10)) THEN 'echo' END, CASE WHEN len(ghosts) > 0 THEN 'year' END, CASE WHEN x < 0.3 OR x > 3.0 THEN 'len' END], lambda x: x IS NOT NULL) END AS found FROM f)
SELECT count(*) AS n, count(*) FILTER (WHERE len(found) > 0) AS with_defects, sum(len(found))::BIGINT AS defects, 0::BIGINT AS labels, count(*) FILTER (WHERE list_contains(found, 'keep:la')) AS lost_words, count(*) FILTER (WHERE list_contains(found, 'year')) AS ghost_years,
  count(*) FILTER (WHERE list_contains(found, 'lines')) AS lines, 0::BIGINT AS loops, count(*) FILTER (WHERE list_contains(found, 'len')) AS lengths, round((count(*) - count(*) FILTER (WHERE list_contains(found, 'keep:la'))) * 100.0 / count(*), 6) AS kept_pct FROM g
""")
def defect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of defects of outputs that are too short to loop."""
    out = F.when(F.col("turn") % 8 == 0, "").when(F.col("turn") % 8 == 2, F.trim(F.left("prompt", F.lit(14)))).when(F.col("turn") % 8 == 4, F.concat(F.left("reply", F.lit(9)), F.lit(" 1987"))).otherwise(F.left("reply", F.lit(15)))
    rows = _pairs(spark, sf_dir).select(F.col("prompt").alias("src"), out.alias("out"), F.array(F.lit("la")).alias("keep"))
    summed = detect.defect_summary(rows.withColumn("found", detect.defects(F.col("src"), F.col("out"), F.col("keep"))))
    return summed.withColumn("kept_pct", F.round("kept_pct", 6))


# --- graded panels over replies ---
def _check_sql(kind: str, args: list[str]) -> str:
    """One check as SQL over an answer `a`."""
    t, q, own = "trim(a, ' ' || chr(10))", literal, [str(x) for x in args]
    pattern = lambda p: q(p.replace("(?U)", ""))
    strip = lambda x, marks: f"regexp_replace({x}, {q(f'[{marks}]+$')}, '')"
    stop, marked = strip(t, "。."), strip(t, "。.！!")
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    chars = lambda x: f"length(regexp_replace({x}, '\\s', '', 'g'))"
    words = lambda x: f"len(list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> ''))"
    between = lambda v, b: " AND ".join(["TRUE", *([f"{v} >= {b[0]}"] if b and b[0] != "" else []), *([f"{v} <= {b[1]}"] if len(b) > 1 and b[1] != "" else [])])
    every = lambda xs, cond: f"len(list_filter({xs}, lambda x: NOT ({cond}))) = 0"
    times = lambda x, m: f"(length({x}) - length(replace({x}, {q(m)}, ''))) // {max(len(m), 1)}"
    any_ = lambda cond: "(" + " OR ".join(cond(q(x)) for x in own) + ")"
    number = "translate(a, '０１２３４５６７８９,， ', '0123456789')"
    made = {
        "exact": lambda: any_(lambda x: f"{marked} = {x}"), "exact_lower": lambda: any_(lambda x: f"lower({marked}) = {x}"),
        "exact_without_blanks": lambda: any_(lambda x: f"{strip(f'''replace({t}, ' ', '')''', '。.！!')} = {x}"),
        "list_of": lambda: f"NOT regexp_matches({stop}, '[：:！!。]') AND NOT contains({stop}, chr(10)) AND length({stop}) < 40 AND len(list_filter(string_split({stop}, {q(own[0])}), lambda x: trim(x) <> '')) = {own[1]}",
        "list_even": lambda: every(f"string_split({stop}, {q(own[0])})", "regexp_matches(trim(x), '^[0-9]*[02468]$')"), "list_each_matches": lambda: every(f"string_split({stop}, {q(own[0])})", f"regexp_matches(trim(x), {pattern(own[1])})"),
        "lines": lambda: f"len({lines}) = {own[0]}", "each_line_chars": lambda: every(lines, between(chars("x"), own)), "each_line_words": lambda: every(lines, between(words("x"), own)), "each_line_starts": lambda: every(lines, f"starts_with(x, {q(own[0])})"),
        "one_line": lambda: f"NOT contains({t}, chr(10))", "chars": lambda: between(chars("a"), own), "chars_without": lambda: between(chars(f"regexp_replace(a, {pattern(own[0])}, '', 'g')"), own[1:]),
        "length": lambda: between(f"length({t})", own), "words": lambda: between(words("a"), own), "words_without": lambda: between(words(f"regexp_replace(a, {pattern(own[0])}, '', 'g')"), own[1:]),
        "occurs": lambda: f"{times(t, own[0])} = {own[1]}", "occurs_raw": lambda: f"{times('a', own[0])} = {own[1]}", "occurs_lower": lambda: f"{times(f'lower({t})', own[0])} = {own[1]}",
        "starts": lambda: any_(lambda x: f"starts_with({t}, {x})"), "ends": lambda: any_(lambda x: f"ends_with({t}, {x})"),
        "ends_without": lambda: "(" + " OR ".join(f"ends_with({strip(t, own[0])}, {q(x)})" for x in own[1:]) + ")", "ends_lower_without": lambda: "(" + " OR ".join(f"ends_with(lower({strip(t, own[0])}), {q(x)})" for x in own[1:]) + ")",
        "contains_any": lambda: any_(lambda x: f"contains(a, {x})"), "contains_any_lower": lambda: any_(lambda x: f"contains(lower(a), {x})"), "number_any": lambda: any_(lambda x: f"contains({number}, {x})"),
        "formula_any": lambda: any_(lambda x: f"contains(replace(upper(a), '₂', '2'), {x})"), "digits_start": lambda: f"starts_with(regexp_replace({number}, '[^0-9]', '', 'g'), {q(own[0])})",
        "lacks": lambda: "NOT " + any_(lambda x: f"contains(a, {x})"), "lacks_lower": lambda: "NOT " + any_(lambda x: f"contains(lower(a), {x})"), "matches": lambda: f"regexp_matches(a, {pattern(own[0])})", "lacks_match": lambda: f"NOT regexp_matches(a, {pattern(own[0])})",
        "without_blanks_is": lambda: f"replace({t}, ' ', '') = {q(own[0])}", "json_keys": lambda: f"CASE WHEN json_valid({t}) AND starts_with({t}, '{{') THEN " + " AND ".join(f"list_contains(json_keys({t}), {q(x)})" for x in own) + " ELSE FALSE END",
        "kana": lambda: f"regexp_matches(a, '[{K.KANA}]')", "han": lambda: f"regexp_matches(a, '[{K.HAN_BASIC}]')", "lowercase": lambda: f"{t} = lower({t})", "traditional": lambda: "NOT regexp_matches(a, '[国马]')",
    }
    return re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", f"coalesce({made[kind]()}, FALSE)")


#: Replies as they are, their beginnings, and short answers in the forms that rules ask for.
FORMS = ["red, green, blue", "7", "YES.", '{"city": "a", "country": "b"}', "2, 4, 6, 8, 10", "一心一意\n三心二意\n五湖四海\n七上八下", "你 好 嗎", "はい。", "答案是12。", "東京です。", "1,2,3,4,5", "H₂O", "3,776", "台北", "国家"]
ANSWER = f"CASE conv_id % 4 WHEN 0 THEN reply WHEN 1 THEN left(reply, 25) ELSE ({literal(FORMS)})[CAST((conv_id + turn // 2) % {len(FORMS)} + 1 AS INT)] END"


def _graded_sql(rules: list[tuple], step: int) -> str:
    passed = " ".join(f"WHEN {i} THEN {' AND '.join(_check_sql(kind, args) for kind, *args in checks)}" for i, (_, _, checks) in enumerate(rules))
    spread = " UNION ALL ".join(f"SELECT conv_id, turn, {ANSWER} AS a, (conv_id * 7 + turn * 3 + {k * step}) % {len(rules)} AS k FROM ({PAIRS})" for k in range(6))
    ids = "[" + ", ".join(str(r[0]) for r in rules) + "]"
    return f"SELECT conv_id, turn, ({ids})[CAST(k + 1 AS INT)]::BIGINT AS rule_id, CASE k {passed} END AS passed FROM ({spread})"


def _graded(spark: SparkSession, sf_dir: str, rules: list[tuple], step: int) -> DataFrame:
    forms = F.element_at(F.array(*map(F.lit, FORMS)), ((F.col("conv_id") + F.floor(F.col("turn") / 2)) % len(FORMS) + 1).cast("int"))
    answer: Column = F.when(F.col("conv_id") % 4 == 0, F.col("reply")).when(F.col("conv_id") % 4 == 1, F.left("reply", F.lit(25))).otherwise(forms)
    ids = F.array(*[F.lit(r[0]).cast("long") for r in rules])
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", answer.alias("output"), F.explode(F.array(*[F.lit(k * step) for k in range(6)])).alias("s"))
    rows = rows.withColumn("rule_id", F.element_at(ids, ((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("s")) % len(rules) + 1).cast("int")))
    return graders.grade(rows, graders.rules_table(spark, rules), simplified="国马").select("conv_id", "turn", "rule_id", "passed")


@query(_graded_sql(INSTRUCTIONS, 13))
def instruction_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies and short answers, each graded by six rules of the instruction panel."""
    return _graded(spark, sf_dir, INSTRUCTIONS, 13)


@query(_graded_sql(GENERAL, 17))
def general_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies and short answers, each graded by six rules of the general panel."""
    return _graded(spark, sf_dir, GENERAL, 17)
