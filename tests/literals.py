"""Queries over small rows that show every case: a test runs each beside its SQL. The tables' queries are in siftwright.plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.functions import text as T
from siftwright.operators import clean, config, convert, curate, decide, detect, graders, metrics, replay
from siftwright.operators.panels import GENERAL, INSTRUCTIONS
from siftwright.plans.base import Catalog, values
from siftwright.sources import readers

CATALOG = Catalog()
query = CATALOG.query


#: Source and target rows for the detectors.
AUDIT = [
    (1, "Visit NASA in 1999.", "請在 1999 年參觀 NASA。"),
    (2, "The H200 ships in 2024.", "這款產品在 2025 年出貨。"),
    (3, "Plain sentence here.", "說明：一般的句子。"),
    (4, "Note: keep it cold.", "註：請冷藏。"),
    (5, "First line.\nSecond line.", "一行而已。"),
    (6, "Anna met Peter.", "安娜見了彼得。"),
    (7, "One thing only.", "1. 只有一件事。"),
    (8, "It rained.", "據報導，下雨了。"),
    (9, "Use GPT4 or HBM3e now.", "現在請用 GPT4 或 HBM3e。"),
    (10, "All fine.", "圖 3. 一切都好。"),
]


def _audit(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AUDIT, "id int, src string, tgt string")


@query(f"""SELECT id, list_sort(list_distinct(list_filter(regexp_extract_all(tgt, '(?:1[89]|20)[0-9]{{2}}'), lambda y: NOT list_contains(regexp_extract_all(src, '(?:1[89]|20)[0-9]{{2}}'), y)))) AS years FROM {values(AUDIT, 'id, src, tgt')}""")
def ghost_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of the target that the source lacks."""
    return _audit(spark).select("id", F.array_sort(detect.ghost_years(F.col("src"), F.col("tgt"))).alias("years"))


@query(f"""SELECT * FROM {values([(1, False, False), (2, True, True), (3, True, False), (4, True, False), (5, True, False), (6, True, False), (7, False, False), (8, False, False), (9, False, False), (10, False, False)], 'id, all_lost, strict_lost')}""")
def lost_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all names, or any strict name, of the source are lost."""
    return _audit(spark).select("id", detect.all_names_lost(F.col("src"), F.col("tgt")).alias("all_lost"), detect.any_strict_lost(F.col("src"), F.col("tgt")).alias("strict_lost"))


@query(f"""SELECT * FROM {values([(3, 'A/label:說明'), (7, 'A/enum:數字'), (8, 'A/narrate:據報導'), (10, 'A/figure:圖N')], 'id, hit')}""")
def label_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the target invented."""
    return _audit(spark).select("id", F.explode(detect.invented_labels(F.col("src"), F.col("tgt"))).alias("hit"))


@query(f"""SELECT hit, count(*) AS n FROM {values([(h,) for h in ['B/專名全失', 'B/型名遺失', 'C/憑空年份', 'A/label:說明', 'B/專名全失', 'B/專名全失', 'B/專名全失', 'D/多行壓扁', 'B/專名全失', 'A/enum:數字', 'A/narrate:據報導', 'A/figure:圖N']], 'hit')} GROUP BY hit""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each audit pattern hits."""
    return detect.audit_counts(_audit(spark))


@query(f"""SELECT count(*) AS n, 7 AS with_names, 3 AS with_strict, 1 AS multi_line FROM {values(AUDIT, 'id, src, tgt')}""")
def audit_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shares of the hits refer to."""
    return detect.audit_denominators(_audit(spark))


REQUESTS = [(1, "翻譯成英文：\n你好。"), (2, "Translate to Japanese:\nGood morning."), (3, "Tell me a story."), (4, "翻譯成繁體中文：\nおはよう。"), (5, "Translate to English:")]


@query(f"""SELECT * FROM {values([(1, 'zhtw', 'en'), (2, 'en', 'ja'), (3, None, None), (4, 'ja', 'zhtw'), (5, 'en', 'en')], 'id, src_lang, tgt_lang')}""")
def request_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of translation requests by their first line."""
    d = detect.direction_of(F.col("text"))
    return spark.createDataFrame(REQUESTS, "id int, text string").select("id", d["src_lang"].alias("src_lang"), d["tgt_lang"].alias("tgt_lang"))


OUTPUTS = [
    (1, "Anna left in 2001.", "安娜在 2001 年離開。", ["2001"]),
    (2, "Keep RTX here.", "", ["RTX"]),
    (3, "Keep RTX here now.", "請留在這裡不要走開。", ["RTX"]),
    (4, "One.\nTwo.\nThree.", "一。二。三。", []),
    (5, "Same words stay.", "Same words stay.", []),
    (6, "Say it once only, please do.", "今天天氣很好。今天天氣很好。今天天氣很好。", []),
    (7, "Short source.", "選擇：短的。1985 與 1950", []),
]


@query(f"""SELECT * FROM {values([(1, []), (2, ['empty']), (3, ['keep:RTX']), (4, ['lines']), (5, ['echo']), (6, ['loop']), (7, ['tag:select', 'year:1950,1985'])], 'id, found').replace('[]', 'CAST([] AS VARCHAR[])')}""")
def defect_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of outputs beside their sources."""
    rows = spark.createDataFrame(OUTPUTS, "id int, src string, out string, keep array<string>")
    return rows.select("id", detect.defects(F.col("src"), F.col("out"), F.col("keep")).alias("found"))


QA = [(1, "台灣最高的山是哪一座？", "What is the highest?"), (2, "How tall is it in metres?", "3952"), (3, "Name the capital of Japan.", "The capital is Tokyo."), (4, "Is it far from here?", "Is it near to there?"), (5, "日本の首都はどこですか。", "首都は東京です。")]


@query(f"SELECT * FROM {values([(1, True), (2, False), (3, False), (4, True), (5, False)], 'id, mere')}")
def mere_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that only translate the question."""
    rows = spark.createDataFrame(QA, "id int, q string, a string")
    return rows.select("id", detect.mere_translation(F.col("q"), F.col("a")).alias("mere"))


ITEMS = [(1, "zhtw", "1+1?", ["2", "3", "4", "5"], 0), (2, "zhtw", "2+2?", ["1", "4", "6", "8"], 1), (3, "ja", "3+3?", ["1", "2", "6", "8"], 2), (4, "en", "4+4?", ["1", "2", "3", "8"], 3)]


@query(f"""
WITH i AS (SELECT *, unnest(range(4)) AS rotation FROM {values(ITEMS, 'item_id, lang, question, options, gold')})
SELECT item_id, rotation, list_concat(options[rotation + 1 :], options[: rotation]) AS options, CASE WHEN gold - rotation < 0 THEN gold - rotation + 4 ELSE gold - rotation END AS gold FROM i
""")
def mcq_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item in its four rotations."""
    rows = spark.createDataFrame(ITEMS, "item_id long, lang string, question string, options array<string>, gold int")
    return metrics.rotations(rows).select("item_id", "rotation", "options", "gold")


@query(f"""
WITH i AS (SELECT lang, (item_id + r) % 4 AS pick, (gold - r + 4) % 4 AS gold FROM (SELECT *, unnest(range(4)) AS r FROM {values(ITEMS, 'item_id, lang, question, options, gold')})),
l AS (SELECT lang, pick, count(*) AS m, count(*) FILTER (WHERE pick = gold) AS c FROM i GROUP BY ALL)
SELECT lang, sum(m)::BIGINT AS n, sum(c)::BIGINT AS correct, sum(c) * 100 / sum(m) AS acc, max(m) / sum(m) AS max_letter_share FROM l GROUP BY lang
""")
def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and share of the most picked letter."""
    rows = spark.createDataFrame(ITEMS, "item_id long, lang string, question string, options array<string>, gold int")
    picks = metrics.rotations(rows).withColumn("pick", (F.col("item_id") + F.col("rotation")) % 4)
    return metrics.choice_scores(picks)


@query(f"""SELECT item_id, question || chr(10) || 'A. ' || options[1] || chr(10) || 'B. ' || options[2] || chr(10) || 'C. ' || options[3] || chr(10) || 'D. ' || options[4] AS prompt FROM {values(ITEMS, 'item_id, lang, question, options, gold')}""")
def mcq_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lettered prompts."""
    rows = spark.createDataFrame(ITEMS, "item_id long, lang string, question string, options array<string>, gold int")
    return rows.select("item_id", metrics.choice_prompt(F.col("question"), F.col("options")).alias("prompt"))


READING = [("Who came?", "A text.", "Ann", "Bob", "Cid", "Dan", "3")]


KNOWLEDGE = [("Q1", "a", "b", "c", "d", "B")]


LISTED = [("Q2", ["e", "f", "g", "h"], 3)]


@query(f"SELECT * FROM {values([('Who came?', ['Ann', 'Bob', 'Cid', 'Dan'], 2), ('Q1', ['a', 'b', 'c', 'd'], 1), ('Q2', ['e', 'f', 'g', 'h'], 3), ('Q1', ['a', 'b', 'c', 'd'], 1)], 'question, options, gold')}")
def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading and knowledge items of four layouts in one table."""
    reading = readers.reading_items(spark.createDataFrame(READING, "question string, flores_passage string, mc_answer1 string, mc_answer2 string, mc_answer3 string, mc_answer4 string, correct_answer_num string")).drop("passage")
    lettered = spark.createDataFrame(KNOWLEDGE, "question string, A string, B string, C string, D string, answer string")
    capital = spark.createDataFrame(KNOWLEDGE, "Question string, A string, B string, C string, D string, Answer string")
    return reading.unionByName(readers.knowledge_items(lettered, spark.createDataFrame(LISTED, "question string, choices array<string>, answer int"), capital))


LOGS = [
    (1, "load\n> Translate:\nHello.\n\n你好。\n[ Prompt: 3 t/s ]", 2, "你好。"),
    (2, "> Say it\nline one\nline two\n[ Prompt: 1 ]\n", 1, "line one line two"),
    (3, "> Say it\n[ Prompt: 1 ]", 1, ""),
    (4, "no prompt here\n[ Prompt: 1 ]", 1, ""),
    (5, "> cut off\nanswer", 1, ""),
]


@query(f"SELECT id, answer FROM {values([(r[0], r[3]) for r in LOGS], 'id, answer')}")
def parse_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in command-line logs."""
    rows = spark.createDataFrame([r[:3] for r in LOGS], "id int, raw string, n int")
    return rows.select("id", T.parse_cli_output(F.col("raw"), F.col("n")).alias("answer"))


CHUNKS = [(1, "Short one.\n\nShort two."), (2, "A" * 150 + ". " + "B" * 150 + ". " + "C" * 20 + "."), (3, "x" * 700), (4, "  \n\n ")]


CHUNKED = [(1, 0, "Short one."), (1, 1, "Short two."), (2, 0, "A" * 150 + "."), (2, 1, "B" * 150 + "." + "C" * 20 + "."), (3, 0, "x" * 280), (3, 1, "x" * 280), (3, 2, "x" * 140)]


@query(f"SELECT id, pos, chunk FROM {values(CHUNKED, 'id, pos, chunk')}")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and sentences packed into chunks."""
    rows = spark.createDataFrame(CHUNKS, "id int, text string")
    return rows.select("id", F.posexplode(T.split_chunks(F.col("text"))).alias("pos", "chunk"))


NUMBERS = [(1, "１，０００ 元"), (2, "about 3,952 m"), (3, "none")]


@query(f"SELECT * FROM {values([(1, '1000元', True), (2, 'about3952m', False), (3, 'none', False)], 'id, form, has')}")
def numeric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in answers after normalisation."""
    form = T.numeric_form(F.col("text"))
    return spark.createDataFrame(NUMBERS, "id int, text string").select("id", form.alias("form"), form.contains("1000").alias("has"))


@query(f"SELECT * FROM {values([(1, 0.5), (3, 0.4)], 'step, value')}")
def log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that have a loss."""
    return readers.log_series(spark.createDataFrame([(1, 0.5, None), (2, None, 0.7), (3, 0.4, None)], "step int, loss double, eval_loss double"), "loss")


#: Answers by (lang, place in the panel) with what they should get; places count from 1 in each language.
GRADED = [
    ("en", 1, "red, green, blue", True), ("en", 1, "Sure: red, green, blue", False), ("en", 2, "YES.", True), ("en", 3, "Rain fell. Lamps glowed.", True), ("en", 5, "A hot infusion of fragrant plant bits, drunk daily, brings calm to many.", True),
    ("en", 6, '{"city": "Taipei", "country": "Taiwan", "x": 1}', True), ("en", 6, '{"city": "Taipei"}', False), ("en", 6, "no json", False), ("en", 24, "2, 4, 6, 8, 10", True), ("en", 24, "1, 2, 3, 4, 5", False), ("en", 1, "", False),
    ("zhtw", 1, "芒果、香蕉、鳳梨", True), ("zhtw", 22, "一心一意\n三心二意\n五湖四海\n七上八下", True), ("zhtw", 28, "你 好 嗎", True), ("zhtw", 28, "你好嗎", False), ("ja", 27, "テレビ、ラジオ、カメラ", True), ("ja", 27, "テレビ、犬、カメラ", False),
]


@query(f"SELECT id, passed FROM {values([(i, g[3]) for i, g in enumerate(GRADED)], 'id, passed')}")
def instruction_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers graded by the rules of the instruction panel."""
    places: dict[str, list[int]] = {}
    for rule_id, lang, _ in INSTRUCTIONS:
        places.setdefault(lang, []).append(rule_id)
    answers = spark.createDataFrame([(i, places[lang][n - 1], text) for i, (lang, n, text, _) in enumerate(GRADED)], "id int, rule_id long, output string")
    return graders.grade(answers, graders.rules_table(spark, INSTRUCTIONS)).select("id", "passed")


#: Answers to items of the general panel by (rule, text) with what they should get.
KNOWN = [(1, "是玉山。", True), (2, "740 元", True), (2, "七百", False), (12, "H₂O", True), (31, "東京です。", True), (33, "約３，７７６メートル", True), (62, "It is 51.", True), (63, "def f(x): return sum(v for v in x if v % 2 == 0)", True), (60, "O", True), (60, "CO2", False), (88, "Hyper-Text Transfer Protocol", True), (89, "1, 2, 5, 9", True), (90, "", False)]


@query(f"SELECT id, passed FROM {values([(i, g[2]) for i, g in enumerate(KNOWN)], 'id, passed')}")
def general_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers graded by the rules of the general panel."""
    answers = spark.createDataFrame([(i, rule, text) for i, (rule, text, _) in enumerate(KNOWN)], "id int, rule_id long, output string")
    return graders.grade(answers, graders.rules_table(spark, GENERAL)).select("id", "passed")


@query("SELECT 7 AS n, 6 AS with_defects, 7 AS defects, 1 AS labels, 1 AS lost_words, 1 AS ghost_years, 1 AS lines, 1 AS loops, 0 AS lengths, round(200.0 / 3, 6) AS kept_pct")
def defect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the defect panel's fixture, by hand on the SQL side."""
    rows = spark.createDataFrame(OUTPUTS, "id int, src string, out string, keep array<string>")
    out = detect.defect_summary(rows.withColumn("found", detect.defects(F.col("src"), F.col("out"), F.col("keep"))))
    return out.withColumn("kept_pct", F.round("kept_pct", 6))


#: Rows that show every reason, in file order.
BITEXT = [
    ("jparacrawl.en-ja.tsv", "en", "ja", "The weather is fine today.\t今日は天気がいいです。", "kept"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "only one column", "bad_format"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "one\ttwo\tthree", "bad_format"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "The weather is fine today.\t今日は天気がいいです。", "dup"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "\t空です。", "empty"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "Same text.\tSame text.", "identical"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "♪ La la la.\tラララ。", "subtitle_noise"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "He left early\t彼は早く帰った。", "punct_asymmetric"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "Open the file API_ KEY now.\t今すぐ鍵のファイルを開いて。", "stray_space"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "A.\t一です。", "length"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "Yes it is.\tはい、それはとても長い長い説明が必要なことなのでここに書いておきます。", "ratio"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "The museum opens at nine.\tThe museum is open.", "lang_mismatch"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "Held out sentence.\t取り置きの文です。", "eval_contaminated"),
    ("jparacrawl.en-ja.tsv", "en", "ja", "(Anna) HW: - We are here.\t(アンナ)私たちはここにいます。", "kept"),
    ("kde4.en-zhtw.tsv", "en", "zhtw", "Press %1 to go on.\t按下按鈕繼續。", "preproc_dropped"),
    ("kde4.en-zhtw.tsv", "en", "zhtw", "Open the window ( main ) .\t開啟 視窗 （ 主要 ） 。", "kept"),
    ("globalvoices.en-zhtw.tsv", "en", "zhtw", "When the rain came,\t當大雨來臨時，", "preproc_dropped"),
    ("globalvoices.en-zhtw.tsv", "en", "zhtw", "The rain came in the night.\t大雨在夜裡降臨。", "kept"),
    ("opensub.en-zhtw.tsv", "en", "zhtw", "[door] Who is there?\t（敲門）誰在外面？", "kept"),
    ("ted2020.en-zhtw.tsv", "en", "zhtw", "We build small boats.\t我們造小船", "kept"),
    ("ted2020.en-zhtw.tsv", "en", "zhtw", "We build small boats\t我們造小船", "preproc_dropped"),
    ("coct.en-zhtw.tsv", "en", "zhtw", "The horse runs.\t马跑得快。", "kept"),
    ("coct.en-zhtw.tsv", "en", "zhtw", "The dragon sleeps.\t龙睡了。", "simplified_residue"),
]


BITEXT_EVAL = ["Held out sentence.", "something else"]


def _bitext(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(BITEXT)], "i long, corpus string, lang_a string, lang_b string, line string, expected string")
    from pyspark.sql import Window

    return rows.withColumn("lineno", F.row_number().over(Window.partitionBy("corpus").orderBy("i")) - 1)


def _convert_some(text):
    return F.translate(text, "马", "馬")


@query(f"SELECT corpus, expected AS reason, count(*) AS n FROM {values([(r[0], r[4]) for r in BITEXT], 'corpus, expected')} GROUP BY ALL")
def pair_filter_chain_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over rows that show every reason. The dictionary knows 马 only, so 龙 is a simplified rest."""
    evaluation = spark.createDataFrame([(x,) for x in BITEXT_EVAL], "line string")
    cleaned = clean.clean_bitext(_bitext(spark), evaluation, convert=_convert_some, simplified=lambda t: t.rlike("[马龙]"))
    return clean.reason_counts(cleaned, "corpus")


ENDS = [
    (1, "We build boats.", "我們造船", "en", "zhtw", "We build boats.", "我們造船。"),
    (2, "We build boats", "我們造船", "en", "zhtw", None, None),
    (3, "We build boats", "我們造船。", "en", "zhtw", "We build boats.", "我們造船。"),
    (4, "It ends.", "因為", "en", "zhtw", "It ends.", "因為"),
    (5, "It ends.", "終わります", "en", "ja", "It ends.", "終わります。"),
    (6, "It ends.", "終わるから", "en", "ja", "It ends.", "終わるから"),
    (7, "It ends,", "終わります。", "en", "ja", "It ends,", "終わります。"),
    (8, "Both end!", "両方終わる！", "en", "ja", "Both end!", "両方終わる！"),
]


@query(f"SELECT id, a, b FROM {values([(r[0], r[5], r[6]) for r in ENDS], 'id, a, b')}")
def restore_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing sentence ends restored where the other side has one."""
    rows = spark.createDataFrame([r[:5] for r in ENDS], "id int, x string, y string, la string, lb string")
    pair = T.restore_pair(F.col("x"), F.col("y"), F.col("la"), F.col("lb"))
    return rows.select("id", pair["a"].alias("a"), pair["b"].alias("b"))


POOLS = [("en", "zhtw", "coct.en-zhtw.tsv", 200_000), ("en", "zhtw", "globalvoices.en-zhtw.tsv", 5_426), ("en", "zhtw", "ted2020.en-zhtw.tsv", 90_000), ("en", "zhtw", "kde4.en-zhtw.tsv", 40_000), ("en", "zhtw", "opus100.en-zh.tsv", 300_000)]


@query(f"SELECT corpus, CAST(take AS BIGINT) AS take FROM {values([('coct.en-zhtw.tsv', 17787), ('globalvoices.en-zhtw.tsv', 5426), ('ted2020.en-zhtw.tsv', 15000), ('kde4.en-zhtw.tsv', 12000), ('opus100.en-zh.tsv', 17787)], 'corpus, take')}")
def recipe_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of one direction's recipe under a limit of 80,000, with pools of known sizes."""
    recipe = curate.recipe_table(spark, limit=80_000).filter("src_lang = 'en' and tgt_lang = 'zhtw'")
    ceilings = curate.quota_ceilings(recipe, spark.createDataFrame(POOLS, "src_lang string, tgt_lang string, corpus string, n long"))
    return curate.waterfill(ceilings, "src_lang", "tgt_lang", budget="sent_budget").select("corpus", "take")


SEGMENTS = [("b", i, lang, f"{lang} text {i}") for i in range(3) for lang in ("en", "ja", "zhtw")]


@query(f"""
WITH s AS (SELECT * FROM {values(SEGMENTS, 'bench, seg_id, lang, text')})
SELECT a.bench, a.seg_id, a.lang AS src_lang, b.lang AS tgt_lang, a.text AS src, CASE WHEN b.lang = 'zhtw' THEN upper(b.text) ELSE b.text END AS tgt
FROM (SELECT bench, seg_id, lang, CASE WHEN lang = 'zhtw' THEN upper(text) ELSE text END AS text FROM s) a JOIN s b ON a.bench = b.bench AND a.seg_id = b.seg_id AND a.lang <> b.lang
WHERE a.seg_id < 2
""")
def multiparallel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All directions of aligned segments, with a conversion of the Chinese side."""
    rows = spark.createDataFrame(SEGMENTS, "bench string, seg_id long, lang string, text string")
    return readers.all_directions(readers.first_segments(rows, 2), F.upper("text"))


PROMPTS = [("English", "How do I plant a tree here?", "Dig a hole first."), ("Japanese", "木の植え方を教えてください。", "まず穴を掘ります。"), ("French", "Comment planter ?", "Creusez."), ("Chinese", "請問怎麼種一棵大樹呢？", "請先挖一個很深的洞吧。")]


@query(f"SELECT CASE language WHEN 'English' THEN 'en' WHEN 'Japanese' THEN 'ja' ELSE 'zhtw' END AS lang, inputs AS prompt, targets AS reply FROM {values(PROMPTS, 'language, inputs, targets')} WHERE language <> 'French'")
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completion rows of the known languages."""
    return replay.prompt_table(spark.createDataFrame(PROMPTS, "language string, inputs string, targets string"))


DICTIONARY = {"龙": "龍", "马": "馬", "国": "國"}


PHRASES = {"软件": "軟體"}


SCRIPTS = [(1, "中国马"), (2, "软件和龙\n平安"), (3, "臺灣"), (4, "")]


@query(f"SELECT id, text FROM {values([(1, '中國馬'), (2, '軟體和龍' + chr(10) + '平安'), (3, '臺灣'), (4, '')], 'id, text')}")
def script_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion by phrases and characters of a small dictionary."""
    run = convert.converter(DICTIONARY, PHRASES)
    return spark.createDataFrame(SCRIPTS, "id int, text string").select("id", run(F.col("text")).alias("text"))


@query(f"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM {values(SCRIPTS, 'id, text')})
SELECT count(*) AS n_lines, 100.0 * avg(CASE WHEN regexp_matches(line, '[龙马国]') THEN 1.0 ELSE 0.0 END) AS leak_pct FROM l WHERE trim(line) <> ''
""")
def leak_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of lines that a conversion changes."""
    return convert.leak_by_line(spark.createDataFrame(SCRIPTS, "id int, hyp string"), convert.converter(DICTIONARY))


@query(f"SELECT 100.0 * avg(CASE WHEN regexp_matches(text, '[龙马国]') THEN 1.0 ELSE 0.0 END) AS leak_pct FROM {values(SCRIPTS, 'id, text')}")
def leak_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of segments with a simplified-only character."""
    chars = convert.simplified_only({"龍": "龙"}, DICTIONARY | {"里": "裡"})
    return convert.leak_by_set(spark.createDataFrame(SCRIPTS, "id int, hyp string"), chars)


@query("SELECT count(*) AS n, count(DISTINCT corpus) AS n_corpora FROM (VALUES ('TED2020'), ('TED2020'), ('OpenSubtitles'), ('WikiMatrix'), ('WikiMatrix'), ('TED2020'), ('Tatoeba'), ('News-Commentary'), ('News-Commentary'), ('GlobalVoices'), ('GlobalVoices'), ('KDE4'), ('KDE4'), ('KFTT'), ('OpenSubtitles'), ('OpenSubtitles')) AS t(corpus)")
def archive_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many archives of how many corpora there are to fetch."""
    return config.archives(spark).agg(F.count("*").alias("n"), F.countDistinct("corpus").alias("n_corpora"))


OPTIONS = [(i, lang, beams, grams, penalty) for i, beams, penalty in (("baseline_ship", 4.0, 1.2), ("greedy_ship_decode", 1.0, None), ("b4_lp1.0", 4.0, 1.0)) for lang, grams in (("ja", 5.0), ("en", 5.0), ("zhtw", 5.0))]


@query(f"SELECT * FROM {values(OPTIONS, 'id, lang, num_beams, grams, length_penalty')}")
def decode_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of three candidates under a run that overrides one setting."""
    o = F.col("options")
    rows = config.resolved_options(config.search_grid(spark), {"no_repeat_ngram_size": 5}).filter(F.col("id").isin("baseline_ship", "greedy_ship_decode", "b4_lp1.0"))
    return rows.select("id", "lang", o["num_beams"].alias("num_beams"), o["no_repeat_ngram_size"].alias("grams"), F.try_element_at(o, F.lit("length_penalty")).alias("length_penalty"))


#: (tag, group, item, value) of a candidate and its baselines; en->ja sits exactly on a tie band, ja->en has no value.
METRICS = [
    *[("base", "leak", d, v) for d, v in (("en->zhtw", 1.0), ("ja->zhtw", 2.0))], *[("cand", "leak", d, v) for d, v in (("en->zhtw", 1.25), ("ja->zhtw", 2.5))],
    *[("base", "comet", d, 85.0) for d in decide.NAMES], *[("cand", "comet", d, v) for d, v in zip(decide.NAMES, (85.0, 84.75, 84.5, None, 84.25, 86.0), strict=True)],
    *[("small", g, lang, 50.0) for g in ("belebele", "knowledge") for lang in decide.LANGS], *[("cand", g, lang, v) for g in ("belebele", "knowledge") for lang, v in zip(decide.LANGS, (47.0, 46.75, 60.0), strict=True)],
    *[("cand", "doc_tail", d, v) for d, v in zip(decide.NAMES, (0.80, 0.79, 0.9, 0.9, 0.9, 0.9), strict=True)], *[("cand", "doc_truncated", d, v) for d, v in zip(decide.NAMES, (5.0, 5.25, 0.0, 0.0, 0.0, 0.0), strict=True)],
    ("cand", "mere_translation", "all", 3.25),
]


INTERVALS = [("base", "cand", "zhtw->en", -0.5, 0.25, True), ("base", "cand", "en->ja", 0.125, 0.5, False)]


def _cells(spark: SparkSession) -> DataFrame:
    metrics = spark.createDataFrame(METRICS, "tag string, grp string, item string, value double")
    intervals = spark.createDataFrame(INTERVALS, "a string, b string, direction string, ci_lo double, ci_hi double, crosses_zero boolean")
    return decide.gate(metrics, intervals, "cand", "base", "small")


GATE_SQL = f"""
WITH m AS (SELECT * FROM {values(METRICS, 'tag, grp, item, value')}), ci AS (SELECT * FROM {values(INTERVALS, 'a, b, direction, ci_lo, ci_hi, crosses_zero')}),
plan AS (
  SELECT 'leak' AS grp, unnest({list(decide.LEAK_NAMES)}) AS item, 'max' AS mode, TRUE AS relative, 0.3 AS off, NULL AS band
  UNION ALL SELECT 'comet', unnest({list(decide.NAMES)}), 'min', TRUE, 0.0, 0.5
  UNION ALL SELECT g, unnest({list(decide.LANGS)}), 'min', TRUE, -3.0, NULL FROM (SELECT unnest(['belebele', 'knowledge']) AS g)
  UNION ALL SELECT 'doc_tail', unnest({list(decide.NAMES)}), 'min', FALSE, 0.8, NULL
  UNION ALL SELECT 'doc_truncated', unnest({list(decide.NAMES)}), 'max', FALSE, 5.0, NULL
  UNION ALL SELECT 'mere_translation', 'all', 'max', FALSE, 5.0, NULL),
j AS (SELECT p.*, c.value AS cand, CASE WHEN relative THEN b.value + off ELSE off END AS bound, ci.crosses_zero FROM plan p
  LEFT JOIN m c ON c.tag = 'cand' AND c.grp = p.grp AND c.item = p.item
  LEFT JOIN m b ON b.tag = CASE WHEN p.grp IN ('belebele', 'knowledge') THEN 'small' ELSE 'base' END AND b.grp = p.grp AND b.item = p.item
  LEFT JOIN ci ON ci.a = 'base' AND ci.b = 'cand' AND ci.direction = p.item AND p.grp = 'comet'),
v AS (SELECT grp, item, CASE WHEN cand IS NULL OR bound IS NULL THEN 'MISSING' WHEN mode = 'max' THEN CASE WHEN cand <= bound THEN 'PASS' ELSE 'FAIL' END WHEN cand >= bound THEN 'PASS'
  WHEN band IS NOT NULL AND cand >= bound - band THEN CASE WHEN crosses_zero IS NULL THEN 'MISSING' WHEN crosses_zero THEN 'PASS' ELSE 'FAIL' END ELSE 'FAIL' END AS verdict FROM j)
"""


@query(GATE_SQL + "SELECT * FROM v")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every gate cell."""
    return _cells(spark).select("grp", "item", "verdict")


@query(GATE_SQL + "SELECT count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE verdict = 'FAIL') AS n_fail, count(*) FILTER (WHERE verdict = 'MISSING') AS n_missing, CASE WHEN count(*) FILTER (WHERE verdict = 'FAIL') > 0 THEN 1 WHEN count(*) FILTER (WHERE verdict = 'MISSING') > 0 THEN 2 ELSE 0 END AS status FROM v")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of verdicts and the exit status."""
    return decide.gate_status(_cells(spark))


CELLS = [("baseline_ship", False), ("loops", True), ("leaks", False), ("edge", False), ("drops", False), ("tie", None), ("best", False)]


SEARCH = [
    *[("baseline_ship", d, 30.0, 1.0) for d in ("en->zhtw", "ja->en")], *[("loops", d, 40.0, 1.0) for d in ("en->zhtw", "ja->en")], ("leaks", "en->zhtw", 35.0, 1.5), ("leaks", "ja->en", 35.0, None),
    ("edge", "en->zhtw", 30.0, 1.25), ("edge", "ja->en", 30.0, None), ("drops", "en->zhtw", 40.0, 1.0), ("drops", "ja->en", 28.0, None), ("tie", "en->zhtw", 30.5, 1.0), ("tie", "ja->en", 29.5, None), ("best", "en->zhtw", 31.0, 0.5), ("best", "ja->en", 30.0, None),
]


@query(f"""
WITH c AS (SELECT * FROM {values(CELLS, 'id, loop_flag')}), m AS (SELECT * FROM {values(SEARCH, 'id, direction, chrf, leak')}),
j AS (SELECT m.*, b.chrf AS bc, b.leak AS bl FROM m LEFT JOIN m b ON b.id = 'baseline_ship' AND b.direction = m.direction),
s AS (SELECT id, avg(chrf) AS mean, coalesce(max(leak) FILTER (WHERE direction LIKE '%->zhtw'), 0.0) AS max_leak,
  bool_or(coalesce(direction LIKE '%->zhtw' AND leak > bl + 0.3, FALSE)) OR bool_or(coalesce(chrf < bc - 1.5, FALSE)) AS bad FROM j GROUP BY id),
e AS (SELECT c.id, NOT coalesce(loop_flag, FALSE) AND NOT bad AS ok, mean, max_leak FROM c JOIN s USING (id))
SELECT id, ok, mean, max_leak, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY mean DESC, max_leak, (id = 'baseline_ship')::INT DESC, id DESC) END AS place FROM e
""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that meet the constraints, in order."""
    out = decide.rank_candidates(spark.createDataFrame(CELLS, "id string, loop_flag boolean"), spark.createDataFrame(SEARCH, "id string, direction string, chrf double, leak double"))
    return out.select("id", "ok", "mean", "max_leak", "place")


BOARD = [(t, b, d, "comet", v) for t, off in (("old", 0.0), ("new", 1.5)) for b, d, v in (("flores", "en->zhtw", 85.0 + off), ("ntrex", "en->zhtw", 80.5 + off), ("wmt22", "en->zhtw", 79.0), ("flores", "ja->en", 84.0 - off))] + [("old", "alt", "ja->en", "comet", 70.0)]


@query(f"""
WITH m AS (SELECT * FROM {values(BOARD, 'tag, bench, direction, metric, value')}), d AS (SELECT direction, bench, max(value) FILTER (WHERE tag = 'new') - max(value) FILTER (WHERE tag = 'old') AS v FROM m WHERE metric = 'comet' GROUP BY ALL)
SELECT direction, max(v) FILTER (WHERE bench = 'flores') AS flores, max(v) FILTER (WHERE bench = 'ntrex') AS ntrex, max(v) FILTER (WHERE bench = 'wmt22') AS wmt22, max(v) FILTER (WHERE bench = 'alt') AS alt, max(v) FILTER (WHERE bench = 'tico19') AS tico19 FROM d GROUP BY direction
""")
def scoreboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two tags by direction and benchmark."""
    return decide.scoreboard(spark.createDataFrame(BOARD, "tag string, bench string, direction string, metric string, value double"), "comet", ["old", "new"])


@query(f"SELECT DISTINCT bench, direction, bench IN ('wmt22', 'alt', 'tico19') AND direction LIKE '%->zhtw' AS secondary FROM {values(BOARD, 'tag, bench, direction, metric, value')}")
def secondary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose references are converted."""
    rows = spark.createDataFrame(BOARD, "tag string, bench string, direction string, metric string, value double")
    return rows.select("bench", "direction", decide.secondary_cell(F.col("bench"), F.col("direction")).alias("secondary")).distinct()


OLD, NEW = [("a", "doc", 1.0), ("a", "general", 2.0), ("b", "doc", 3.0)], [("a", "doc", 9.0), ("c", "doc", 4.0)]


@query(f"WITH o AS (SELECT * FROM {values(OLD, 'tag, axis, value')}), n AS (SELECT * FROM {values(NEW, 'tag, axis, value')}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tag = o.tag AND n.axis = o.axis)")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axis replaced, the others kept."""
    schema = "tag string, axis string, value double"
    return decide.merge_results(spark.createDataFrame(OLD, schema), spark.createDataFrame(NEW, schema), "tag", "axis")


@query(f"WITH o AS (SELECT * FROM {values(OLD, 'tag, axis, value')}), n AS (SELECT * FROM {values(NEW, 'tag, axis, value')}) SELECT o.tag, o.axis, coalesce(n.value, o.value) AS value FROM o LEFT JOIN n ON o.tag = n.tag AND o.axis = n.axis")
def score_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written into results where there are any."""
    schema = "tag string, axis string, value double"
    return decide.write_back(spark.createDataFrame(OLD, schema), spark.createDataFrame(NEW, schema).withColumnRenamed("value", "score"), "value", "tag", "axis").select("tag", "axis", "value")


RUNS = [("plain", 1, "a", True, True), ("plain", 1, "b", False, False), ("chunked", 2, "a", True, False), ("chunked", 2, "b", False, True), ("both", 3, "a", True, False)]


@query(f"""
WITH r AS (SELECT strategy, min(ord) AS ord, bool_and(NOT loop_flag OR NOT critical) AS passed FROM {values(RUNS, 'strategy, ord, case_id, critical, loop_flag')} GROUP BY strategy)
SELECT strategy, passed, passed AND row_number() OVER (PARTITION BY passed ORDER BY ord) = 1 AS recommended FROM r
""")
def strategy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies whose critical cases do not loop."""
    return decide.strategy_verdicts(spark.createDataFrame(RUNS, "strategy string, ord int, case_id string, critical boolean, loop_flag boolean"))


@query("SELECT TRUE AS same")
def winner_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped settings against the winner's; a null penalty is 1.0."""
    schema = "decode string, beams int, length_penalty double"
    return decide.winner_matches(spark.createDataFrame([("greedy", 4, 1.0)], schema), spark.createDataFrame([("greedy", 4, None)], schema))
