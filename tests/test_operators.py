"""Edges of the operators: bounds, gaps, one-sided marks, missing values, invariants."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from siftwright.functions import text as T
from siftwright.operators import clean, convert, curate, decide, detect, graders, metrics, panels, replay
from siftwright.sources import readers, writers


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [("a​ b\x07", "a b"), ("日本　語", "日本語"), ("我 們 abc", "我們 abc"), ("「好」 ，是", "「好」，是"), ("é", "é"), ("  ", "")])
def test_normalize(spark, raw, expected):
    assert one(spark, raw, T.normalize) == expected


@pytest.mark.parametrize("raw,expected", [("(Ann) hello", "hello"), ("HW:: - (x) text", "text"), ("I said: stop", "I said: stop"), ("- - - -a", "-a"), ("Name: A: B: C: d", "C: d"), ("（安）好", "好")])
def test_speaker_marks(spark, raw, expected):
    assert one(spark, raw, T.strip_speaker_marks) == expected


@pytest.mark.parametrize("raw,expected", [("Open ( it ) , now", "Open (it), now"), ("100 %", "100%"), ("開啟 視窗", "開啟視窗")])
def test_detokenize(spark, raw, expected):
    assert one(spark, raw, T.detokenize) == expected


@pytest.mark.parametrize("raw,n", [("abc", 3), ("漢字", 4), ("aカ", 3), ("", 0)])
def test_effective_length(spark, raw, n):
    assert one(spark, raw, T.effective_length) == n


@pytest.mark.parametrize("text,lang,ok", [("漢字", "ja", False), ("漢字かな", "ja", True), ("かな", "zhtw", False), ("漢字", "zhtw", True), ("mixed 漢", "en", False), ("plain", "en", True), ("ééééé", "en", False)])
def test_valid_language(spark, text, lang, ok):
    assert one(spark, text, lambda x: T.valid_language(x, F.lit(lang))) is ok


def test_unknown_language_is_an_error(spark):
    with pytest.raises(Exception, match="unknown language"):
        one(spark, "x", lambda x: T.valid_language(x, F.lit("xx")))


def test_reasons_add_up(spark):
    from tests.literals import BITEXT, BITEXT_EVAL, _bitext

    cleaned = clean.clean_bitext(_bitext(spark), spark.createDataFrame([(x,) for x in BITEXT_EVAL], "line string"))
    counts = {r["reason"]: r["n"] for r in clean.reason_counts(cleaned.withColumn("all", F.lit(1)), "all").collect()}
    assert sum(counts.values()) == len(BITEXT)
    kept = cleaned.filter("reason = 'kept'").select("lineno", "a").collect()
    assert ("We are here.") in {r["a"] for r in kept}


def test_copies_of_a_pair_keep_the_first(spark):
    rows = spark.createDataFrame([("c.x", i, "Same text here.\tGleicher Text hier.", "en", "en") for i in (9, 3, 67, 131, 5)], "corpus string, lineno long, line string, lang_a string, lang_b string")
    got = clean.clean_bitext(rows, spark.createDataFrame([], "line string"), compose=False)
    assert [r["lineno"] for r in got.filter("reason = 'kept'").collect()] == [3] and got.filter("reason = 'dup'").count() == 4


def test_documents_break_at_gaps_and_open_ends(spark):
    rows = [(i, f"line {i}.", f"zeile {i}.") for i in range(40) if i != 12]
    rows = [(i, a if i != 25 else "open", b) for i, a, b in rows]
    docs = curate.build_documents(spark.createDataFrame([("c", *r) for r in rows], "corpus string, lineno long, a string, b string"), "corpus").collect()
    for d in docs:
        lines = [int(x.split()[1][:-1]) for x in d["a"].split("\n")]
        assert 4 <= len(lines) <= 16 and lines == list(range(lines[0], lines[0] + len(lines))) and 12 not in lines and 25 not in lines
        assert d["b"].count("\n") == len(lines) - 1 and d["first_line"] == lines[0]


def test_long_runs_are_cut_without_loss(spark):
    rows = spark.range(200_001).select(F.lit("c").alias("corpus"), F.lit(None).cast("int").alias("other"), (F.col("id") + 7).alias("lineno"), F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(".")).alias("a")).repartition(4)
    docs = curate.build_documents(rows, "corpus", "other", sides=("a",)).orderBy("part").collect()
    assert [d["part"] for d in docs] == list(range(len(docs)))
    at = 7
    for d in docs:
        drawn = int(hashlib.sha256(f"42|c|{d['island']}|{at - 7}".encode()).hexdigest()[:8], 16) % 13 + 4
        assert d["first_line"] == at and d["n_lines"] == min(drawn, 200_008 - at) and d["a"].split("\n")[0] == f"line {at - 7}."
        at += d["n_lines"]
    assert 200_008 - at < 4


def test_ranks_equal_a_window(spark):
    rows = spark.range(500).withColumn("g", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3))
    got = {r["id"]: (r["rn"], r["n"]) for r in curate.hash_ranks(rows, 1, F.col("id"), "g", total="n").collect()}
    from pyspark.sql import Window

    w = Window.partitionBy("g")
    expected = rows.withColumn("rn", F.row_number().over(w.orderBy(T.hash_order(1, F.col("id"))))).withColumn("n", F.count("*").over(w))
    assert got == {r["id"]: (r["rn"], r["n"]) for r in expected.collect()}


@pytest.mark.parametrize("ceilings,budget", [([10, 10, 10], 9), ([1, 100, 2], 60), ([5, 5], 100), ([3], 0), ([8500, 3, 9000], 100)])
def test_waterfill(spark, ceilings, budget):
    rows = spark.createDataFrame([("d", i, c, budget) for i, c in enumerate(ceilings)], "dir string, ord int, ceiling long, budget long")
    takes = {r["ord"]: r["take"] for r in curate.waterfill(rows, "dir").collect()}
    assert sum(takes.values()) == min(budget, sum(ceilings)) and all(takes[i] <= c for i, c in enumerate(ceilings))
    if ceilings == [8500, 3, 9000]:
        assert takes == {0: 48, 1: 3, 2: 49}


def test_alignment_filter_failures(spark):
    rows = spark.createDataFrame([("c", i) for i in range(10)], "corpus string, lineno long")
    scores = spark.createDataFrame([("c", i, 0.65 if i % 2 else 0.64) for i in range(10)], "corpus string, lineno long, score double")
    assert {r["lineno"] for r in curate.alignment_filter(rows, scores).collect()} == {1, 3, 5, 7, 9}
    assert curate.alignment_filter(rows, None, 0).count() == 10
    with pytest.raises(FileNotFoundError):
        curate.alignment_filter(rows, None)
    with pytest.raises(ValueError, match="less than"):
        curate.alignment_filter(rows, scores.filter("lineno < 9"))


def test_halves_and_one_way(spark):
    rows = spark.createDataFrame([(c, i, f"a{i}", f"b{i}", "en", "ja") for c in ("x", "opensub.en-ja.tsv") for i in range(11)], "corpus string, i long, a string, b string, lang_a string, lang_b string")
    got = curate.direction_halves(rows, F.col("i"), "corpus", one_way={"opensub.en-ja.tsv": ("ja", "en")}).collect()
    assert sum(r["src_lang"] == "en" for r in got if r["corpus"] == "x") == 5
    assert {(r["src_lang"], r["src"][0]) for r in got if r["corpus"] != "x"} == {("ja", "b")}


def test_packing(spark):
    items = spark.createDataFrame([(i, 1 + (i * 37) % 200) for i in range(100)], "id long, length long")
    got = curate.pack_by_length(items, budget=500).collect()
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r["length"])
    assert len(got) == 100 and all(max(b) * len(b) <= 500 or len(b) == 1 for b in batches.values())


@pytest.mark.parametrize("seed,budget", [(1, 500), (2, 37), (3, 4000)])
def test_packing_equals_one_pass_in_order(spark, seed, budget):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 1, 3, 9, 9, 9, 40, 600])) for i in range(400)]
    got = {r["id"]: r["batch"] for r in curate.pack_by_length(spark.createDataFrame(rows, "id long, g string, length long"), "length", "id", budget, "g").collect()}
    for g in ("a", "b", None):
        batch, n = 0, 0
        for size, i in sorted((size, i) for i, own, size in rows if own == g):
            if n and size * (n + 1) > budget:
                batch, n = batch + 1, 0
            n += 1
            assert got[i] == batch


def test_records_that_fit_are_whole(spark):
    rows = spark.createDataFrame([("a", 1408), ("a", 1409), ("b", None)], "split string, n int")
    assert [r["n"] for r in curate.fitting(rows, F.col("n")).collect()] == [1408]
    assert sorted(map(tuple, curate.fitting_counts(rows, F.col("n"), "split").collect())) == [("a", 2, 1, 1), ("b", 1, 0, 1)]


@pytest.mark.parametrize("text,ok", [("漢字漢字漢", True), ("漢字", False), ("plain text", False), ("漢" * 4001, False), ("国字国字国", False), (None, False)])
def test_usable_replies(spark, text, ok):
    assert one(spark, text, lambda t: replay.usable(t, lambda x: F.translate(x, "国", "國") != x)) is ok


@pytest.mark.parametrize("direction,target", [("en2zhtw", "zhtw"), ("a2b2c", "b2c"), ("none", None), (None, None)])
def test_target_of_a_direction(spark, direction, target):
    assert one(spark, direction, detect.target_of) == target


def test_prompt_completion(spark):
    rows = spark.createDataFrame([([("user", "q"), ("assistant", "a")],)], readers.RECORD)
    r = curate.prompt_completion(rows).first()
    assert [m["content"] for m in r["prompt"]] == ["q"] and [m["content"] for m in r["completion"]] == ["a"]
    assert curate.replay_count(100, 0.35) == 53


def test_best_reply_edges(spark):
    rows = [("p", None, "prompter", "ask", "zh-TW", None, False, 0), ("r1", "p", "assistant", "none", "zh", None, False, 1), ("r2", "p", "assistant", "first", "zh", 0, False, 2), ("r3", "p", "assistant", "tie", "zh", 0, False, 3), ("r4", "p", "assistant", "gone", "zh", 0, True, 0), ("q", None, "prompter", "x", "fr", None, False, 5)]
    assert [(r["lang"], r["reply"]) for r in replay.best_replies(spark.createDataFrame(rows, readers.NODE)).collect()] == [("zhtw", "first")]


def test_array_pairs(spark):
    rows = spark.createDataFrame([([("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("user", "q3"), ("assistant", "a3")],), ([("user", "only")],), ([],)], "conversations array<struct<role:string,content:string>>")
    assert sorted((r["prompt"], r["reply"]) for r in replay.array_turn_pairs(rows).collect()) == [("q1", "a1"), ("q3", "a3")]


def test_reply_cleaning(spark):
    rows = spark.createDataFrame([("en", "Please translate this for me", "ok then, here it is"), ("ja", "漢字だけではない文です。", "これはとても長い返事です。"), ("ja", "漢字漢字漢字漢字漢字漢字", "返事返事返事返事返事返事"), ("en", "short", "a long enough answer"), ("en", "line one line two", "a long enough answer")], "lang string, prompt string, reply string")
    got = [(r["reason"], r["prompt"]) for r in replay.emit(rows).collect()]
    assert [g[0] for g in got] == ["drop_translation_prompt", "kept", "drop_clean", "drop_clean", "kept"] and got[4][1] == "line one\nline two"


@pytest.mark.parametrize("text,loop", [("go away go away go away go away", True), ("A sentence that says every thing once.", False), ("abcabcabcabc", False), ("xyzxyz the end of it is here xyzxyz now xyzxyz", True), (None, False)])
def test_repetition_loop(spark, text, loop):
    assert (one(spark, text, detect.repetition_loop) is not None) is loop


def test_loop_stats_of_short_and_looping_texts(spark):
    short = one(spark, "abc", detect.loop_stats)
    assert (short["loop_flag"], short["chars"], short["unique_line_ratio"]) == (False, 3, 1.0)
    looping = one(spark, "it's gone and over. " * 6, detect.loop_stats)
    assert looping["loop_flag"] and looping["max_sentence_count"] == 6 and looping["regex_multi_repeat"] == 1


def test_upper_median_and_positions(spark):
    assert one(spark, [4, 1, 3, 2], T.upper_median, "array<int>") == 3 and one(spark, [], T.upper_median, "array<int>") is None
    assert one(spark, list(range(100)), lambda x: metrics.positional(x, 0.95), "array<int>") == 95


def test_alignment_edges(spark):
    rows = spark.createDataFrame([("a", "x\ny\nz", "p\nq\nr"), ("b", "x\ny\n", "p\nq\nr"), ("c", "x\ny\nz\njunk", "p\nq\nr"), ("d", "x", "p")], "k string, hyp string, ref string")
    got = {r["k"]: (r["line_ratio_median"], r["tail_ratio_median"]) for r in metrics.document_alignment(rows, "k").collect()}
    assert got["a"] == (1.0, 1.0) and got["b"][1] == 0.0 and got["c"] == (pytest.approx(4 / 3), 5.0) and got["d"] == (1.0, None)


def test_chrf_and_bleu_by_hand(spark):
    same = spark.createDataFrame([("the cat sat on the mat.", "the cat sat on the mat.")], "hyp string, ref string")
    assert metrics.chrf(same).first()["chrf"] == pytest.approx(100)
    none = spark.createDataFrame([("abc", "xyz")], "hyp string, ref string")
    assert metrics.chrf(none).first()["chrf"] == 0
    words = spark.createDataFrame([("ab", "ab cd")], "hyp string, ref string")
    precision, recall = (1 + 1 + 1) / 3, (2 / 4 + 1 / 3 + 1 / 2) / 3  # characters 1 and 2, words 1; longer orders have no hypothesis grams
    assert metrics.chrf(words).first()["chrf"] == pytest.approx(100 * 5 * precision * recall / (4 * precision + recall))
    tokens = lambda a, b: spark.createDataFrame([(a.split(), b.split())], "hyp_tokens array<string>, ref_tokens array<string>")
    assert metrics.bleu(tokens("a b c d e", "a b c d e")).first()["bleu"] == pytest.approx(100)
    assert metrics.bleu(tokens("x y z w", "a b c d")).first()["bleu"] == 0
    assert one(spark, "It costs 3.50, ok?", metrics.tokens_13a) == ["It", "costs", "3.50", ",", "ok", "?"]


def test_bootstrap_needs_equal_segments(spark):
    a = spark.createDataFrame([(i, "s", "r", 0.5) for i in range(4)], "seg_id long, src string, ref string, score double")
    b = a.withColumn("score", F.lit(0.75))
    diffs = metrics.paired_segments(a, b).withColumnRenamed("seg_id", "i")
    row = metrics.paired_bootstrap(diffs, 50).first()
    assert (row["n"], row["delta"], row["ci_lo"], row["crosses_zero"], row["p_b_better"]) == (4, 25.0, 25.0, False, 1.0)
    with pytest.raises(Exception, match="differ in source"):
        metrics.paired_segments(a, b.withColumn("src", F.lit("t"))).collect()


def test_rotations_visit_every_place(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c", "d"], 2)], "item_id long, options array<string>, gold int")
    got = metrics.rotations(rows).collect()
    assert sorted(r["gold"] for r in got) == [0, 1, 2, 3] and all(r["options"][r["gold"]] == "c" for r in got)


@pytest.mark.parametrize("cand,bound,mode,band,expected", [(1.0, 1.0, "max", None, "PASS"), (1.01, 1.0, "max", None, "FAIL"), (1.0, 1.0, "min", None, "PASS"), (0.5, 1.0, "min", 0.5, "TIE?"), (0.49, 1.0, "min", 0.5, "FAIL"), (None, 1.0, "min", 0.5, "MISSING"), (1.0, None, "max", None, "MISSING")])
def test_verdicts(spark, cand, bound, mode, band, expected):
    assert one(spark, cand, lambda x: decide.verdict(x, F.lit(bound).cast("double"), F.lit(mode), F.lit(band).cast("double")), "double") == expected


def test_gate_without_any_metric_is_missing(spark):
    metrics_ = spark.createDataFrame([], "tag string, grp string, item string, value double")
    ci = spark.createDataFrame([], "a string, b string, direction string, ci_lo double, ci_hi double, crosses_zero boolean")
    status = decide.gate_status(decide.gate(metrics_, ci, "c", "b")).first()
    assert (status["n_pass"], status["n_fail"], status["n_missing"], status["status"]) == (0, 0, 27, 2)


def test_ranking_needs_a_baseline_and_may_have_no_winner(spark):
    cells = spark.createDataFrame([("x", True)], "id string, loop_flag boolean")
    rows = spark.createDataFrame([("x", "en->ja", 1.0, None)], "id string, direction string, chrf double, leak double")
    with pytest.raises(Exception, match="no baseline"):
        decide.rank_candidates(cells, rows).collect()
    both = cells.unionByName(spark.createDataFrame([("baseline_ship", True)], "id string, loop_flag boolean"))
    assert [r["place"] for r in decide.rank_candidates(both, rows).collect()] == [None, None]


@pytest.mark.parametrize("panel", [panels.INSTRUCTIONS, panels.GENERAL])
def test_panels_fail_vacuous_answers(spark, panel):
    rules = graders.rules_table(spark, panel)
    junk = ["", " ", "\n", "I cannot answer that.", "...", "？", "申し訳ありません。", "-"]
    answers = spark.createDataFrame([(i, j) for i, *_ in panel for j in junk], "rule_id long, output string")
    passed = graders.grade(answers, rules, simplified="龙").filter("passed").select("rule_id", "output").collect()
    assert len(panel) == 90 and not [r for r in passed if r["output"].strip() in ("", "...", "-")]


def test_graders_know_traditional_text_by_a_set(spark):
    rules = graders.rules_table(spark, [(1, "zhtw", [("traditional",)])])
    answers = spark.createDataFrame([(1, "龍"), (1, "龙")], "rule_id long, output string")
    assert {r["output"]: r["passed"] for r in graders.grade(answers, rules, simplified="龙").collect()} == {"龍": True, "龙": False}
    assert not any(r["passed"] for r in graders.grade(answers, rules).collect())


def test_conversion_takes_the_longest(spark):
    run = convert.converter({"软": "軟"}, {"软件": "軟體", "软件包": "套件"})
    assert one(spark, "软件包和软件，软", run) == "套件和軟體，軟" and one(spark, None, run) is None
    assert convert.simplified_only({"龍": "龙"}, {"龙": "龍", "群": "羣"}) == "龙"
    old = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, leak_pct double")
    new = spark.createDataFrame([("x", 1.0), ("y", 2.5)], "k string, leak_pct double")
    assert [(r["k"], r["delta"]) for r in convert.rescored(old, new, "k").collect()] == [("y", 0.5)]


def test_numbered_lines_and_pairs(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("".join(f"a{i}\tb{i}\n" for i in range(1000)) + "bad\n", encoding="utf-8")
    rows = readers.bitext_file(spark, str(path), "x", "en", "ja")
    assert [r["lineno"] for r in rows.orderBy("lineno").collect()] == list(range(1001))
    three = spark.createDataFrame([("1\tsame\tsame",), ("2\tja\ten",), ("3\tx",)], "line string")
    assert [tuple(r) for r in readers.three_columns(three).collect()] == [("en", "ja")]
    left, right = spark.createDataFrame([(0, "a"), (1, "b")], "lineno long, line string"), spark.createDataFrame([(0, "c")], "lineno long, line string")
    with pytest.raises(Exception, match="differ in length"):
        readers.line_aligned(left, right).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.evaluation_lines(spark, str(tmp_path / "missing.txt")).collect()


def test_files_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("a\tb", "c\r"), ("", "x"), ("說明", "説明")], "a string, b string")
    writers.write_pairs(pairs, str(tmp_path / "pairs"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "pairs")).collect()) == sorted(["a b\tc", "說明\t説明"])
    records = spark.createDataFrame([([("user", "one two")],)], readers.RECORD)
    writers.write_records(records, str(tmp_path / "records"))
    assert readers.jsonl(spark, str(tmp_path / "records")).first()["messages"][0]["content"] == "one two"
    segments = spark.createDataFrame([(1, "b\nc"), (0, "a")], "seg_id long, hyp string")
    writers.write_segments(segments.coalesce(1), str(tmp_path / "hyp"), "hyp")
    assert {r["value"] for r in spark.read.text(str(tmp_path / "hyp")).collect()} == {"a", "b c"}
    scores = spark.createDataFrame([("c", 0, 0.5)], readers.ALIGNMENT)
    for force, value in ((False, 0.5), (False, 0.5), (True, 0.25)):
        writers.write_scores(scores.withColumn("score", F.lit(value if force else 0.5).cast("float")), str(tmp_path / "scores"), force)
        assert spark.read.parquet(str(tmp_path / "scores")).first()["score"] == value
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    assert json.loads(writers.statistics_json(counts, F.col("k")).first()["json"]) == {"a": 1, "b": 2}


def test_result_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "v1-flores.json").write_text(json.dumps({"results": {"en->ja": {"comet": 85.5, "bleu": None}}}))
    rows = readers.result_files(spark, str(tmp_path), "v1").collect()
    assert {(r["bench"], r["direction"], r["metric"], r["value"]) for r in rows} == {("flores", "en->ja", "comet", 85.5), ("flores", "en->ja", "bleu", None)}
    (tmp_path / "v1-flores.json").write_text(json.dumps({"results": {"en->ja": {"comet": 1.0}}}))
    with pytest.raises(Exception, match="two files"):
        readers.result_files(spark, str(tmp_path), "v1").collect()


def test_reports_are_read_back(spark, tmp_path):
    scores = spark.createDataFrame([("en->ja", "chrf", 29.5), ("en->ja", "leak", None), ("ja->en", "chrf", 30.0)], "direction string, metric string, value double")
    document = writers.run_result(scores, "v1-flores", "flores", 500, model="m", gen={"num_beams": 4}, defaults={"ja": {"length_penalty": 1.2}})
    writers.write_json(document, str(tmp_path / "run"))
    text = spark.read.text(str(tmp_path / "run")).first()["value"]
    found = json.loads(text)
    assert (found["tag"], found["n"], found["adapter"], found["gen"], found["decode_defaults"]) == ("v1-flores", 500, None, {"num_beams": "4"}, {"ja": {"length_penalty": "1.2"}})
    assert found["results"] == {"en->ja": {"chrf": 29.5, "leak": None}, "ja->en": {"chrf": 30.0}}
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "v1-flores.json").write_text(text)
    assert {(r["direction"], r["metric"], r["value"]) for r in readers.result_files(spark, str(tmp_path / "results"), "v1").collect()} == {tuple(r) for r in scores.collect()}

    intervals = spark.createDataFrame([("base", "v1", "en2ja", 10, 0.12345, 0.01, 0.2, 0.99, False), ("base", "v2", "en2ja", 10, -0.5, -0.7, 0.1, 0.1, True)], "a string, b string, direction string, n long, delta double, ci_lo double, ci_hi double, p_b_better double, crosses_zero boolean")
    writers.write_named(writers.bootstrap_records(intervals), str(tmp_path / "boot"))
    named = {r["name"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "boot")).collect()}
    assert named["base__v1__en2ja"]["delta"] == 0.1235 and named["base__v1__en2ja"]["better"] == "b" and named["base__v2__en2ja"]["better"] == "none"

    ranking = spark.createDataFrame([(2, "x", 29.0), (1, "y", 30.0)], "rank int, candidate string, mean double")
    cells = spark.createDataFrame([("x", "chrf", 29.0), ("y", "chrf", 30.0)], "candidate string, metric string, value double")
    found = json.loads(writers.ranking_report(ranking, cells).first()["json"])
    assert [c["candidate"] for c in found["ranking"]] == ["y", "x"] and found["cells"] == {"x": {"chrf": 29.0}, "y": {"chrf": 30.0}}

    pairs = spark.createDataFrame([(1, "en->ja", "It rained.", "據報導，下雨了。"), (2, "en->ja", "One.\nTwo.", "一。")], "k int, direction string, src string, tgt string")
    both = detect.both_orientations(spark.createDataFrame([("It rained.", "據報導，下雨了。", "en", "zhtw")], "a string, b string, lang_a string, lang_b string")).withColumnRenamed("tgt_lang", "direction")
    found = json.loads(writers.audit_report(detect.audit_counts(pairs, "direction"), detect.audit_denominators(pairs, "direction"), detect.audit_samples(pairs, "k"), detect.audit_counts(both, "direction"), skipped=3).first()["json"])
    assert found["totals"] == {"en->ja": 2} and found["counts"]["en->ja"]["D/多行壓扁"] == 1 and found["replay_skipped"] == 3
    assert found["denominators"]["en->ja"]["multi_line"] == 1 and found["samples"]["D/多行壓扁"][0]["k"] == 2 and found["raw"]["zhtw"] == {"A/narrate:據報導": 1}

    rows = spark.createDataFrame([(2, ["loop"], []), (1, [], ["RTX"])], "id int, found array<string>, keep array<string>")
    writers.write_defects(detect.defect_summary(rows), rows, str(tmp_path / "defects"))
    summary, cases = readers.stored_defects(spark, str(tmp_path / "defects"), "n long, with_defects long", "id int, found array<string>, keep array<string>")
    assert tuple(summary.first()) == (2, 1) and sorted(map(tuple, cases.collect())) == [(1, [], ["RTX"]), (2, ["loop"], [])]
    assert len(spark.read.text(str(tmp_path / "defects" / "cases")).collect()) == 2


def test_files_of_pairs_and_cases(spark, tmp_path):
    spark.createDataFrame([("hello", "你好")], "sourceString string, targetString string").write.parquet(str(tmp_path / "pairs"))
    assert [tuple(r) for r in readers.parquet_pairs(spark, str(tmp_path / "pairs")).collect()] == [("hello", "你好")]
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"case_id": "c1", "source": "a.txt", "targets": ["en", "ja"]}, {"case_id": "c2", "source": "b.txt", "targets": []}]}, indent=1))
    assert sorted(map(tuple, readers.case_manifest(spark, str(tmp_path / "cases.json")).collect())) == [("c1", "a.txt", "en"), ("c1", "a.txt", "ja")]


def test_leak_shares_are_scored_again(spark):
    frame = lambda rows: spark.createDataFrame(rows, "d string, leak_pct double")
    got = convert.rescored(frame([("a", 1.0), ("b", 2.0), ("c", None)]), frame([("a", 1.0), ("b", 2.5), ("c", 3.0)]), "d").collect()
    assert sorted((r["d"], r["old"], r["new"], r["delta"]) for r in got) == [("b", 2.0, 2.5, 0.5), ("c", None, 3.0, None)]


def test_upper_medians_of_groups(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, 1.0, 2.5, 7.0, rng.random()])) for k in "abc" for _ in range(rng.randrange(1, 30))] + [("d", None)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(metrics.upper_median("x").alias("m")).collect()}
    for k in "abcd":
        own = sorted(x for g, x in rows if g == k and x is not None)
        assert got[k] == (own[len(own) // 2] if own else None)


def test_hashed_grams_equal_slices(spark):
    from collections import Counter

    from siftwright.functions import grams

    rng = random.Random(6)
    texts = [None, "", "ab", "aaaaaaaaaaaa", "日本語日本語日本語"] + ["".join(rng.choice("abc \n") for _ in range(rng.randrange(200))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "id int, t string, o string").repartition(3)
    got = {r["id"]: r for r in docs.select("id", grams.repeated_share(F.col("t"), 3).alias("share"), grams.character_overlaps(F.col("t"), F.col("o"), 2).alias("c"), grams.word_overlaps(F.split("t", " "), F.split("o", " "), 2).alias("w")).collect()}
    for i, t in enumerate(texts):
        windows = [t[k : k + 3] for k in range(len(t or "") - 2)] if t else []
        assert got[i]["share"] == (None if t is None else pytest.approx(1 - len(set(windows)) / len(windows)) if windows else 0.0)
        for name, of in (("c", lambda x: x or ""), ("w", lambda x: [] if x is None else x.split(" "))):
            for n, cell in enumerate(got[i][name], 1):
                a, b = (Counter(tuple(u[k : k + n]) for k in range(len(u) - n + 1)) for u in (of(t), of(texts[-1 - i])))
                assert tuple(cell) == (n, (a & b).total(), a.total(), b.total())


def test_sources_of_other_layouts(spark):
    judged = spark.createDataFrame([("a", "b", True, True), ("c", "d", True, False)], "english string, japanese string, model1_accepted boolean, model2_accepted boolean")
    assert [tuple(r) for r in readers.judged_pairs(judged).collect()] == [("a", "b")]
    nested = spark.createDataFrame([(("x", "y"),)], "translation struct<en:string,zh:string>")
    assert tuple(readers.translation_struct(nested, "en", "zh").first()) == ("x", "y")
    named = spark.createDataFrame([("中", "Z")], "chinese_zh string, English string")
    assert readers.inferred_english(named).columns == ["en", "other"]
    assert readers.corpora(spark).count() == 20
    full = spark.createDataFrame([("a", "b", "c"), ("a", "", "c"), ("a", None, "c")], "en string, ja string, zh string")
    assert readers.complete_rows(full, "en", "ja", "zh").count() == 1


def test_broadcast_of_the_evaluation_set(spark):
    lines = spark.createDataFrame([("x",)], "line string")
    plan = clean.mark_contaminated(spark.createDataFrame([("x",), ("y",)], "a string"), lines, "a")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    assert clean._bounded(lines, 10) is lines


def test_stream_keeps_each_pair_once(spark, tmp_path):
    from siftwright.streaming.cleaner import clean_stream

    rows = spark.createDataFrame([("2024-01-01 00:00:00", "One line here.", "Eine Zeile hier."), ("2024-01-01 00:01:00", "One line here.", "Eine Zeile hier."), ("2024-01-01 00:02:00", "same", "same")], "ts string, a string, b string")
    rows.select(F.to_timestamp("ts").alias("ts"), "a", "b").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, a string, b string").parquet(str(tmp_path / "in"))
    run = clean_stream(stream).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("kept").count() == 1


def test_containing_finds_items_beside_other_characters(spark):
    from siftwright.plans.corpus import containing

    items = [(1, "As it was in the beginning"), (2, "it was"), (3, " as it  was then"), (4, "ginning of all things"), (5, ""), (6, None), (7, "one two three"), (8, "日本")]
    texts = ['"As it was in the beginning"', "(As it was in the beginning, of all", "x as it  was then.", "beginning of all things!", "one two three, four", "-one two threefold", "in 日本語", "", None, "As it was in", '"As it was in the beginning"']
    rows = [(i % 10, t) for i, t in enumerate(texts)]
    expected = sorted((d, i) for d, t in rows for i, item in items if t is not None and item is not None and item in t)
    docs, bench = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, item string")
    for block_bytes in (16 << 20, 20):
        assert sorted(map(tuple, containing(docs, bench, block_bytes).collect())) == expected
    assert containing(docs, bench.filter("false")).count() == 0
