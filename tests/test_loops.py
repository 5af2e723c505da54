"""Loops against the patterns with back-references that define them, and in linear time."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwright.functions import loops
from siftwright.operators import detect


def slow_loop(text):
    t = re.sub(r"\s+", "", text or "")
    if len(t) < 16:
        return None
    if m := re.search(r"(.{4,24}?)\1+", t, re.DOTALL):
        return m.group(1)
    seen = Counter()
    for i in range(len(t) - 5):
        seen[t[i : i + 6]] += 1
        if seen[t[i : i + 6]] == 3:
            return t[i : i + 6]
    return None


def slow_facts(text):
    text = text or ""
    sentences = Counter(x.strip() for x in re.split(r"(?<=[。．.!?\n])\s*", text) if len(x.strip()) >= 8)
    windows = Counter(text[i : i + 20] for i in range(len(text) - 19))
    lines = [x for x in text.splitlines() if x.strip()]
    (s, n), (w, m) = (c.most_common(1)[0] if c else (None, 0) for c in (sentences, windows))
    return {"sentence_n": n, "sentence": s, "window_n": m, "window": w, "blocks": len(re.findall(r"(.{12,80}?)\1{3,}", text)), "lines": len(lines), "different_lines": len(set(lines))}


def texts():
    rng = random.Random(8)
    made = [None, "", "x", "a" * 400, "ab" * 300, "abc\n" * 90, "日本語の文。" * 30, "x" * 15, "x" * 16, "\U0001f600é" * 40]
    for _ in range(300):
        alphabet = rng.choice(["ab", "abc ", "abcdefgh .\n", "日本語 。"])
        made.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(300))))
    for size in (*range(3, 27), *range(11, 83)):
        block = "".join(rng.choice("abcdefghijklmnop") for _ in range(size))
        for times in (2, 3, 4, 5, 9):
            made.append("start of it " + block * times + block[: size // 2] + rng.choice(["", "\n", " end. "]) + block[::-1] * rng.choice([1, 4]))
    return made


def test_loops_equal_patterns():
    made = texts()
    assert loops.find_loops(made) == [slow_loop(t) for t in made]
    assert loops.loop_facts(made) == [slow_facts(t) for t in made]


def test_small_chunks_do_not_matter(monkeypatch):
    made = texts()[:200]
    whole = loops.find_loops(made), loops.loop_facts(made)
    monkeypatch.setattr(loops.chunks, "__defaults__", (50,))
    assert (loops.find_loops(made), loops.loop_facts(made)) == whole


def test_columns(spark):
    made = texts()[:60]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string").repartition(3)
    got = rows.select("i", detect.repetition_loop(F.col("t")).alias("loop"), detect.loop_stats(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["loop"] for r in got] == [slow_loop(t) for t in made]
    for r, t in zip(got, made, strict=True):
        facts, s = slow_facts(t), r["s"]
        if len(t or "") < 12:
            assert (s["max_phrase_count"], s["worst_phrase"], s["unique_line_ratio"], s["loop_flag"], s["regex_multi_repeat"]) == (0, "", 1.0, False, 0) and s["chars"] == (None if t is None else len(t))
        else:
            assert (s["max_sentence_count"], s["max_window20_count"], s["regex_multi_repeat"]) == (facts["sentence_n"], facts["window_n"], facts["blocks"])
            assert s["unique_line_ratio"] == pytest.approx(facts["different_lines"] / max(facts["lines"], 1))
            flag = facts["sentence_n"] >= 4 or facts["window_n"] >= 8 or facts["blocks"] > 0 or (facts["sentence_n"] >= 3 and len(facts["sentence"]) >= 12)
            assert s["loop_flag"] == flag and s["max_phrase_count"] == max(facts["sentence_n"], facts["window_n"])


def test_time_is_linear():
    took = []
    for n in (200_000, 800_000):
        text = ("a" * 23 + "b") * (n // 48) + "".join(random.Random(1).choice("ab") for _ in range(n // 2))
        began = time.perf_counter()
        loops.find_loops([text])
        loops.loop_facts([text])
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


def test_flags_of_odd_texts_equal_sql(spark, tmp_path):
    import duckdb

    from siftwright.plans import loops as plans

    short, long = "nine char.", "a sentence of more than twelve."
    made = [
        None,
        "",
        f"{short} {long} " * 3,  # the first of two equally frequent sentences is short
        f"{long} {short} " * 3,
        f"{short} " * 3,
        f"{long}　{long}　{long}",  # only ASCII's white space is left out
        f"seven c . x{long}  y" * 3,
        f"{long}\x0b{long}\x1c{long}\x85{long}",
        f"{long[:-1]}\x01" * 3,
        f"{long}\r\n\f{long}\n\n\t{long}",
    ]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(plans.CATALOG.sql["loop_flags"]).fetchall()
    got = [tuple(r) for r in plans.loop_flags(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {2, 3} <= {r[0] for r in got}
