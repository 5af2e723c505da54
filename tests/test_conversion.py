"""The automaton against a reader that tries every entry at every place."""

from __future__ import annotations

import pickle
import random
import time
import tracemalloc

from pyspark.sql import functions as F

from siftwright.functions.automaton import Replacer, Trie
from siftwright.operators import convert


def slow(text, words):
    if text is None:
        return None
    out, at = [], 0
    while at < len(text):
        for n in range(len(text) - at, 0, -1):
            if text[at : at + n] in words:
                out.append(words[text[at : at + n]])
                at += n
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_replacing_equals_the_slow_reader():
    rng = random.Random(7)
    for alphabet, longest in (("ab", 5), ("abcdefgh ", 4), ("漢字國語\U0001f600é", 3)):
        word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))  # noqa: E731,B023
        words = {word(rng.randint(1, longest)): word(rng.randint(0, 4)) for _ in range(40)} | {"": "never"}
        texts = [None, "", alphabet] + [word(rng.randrange(120)) for _ in range(200)]
        assert Replacer(words).replace(texts) == [slow(t, {k: v for k, v in words.items() if k}) for t in texts]


def test_entries_do_not_reach_across_texts():
    assert Replacer({"ab": "x", "a\0b": "y", "b\0": "z"}).replace(["a", "b", "ab", "a\0b", "b"]) == ["a", "b", "x", "y", "b"]


def test_trie_finds_every_entry_and_nothing_else():
    rng = random.Random(1)
    entries = {"".join(chr(rng.choice([97, 98, 0x4E00, 0x4E01, 0x20000]) + rng.randrange(3)) for _ in range(rng.randint(1, 6))) for _ in range(3000)}
    trie = Trie(entries)
    import numpy as np

    for e in entries:
        length, entry = trie.longest(np.frombuffer(e.encode("utf-32-le"), np.uint32))
        assert length[0] == len(e) and trie.entries[entry[0]] == e
    assert Trie([]).longest(np.array([97, 98], np.uint32))[0].tolist() == [0, 0]


def test_time_does_not_grow_with_the_dictionary():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400_000))
    took = []
    for n in (100, 20_000):
        replacer = Replacer({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))): "x" for _ in range(n)})
        began = time.perf_counter()
        replacer.replace([text])
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_a_letter_of_few_entries_does_not_slow_the_building():
    rng = random.Random(3)
    words = {"".join(rng.choice("bcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))): "x" for _ in range(5000)}
    began = time.perf_counter()
    Trie([*words, "a rare one", "Z"])
    assert time.perf_counter() - began < 5


def test_converter_on_columns(spark):
    rows = spark.createDataFrame([(0, "国家和国"), (1, None), (2, "none"), (3, "")], "i int, t string").repartition(2)
    run = convert.converter({"国": "國"}, {"国家": "國家了"})
    assert [r["x"] for r in rows.select("i", run(F.col("t")).alias("x")).orderBy("i").collect()] == ["國家了和國", None, "none", ""]


def test_a_dictionary_that_grew_with_its_texts(spark):
    entries = spark.range(500_003).selectExpr("concat('w', lpad(cast(id as string), 7, '0')) AS source", "cast(id as string) AS target")
    words = convert.read_dictionary(entries)
    assert len(words) == 500_003
    rows = spark.createDataFrame([(0, "w0500002 and w0000017w00"), (1, None)], "i int, t string")
    got = rows.select("i", convert.converter({}, words)(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == ["500002 and 17w00", None]


def test_a_large_dictionary_is_built_and_shipped_in_little_memory():
    rng = random.Random(4)
    entries = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(50_000)}
    tracemalloc.start()
    try:
        trie = Trie(entries)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 30e6, most  # 173,000 nodes or so
    assert len(pickle.dumps(trie)) < 24 * len(trie.value)


def test_letters_beyond_one_step():
    rng = random.Random(6)
    for n in (1, 2, 64, 65, 4096, 4097):
        letters = [chr(0x4E00 + i) for i in range(n)]
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 3))): rng.choice(["", "x", "yz"]) for _ in range(300)}
        texts = ["".join(rng.choice(letters[:40] + [letters[-1], "￾", "a"]) for _ in range(80)) + "".join(rng.sample(sorted(words), min(len(words), 5))) for _ in range(30)]
        assert Replacer(words).replace(texts) == [slow(t, words) for t in texts]
