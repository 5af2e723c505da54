"""The cheapest path against all paths."""

from __future__ import annotations

import pickle
import random

import pytest
from pyspark.sql import functions as F

from siftwright.functions import segment
from siftwright.functions.segment import Segmenter, read_costs, tokens_lattice, word_costs
from siftwright.operators import metrics


def paths(text, costs, unknown):
    if not text:
        yield 0, ()
    for m in range(1, len(text) + 1):
        w = text[:m]
        cost = min(costs.get(w, unknown), unknown) if m == 1 else costs.get(w)
        if cost is not None:
            for rest, words in paths(text[m:], costs, unknown):
                yield cost + rest, (w, *words)


def test_cheapest_of_all_paths():
    rng = random.Random(9)
    for _ in range(30):
        costs = {"".join(rng.choice("ab漢") for _ in range(rng.randint(1, 4))): rng.randint(1, 6) for _ in range(12)}
        texts = ["".join(rng.choice("ab漢x") for _ in range(rng.randrange(11))) for _ in range(20)]
        got = Segmenter(costs, 5, None).segment(texts)
        for t, words in zip(texts, got, strict=True):
            # of equal costs the one with the longest last word, and so on from the end
            best = min(paths(t, costs, 5), key=lambda p: (p[0], [-len(w) for w in reversed(p[1])]))
            assert tuple(words) == best[1]


def test_blanks_and_whole_runs():
    cut = Segmenter({"東京": 1, "京都": 1, "東": 2, "都": 1, "に": 1}, 50)
    assert cut.segment(["東京都に GPT4　行く", None, "", " ", "Spark", "京都abc東京"]) == [["東京", "都", "に", "GPT4", "行", "く"], None, [], [], ["Spark"], ["京都", "abc", "東京"]]
    assert Segmenter({}, 1, None).segment(["ab c"]) == [["a", "b", "c"]]


def test_long_texts_in_many_chunks():
    rng = random.Random(1)
    words = ["".join(rng.choice("漢字國語日本") for _ in range(rng.randint(2, 5))) for _ in range(50)]
    text = "".join(rng.choice(words) for _ in range(20_000))
    found = Segmenter(dict.fromkeys(words, 3), 100).segment([text, "日", text])
    assert "".join(found[0]) == text and found[0] == found[2] and found[1] == ["日"]


def test_bleu_over_segments(spark):
    counts = spark.createDataFrame([("東京", 8), ("行く", 4), ("に", 16), ("は", 4)], "word string, n long")
    costs = read_costs(word_costs(counts))
    assert costs == {"東京": 1386, "行く": 2079, "に": 693, "は": 2079}
    cut = Segmenter(costs, 9000)
    rows = spark.createDataFrame([("東京に行く", "東京に行く"), (None, "に")], "hyp string, ref string")
    tokens = rows.select(tokens_lattice(F.col("hyp"), cut).alias("hyp_tokens"), tokens_lattice(F.col("ref"), cut).alias("ref_tokens"))
    assert tokens.first()["hyp_tokens"] == ["東京", "に", "行く"]
    assert metrics.bleu(tokens.limit(1).unionByName(tokens.limit(1)), most=3).first()["bleu"] == pytest.approx(100)


def test_a_dictionary_of_more_than_half_a_million_words(spark):
    costs = read_costs(spark.range(600_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), (F.col("id") % 7 + 1).alias("cost")))
    assert len(costs) == 600_000 and costs["w599999"] == 599_999 % 7 + 1
    cut = Segmenter(costs, 100, None)
    assert cut.segment(["w599999w12w600000"]) == [["w599999", "w12", "w60000", "0"]]
    assert len(pickle.dumps(cut)) < 60_000_000


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(segment, "_further", lambda h, points: (h + points.astype("uint64")) % 3)
    test_cheapest_of_all_paths()
