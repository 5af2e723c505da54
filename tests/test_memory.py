"""What is made of an Arrow batch is made part by part: the same results, and memory that does not grow with the batch."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from siftwright.functions import grams, loops
from siftwright.functions.automaton import Replacer
from siftwright.functions.segment import Segmenter


def peak(make, *columns):
    tracemalloc.start()
    try:
        return make(*columns), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_parts_hold_all_rows_in_order():
    texts = pa.array(["ab", None, "", "abcdefgh", "a", "ü", None, "b"])
    lists = pa.array([[1], [], None, [1, 2, 3], [1], None, [2], []], pa.list_(pa.int64()))
    got = list(loops.parts(texts.slice(1), lists.slice(1), size=4))
    assert [x for t, _ in got for x in t.to_pylist()] == texts.to_pylist()[1:] and [x for _, v in got for x in v.to_pylist()] == lists.to_pylist()[1:]
    assert [len(t) for t, _ in got] == [2, 1, 2, 2]
    assert not list(loops.parts(texts.slice(8)))


def test_overlaps_of_a_batch_need_the_memory_of_a_part():
    rng = random.Random(5)
    words = [[rng.getrandbits(62) for _ in range(300)] for _ in range(40)]
    texts = ["".join(rng.choice("abc dü") for _ in range(1500)) for _ in range(40)]
    column = lambda rows, kind, k: pa.array([None, *[rows[(k * i) % 40] for i in range(2000)]], kind)
    for values, rows, kind in ((grams._numbers, words, pa.list_(pa.int64())), (grams._points, texts, pa.string())):
        h, r = column(rows, kind, 1), column(rows, kind, 3)
        got, most = peak(lambda: grams._by_parts(h, r, values, 4))
        assert most < 60e6, most
        assert got.to_pylist()[:500] == grams._overlaps(values(h.slice(0, 500)), values(r.slice(0, 500)), 500, range(1, 5)).to_pylist()
        assert grams._by_parts(h.slice(0, 0), r.slice(0, 0), values, 4).to_pylist() == []


def test_words_of_a_batch_need_the_memory_of_a_part():
    rng = random.Random(8)
    costs = {"ab": 3, "abc": 4, "ca": 3, "da": 2}
    cut, texts = Segmenter(costs, 9), ["".join(rng.choice("abcd ") for _ in range(400)) for _ in range(60)]
    column = pa.array([None, *[texts[i % 60] for i in range(3000)]])
    got, most = peak(lambda: loops.by_parts(cut.segment, column, pa.list_(pa.string())))
    assert most < 60e6, most
    assert got.to_pylist() == [None, *(cut.segment(texts) * 50)]
