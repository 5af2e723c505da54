"""Lexical search, URL rules and collocations against brute force, SQL and defined cases."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from siftwright.llm import bytewords, collocations, lexical, queries, urlrules
from tests.llm.test_llm_operators import DOC, ODD, clashing, docs_of

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_url_rules", "op13_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


# --- words of bytes ---
def test_words_across_slices():
    text = ("Ab c,dÉ 日本 " * 50 + "x" * 300 + " END").encode()
    classes = collocations.CLASSES
    want = [w for p in re.split(r"[.,;:!?\x0A-\x0D]", text.decode().translate(UPPER)) for w in re.findall(r"[^\x20\x09]+", p)]
    for size in (7, 64, 1 << 20):
        got, hashes = [], []
        for part in bytewords.slices([b"", text], classes, 2, size):
            words = bytewords.find_words(part, classes)
            got += [w.decode() for w in bytewords.spelled(words, np.flatnonzero(words.own)).to_pylist()]
            hashes += words.hash[words.own].tolist()
        assert got == want
        assert len(set(hashes)) == len(set(want)) and len(set(zip(hashes, want))) == len(set(want))


# --- lexical search ---
def slow_ranks(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    rows = [(i, split(t)) for i, t in docs]
    rows = [(i, Counter(w), len(w)) for i, w in rows if w]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, w, _ in rows for t in w)
    out = []
    for item, text in items:
        scores = []
        for i, w, n in rows:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * w[t]) // (1000 * w[t] + 8 * m)) for t in split(text) if w[t]), i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(x for x in scores if x[0])[:k], 1):
            out.append((item, rank, None if none else i, -s))
    return out


def test_ranks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "x1", "THE"]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(64)], k=rng.randint(0, 40))) for _ in range(300)] + ODD
    texts += [texts[0]] * 40 + ["w1 " * 5000 + "w2", "w1-w1.w2"]
    docs = docs_of(spark, texts)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(20)] + [(3, "w1 w1 w1 w1 w1 THE the"), (None, "w2"), (40, None), (41, "--"), (42, "unseen"), (43, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "DOCS", 128)
    monkeypatch.setattr(lexical, "ITEMS", 7)
    want = sorted(slow_ranks([(i, t) for i, t in enumerate(texts)], items), key=repr)
    for block_bytes in (1 << 20, 150):
        got = lexical.rank_documents(clashing(docs.repartition(3)), bench.withColumn("rank", bench.item_id), block_bytes=block_bytes)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_rank_ids_and_empty(spark, empty):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert lexical.rank_documents(empty, bench).collect() == []
    docs = spark.createDataFrame([("b", "alpha"), (None, "alpha"), ("a", "alpha"), ("a", "alpha"), ("c", "x"), ("d", "y"), ("e", "z")], "doc_id string, text string")
    assert [tuple(r) for r in lexical.rank_documents(docs, bench).orderBy("rank").select("doc_id", "rank").collect()] == [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    assert lexical.rank_documents(docs, bench.filter("item_id > 1")).collect() == []
    assert lexical.rank_documents(docs.filter("text = 'nothing'"), bench).collect() == []


def test_slices_add_and_descend():
    rng = np.random.default_rng(2)
    sums = np.zeros((40, 3 * 4), np.uint64)
    plain = np.zeros((3, 256), np.int64)
    for _ in range(30):
        doc = np.sort(rng.choice(256, 90, replace=False))
        value = rng.integers(1, 1 << 30, 90)
        item, shift = int(rng.integers(3)), int(rng.integers(3))
        _, place, made = lexical.impact_slices(np.zeros(90, np.int64), doc, value, 4)
        lexical.add_slices(sums, item * 4 + place, made, shift)
        plain[item, doc] += value << shift
    item, doc, value = lexical.top_slices(sums.reshape(40, 3, 4), 10)
    for q in range(3):
        order = sorted(range(256), key=lambda d: (-plain[q, d], d))[:10]
        assert sorted(zip(doc[item == q].tolist(), value[item == q].tolist())) == sorted((d, int(plain[q, d])) for d in order)


# --- URL rules ---
def slow_verdict(url, rules):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(UPPER)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


URLS = [
    None, "", "no scheme", "http://", "http:///en/", "https://example.com", "https://EXAMPLE.com/en/a?x#y", "http://www.example.com/en/", "http://a.www.example.com/en/b", "http://notexample.com/en/",
    "http://example.com?/en/", "http://x.net/es/1", "http://x.net/de/1", "http://net/fr/", "http://a.b://c.net/es/", "http://com/", "http://example.com./en/", "http://example-x.com/en/", "ftp://u@h.example.com:80/en/", "http://exa\nmple.com/e\nn?",
    "http://münchen.example.com/en/ü",
]


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "net", "x.net", "example-x.com", "org", "b.org"]
    rules = [(rng.choice(hosts), rng.choice(["/", "/en/", "/en/a", "/e", "", "/fr/"]), rng.choice(["allow", "block"])) for _ in range(60)] + [(None, "/", "block"), ("org", None, "block"), ("de", "/", "block")]
    urls = URLS + [f"http://{rng.choice(['', 'm.', 'www.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/abc', '/fr/x?y', '#z'])}" for _ in range(800)] + ["http://hot.example.com/en/1"] * 500
    pages = spark.createDataFrame([(i if i % 50 else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    for given in (rules, list(urlrules.RULES), []):
        table = spark.createDataFrame(given, "host string, path string, verdict string")
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as there can be
        try:
            got = urlrules.judge_urls(pages.withColumn("host", pages.url).withColumn("key", pages.url), table).collect()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((i if i % 50 else None, *slow_verdict(u, given))) for i, u in enumerate(urls))


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id string, url string")
    got = urlrules.judge_urls(pages, spark.createDataFrame(urlrules.RULES, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and got.collect() == []


# --- collocations ---
def slow_collocations(rows, least=10, max_words=3, inside=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    around = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[lang, w[i : i + m]] = max(around[lang, w[i : i + m]], a)
    out = []
    for lang in n:
        kept = []
        for (of, w), a in candidates.items():
            if of == lang and not (around[of, w] and 100 * around[of, w] >= inside * a):
                score, _, x, y = min((1_000_000 * a * a // (f[of, w[:k]] * f[of, w[k:]]), k, f[of, w[:k]], f[of, w[k:]]) for k in range(1, len(w)))
                kept.append((-score, -a, " ".join(w).encode(), x, y))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("max_words", "bound", "top"), [(3, 500_000, 2000), (3, 25, 2000), (4, 40, 30), (2, 100, 5)])
def test_collocations_equal_brute_force(spark, max_words, bound, top):
    rng = random.Random(max_words)
    words = ["The", "of", "New", "York", "City", "é", "日本", "a|b"] + [f"v{i}" for i in range(30)]
    texts = []
    for _ in range(150):
        text = " ".join(rng.choices(words, [9, 7, 5, 5, 4, 3, 3, 3] + [1] * 30, k=rng.randint(0, 80)))
        texts.append(text.replace("v3 ", "v3. ").replace("v4 ", "v4\n").replace("New ", rng.choice(["New York City ", "New York ", "New\t"])))
    rows = [(rng.choice(["en", "fr", None, "und"]), t) for t in texts] + [("en", t) for t in ODD] + [("fr", "hot pair here. " * 400)] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collocations.mine_collocations(clashing(docs), max_words=max_words, bound=bound, top=top)
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, max_words=max_words, top=top)


def test_no_collocations(spark, empty):
    assert collocations.mine_collocations(empty).collect() == []
    assert collocations.mine_collocations(docs_of(spark, ["", None, "a b c"])).collect() == []
