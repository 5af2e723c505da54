"""The registered queries' columns against plain Python over the smallest tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
import xxhash

from siftwright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    found = queries.QUERIES[name](spark, SF).collect()
    return {r["doc_id"]: r for r in found}, len(found)


def test_toxicity_query(spark, docs):
    got, n = rows(spark, "op1_toxicity")
    assert n == len(docs) and set(got) == set(docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_language_query(spark, docs):
    got, n = rows(spark, "op2_language_id")
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    learned = {lang for i, lang in langs.items() if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    assert n == len(docs)
    held = [(r["lang_pred"], langs[i]) for i, r in got.items() if r["held_out"]]
    for i, r in got.items():
        letters = any(c.isalpha() for c in docs[i] or "")
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if letters else r["lang_pred"] == "und"
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_simhash_query(spark, docs):
    got, n = rows(spark, "op6_simhash_neardup")
    assert n == len(docs)
    prints = {}
    for i, text in docs.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        ones = Counter(b for g in grams for h in (xxhash.xxh64_intdigest(g, 42),) for b in range(64) if h >> b & 1)
        prints[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if least[b] < least[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    least[a], changed = least[b], True
    assert {i: r["component_id"] for i, r in got.items()} == least


def test_audio_query(spark, docs):
    got, n = rows(spark, "op7_telephony_audio")
    assert n == len(docs)
    for i, r in got.items():
        data = (docs[i] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]


def test_repeats_query(spark, docs):
    got, n = rows(spark, "op9_suffix_repeats")
    assert n == len(docs)
    texts = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(hash(t[k : k + 200]) for t in texts.values() for k in range(len(t) - 199))
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[hash(t[k : k + 200])] > 1:
                gone[k : k + 200] = b"\x01" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
