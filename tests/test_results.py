"""Stores: partial writes, failures, concurrent writers, scores that are computed once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwright.sources import results

SCHEMA = "tag string, axis string, value double"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    store = results.Store(spark, str(tmp_path / "s"), "tag", "axis", buckets=32)
    assert store.current() is None
    old = [(f"t{i}", a, float(i)) for i in range(40) for a in ("doc", "general")] + [(None, "doc", 7.0)]
    store.upsert(spark.createDataFrame(old, SCHEMA))
    before = store._manifest(1)["parts"]
    reader = store.current()
    store.upsert(spark.createDataFrame([("t3", "doc", 99.0), ("new", "doc", 1.0)], SCHEMA))
    after = store._manifest(2)["parts"]
    assert 1 <= sum(before.get(b) != p for b, p in after.items()) <= 2
    assert rows_of(store.current()) == sorted([r for r in old if r[:2] != ("t3", "doc")] + [("t3", "doc", 99.0), ("new", "doc", 1.0)], key=repr)
    assert rows_of(reader) == sorted(old, key=repr)  # what was opened before stays readable
    store.upsert(spark.createDataFrame([], SCHEMA))
    assert store.versions() == [1, 2, 3] and len(store.current().collect()) == 82
    store.tidy(1)
    assert store.versions() == [3] and len(store.current().collect()) == 82


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    store = results.Store(spark, str(tmp_path / "s"), "tag", "axis")
    store.upsert(spark.createDataFrame([("a", "doc", 1.0)], SCHEMA))
    bad = spark.range(100).select(F.lit("a").alias("tag"), F.lit("doc").alias("axis"), F.when(F.col("id") < 99, 2.0).otherwise(F.raise_error(F.lit("no score")).cast("double")).alias("value"))
    with pytest.raises(Exception, match="no score"):
        store.upsert(bad)
    assert rows_of(store.current()) == [("a", "doc", 1.0)] and store.versions() == [1]
    # two writers that started from one version: the second is refused
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(1, store._manifest(1))
    store.upsert(spark.createDataFrame([("a", "doc", 3.0)], SCHEMA))
    assert rows_of(store.current()) == [("a", "doc", 3.0)]


def test_write_back(spark, tmp_path):
    store = results.Store(spark, str(tmp_path / "s"), "tag", "axis")
    store.upsert(spark.createDataFrame([("a", "doc", 1.0), ("b", "doc", None)], SCHEMA))
    store.write_back(spark.createDataFrame([("b", "doc", 5.0), ("c", "doc", 6.0)], "tag string, axis string, score double"), "value")
    assert rows_of(store.current()) == [("a", "doc", 1.0), ("b", "doc", 5.0)]


def test_scores_are_computed_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a):
        calls.add(1)
        return len(a) / 10

    frame = lambda rows: spark.createDataFrame(rows, "corpus string, lineno long, a string")
    run = lambda rows, name, **k: sorted(map(tuple, results.score_once(frame(rows), path, score(F.col("a")), name, "a", **k).collect()))
    first = [("x", i, "a" * i) for i in range(5)] + [("y", i, "b") for i in range(3)]
    assert run(first, "1") == [("x", 5, 5), ("y", 3, 3)] and calls.value == 8
    assert run(first, "2") == [] and calls.value == 8
    second = [("x", i, "a" * i) for i in range(5)] + [("y", 0, "b"), ("y", 1, "changed"), ("y", 2, "b"), ("y", 3, "new"), ("z", 0, "c")]
    assert run(second, "3") == [("y", 4, 2), ("z", 1, 1)] and calls.value == 11
    got = {(r["corpus"], r["lineno"]): (round(r["score"], 2), r["run"]) for r in results.stored_scores(spark, path).collect()}
    assert got["y", 1] == (0.7, "3") and got["y", 0] == (0.1, "1") and got["z", 0] == (0.1, "3") and len(got) == 10
    # a run that broke off before it noted what is done finds its scores again
    results.Store(spark, f"{path}/done", "corpus").upsert(spark.createDataFrame([("z", 0, 0, 0, "")], "corpus string, n long, mark long, computed long, run string"))
    assert run(second, "4") == [("z", 1, 0)] and calls.value == 11
    assert run(second, "5", force=True) == [("x", 5, 5), ("y", 4, 4), ("z", 1, 1)] and calls.value == 21


def test_no_task_takes_all_rows_of_a_corpus(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    rows = spark.range(4000).select(F.when(F.col("id") < 3990, "en").when(F.col("id") < 3998, "de").alias("corpus"), F.col("id").alias("lineno"))
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = results.of_corpora(rows, spark.createDataFrame([("en",), ("fr",)], "corpus string"))
        assert found.columns == rows.columns and sorted(r["lineno"] for r in found.collect()) == list(range(3990))
        assert found.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
