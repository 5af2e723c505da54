"""Numbered lines over many splits and files, reports by name, manifests."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from siftwright.sources import readers, shared, writers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_many_splits(small_splits, tmp_path):
    spark, rng = small_splits, random.Random(4)
    files = {}
    for name in ("b.txt", "a.txt", "c.txt"):
        files[name] = ["".join(rng.choice("ab\r é 日\t") for _ in range(rng.randrange(30))) for _ in range(rng.choice([1, 300]))]
        (tmp_path / name).write_bytes("".join(x + "\n" for x in files[name]).encode())
    (tmp_path / "d.txt").write_bytes(b"no line feed at the end\nof this")
    files["d.txt"] = ["no line feed at the end", "of this"]
    (tmp_path / "empty.txt").write_bytes(b"")
    for name, lines in files.items():
        got = readers.numbered_lines(spark, str(tmp_path / name)).collect()
        assert sorted(map(tuple, got)) == list(enumerate(lines))
    got = readers.numbered_files(spark, str(tmp_path), "file").collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["lineno"], r["line"]) for r in got) == sorted((n, i, x) for n, lines in files.items() for i, x in enumerate(lines))
    got = readers.numbered_lines(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == list(enumerate(x for n in sorted(files) for x in files[n]))


def test_an_ordered_folder_is_numbered_in_its_order(small_splits, tmp_path):
    spark = small_splits
    rows = spark.range(5000).select(F.format_string("line %06d", "id").alias("value")).repartition(7)
    rows.orderBy("value").write.text(str(tmp_path / "sorted"))
    got = readers.numbered_lines(spark, str(tmp_path / "sorted"))
    assert got.filter(F.format_string("line %06d", "lineno") != F.col("line")).count() == 0 and got.count() == 5000
    # nothing but the splits is shuffled or sorted, and no Python worker takes part
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_reports_have_their_names(spark, tmp_path):
    path = str(tmp_path / "deep" / "v1-flores.json")
    for n in (1, 2):
        writers.write_report(spark.sql(f"select '{{\"n\": {n}}}' as json"), path)
        assert json.loads((tmp_path / "deep" / "v1-flores.json").read_text()) == {"n": n}
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["v1-flores.json"]


def test_manifests_of_bounded_size(spark, tmp_path):
    cases = spark.range(2500).select(F.concat(F.lit("c"), "id").alias("case_id"), F.lit("s").alias("source"), F.array(F.lit("en"), F.lit("ja")).alias("targets"), "id")
    writers.write_manifests(cases, str(tmp_path / "m"), F.floor(F.col("id") / 1000))
    assert spark.read.text(str(tmp_path / "m")).count() == 3
    assert readers.case_manifest(spark, str(tmp_path / "m"), one_document=False).count() == 5000


def test_shared_folder():
    class Session:
        """A session without the setting: the folder of its context counts."""

        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            folder, master = None, "local[2]"
            getCheckpointDir = classmethod(lambda c: c.folder)
            setCheckpointDir = classmethod(lambda c, path: setattr(c, "folder", path))

    own = shared.shared_folder(Session)
    assert own.startswith("file:///") and shared.shared_folder(Session) == own
    assert shared.new_path(Session, "x").startswith(f"{own}/siftwright/x-") and shared.new_path(Session, "x") != shared.new_path(Session, "x")
    Session.sparkContext.folder, Session.sparkContext.master = None, "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Session)
    Session.conf.get = staticmethod(lambda key, default: "hdfs://shared/")
    assert shared.shared_folder(Session) == "hdfs://shared"
