"""Stored results that are changed in place: upserts, write-backs and scores that are computed once.

A store is a folder of data parts, one for each bucket of the keys and write, and of numbered versions. A bucket is
written anew as a whole, so the number of buckets should grow with the table, and stay as it is for one store. A version is a
small file that names the part in force for every bucket. A change reads and writes the buckets of its keys only, aside;
the new version is then put in place by one rename, which fails if another writer was first. A write that fails at any
point before leaves the last version as it is, and what readers have open stays where it is until `tidy`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwright.operators import decide

BUCKETS = 64
#: Tasks, and so files, that write one bucket.
FILES = 8
#: Groups that the rows of one corpus are dealt to when corpora are looked up.
SPREAD = 256
BUCKET = "_bucket"


class Store:
    """A table below a path, with the columns that tell its rows apart."""

    def __init__(self, spark: SparkSession, path: str, *keys: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all versions, in order."""
        folder = self._path(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{version:08d}.json").collect()))

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        parts = [f"{self.path}/{part}" for b, part in manifest["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame | None:
        """The rows of the last version; None before the first."""
        versions = self.versions()
        return self._read(self._manifest(versions[-1])) if versions else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def change(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Put merge(old rows, new rows) in place of the rows in the buckets that new has keys in; the new version's number."""
        versions = self.versions()
        last = self._manifest(versions[-1]) if versions else {"schema": new.schema.jsonValue(), "parts": {}}
        touched = {r[0] for r in new.select(self._bucket().alias(BUCKET)).distinct().collect()}  # at most as many as buckets
        rows = merge(self._read(last, touched), new)
        write = f"data/{uuid.uuid4().hex}"
        spread = F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(FILES))
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET, spread).write.partitionBy(BUCKET).parquet(f"{self.path}/{write}")
        made = {f.getPath().getName().split("=")[1] for f in self._fs.listStatus(self._path(f"{self.path}/{write}")) if "=" in f.getPath().getName()}
        parts = {b: p for b, p in last["parts"].items() if int(b) not in touched} | {b: f"{write}/{BUCKET}={b}" for b in made}
        return self._commit((versions[-1] if versions else 0) + 1, {"schema": rows.schema.jsonValue(), "parts": parts})

    def _commit(self, version: int, manifest: dict) -> int:
        aside, place = (self._path(f"{self.path}/versions/{name}") for name in (f".{uuid.uuid4().hex}", f"{version:08d}.json"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            raise RuntimeError(f"another writer made version {version} of {self.path}; run again")
        return version

    def upsert(self, new: DataFrame) -> int:
        """The rows of new in place of those with the same keys; all others stay, and so do rows with a null among their keys."""
        return self.change(new, lambda old, rows: decide.merge_results(old, rows, *self.keys))

    def write_back(self, scores: DataFrame, column: str) -> int:
        """A column set from scores (keys..., score) where there are rows for them; rows without a score keep what they have."""
        return self.change(scores, lambda old, rows: decide.write_back(old, rows, column, *self.keys))

    def tidy(self, keep: int = 2) -> None:
        """Delete all but the last versions, and data that none of these names."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/{v:08d}.json"), False)
        used = {part.split("/")[1] for v in versions[-keep:] for part in self._manifest(v)["parts"].values()}
        for f in self._fs.listStatus(self._path(f"{self.path}/data")):
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)


def of_corpora(rows: DataFrame, corpora: DataFrame) -> DataFrame:
    """The rows (corpus, lineno, ...) of the corpora; those of one corpus are dealt to `SPREAD` groups, so no task takes them all."""
    groups = corpora.select("corpus", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("_group"))
    return rows.withColumn("_group", F.pmod(F.xxhash64("lineno"), F.lit(SPREAD).cast("long"))).join(groups, ["corpus", "_group"], "left_semi").select(*rows.columns)


def score_once(rows: DataFrame, path: str, score: Column, run: str, *sides: str, force: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Score the rows (corpus, lineno, sides...) that the store at path does not have with this content, and keep the scores.

    A corpus whose rows have the number and digest of the last complete run is passed over without a look at its rows;
    of the others, rows are known by corpus, line number and a digest of the sides. Scores are stored first, then which
    corpora are done: a run that broke off in between, run again, finds its scores and computes none twice.
    Returns (corpus, n, computed): the corpora that were not passed over, their rows, and how many were scored.
    """
    spark = rows.sparkSession
    scores, done = Store(spark, f"{path}/scores", "corpus", "lineno", buckets=buckets), Store(spark, f"{path}/done", "corpus")
    marked = rows.withColumn("digest", F.xxhash64(*sides))
    corpora = marked.groupBy("corpus").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lineno", "digest")).alias("mark"))
    before = None if force else done.current()
    if before is not None:
        corpora = corpora.join(before.select("corpus", "n", "mark"), ["corpus", "n", "mark"], "left_anti")
    waiting = of_corpora(marked, corpora)
    known = None if force else scores.current()
    if known is not None:
        waiting = waiting.join(known.select("corpus", "lineno", "digest"), ["corpus", "lineno", "digest"], "left_anti")
    scores.upsert(waiting.select("corpus", "lineno", "digest", score.cast("float").alias("score"), F.lit(run).alias("run")))
    computed = scores.current().filter(F.col("run") == run).groupBy("corpus").agg(F.count("*").alias("computed"))
    report = corpora.join(computed, "corpus", "left").select("corpus", "n", F.coalesce("computed", F.lit(0)).alias("computed"), "mark")
    done.upsert(report.select("corpus", "n", "mark", "computed", F.lit(run).alias("run")))
    return done.current().filter(F.col("run") == run).select("corpus", "n", "computed")


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, lineno, digest, score, run) of a store of score_once."""
    return Store(spark, f"{path}/scores", "corpus", "lineno").current()
