"""Queries that replay tables as streams, with lines that come in another order than they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import text as T
from siftwright.plans.base import Catalog, table
from siftwright.plans.corpus import ENDED, LINES
from siftwright.sources.shared import new_path
from siftwright.streaming import keyed

CATALOG = Catalog()
query = CATALOG.query
PARTS = 3


def _batches(lines: DataFrame, closing: DataFrame) -> list[DataFrame]:
    """Lines dealt by number, the last part first, a minute apart; a closing row a day later lets all state go."""
    part = lambda n: lines.filter(F.pmod(F.col("lineno"), F.lit(PARTS)) == PARTS - 1 - n).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + 60 * n)))
    return [*map(part, range(PARTS)), closing.withColumn("ts", F.timestamp_seconds(F.lit(1_700_200_000)))]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("lineno", "line")).withColumn("lineno", F.col("lineno").cast("long"))


@query(f"""
WITH i AS (SELECT doc_id, lineno, line, lineno - row_number() OVER (PARTITION BY doc_id ORDER BY lineno) AS island FROM ({LINES}) WHERE {ENDED('line')})
SELECT doc_id, min(lineno) AS first_line, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY lineno)) AS digest FROM i GROUP BY doc_id, island
""")
def streamed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of following lines of every document, from a stream that brings every third line at a time."""
    lines = _lines(spark, sf_dir).filter(T.terminated(F.col("line"))).select("doc_id", "lineno", "line")
    closing = spark.createDataFrame([(-1, 0, "")], lines.schema)
    runs = keyed.replay(_batches(lines, closing), new_path(spark, "streamed-runs"), lambda s: keyed.line_runs(s, "doc_id", groups=keyed.GROUPS))
    return runs.filter("doc_id >= 0").select("doc_id", "first_line", "n_lines", F.md5("text").alias("digest"))


@query("""
SELECT lang, md5(line) AS digest, min(doc_id * 100000 + k) AS lineno FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)
GROUP BY lang, line
""")
def streamed_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal lines of a language the first by number, from a stream that brings later ones before."""
    lines = _lines(spark, sf_dir).select("lang", F.md5("line").alias("digest"), (F.col("doc_id") * 100_000 + F.col("lineno")).alias("lineno"))
    closing = spark.createDataFrame([("", "", -1)], lines.schema)
    first = keyed.replay(_batches(lines, closing), new_path(spark, "streamed-lines"), lambda s: keyed.first_wins(s, "lang", "digest"))
    return first.filter("lineno >= 0")
