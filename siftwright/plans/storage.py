"""Queries of stored results that a second run changes in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.operators import curate
from siftwright.plans.base import Catalog, table
from siftwright.sources import results
from siftwright.sources.shared import new_path

CATALOG = Catalog()
query = CATALOG.query

#: The second run has more documents than the first, some with another text; the English ones stay as they are.
FIRST, CHANGED = "lang = 'en' OR doc_id % 3 <> 0", "lang <> 'en' AND doc_id % 10 = 0"


def _scored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    path = new_path(spark, "scores")
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("lineno"), "lang", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    score = (F.length("text") % 97) / 97
    results.score_once(docs.filter(FIRST).drop("lang", "doc_id"), path, score, "first", "text")
    second = docs.withColumn("text", F.when(F.expr(CHANGED), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).drop("lang", "doc_id")
    return path, second, results.score_once(second, path, score, "second", "text")


@query(f"""
SELECT lang AS corpus, doc_id AS lineno, round((length(CASE WHEN {CHANGED} THEN text || '!' ELSE text END) % 97) / 97, 4) AS score, CASE WHEN NOT ({FIRST}) OR {CHANGED} THEN 'second' ELSE 'first' END AS run FROM documents
""")
def scores_of_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after two runs, and which run computed each: the second only what was new or had changed."""
    path, _, _ = _scored(spark, sf_dir)
    return results.stored_scores(spark, path).select("corpus", "lineno", F.round(F.col("score").cast("double"), 4).alias("score"), "run")


@query(f"SELECT lang AS corpus, count(*) AS n, count(*) FILTER (WHERE NOT ({FIRST}) OR {CHANGED}) AS computed FROM documents GROUP BY lang HAVING lang <> 'en'")
def second_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run looked into and computed; unchanged corpora are not among it."""
    return _scored(spark, sf_dir)[2]


@query("""
WITH s AS (SELECT lang AS corpus, doc_id AS lineno, (length(text) % 97) / 97 AS score FROM documents)
SELECT corpus, count(*) AS n FROM s WHERE score >= 0.6 GROUP BY corpus
""")
def aligned_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the alignment filter with the scores of the store."""
    path = new_path(spark, "scores")
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("lineno"), "text")
    results.score_once(docs, path, (F.length("text") % 97) / 97, "only", "text")
    return curate.alignment_filter(docs, results.stored_scores(spark, path), 0.6).groupBy("corpus").agg(F.count("*").alias("n"))


AXES = "SELECT source AS tag, unnest(['chars', 'docs']) AS axis, unnest([round(avg(n_chars), 3), count(*)::DOUBLE]) AS value FROM documents WHERE source IS NOT NULL GROUP BY source"


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    wide = docs.groupBy(F.col("source").alias("tag")).agg(F.round(F.avg("n_chars"), 3).alias("chars"), F.count("*").cast("double").alias("docs"))
    return wide.unpivot("tag", ["chars", "docs"], "axis", "value")


@query(f"""
WITH o AS ({AXES}), n AS (SELECT tag, axis, value + 1000 AS value FROM o WHERE axis = 'docs' AND tag LIKE '%1' UNION ALL SELECT tag, 'words', value / 5 FROM o WHERE axis = 'chars' AND tag LIKE '%2')
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tag = o.tag AND n.axis = o.axis)
""")
def stored_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by tag and axis, after a second write that replaced some axes and added others."""
    store = results.Store(spark, new_path(spark, "axes"), "tag", "axis", buckets=16)
    rows = _axes(spark, sf_dir)
    store.upsert(rows)
    store.upsert(rows.filter("axis = 'docs' and tag like '%1'").withColumn("value", F.col("value") + 1000))
    store.upsert(store.current().filter("axis = 'chars' and tag like '%2'").select("tag", F.lit("words").alias("axis"), (F.col("value") / 5).alias("value")))
    return store.current()


@query(f"WITH o AS ({AXES}) SELECT tag, axis, value, CASE WHEN axis = 'docs' AND tag LIKE '%1' THEN value / 10 END AS comet FROM o")
def stored_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written into stored results where there are any; scores without results are none."""
    store = results.Store(spark, new_path(spark, "results"), "tag", "axis", buckets=16)
    rows = _axes(spark, sf_dir)
    store.upsert(rows.withColumn("comet", F.lit(None).cast("double")))
    scores = rows.filter("axis = 'docs' and tag like '%1'").select("tag", "axis", (F.col("value") / 10).alias("score"))
    store.write_back(scores.unionByName(scores.withColumn("axis", F.lit("unknown"))), "comet")
    return store.current()
