"""Queries of shuffles that are computed instead of sorted, and of bootstraps without draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.functions import text as T
from siftwright.functions.permute import shuffled_sql
from siftwright.functions.resampling import multiplicities_sql
from siftwright.operators import curate, metrics
from siftwright.plans.base import Catalog, h32_sql, table

CATALOG = Catalog()
query = CATALOG.query

RANKED = "(SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS x, count(*) OVER (PARTITION BY lang) AS n FROM documents)"
WALK = shuffled_sql(RANKED, "lang, doc_id", K.SEED)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.placed(table(spark, sf_dir, "documents").select("lang", "doc_id"), "doc_id", "lang")


@query(f"WITH RECURSIVE {WALK.strip()}\nSELECT lang, doc_id, p AS place FROM walked")
def shuffled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a shuffle of its language."""
    return _placed(spark, sf_dir).select("lang", "doc_id", "place")


@query(f"WITH RECURSIVE {WALK.strip()}\nSELECT lang, p < n // 2 AS forward, count(*) AS docs, sum(doc_id)::BIGINT AS ids FROM walked GROUP BY ALL")
def shuffled_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each language's shuffle, by number and sum of ids."""
    return curate.halves_by_place(_placed(spark, sf_dir)).groupBy("lang", "forward").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("ids"))


@query(f"WITH RECURSIVE {WALK.strip()}\nSELECT lang, doc_id, CASE WHEN p < 50 THEN 'dev' ELSE 'train' END AS part FROM walked")
def shuffled_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty places of each language as dev set."""
    return curate.dev_by_place(_placed(spark, sf_dir), 50).select("lang", "doc_id", "part")


@query(f"""
WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, (quality - {h32_sql("'b'", 'doc_id')} % 1000 / 1000.0) / 10 AS diff FROM labels),
size AS (SELECT count(*) AS n FROM s),{multiplicities_sql('size', 200, 42)},
m AS (SELECT r, sum(c * diff) / max(n) * 100 AS d FROM drawn JOIN s USING (i) GROUP BY r)
SELECT (SELECT n FROM size) AS n, round((SELECT avg(diff) * 100 FROM s), 6) AS delta, round(list_sort(list(d))[6], 6) AS ci_lo, round(list_sort(list(d))[196], 6) AS ci_hi, avg((d > 0)::INT) AS p_b_better, list_sort(list(d))[6] <= 0 AND list_sort(list(d))[196] >= 0 AS crosses_zero FROM m
""")
def bootstrap_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap over differences made from labels, by how often each resample draws each segment."""
    labels = curate.ranks(table(spark, sf_dir, "labels"), F.col("doc_id"), F.floor(F.col("doc_id") / 1024))
    diffs = labels.select((F.col("rn") - 1).alias("i"), ((F.col("quality") - F.pmod(T.h32("b", F.col("doc_id")), F.lit(1000)) / 1000.0) / 10).alias("diff"))
    out = metrics.multinomial_bootstrap(diffs, 200)
    return out.select("n", F.round("delta", 6).alias("delta"), F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"), "p_b_better", "crosses_zero")
