"""The relational substrate at bench scale: the same plan shapes over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.plans.base import Catalog, table

CATALOG = Catalog()
query = CATALOG.query


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def orders_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority with subtotals."""
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def top3_lines_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest lines of each order."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(w).alias("rn")).filter("rn <= 3").drop("rn")


@query("SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier) WHERE rn = 1")
def supplier_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with the least balance in each nation."""
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min(F.struct("s_acctbal", "s_suppkey")).alias("m")).select("s_nationkey", "m.s_suppkey")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each nation's customers. Lines are summed by order before they meet anything else."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    by = joined.groupBy("c_nationkey").agg(F.sum("r").alias("r"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return by.join(nations, "c_nationkey").select("n_name", F.round("r", 2).alias("revenue"))
