"""Relational queries over the star schema: grouping sets, windows, ranges and as-of joins (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.tables import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    cents = lambda c: F.sum(F.round(c * 100).cast("long"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), cents(F.col("l_extendedprice")).alias("price_cents"), F.count(F.lit(1)).alias("lines"))


def nation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("customers"), F.sum("cents").alias("cents"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each priority."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.datediff("o_orderdate", F.lag("o_orderdate").over(w))
    return table(spark, sf_dir, "orders").select("o_custkey", days.alias("gap")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("gap").cast("long").alias("longest_gap"))


QUERIES = {
    "pricing_summary": (
        pricing_summary,
        "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price_cents, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "nation_rollup": (
        nation_rollup,
        "SELECT r_name, n_name, grouping(r_name, n_name)::INT AS level, count(*) AS customers, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    ),
    "top_orders": (top_orders, "SELECT o_orderpriority, o_orderkey, rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"),
    "order_gaps": (
        order_gaps,
        "WITH d AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::DATE, o_orderdate::DATE) AS gap FROM orders) SELECT o_custkey, count(*) AS orders, max(gap)::BIGINT AS longest_gap FROM d GROUP BY 1",
    ),
}
