"""Relational queries on the star schema: what the engine's host offers besides its domain operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .views import table

C = F.col


def pricing_summary(spark, d):
    """Scan, filter, group: one pass with partial aggregation."""
    li = table(spark, d, "lineitem").where(C("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = C("l_extendedprice") * (1 - C("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.count("*").alias("n"))


def shipping_priority(spark, d):
    """Three-way join and top ten."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").join(c, C("o_custkey") == C("c_custkey")).select("o_orderkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", (C("l_extendedprice") * (1 - C("l_discount"))).alias("v"))
    revenue = li.join(o, C("l_orderkey") == C("o_orderkey")).groupBy("l_orderkey").agg(F.round(F.sum("v"), 2).alias("revenue"))
    return revenue.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def nation_volume(spark, d):
    """Star join with small dimensions."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    s = table(spark, d, "supplier").join(n, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    return li.join(s, C("l_suppkey") == C("s_suppkey")).groupBy("r_name", "n_name").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


def event_sessions(spark, d):
    """Gaps of over half an hour start a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.timestamp_diff("SECOND", F.lag("ts").over(w), C("ts")) > 1800, F.lit(True))
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value").withColumn("new", gap.cast("int"))
    e = e.withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def event_rank(spark, d):
    """Top three events of a type by value."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("event_type", "event_id", "value", F.row_number().over(w).alias("rank")).where("rank <= 3")


def order_cube(spark, d):
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def customers_without_orders(spark, d):
    """Anti join: customers without an urgent order."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


QUERIES = {f.__name__: f for f in (
    pricing_summary, shipping_priority, nation_volume, event_sessions, event_rank, order_cube, customers_without_orders)}
SQL = {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "shipping_priority": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "nation_volume": """SELECT r_name, n_name, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "event_sessions": """WITH g AS (SELECT *, coalesce(date_sub('second', lag(ts) OVER w, ts) > 1800, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""",
    "event_rank": """SELECT event_type, event_id, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank
  FROM events) WHERE rank <= 3""",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
}
