"""Relational queries: joins, sets, windows, groupings, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators import relational as rel
from quillspan.sources.tables import table


def cube_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.cube("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def rollup_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def asof_orders(spark: SparkSession, sf: str) -> DataFrame:
    """For each even order the price of the customer's last odd order at or before it."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    odd = o.where("o_orderkey % 2 = 1").groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("last_price"))
    return rel.as_of(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_orderdate"), odd, "o_custkey", "o_orderdate", "last_price").select("o_orderkey", "last_price")


def window_events(spark: SparkSession, sf: str) -> DataFrame:
    w = rel.tumbling(table(spark, sf, "events"), "ts", "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("started"), "n", "total")


def sliding_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("started"), "n")


def session_events(spark: SparkSession, sf: str) -> DataFrame:
    s = rel.sessions(table(spark, sf, "events"), "user_id", "ts", 3600)
    return s.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [("intersect", c.intersect(s)), ("except", c.exceptAll(s).distinct()), ("union", c.union(s).distinct())]
    out = None
    for name, df in parts:
        part = df.select(F.lit(name).alias("op"), "k")
        out = part if out is None else out.unionByName(part)
    return out


def window_functions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("long").alias("rnk"),
        F.first("o_orderkey").over(w).alias("first_key"), F.count("*").over(w.rowsBetween(-2, 0)).alias("last_three"),
    )


def run_starts(spark: SparkSession, sf: str) -> DataFrame:
    return rel.runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "first_of_run")


def stage_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rel.histogram(table(spark, sf, "events"), ["event_type"], "value", [1.0, 10.0, 50.0, 100.0])


def document_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("client_id"), F.pmod("o_orderkey", F.lit(11)).alias("name"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("state"))
    return rel.upsert(o.where("seq % 2 = 0"), o.where("seq % 2 = 1"), ["client_id", "name"], "seq")


def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 200000")
    has = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", F.lit("has").alias("kind"))
    return has.unionByName(c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", F.lit("none").alias("kind")))


def idempotency(spark: SparkSession, sf: str) -> DataFrame:
    """Of events with one key the earliest; without a key all."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("key"))
    keyed = e.where("key is not null").groupBy("user_id", "key").agg(F.min("event_id").alias("event_id"))
    return keyed.select("event_id", "user_id", "key").unionByName(e.where("key is null"))


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.expr("percentile(l_quantity, 0.5)"), 4).alias("median"), F.round(F.stddev("l_quantity"), 6).alias("sd"), F.count_distinct("l_suppkey").alias("suppliers"))


PLANS = {
    "cube_events": (cube_events, "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY CUBE (event_type, strftime(ts, '%Y-%m-%d'))"),
    "rollup_lines": (rollup_lines, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "asof_orders": (asof_orders, "WITH odd AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS last_price FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) SELECT o.o_orderkey, odd.last_price FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ASOF LEFT JOIN odd ON o.o_custkey = odd.o_custkey AND o.o_orderdate >= odd.o_orderdate"),
    "window_events": (window_events, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS started, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"),
    "sliding_events": (sliding_events, "SELECT strftime(date_trunc('hour', ts) - INTERVAL (h) HOUR, '%Y-%m-%d %H:%M') AS started, count(*) AS n FROM events, (VALUES (0), (1)) v(h) GROUP BY 1"),
    "session_events": (session_events, """
        WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN d IS NULL OR d >= INTERVAL 3600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k"""),
    "set_operations": (set_operations, "SELECT 'intersect' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)"),
    "window_functions": (window_functions, """
        SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, ntile(4) OVER w AS quarter, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rnk, first_value(o_orderkey) OVER w AS first_key,
            count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""),
    "run_starts": (run_starts, "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS first_of_run FROM events"),
    "stage_histogram": (stage_histogram, "SELECT event_type, bound::DOUBLE AS bound, count(*) FILTER (value <= bound) AS n FROM events, (VALUES (1.0), (10.0), (50.0), (100.0)) v(bound) GROUP BY ALL"),
    "document_upsert": (document_upsert, "SELECT client_id, name, arg_max(seq, seq) AS seq, arg_max(state, seq) AS state FROM (SELECT o_custkey AS client_id, o_orderkey % 11 AS name, o_orderkey AS seq, o_orderstatus AS state FROM orders) GROUP BY ALL"),
    "semi_anti": (semi_anti, "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'has' ELSE 'none' END AS kind FROM customer"),
    "idempotency": (idempotency, "WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS key FROM events) SELECT min(event_id) AS event_id, user_id, key FROM e WHERE key IS NOT NULL GROUP BY user_id, key UNION ALL SELECT * FROM e WHERE key IS NULL"),
    "percentiles": (percentiles, "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(stddev(l_quantity), 6) AS sd, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1"),
}
