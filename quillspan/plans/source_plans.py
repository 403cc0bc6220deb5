"""Queries over readers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.tables import kept, shared_folder
from quillspan.plans import version_plans
from quillspan.sources import readers
from quillspan.sources.tables import table
from quillspan.streaming import feed, stateful, streams


def kind_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as uploads with file names, types and magic numbers by their number."""
    i = F.pmod("page_id", F.lit(7))
    name = F.when(i == 0, "a.PDF").when(i == 1, "b.docx").when(i == 2, "c.jpeg").otherwise("d")
    mime = F.when(i == 3, "image/png").when(i == 4, "application/msword")
    content = F.when(i == 5, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("html", "utf-8"))).otherwise(F.encode("html", "utf-8"))
    return table(spark, sf, "pages").select("page_id", readers.kind(content, name, mime).alias("kind"))


def blob_addresses(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("pg://"), F.col("o_custkey").cast("string"), F.lit("/k/"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 4 == 1, "pg://other/x").when(F.col("o_orderkey") % 4 == 2, "pg://only").otherwise("s3://b/k").alias("uri"), F.col("o_custkey").cast("string").alias("client"))
    return o.select("o_orderkey", readers.blob_address(F.col("uri"), F.col("client")).alias("a")).select("o_orderkey", "a.key", "a.problem")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return streams.source(spark, f"{sf}/events.parque[t]")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.drain(streams.windowed(_events(spark, sf), "1 hour", "1 hour")).select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "n")


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return streams.drain(streams.first_of_key(_events(spark, sf), ["event_id"], "1 day").select("event_id", "event_type"))


def stream_token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    requests = _events(spark, sf).select(F.col("user_id").alias("key"), (F.col("ts").cast("timestamp").cast("long") - 1704067200).cast("double").alias("at"))
    return streams.drain(streams.token_bucket(requests, rate=1 / 50000, burst=3)).groupBy("key").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


def stream_static_join(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return streams.drain(_events(spark, sf).select("event_id", "user_id").join(users, "user_id")).select("event_id", "c_mktsegment")


def stream_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """How often each user is looked up and answered from the cache of refused ones, every third being unknown."""
    requests = _events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 3 != 0).alias("known"))
    with stateful.keyed_state(spark):
        done = streams.drain(stateful.refusals(requests, seconds=86_400))
    return done.groupBy("key", "outcome").agg(F.count("*").alias("n"))


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """The feed of all versions, read by a consumer that stops behind the first half of the log and resumes."""
    chain = version_plans.version_chain(spark, sf).select("client_id", "doc_key", "version_no", F.col("change_seq").cast("long").alias("change_seq"))
    folder = f"{shared_folder(spark)}/change-log-{uuid.uuid4().hex}"
    rows = kept(chain)
    middle = rows.agg(F.percentile_approx("change_seq", 0.5)).first()[0] or 0
    for part in (rows.where(F.col("change_seq") <= middle), rows.where(F.col("change_seq") > middle)):
        part.write.mode("append").parquet(f"{folder}/log")
        got = feed.consume(feed.changes(spark, f"{folder}/log", after=-1), f"{folder}/consumer")
    return got


_REFUSALS_SQL = """
    WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS us, user_id % 3 <> 0 AS known FROM events),
    looked(key, us) AS (
        SELECT key, min(us) FROM e WHERE NOT known GROUP BY key
        UNION ALL SELECT l.key, min(e.us) FROM looked l JOIN e ON e.key = l.key AND e.us >= l.us + 86400000000 GROUP BY l.key),
    judged AS (
        SELECT e.key, CASE WHEN e.known THEN 'accepted' WHEN row_number() OVER (PARTITION BY e.key, e.us ORDER BY l.us NULLS LAST) = 1 AND l.us IS NOT NULL THEN 'refused' ELSE 'refused again' END AS outcome
        FROM e LEFT JOIN looked l ON e.key = l.key AND e.us = l.us)
    SELECT key, outcome, count(*) AS n FROM judged GROUP BY ALL
"""

PLANS = {
    "stream_refusals": (stream_refusals, _REFUSALS_SQL),
    "change_log": (change_log, f"WITH {version_plans._CHAIN_SQL} SELECT client_id, doc_key, version_no, upload_id AS change_seq FROM chain"),
    "kind_detection": (kind_detection, "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN 'docx' WHEN 5 THEN 'image' ELSE 'text' END AS kind FROM pages"),
    "blob_addresses": (blob_addresses, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'k/' || o_orderkey END AS key, CASE o_orderkey % 4 WHEN 1 THEN 'foreign' WHEN 2 THEN 'malformed' WHEN 3 THEN 'not an address' END AS problem FROM orders"),
    "stream_windows": (stream_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS started, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL"),
    "stream_dedupe": (stream_dedupe, "SELECT event_id, event_type FROM events"),
    "stream_token_bucket": (stream_token_bucket, None),
    "stream_static_join": (stream_static_join, "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey"),
}
