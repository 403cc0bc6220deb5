"""Queries over learned classes, stored sketches, repeatable writes and table functions."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import ontology
from quillspan.functions import tabular
from quillspan.functions.tables import kept, shared_folder
from quillspan.operators import classifier, gateway, sketches
from quillspan.sources import blobs, versions_store
from quillspan.sources.tables import kyc_documents, kyc_sql, quoted, table

_TYPES = [t[0] for t in ontology.DOCUMENT_TYPES]


def trained_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality and confidence by a model of four fifths of the labels, saved and loaded again."""
    labels = table(spark, sf, "labels").where("pmod(doc_id, 5) <> 0").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = classifier.load(classifier.train(docs, labels, kept))
    return classifier.classify(docs, model).select("doc_id", F.col("doc_type").alias("quality"), F.round("doc_confidence", 6).alias("confidence"))


def _by_month(stored: DataFrame) -> DataFrame:
    return stored.withColumn("month", F.substring("day", 1, 7))


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def sketch_users(spark: SparkSession, sf: str) -> DataFrame:
    """Users of each kind and month by sketches of days, beside their exact number and whether that is within the bound."""
    days = _days(spark, sf)
    stored = kept(sketches.distinct_sketches(days, ["event_type", "day"], "user_id"))
    about = sketches.distinct_united(_by_month(stored), ["event_type", "month"])
    exact = _by_month(days).groupBy("event_type", "month").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("n") - F.col("users")) <= sketches.distinct_error() * F.col("users") + 0.5
    return exact.join(about, ["event_type", "month"]).select("event_type", "month", "users", near.alias("near"))


def sketch_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """The ninth decile of each kind and month, by an aggregate in SQL over buckets stored by day."""
    kept(sketches.quantile_sketches(_days(spark, sf), ["event_type", "day"], "value")).createOrReplaceTempView("value_sketches")
    sketches.register(spark)
    return spark.sql("""
        SELECT event_type, month, round(sketch_quantile(bucket, n, 0.9D), 6) AS decile
        FROM (SELECT event_type, substring(day, 1, 7) AS month, bucket, sum(n) AS n FROM value_sketches GROUP BY ALL)
        GROUP BY event_type, month""")


def version_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as three versions: the first is written twice, the second stops and is resumed, the third stays without its mark."""
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.pmod("o_orderkey", F.lit(3)).cast("long").alias("v"))
    part = lambda v: orders.where(F.col("v") == v).drop("v")
    for _ in range(2):
        versions_store.put(part(0), folder, 0, ["o_custkey"])
    versions_store.put_rows(orders.drop("v"), folder, 1, ["o_custkey"])
    versions_store.put(part(1), folder, 1, ["o_custkey"])
    versions_store.put_rows(part(2), folder, 2, ["o_custkey"])
    return versions_store.read(spark, folder).select("version", "o_orderkey", "o_custkey")


def replaced_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sets of customers; then every third customer's set is replaced by its dear orders, which may be none."""
    folder = f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    versions_store.replace_sets(orders, orders.select("o_custkey"), folder, "o_custkey")
    third = orders.where("o_custkey % 3 = 0")
    versions_store.replace_sets(third.where("o_totalprice > 200000"), third.select("o_custkey"), folder, "o_custkey")
    return versions_store.sets(spark, folder).select("o_custkey", "o_orderkey")


_NUMBERS = {"SSN": "id.ssn", "SIN": "id.sin", "EIN": "id.ein", "CURP": "id.curp"}


def _numbers(text: str) -> list[tuple[str, str]]:
    return [(_NUMBERS[m[1]], m[2]) for m in re.finditer(r"(?m)^(SSN|SIN|EIN|CURP) (\S+)$", text)]


def facts_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of documents of the even classes by extractors that are called in SQL."""
    types = F.get(F.array(*[F.lit(t) for t in _TYPES]), F.pmod("doc_id", F.lit(len(_TYPES) + 1)).cast("int"))
    kyc_documents(spark, sf).withColumn("doc_type", types).createOrReplaceTempView("typed_documents")
    tabular.register_extractors(spark, {t: _numbers for t in _TYPES[::2]})
    return spark.sql("SELECT * FROM facts_of(TABLE(typed_documents), key => 'doc_id')")


def state_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one kind in each user's events, by a table function over partitions in SQL."""
    tabular.register(spark)
    table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts").createOrReplaceTempView("user_events")
    return spark.sql("""
        SELECT user_id, event_type, n, date_format(started, 'yyyy-MM-dd HH:mm:ss') AS started, date_format(ended, 'yyyy-MM-dd HH:mm:ss') AS ended
        FROM state_runs(TABLE(user_events) PARTITION BY user_id ORDER BY (ts, event_id), key => 'user_id', at => 'ts', state => 'event_type')""")


def blob_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as blobs of five tenants: put, partly put again, partly deleted, one tenant's all deleted; then each is asked for, some by another tenant."""
    folder = f"{shared_folder(spark)}/blobs-{uuid.uuid4().hex}"
    client = F.pmod("page_id", F.lit(5)).cast("string")
    pages = table(spark, sf, "pages").select("page_id", client.alias("client_id"), F.concat(F.lit("p/"), "page_id").alias("key"), F.lit("text/html").alias("content_type"), F.encode("html", "utf-8").alias("data"))
    blobs.put(pages, folder, 0)
    blobs.put(pages.where("page_id % 3 = 0").withColumn("data", F.encode(F.col("key"), "utf-8")), folder, 1)
    blobs.delete(pages.where("page_id % 4 = 0"), folder, 2)
    blobs.delete(pages.where("client_id = '4'").select("client_id", F.lit(None).cast("string").alias("key")).distinct(), folder, 3)
    blobs.put(pages.where("page_id % 8 = 0"), folder, 4)
    asker = F.when(F.col("page_id") % 7 == 0, "other").otherwise(F.col("client_id"))
    asked = pages.select("page_id", F.concat(F.lit("pg://"), "client_id", F.lit("/"), "key").alias("uri"), asker.alias("client_id"))
    return blobs.get(asked, folder).select("page_id", "sha256", "problem")


def _sizes(texts: list[str]) -> list[str]:
    """A model of the query below: it knows a text's length, and refuses texts whose length 7 divides."""
    if any(len(t) % 7 == 0 for t in texts):
        raise RuntimeError("refused")
    return [f'Here it is: {{"attributes": {{"size": "{len(t)}"}}, "confidence": {len(t) % 3}}}' for t in texts]


def gateway_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What a model says about every document, beside the documents that it refuses."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = kept(gateway.ask(docs, "text", _sizes, limits=gateway.Limits(attempts=2, wait=0.0)).select("id", "reply", "problem"))
    told = gateway.facts(asked).select(F.col("id").alias("doc_id"), "attribute_key", "value", "confidence", "verification_status")
    failed = asked.where("problem is not null").select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("attribute_key"), F.col("problem").alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("verification_status"))
    return told.unionByName(failed)


_GROWTH = math.log((1 + sketches.ERROR) / (1 - sketches.ERROR))
_QUANTILE_SQL = f"""
    WITH e AS (SELECT event_type, strftime(ts, '%Y-%m') AS month, value, row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m') ORDER BY value) - 1 AS before,
            count(value) OVER (PARTITION BY event_type, strftime(ts, '%Y-%m')) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, month, round(CASE WHEN value = 0 THEN 0 ELSE sign(value) * 2 * exp(ceil(ln(abs(value)) / {_GROWTH!r}) * {_GROWTH!r}) / (exp({_GROWTH!r}) + 1) END, 6) AS decile
    FROM e WHERE before = floor(0.9 * (n - 1))
"""
_EVEN = ", ".join(str(i) for i in range(0, len(_TYPES), 2))
_KEYS = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in _NUMBERS.items())

PLANS = {
    "trained_quality": (trained_quality, None),
    "sketch_users": (sketch_users, "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY ALL"),
    "sketch_quantiles": (sketch_quantiles, _QUANTILE_SQL),
    "version_writes": (version_writes, "SELECT o_orderkey % 3 AS version, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 < 2"),
    "replaced_sets": (replaced_sets, "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 3 <> 0 OR o_totalprice > 200000"),
    "facts_in_sql": (facts_in_sql, f"""
        WITH docs AS ({kyc_sql()}), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs WHERE doc_id % {len(_TYPES) + 1} IN ({_EVEN}))
        SELECT doc_id, key AS attribute_key, regexp_extract(line, '^[A-Z]+ (\\S+)$', 1) AS value FROM lines JOIN (VALUES {_KEYS}) k(label, key) ON regexp_matches(line, '^' || label || ' \\S+$')"""),
    "blob_requests": (blob_requests, """
        WITH b AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'foreign' WHEN html IS NULL AND page_id % 3 > 0 THEN 'missing' WHEN page_id % 8 = 0 AND html IS NOT NULL THEN 'first'
                WHEN page_id % 4 = 0 OR page_id % 5 = 4 THEN 'missing' WHEN page_id % 3 = 0 THEN 'second' ELSE 'first' END AS state, html FROM pages)
        SELECT page_id, CASE state WHEN 'first' THEN sha256(html) WHEN 'second' THEN sha256('p/' || page_id) END AS sha256, CASE WHEN state IN ('missing', 'foreign') THEN state END AS problem FROM b"""),
    "gateway_facts": (gateway_facts, """
        SELECT doc_id, CASE WHEN length(text) % 7 > 0 THEN 'size' END AS attribute_key, CASE WHEN length(text) % 7 > 0 THEN length(text)::VARCHAR ELSE 'RuntimeError: refused' END AS value,
            CASE WHEN length(text) % 7 > 0 THEN least(length(text) % 3, 1)::DOUBLE END AS confidence, CASE WHEN length(text) % 7 > 0 THEN 'llm_unverified' END AS verification_status
        FROM documents WHERE text IS NOT NULL"""),
    "state_runs": (state_runs, """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events)
        SELECT user_id, event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM r GROUP BY user_id, event_type, run"""),
}
