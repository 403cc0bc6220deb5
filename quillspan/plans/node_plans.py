"""Queries over projections, node texts, representations, logs of events, spans and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators import nodes, queue, search, service, versions
from quillspan.plans.version_plans import _CHAIN_SQL, _JOBS_SQL, NOW, _jobs, _now, _uploads
from quillspan.sources.tables import table


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as nodes: every third a fact, every fifth without content, every seventh deleted."""
    i = F.col("conv_id") + F.col("turn")
    return table(spark, sf, "conversations").select(
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.when(i % 3 == 0, "fact").otherwise("chunk").alias("node_type"),
        F.when(i % 5 > 0, F.col("text")).otherwise(" \n").alias("content"),
        F.when(i % 2 == 0, F.concat(F.lit(" t"), F.col("turn").cast("string"))).alias("title"),
        F.when(i % 4 > 0, F.concat(F.lit("k."), F.col("role"))).alias("attribute_key"),
        F.when(i % 6 > 0, F.col("role")).otherwise("").alias("value_text"),
        F.when(i % 8 > 0, F.lit("before")).alias("context_prefix"),
        F.when(i % 7 == 0, F.lit("gone")).alias("deleted_at"),
        (i % 11 > 0).alias("is_current"),
    )


_ROWS_SQL = """
    n AS (SELECT conv_id || '.' || turn AS id, CASE WHEN i % 3 = 0 THEN 'fact' ELSE 'chunk' END AS node_type, CASE WHEN i % 5 > 0 THEN text ELSE ' ' || chr(10) END AS content, CASE WHEN i % 2 = 0 THEN ' t' || turn END AS title,
        CASE WHEN i % 4 > 0 THEN 'k.' || role END AS attribute_key, CASE WHEN i % 6 > 0 THEN role ELSE '' END AS value_text, CASE WHEN i % 8 > 0 THEN 'before' END AS context_prefix, i % 7 = 0 AS deleted, i % 11 > 0 AS is_current
        FROM (SELECT *, conv_id + turn AS i FROM conversations))"""
_BARE = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def nodes_narrow(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.project(_rows(spark, sf), nodes.NODE_COLUMNS).select("id", "node_type", "title", "value_text", "provenance")


def facts_narrow(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.merge_input(_rows(spark, sf)).select("id", "attribute_key", "value_text", "verification_status")


def documents_narrow(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the list, their texts never read."""
    docs = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "id", "source": "subject"})
    return nodes.project(docs, nodes.DOCUMENT_COLUMNS).select("id", "subject", "mime")


def node_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = {x: F.col(x) for x in ("node_type", "content", "title", "attribute_key", "value_text", "context_prefix")}
    return _rows(spark, sf).select(
        "id",
        nodes.shown_text(c["content"], c["title"], c["value_text"]).alias("shown"),
        nodes.context_text(c["content"], c["title"], c["attribute_key"], c["value_text"]).alias("in_context"),
        nodes.embedded_text(c["node_type"], c["attribute_key"], c["value_text"], c["title"], c["context_prefix"], c["content"]).alias("embedded"),
    )


def context_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Turns within their conversations' roles, by the stub model."""
    return table(spark, sf, "conversations").select("conv_id", "turn", service.context_prefix(F.col("text"), F.col("role")).alias("prefix"))


def titled_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as sections below their role; a blank one is its title alone."""
    c = table(spark, sf, "conversations")
    body = F.when(F.col("turn") % 4 > 0, F.regexp_replace(F.trim("text"), r"\s+", " ")).otherwise("")
    return c.select("conv_id", "turn", F.array_join(nodes.titled_chunks(F.concat(F.lit(" "), "role"), body), "|").alias("chunks"))


def queue_oldest(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.oldest_queued(queue.stats(_jobs(spark, sf), _now()))


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Two stages reported for every other job, some by a worker that does not hold it."""
    i = F.col("id")
    jobs = _jobs(spark, sf).withColumns({
        "locked_by": F.when(F.col("status") == "running", F.concat(F.lit("w"), F.pmod(i, F.lit(3)).cast("string"))),
        "events": F.array(F.struct(F.lit("queued").alias("stage"), F.lit(0).cast("long").alias("attempt"))),
    })
    worker = F.concat(F.lit("w"), F.pmod(i, F.lit(3)) - F.pmod(i, F.lit(5)).cast("boolean").cast("int") + 1)
    stages = F.posexplode(F.array(F.lit("ocr"), F.lit("gate"))).alias("call_no", "stage")
    calls = jobs.where("id % 2 = 0").select("id", worker.alias("worker"), stages)
    return nodes.event_log(nodes.append_events(jobs, calls)).select("id", F.col("no").cast("long").alias("no"), "stage", F.col("attempt").cast("long").alias("attempt"))


def change_since(spark: SparkSession, sf: str) -> DataFrame:
    """Changes since a time, newest first, and the sequence number to go on from."""
    chain = versions.version_chain(_uploads(spark, sf))
    page = versions.change_feed(chain, chain.select("client_id", "doc_key").distinct(), since="1997-06-01 00:00:00", limit=200)
    return versions.with_next_seq(page).select("client_id", "doc_key", "change_seq", "next_seq")


def interval_events(spark: SparkSession, sf: str) -> DataFrame:
    """How many events a user has within two hours of each purchase."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hours = 2 * 3600 * 10**6
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("start"), (F.col("at") + hours).alias("end"))
    return nodes.within(e.select("user_id", "at"), spans, "user_id", "at", "start", "end", hours).groupBy("span_id").agg(F.count("*").alias("n"))


def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    return items.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))


def range_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the customer in the 30 days before, and the customer's second order."""
    by = Window.partitionBy("o_custkey")
    days = by.orderBy(F.unix_date(F.col("o_orderdate").cast("date"))).rangeBetween(-30, 0)
    whole = by.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "orders").select("o_orderkey", F.count("*").over(days).alias("n"), F.max("o_totalprice").over(days).alias("most"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    """Documents found by their texts and by two representations each, the halves of the text; every document with an id of hundreds asks."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.substring_index("text", " ", 3).alias("query_text"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.explode(F.array(*[F.struct((F.col("doc_id") * 2 + i).alias("id"), (F.substr("text", F.lit(1), half) if i == 0 else F.substr("text", half + 1)).alias("text")) for i in (0, 1)]))
    reps = docs.select(F.col("doc_id").alias("node_id"), parts.alias("r")).select("node_id", "r.*")
    pool = nodes.pool_of(10)
    whole = search.lexical(docs.withColumnRenamed("doc_id", "id"), asked, pool)
    return search.fuse([whole, nodes.parents(search.lexical(reps, asked, pool), reps)], top=10)


def search_representations(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "id", "rnk", "score")


def search_reranked(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.rerank(_fused(spark, sf), 5)


_FUSED_SQL = r"""
    q AS (SELECT doc_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS word FROM documents WHERE doc_id % 100 = 0),
    need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
    held AS (SELECT 'whole' AS leg, doc_id AS id, doc_id AS node_id, text FROM documents UNION ALL SELECT 'rep', doc_id * 2 + i, doc_id, CASE WHEN i = 0 THEN left(text, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END FROM documents, (VALUES (0), (1)) v(i)),
    bags AS (SELECT leg, id, node_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM held),
    counted AS (SELECT leg, id, node_id, n, word, count(*) AS tf FROM (SELECT leg, id, node_id, len(w) AS n, unnest(w) AS word FROM bags) GROUP BY ALL),
    scored AS (SELECT leg, query_id, id, node_id, count(*) AS have, round(sum(tf / (1 + ln(n))), 6) AS score FROM counted JOIN q USING (word) GROUP BY leg, query_id, id, node_id),
    legs AS (SELECT leg, query_id, node_id, row_number() OVER (PARTITION BY leg, query_id ORDER BY score DESC, id) AS rnk FROM scored JOIN need USING (query_id) WHERE have = need),
    summed AS (SELECT query_id, node_id AS id, round(sum(1.0::DOUBLE / (60 + rnk)), 9) AS score FROM legs WHERE rnk <= 50 GROUP BY ALL),
    fused AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk FROM summed)"""

_CONTENT, _TITLE = (f"nullif({_BARE.format(c)}, '')" for c in ("content", "title"))

PLANS = {
    "nodes_narrow": (nodes_narrow, f"WITH {_ROWS_SQL} SELECT id, node_type, title, value_text, NULL::VARCHAR AS provenance FROM n"),
    "facts_narrow": (facts_narrow, f"WITH {_ROWS_SQL} SELECT id, attribute_key, value_text, NULL::VARCHAR AS verification_status FROM n WHERE node_type = 'fact' AND attribute_key IS NOT NULL AND NOT deleted AND is_current"),
    "documents_narrow": (documents_narrow, "SELECT doc_id AS id, source AS subject, NULL::VARCHAR AS mime FROM documents"),
    "node_texts": (node_texts, f"""WITH {_ROWS_SQL} SELECT id, coalesce({_CONTENT}, {_TITLE}, nullif({_BARE.format("value_text")}, ''), '') AS shown,
        coalesce({_CONTENT}, concat_ws(chr(10), {_TITLE}, {_BARE.format("attribute_key || ': ' || coalesce(value_text, '')")})) AS in_context,
        CASE WHEN node_type = 'fact' THEN {_BARE.format("trim(coalesce(attribute_key, '') || ': ' || coalesce(nullif(value_text, ''), title, ''), ': ')")} ELSE concat_ws(chr(10) || chr(10), context_prefix, nullif(content, '')) END AS embedded FROM n"""),
    "context_prefixes": (context_prefixes, "SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN '[stub:contextual] ' || substr(substr(text, 1, 4000) || chr(10) || role, 1, 120) END AS prefix FROM conversations"),
    "titled_sections": (titled_sections, r"SELECT conv_id, turn, CASE WHEN turn % 4 > 0 AND trim(text) <> '' THEN role || chr(10) || chr(10) || regexp_replace(trim(text), '\s+', ' ', 'g') ELSE role END AS chunks FROM conversations"),
    "queue_oldest": (queue_oldest, f"WITH {_JOBS_SQL} SELECT kind, max(date_diff('second', date_trunc('second', created_at), TIMESTAMP '{NOW}')) AS oldest_seconds FROM jobs WHERE status = 'queued' GROUP BY 1"),
    "job_events": (job_events, f"""WITH {_JOBS_SQL} SELECT id, 0::BIGINT AS no, 'queued' AS stage, 0::BIGINT AS attempt FROM jobs
        UNION ALL SELECT id, k, s, attempts FROM jobs, (VALUES (1, 'ocr'), (2, 'gate')) v(k, s) WHERE status = 'running' AND id % 2 = 0 AND id % 5 > 0"""),
    "change_since": (change_since, f"""WITH {_CHAIN_SQL}, p AS (SELECT client_id, doc_key, upload_id AS change_seq FROM chain WHERE created_at >= TIMESTAMP '1997-06-01 00:00:00' ORDER BY created_at DESC, upload_id DESC LIMIT 200)
        SELECT *, (SELECT max(change_seq) FROM p) AS next_seq FROM p"""),
    "interval_events": (interval_events, "SELECT p.event_id AS span_id, count(*) AS n FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 2 HOUR WHERE p.event_type = 'purchase' GROUP BY 1"),
    "grouping_sets": (grouping_sets, "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "range_frames": (range_frames, """
        SELECT o_orderkey, count(*) OVER d AS n, max(o_totalprice) OVER d AS most, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
        FROM (SELECT *, o_orderdate::DATE - DATE '1970-01-01' AS day FROM orders) WINDOW d AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)"""),
    "search_representations": (search_representations, f"WITH {_FUSED_SQL} SELECT query_id, id, rnk, score FROM fused WHERE rnk <= 10"),
    "search_reranked": (search_reranked, f"WITH {_FUSED_SQL} SELECT query_id, id, round(1 - (rnk - 1) * 0.01::DOUBLE, 6) AS score FROM fused WHERE rnk <= 5"),
}
