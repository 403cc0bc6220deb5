"""Queries over versions, trees, queues and search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.tables import kept
from quillspan.operators import nearest, querying, queue, search, tree, versions
from quillspan.sources.tables import kyc_documents, table

NOW = "2024-01-20 12:00:00"
_CHAIN_SQL = """
    up AS (SELECT o_custkey AS client_id, o_orderkey % 7 AS doc_key, sha256(o_orderstatus || o_orderpriority) AS content_hash, o_orderdate AS created_at, o_orderkey AS upload_id FROM orders),
    seen AS (SELECT *, lag(content_hash) OVER w AS before FROM up WINDOW w AS (PARTITION BY client_id, doc_key ORDER BY created_at, upload_id)),
    chain AS (SELECT client_id, doc_key, content_hash, created_at, upload_id, row_number() OVER w AS version_no, lead(upload_id) OVER w IS NULL AS is_current
        FROM seen WHERE before IS NULL OR before <> content_hash WINDOW w AS (PARTITION BY client_id, doc_key ORDER BY created_at, upload_id))"""


def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("client_id"), F.pmod("o_orderkey", F.lit(7)).alias("doc_key"), F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("content_hash"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("upload_id"))


def version_chain(spark: SparkSession, sf: str) -> DataFrame:
    return versions.version_chain(_uploads(spark, sf)).select("client_id", "doc_key", "content_hash", "upload_id", F.col("version_no").cast("long").alias("version_no"), F.col("supersedes_no").cast("long").alias("supersedes_no"), "is_current", "change_seq")


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    chain = versions.version_chain(_uploads(spark, sf))
    docs = chain.select("client_id", "doc_key").distinct().withColumn("name", F.concat_ws("/", F.col("client_id").cast("string"), F.col("doc_key").cast("string")))
    return versions.change_feed(chain, docs, after_seq=100, limit=200).select("client_id", "doc_key", "name", "change_seq", F.col("version_no").cast("long").alias("version_no"))


def version_dupes(spark: SparkSession, sf: str) -> DataFrame:
    broken = versions.version_chain(_uploads(spark, sf)).withColumn("version_no", F.greatest(F.lit(1), F.col("version_no") - F.col("version_no") % 2))
    return versions.duplicates(broken).select("client_id", "doc_key", F.col("version_no").cast("long").alias("version_no"), "n", "upload_ids")


def version_renumber(spark: SparkSession, sf: str) -> DataFrame:
    broken = versions.version_chain(_uploads(spark, sf)).withColumn("version_no", F.greatest(F.lit(1), F.col("version_no") - F.col("version_no") % 2))
    return versions.renumber(broken).select("client_id", "doc_key", "upload_id", F.col("version_no").cast("long").alias("version_no"))


def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), "o_orderkey", F.col("o_orderstatus").alias("hash"))
    old = orders.where("o_orderkey % 5 <> 0")
    new = orders.where("o_orderkey % 7 <> 0").withColumn("hash", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("hash")))
    return versions.diff(old, new)


def version_decision(spark: SparkSession, sf: str) -> DataFrame:
    rows = _uploads(spark, sf).select("upload_id", F.when(F.col("upload_id") % 4 > 0, F.lit(3)).alias("no"), F.when(F.col("upload_id") % 4 == 1, F.col("content_hash")).when(F.col("upload_id") % 4 > 1, F.lit("other")).alias("h"), "content_hash", (F.col("upload_id") % 3 > 0).alias("complete"))
    return rows.select("upload_id", versions.decide(F.col("content_hash"), F.col("no"), F.col("h"), F.col("complete")).alias("d")).select("upload_id", "d.*")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of regions, nations and customers with paths."""
    region = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("path"), F.col("r_regionkey").alias("seq"), F.lit("document").alias("node_type"))
    nations = table(spark, sf, "nation")
    nation = nations.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.concat_ws(".", F.concat(F.lit("r"), F.col("n_regionkey")), F.concat(F.lit("n"), F.col("n_nationkey"))).alias("path"), F.col("n_nationkey").alias("seq"), F.lit("section").alias("node_type"))
    customer = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"), F.concat_ws(".", F.concat(F.lit("r"), F.col("n_regionkey")), F.concat(F.lit("n"), F.col("c_nationkey")), F.concat(F.lit("c"), F.col("c_custkey"))).alias("path"), F.col("c_custkey").cast("int").alias("seq"), F.lit("chunk").alias("node_type"))
    return region.unionByName(nation).unionByName(customer).withColumn("depth", F.size(F.split("path", r"\.")))


_NODES_SQL = """
    nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 'r' || r_regionkey AS path, r_regionkey AS seq, 1 AS depth, printf('%08d', r_regionkey) || '/r' || r_regionkey AS order_key FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'r' || n_regionkey || '.n' || n_nationkey, n_nationkey, 2, printf('%08d', n_regionkey) || '/r' || n_regionkey || '|' || printf('%08d', n_nationkey) || '/r' || n_regionkey || '.n' || n_nationkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey || '.n' || c_nationkey || '.c' || c_custkey, c_custkey, 3,
            printf('%08d', n_regionkey) || '/r' || n_regionkey || '|' || printf('%08d', n_nationkey) || '/r' || n_regionkey || '.n' || n_nationkey || '|' || printf('%08d', c_custkey) || '/r' || n_regionkey || '.n' || c_nationkey || '.c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def tree_flat(spark: SparkSession, sf: str) -> DataFrame:
    return tree.nest(_nodes(spark, sf)).select("id", "path", "level", "order_key")


def subtree_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return tree.subtree(_nodes(spark, sf), "r1", 2).select("id", "path", F.col("depth").cast("long").alias("depth"), "node_type")


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tree.text_lines(table(spark, sf, "documents"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    lines = tree.text_lines(table(spark, sf, "documents")).select("doc_id", F.pmod("line_no", F.lit(2)).alias("page"), "line_no", F.col("line").alias("text"))
    return tree.sections(lines)


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", tree.chunks(F.regexp_replace("text", "\n", "\n\n")).alias("c"))
    return docs.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.array_max(F.transform("c", lambda x: F.length(x))).cast("long").alias("longest"))


def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    docs = kyc_documents(spark, sf).withColumn("doc_type", F.lit("UNKNOWN")).withColumn("sensitivity", F.lit("LOW"))
    return tree.build(docs).select("doc_id", "path", "node_type", "seq", "depth")


def areps_plan(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "conversations").select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    return tree.representations(nodes)


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"signup": "queued", "view": "running", "click": "succeeded", "purchase": "canceled", "error": "dead"}
    status = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("client_id"), F.try_element_at(status, "event_type").alias("status"), F.pmod("event_id", F.lit(3)).alias("priority"), F.col("ts").alias("created_at"), F.col("ts").alias("run_after"), F.col("ts").alias("updated_at"),
        F.when(F.pmod("event_id", F.lit(4)) > 0, F.col("ts") + F.expr("interval 10 minutes")).alias("lease_expires_at"), F.pmod("event_id", F.lit(5)).alias("attempts"), F.lit(3).alias("max_attempts"), F.when(F.pmod("event_id", F.lit(2)) == 0, "ingest").otherwise("arep").alias("kind"),
    )


_JOBS_SQL = """
    jobs AS (SELECT event_id AS id, user_id AS client_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'succeeded' WHEN 'purchase' THEN 'canceled' WHEN 'error' THEN 'dead' END AS status, event_id % 3 AS priority, ts AS created_at,
        CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL 10 MINUTE END AS lease_expires_at, event_id % 5 AS attempts, 3 AS max_attempts, CASE WHEN event_id % 2 = 0 THEN 'ingest' ELSE 'arep' END AS kind FROM events)"""


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def queue_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """A call for most jobs, some by others than those who may make it, some twice."""
    i = F.col("id")
    jobs = _jobs(spark, sf).withColumns({"locked_by": F.when(F.col("status") == "running", F.concat(F.lit("w"), F.pmod(i, F.lit(3)).cast("string"))), "error": F.when(F.col("status") == "dead", "lost"), "finished_at": F.when(F.col("status").isin("dead", "succeeded"), F.col("created_at"))})
    actions = F.get(F.array(*[F.lit(x) for x in ("heartbeat", "complete", "release", "retry_later", "retry", "cancel")]), F.pmod(i, F.lit(6)).cast("int"))
    call = jobs.where("id % 13 > 0").select("id", F.lit(1).alias("call_no"), actions.alias("action"), F.concat(F.lit("w"), F.pmod(i, F.lit(3)) - F.pmod(i, F.lit(2))).alias("worker"), F.when(i % 4 > 0, F.col("client_id")).alias("client_id"), F.lit("succeeded").alias("status"), F.lit("why").alias("error"))
    calls = call.unionByName(call.where("id % 5 = 0").withColumns({"call_no": F.lit(2), "action": F.lit("cancel")}))
    out = queue.transition(jobs, calls, _now())
    return out.where("applied").select("id", "status", "locked_by", F.date_format("lease_expires_at", "yyyy-MM-dd HH:mm:ss").alias("lease"), F.date_format("run_after", "yyyy-MM-dd HH:mm:ss").alias("run_after"), F.col("attempts").cast("long").alias("attempts"), "error", F.col("finished_at").isNotNull().alias("finished"))


_ACTED_SQL = f"""
    j AS (SELECT *, CASE WHEN status = 'running' THEN 'w' || id % 3 END AS locked_by, ['heartbeat', 'complete', 'release', 'retry_later', 'retry', 'cancel'][id % 6 + 1] AS a, id % 4 > 0 AS mine FROM jobs WHERE id % 13 > 0),
    x AS (SELECT *, CASE WHEN a IN ('retry', 'cancel') THEN mine AND status = CASE a WHEN 'retry' THEN 'dead' ELSE 'queued' END ELSE coalesce(locked_by = 'w' || (id % 3 - id % 2), FALSE) END AS ok FROM j)
    SELECT id, CASE a WHEN 'heartbeat' THEN 'running' WHEN 'complete' THEN 'succeeded' WHEN 'cancel' THEN 'canceled' ELSE 'queued' END AS status, CASE WHEN a = 'heartbeat' THEN locked_by END AS locked_by,
        strftime(CASE a WHEN 'heartbeat' THEN TIMESTAMP '{NOW}' + INTERVAL 300 SECOND WHEN 'cancel' THEN lease_expires_at END, '%Y-%m-%d %H:%M:%S') AS lease,
        strftime(CASE WHEN a IN ('release', 'retry') THEN TIMESTAMP '{NOW}' WHEN a = 'retry_later' THEN TIMESTAMP '{NOW}' + to_seconds(least(3600, 30 * pow(2, attempts))::INT) ELSE created_at END, '%Y-%m-%d %H:%M:%S') AS run_after,
        CASE a WHEN 'release' THEN greatest(attempts - 1, 0) WHEN 'retry' THEN 0 ELSE attempts END AS attempts, CASE WHEN a IN ('complete', 'retry_later') THEN 'why' END AS error, a IN ('complete', 'cancel') AS finished FROM x WHERE ok"""


def queue_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of every event's successor: some keys exist, some come twice, some have none."""
    key = F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.floor(F.col("id") / 4).cast("string")))
    jobs = _jobs(spark, sf).withColumn("idempotency_key", F.when(F.col("id") % 2 == 0, key))
    asked = jobs.select((F.col("id") + 10**9).alias("id"), "client_id", "kind", "priority", key.alias("idempotency_key"))
    return queue.enqueue(jobs, asked, _now()).where(F.col("id") >= 10**9).select("id", "client_id", "idempotency_key", "status", F.col("attempts").cast("long").alias("attempts"))


def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return queue.stats(_jobs(spark, sf), _now())


def queue_claim(spark: SparkSession, sf: str) -> DataFrame:
    jobs = _jobs(spark, sf).withColumn("status", F.when((F.col("status") == "running") & (F.col("id") % 40 > 0), "succeeded").otherwise(F.col("status")))
    return queue.claim(jobs, _now(), batch=40).select("id", "client_id", "priority")


def queue_reap(spark: SparkSession, sf: str) -> DataFrame:
    return queue.reap(_jobs(spark, sf), _now()).where("reaped").select("id", "status", "wait_seconds")


def quota_verdict(spark: SparkSession, sf: str) -> DataFrame:
    jobs = _jobs(spark, sf)
    policies = jobs.select("client_id").distinct().where("client_id % 3 <> 0").select("client_id", F.when(F.col("client_id") % 3 == 1, F.lit(20)).alias("max_active_jobs"), F.when(F.col("client_id") % 5 < 3, F.col("client_id") % 5).alias("daily_ingest_limit"))
    return queue.quota(jobs, policies, _now())


def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return queue.token_bucket(events.select(F.col("user_id").alias("key"), (F.col("ts").cast("timestamp").cast("long") - 1704067200).cast("double").alias("at")), rate=1 / 50000, burst=3)


def _lexical(spark: SparkSession, sf: str, scope: DataFrame | None = None) -> DataFrame:
    """The first two words of every hundredth document against all documents (of a scope)."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.array_join(F.slice(search.tokens(F.col("text")), 1, 2), " ").alias("query_text"))
    return search.lexical(docs, asked, scope=scope)


def _vector(spark: SparkSession, sf: str, scope: DataFrame | None = None) -> DataFrame:
    """Every hundredth vector against all vectors (of a scope)."""
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.vector(nodes, nodes.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), scope=scope)


def _lex_sql(scope: str = "true") -> str:
    return rf"""
    words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
    q AS (SELECT DISTINCT doc_id AS query_id, unnest(t[1:2]) AS word FROM words WHERE doc_id % 100 = 0), need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
    w AS (SELECT doc_id AS id, unnest(t) AS word, len(t) AS len FROM words WHERE {scope}),
    h AS (SELECT query_id, id, word, count(*) AS tf, any_value(len) AS len FROM w JOIN q USING (word) GROUP BY ALL),
    s AS (SELECT query_id, id, count(*) AS have, round(sum(tf / (1 + ln(len))), 6) AS score FROM h GROUP BY ALL),
    lex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk, score FROM s JOIN need USING (query_id) WHERE have = need)"""


def _vec_sql(scope: str = "true") -> str:
    return f"""
    vs AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND {scope}),
    vec AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rnk, score FROM vs)"""


#: Four forms of a query over the words w1, w2 and w3 with which a document begins.
FORMS = ["w1 w2", "w1 OR w2 -w3", 'w1 -w3', '"w1 w2"']


def search_language(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth document asks all forms of its first words of all documents."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    words = docs.where("id % 100 = 0").select("id", F.slice(search.tokens(F.col("text")), 1, 3).alias("w")).where("size(w) = 3")
    form = lambda f: F.concat(*[F.get("w", F.lit(int(x[1]) - 1)) if x in ("w1", "w2", "w3") else F.lit(x) for x in re.split("(w[123])", f) if x])
    asked = words.select("id", F.posexplode(F.array(*[form(f) for f in FORMS])).alias("form", "query_text"))
    return querying.search(docs, asked.select((F.col("id") * 10 + F.col("form")).alias("query_id"), "query_text"), kept, pool=50)


def search_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every hundredth vector, through an inverted file of all vectors."""
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = nearest.build(nodes, kept, lists=64)
    return nearest.search(index, nodes.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), pool=10)


_LANGUAGE_SQL = r"""
    WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
    q AS (SELECT id AS asker, t[1] AS w1, t[2] AS w2, t[3] AS w3 FROM t WHERE id % 100 = 0 AND len(t) >= 3),
    pairs AS (SELECT asker, id, w1, w2, w3, len(t) AS n, len(list_filter(t, lambda x: x = w1)) AS c1, len(list_filter(t, lambda x: x = w2)) AS c2, list_contains(t, w3) AS has3,
            len(list_filter(range(1, len(t)), lambda i: t[i] = w1 AND t[i + 1] = w2)) > 0 AS follows
        FROM q JOIN t ON list_contains(t, w1) OR list_contains(t, w2)),
    clauses AS (
        SELECT asker * 10 AS query_id, id, CASE WHEN w1 = w2 THEN c1 ELSE c1 + c2 END AS tf, n FROM pairs WHERE c1 > 0 AND c2 > 0
        UNION ALL SELECT asker * 10 + 1, id, c1, n FROM pairs WHERE c1 > 0 AND w1 <> 'or'
        UNION ALL SELECT asker * 10 + 1, id, c2, n FROM pairs WHERE c2 > 0 AND NOT has3
        UNION ALL SELECT asker * 10 + 2, id, c1, n FROM pairs WHERE c1 > 0 AND NOT has3
        UNION ALL SELECT asker * 10 + 3, id, CASE WHEN w1 = w2 THEN c1 ELSE c1 + c2 END, n FROM pairs WHERE follows),
    scored AS (SELECT query_id, id, round(max(tf / (1 + ln(n))), 6) AS score FROM clauses GROUP BY ALL)
    SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk, score FROM scored) WHERE rnk <= 50
"""


def search_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuse([_lexical(spark, sf), _vector(spark, sf)], top=20)


PLANS = {
    "version_chain": (version_chain, f"WITH {_CHAIN_SQL} SELECT client_id, doc_key, content_hash, upload_id, version_no, CASE WHEN version_no > 1 THEN version_no - 1 END AS supersedes_no, is_current, upload_id AS change_seq FROM chain"),
    "change_feed": (change_feed, f"WITH {_CHAIN_SQL} SELECT client_id, doc_key, client_id || '/' || doc_key AS name, upload_id AS change_seq, version_no FROM chain WHERE upload_id > 100 ORDER BY upload_id LIMIT 200"),
    "version_dupes": (version_dupes, f"WITH {_CHAIN_SQL}, b AS (SELECT * REPLACE (greatest(1, version_no - version_no % 2) AS version_no) FROM chain) SELECT client_id, doc_key, version_no, count(*) AS n, string_agg(upload_id::VARCHAR, ',' ORDER BY created_at, upload_id) AS upload_ids FROM b GROUP BY ALL HAVING count(*) > 1"),
    "version_renumber": (version_renumber, f"""WITH {_CHAIN_SQL}, b AS (SELECT * REPLACE (greatest(1, version_no - version_no % 2) AS version_no) FROM chain),
        m AS (SELECT *, row_number() OVER (PARTITION BY client_id, doc_key, version_no ORDER BY created_at, upload_id) > 1 AS extra, max(version_no) OVER (PARTITION BY client_id, doc_key) AS top FROM b)
        SELECT client_id, doc_key, upload_id, CASE WHEN extra THEN top + row_number() OVER (PARTITION BY client_id, doc_key, extra ORDER BY created_at, upload_id) ELSE version_no END AS version_no FROM m"""),
    "version_diff": (version_diff, """
        WITH a AS (SELECT o_orderkey::VARCHAR AS path, o_orderstatus AS h FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 7 <> 0)
        SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h"""),
    "version_decision": (version_decision, """
        SELECT o_orderkey AS upload_id, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 > 0 THEN 'noop' WHEN o_orderkey % 4 = 1 THEN 'resume' ELSE 'new' END AS action,
            CASE WHEN o_orderkey % 4 = 1 THEN 3 WHEN o_orderkey % 4 > 1 THEN 4 ELSE 1 END AS version_no, CASE WHEN o_orderkey % 4 > 1 THEN 3 END AS supersedes_no FROM orders"""),
    "tree_flat": (tree_flat, f"WITH {_NODES_SQL} SELECT id, path, depth - 1 AS level, order_key FROM nodes"),
    "subtree_scoped": (subtree_scoped, f"WITH {_NODES_SQL} SELECT id, path, depth, CASE depth WHEN 1 THEN 'document' ELSE 'section' END AS node_type FROM nodes WHERE (path = 'r1' OR starts_with(path, 'r1.')) AND depth <= 2"),
    "text_lines": (text_lines, "SELECT doc_id, i - 1 AS line_no, trim(p[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(p[i]) <> ''"),
    "sections": (sections, "WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(p[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) SELECT doc_id, line_no % 2 AS page, trim(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM l WHERE line <> '' GROUP BY ALL"),
    "chunk_stats": (chunk_stats, None),
    "tree_nodes": (tree_nodes, None),
    "areps_plan": (areps_plan, "SELECT conv_id || '.' || turn AS path, r AS rep_type, '[stub:' || r || '] ' || substr(text, 1, 120) AS rep_text FROM conversations, (SELECT unnest(['hypothetical_q', 'proposition', 'summary', 'alt_phrasing']) AS r) WHERE trim(text) <> ''"),
    "queue_stats": (queue_stats, f"WITH {_JOBS_SQL} SELECT kind, status, count(*) AS n, max(epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(created_at))::BIGINT) AS oldest_seconds FROM jobs GROUP BY ALL"),
    "queue_transitions": (queue_transitions, f"WITH {_JOBS_SQL}, {_ACTED_SQL.strip()}"),
    "queue_enqueue": (queue_enqueue, """
        WITH e AS (SELECT event_id AS id, user_id AS client_id, CASE WHEN event_id % 3 > 0 THEN 'k' || (event_id // 4) END AS key FROM events), had AS (SELECT client_id, key FROM e WHERE id % 2 = 0 AND key IS NOT NULL),
        r AS (SELECT min(id) AS id, client_id, key FROM e WHERE key IS NOT NULL AND (client_id, key) NOT IN (SELECT (client_id, key) FROM had) GROUP BY client_id, key UNION ALL SELECT id, client_id, key FROM e WHERE key IS NULL)
        SELECT id + 1000000000 AS id, client_id, key AS idempotency_key, 'queued' AS status, 0 AS attempts FROM r"""),
    "queue_claim": (queue_claim, f"""WITH {_JOBS_SQL}, j AS (SELECT * REPLACE (CASE WHEN status = 'running' AND id % 40 > 0 THEN 'succeeded' ELSE status END AS status) FROM jobs), r AS (SELECT client_id, count(*) AS running FROM j WHERE status = 'running' GROUP BY 1),
        d AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY priority, created_at, id) AS rn FROM j WHERE status = 'queued' AND created_at <= TIMESTAMP '{NOW}')
        SELECT id, client_id, priority FROM d LEFT JOIN r USING (client_id) WHERE rn <= greatest(4 - coalesce(running, 0), 0) ORDER BY priority, created_at, id LIMIT 40"""),
    "queue_reap": (queue_reap, f"""WITH {_JOBS_SQL} SELECT id, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'dead' END AS status, CASE WHEN attempts < max_attempts THEN least(3600.0, 30 * pow(2, attempts)) END AS wait_seconds FROM jobs
        WHERE status = 'running' AND coalesce(lease_expires_at < TIMESTAMP '{NOW}', created_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE)"""),
    "quota_verdict": (quota_verdict, f"""WITH {_JOBS_SQL}, u AS (SELECT client_id, count(*) FILTER (status IN ('queued', 'running')) AS active, count(*) FILTER (created_at >= date_trunc('day', TIMESTAMP '{NOW}')) AS today FROM jobs GROUP BY 1),
        v AS (SELECT *, active >= CASE WHEN client_id % 3 = 1 THEN 20 ELSE 25 END AS a, client_id % 3 <> 0 AND client_id % 5 < 3 AND today >= client_id % 5 AS d FROM u)
        SELECT client_id, active, today, CASE WHEN a THEN 'too_many_active' WHEN d THEN 'daily_limit' ELSE 'ok' END AS verdict, CASE WHEN a THEN 30 WHEN d THEN 3600 END AS retry_after FROM v"""),
    "token_bucket": (token_bucket, None),
    "search_lexical": (_lexical, f"WITH {_lex_sql()} SELECT * FROM lex WHERE rnk <= 50"),
    "search_language": (search_language, _LANGUAGE_SQL),
    "search_approximate": (search_approximate, None),
    "search_vector": (_vector, f"WITH {_vec_sql()} SELECT * FROM vec WHERE rnk <= 50"),
    "search_rrf": (search_rrf, f"""WITH {_lex_sql()}, {_vec_sql()}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rnk)), 9) AS score FROM (SELECT query_id, id, rnk FROM lex WHERE rnk <= 50 UNION ALL SELECT query_id, id, rnk FROM vec WHERE rnk <= 50) GROUP BY ALL)
        SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk FROM f) WHERE rnk <= 20"""),
}
