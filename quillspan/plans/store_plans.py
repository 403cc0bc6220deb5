"""Queries over whole trees, search in four legs, verdicts as they are recorded, deletes and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.tables import kept
from quillspan.operators import hybrid, merge, search, service, serving, tree, versions
from quillspan.plans.fact_plans import _ADJ_SQL, _MERGE_SQL, _VERDICTS_SQL, _merged, _shown, _verdicts
from quillspan.sources.tables import line_facts, line_facts_sql, table

_SPLIT = "2024-01-15 00:00:00"


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """English documents of current versions by the words and vectors of themselves and of the halves of their texts."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    node = docs.join(vectors, F.col("id") == F.col("_v"), "left").select(
        "id", "text", "embedding", F.lit("t1").alias("client_id"), F.col("id").alias("doc_id"), F.pmod("id", F.lit(3)).alias("version_id"),
        F.concat(F.lit("kb."), "lang", F.lit(".d"), F.col("id").cast("string")).alias("path"), F.when(F.pmod("id", F.lit(11)) == 5, F.lit("gone")).alias("deleted_at"),
    )
    current = node.select("client_id", "version_id").distinct().withColumn("is_current", F.col("version_id") != 1)
    half = F.floor(F.length("text") / 2).cast("int")
    parts = [docs.select((F.col("id") * 2 + i).alias("id"), F.col("id").alias("node_id"), (F.substr("text", F.lit(1), half) if i == 0 else F.substr("text", half + 1)).alias("text"), (F.col("id") + 1 + i).alias("_at")) for i in (0, 1)]
    reps = parts[0].unionByName(parts[1]).join(vectors, F.col("_at") == F.col("_v"), "left").select("id", "node_id", "text", "embedding")
    words = F.array_join(F.transform(F.slice(search.tokens(F.col("text")), 1, 2), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")
    asked = node.where("id % 100 = 0").select(F.col("id").alias("query_id"), words.alias("query_text"), "embedding")
    return hybrid.search_all(node, reps, asked, kept, hybrid.allowed(node, "t1", current, scope_path="kb.en"), top=10)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("event_type").isin("click", "signup"), "cleared").when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "error", "reject").otherwise("override")
    return table(spark, sf, "events").select(
        F.pmod("user_id", F.lit(40)).alias("client_id"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(9)).cast("string")).alias("attribute_key"), F.lit("").alias("instance_key"),
        F.col("event_id").alias("no"), verdict.alias("verdict"), F.col("event_type").alias("override_text"), F.col("ts").alias("at"),
    )


def _recorded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts recorded in two batches, the second upon what the first left."""
    asked = _requests(spark, sf)
    none = asked.select("client_id", "attribute_key", "instance_key", "verdict", "override_text", F.col("at").alias("created_at"), F.col("at").alias("updated_at")).limit(0)
    live, first = merge.record_verdicts(none, asked.where(F.col("at") < F.lit(_SPLIT).cast("timestamp_ntz")))
    live, second = merge.record_verdicts(kept(live), asked.where(F.col("at") >= F.lit(_SPLIT).cast("timestamp_ntz")))
    return live, first.unionByName(second)


def verdicts_recorded(spark: SparkSession, sf: str) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _recorded(spark, sf)[0].select("client_id", "attribute_key", "verdict", "override_text", shown("created_at"), shown("updated_at"))


def verdict_events(spark: SparkSession, sf: str) -> DataFrame:
    return _recorded(spark, sf)[1].select("client_id", "attribute_key", F.col("no").alias("event_id"), "verdict")


def facts_listed(spark: SparkSession, sf: str) -> DataFrame:
    return merge.listed(_merged(spark, sf), 7).select("attribute_key", "instance_key", "resolved_value")


def node_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Where the nodes of order lines come from; every fifth is asked by another tenant, every seventh has an unknown id."""
    facts = line_facts(spark, sf)
    nodes = facts.select(F.col("fact_id").alias("id"), "client_id", "doc_id", F.lit(1).alias("version_id"), F.lit("fact").alias("node_type"), "attribute_key", "verification_status", "confidence", F.to_json(F.struct(F.pmod("doc_id", F.lit(9)).alias("page"), F.lit("regex").alias("extractor"))).alias("provenance"))
    asked = facts.select(F.when(F.col("fact_id") % 7 == 0, -F.col("fact_id")).otherwise(F.col("fact_id")).alias("node_id"), F.when(F.col("fact_id") % 5 == 0, F.col("client_id") + 1).otherwise(F.col("client_id")).alias("client_id"))
    return serving.provenance(nodes, asked.distinct()).select("node_id", "client_id", "doc_id", "attribute_key", "confidence", "provenance", "problem")


def _store(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Order lines as facts of documents, and the tables around them."""
    client = lambda c: F.pmod(c, F.lit(500)).alias("client_id")
    facts, merged = line_facts(spark, sf), _merged(spark, sf)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), client("o_orderkey"), "o_orderstatus")
    documents = orders.drop("o_orderstatus")
    return {
        "documents": documents, "versions": documents.unionByName(documents.where("doc_id % 2 = 0")), "traces": documents.where("doc_id % 3 = 0"), "nodes": facts.withColumn("node_type", F.lit("fact")),
        "representations": facts.where("fact_id % 4 < 2").select("doc_id", "client_id"), "merged_facts": merged, "verdicts": _verdicts(merged),
        "entities": table(spark, sf, "customer").select(client("c_custkey")), "jobs": table(spark, sf, "events").select(client("user_id")), "blobs": table(spark, sf, "pages").select(client("page_id")),
    }


def _finished(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id"))


def documents_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that go and stay in the five tables of documents when every fifth order's is deleted, if it is finished."""
    return service.delete_documents(_store(spark, sf), _finished(spark, sf))[1]


def facts_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    """The merged facts behind that delete: clients who lost a document have theirs merged anew, under their verdicts."""
    return _shown(service.delete_documents(_store(spark, sf), _finished(spark, sf))[0]["merged_facts"], "needs_review")


def tenants_purged(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that go and stay in the ten tables of tenants when every ninth is purged."""
    tables = _store(spark, sf)
    return service.purge(tables, tables["documents"].where("client_id % 9 = 4").select("client_id"))[1]


def tree_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Users as documents, days of events as their pages, purchases as their facts; every fifth user has a text and no lines."""
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyyMMdd").cast("int"))
    user = F.col("user_id")
    docs = e.groupBy(user.alias("doc_id")).agg(F.min("event_type").alias("least")).select("doc_id", F.lit("c").alias("client_id"), F.lit("STATEMENT").alias("doc_type"), F.when(F.col("doc_id") % 2 == 0, "HIGH").otherwise("LOW").alias("sensitivity"), F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" "), "least", F.lit("\n"))).otherwise(" ").alias("text"))
    lines = e.where("user_id % 5 > 0").select(user.alias("doc_id"), F.col("day").alias("page"), F.col("event_id").alias("line_no"), F.when(F.col("day") % 4 == 0, " ").otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("text"))
    facts = e.where("event_type = 'purchase'").select(user.alias("doc_id"), F.col("event_id").alias("fact_no"), F.lit("income.amount").alias("attribute_key"), F.col("props").alias("value_text"), F.lit("MEDIUM").alias("sensitivity"))
    return tree.build_pages(docs, lines, facts)


def version_diff_last(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by the status of their last order, among all orders and among those but every third."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.concat("o_orderstatus", "o_orderpriority").alias("hash"), F.col("o_orderkey").alias("seq"))
    return versions.diff(rows.where("seq % 3 > 0"), rows.where("seq % 4 > 0"))


_WITHIN = "lang = 'en' AND doc_id % 11 <> 5 AND doc_id % 3 <> 1"
_HYBRID_SQL = rf"""
    WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
    q AS (SELECT DISTINCT doc_id AS query_id, unnest(t[1:2]) AS word FROM d WHERE doc_id % 100 = 0), need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
    held AS (SELECT 'node' AS leg, doc_id AS id, doc_id AS node_id, text, doc_id AS at FROM documents WHERE {_WITHIN}
        UNION ALL SELECT 'rep', doc_id * 2 + i, doc_id, CASE WHEN i = 0 THEN left(text, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END, doc_id + 1 + i FROM documents, (VALUES (0), (1)) v(i) WHERE {_WITHIN}),
    bags AS (SELECT leg, id, node_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM held),
    counted AS (SELECT leg, id, node_id, n, word, count(*) AS tf FROM (SELECT leg, id, node_id, len(w) AS n, unnest(w) AS word FROM bags) GROUP BY ALL),
    scored AS (SELECT leg, query_id, id, node_id, count(*) AS have, round(sum(tf / (1 + ln(n))), 6) AS score FROM counted JOIN q USING (word) GROUP BY leg, query_id, id, node_id),
    lex AS (SELECT leg, query_id, node_id, row_number() OVER (PARTITION BY leg, query_id ORDER BY score DESC, id) AS rnk FROM scored JOIN need USING (query_id) WHERE have = need),
    near AS (SELECT leg, a.vec_id AS query_id, id, node_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score
        FROM held JOIN embeddings e ON e.vec_id = held.at, embeddings a WHERE a.vec_id % 100 = 0 AND a.vec_id IN (SELECT doc_id FROM documents)),
    vec AS (SELECT leg, query_id, node_id, row_number() OVER (PARTITION BY leg, query_id ORDER BY score, id) AS rnk FROM near),
    summed AS (SELECT query_id, node_id AS id, round(sum(1.0::DOUBLE / (60 + rnk)), 9) AS score FROM (FROM lex UNION ALL FROM vec) WHERE rnk <= 50 GROUP BY ALL),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk FROM summed)
    SELECT query_id, id, rnk, score FROM fused WHERE rnk <= 10"""

_REQUESTS_SQL = """
    WITH e AS (SELECT user_id % 40 AS client_id, 'k' || (event_id % 9) AS attribute_key, event_id, ts, event_type AS override_text,
        CASE WHEN event_type IN ('click', 'signup') THEN 'cleared' WHEN event_type = 'view' THEN 'accept' WHEN event_type = 'error' THEN 'reject' ELSE 'override' END AS verdict FROM events),
    o AS (SELECT *, coalesce(lag(verdict) OVER w, 'cleared') AS before, row_number() OVER (PARTITION BY client_id, attribute_key ORDER BY event_id DESC) AS back FROM e WINDOW w AS (PARTITION BY client_id, attribute_key ORDER BY event_id))"""

_GONE = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0)"
_LEFT_SQL = _MERGE_SQL.replace("FROM lineitem", f"FROM lineitem WHERE l_orderkey NOT IN {_GONE}")
_LEFT_ADJ_SQL = _ADJ_SQL.replace(_VERDICTS_SQL, _VERDICTS_SQL.replace("FROM merged WHERE (", f"FROM merged WHERE client_id IN (SELECT o_orderkey % 500 FROM orders WHERE o_orderkey IN {_GONE}) AND ("))


def _counts_sql(parts: list[tuple[str, str]], gone: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) FILTER ({gone}) AS removed, count(*) FILTER (NOT ({gone})) AS kept FROM ({sql})" for name, sql in parts)


_DOCUMENTS = "SELECT o_orderkey AS doc_id, o_orderkey % 500 AS client_id FROM orders"
_DOCUMENT_PARTS = [
    ("documents", _DOCUMENTS), ("versions", f"{_DOCUMENTS} UNION ALL {_DOCUMENTS} WHERE o_orderkey % 2 = 0"), ("traces", f"{_DOCUMENTS} WHERE o_orderkey % 3 = 0"),
    ("nodes", "SELECT doc_id, client_id FROM facts"), ("representations", "SELECT doc_id, client_id FROM facts WHERE fact_id % 4 < 2"),
]
_TENANT_PARTS = [
    *_DOCUMENT_PARTS, ("merged_facts", "SELECT client_id FROM merged"), ("verdicts", "SELECT client_id FROM verdicts"), ("entities", "SELECT c_custkey % 500 AS client_id FROM customer"),
    ("jobs", "SELECT user_id % 500 AS client_id FROM events"), ("blobs", "SELECT page_id % 500 AS client_id FROM pages"),
]

_PAGES_SQL = """
    WITH e AS (SELECT *, strftime(ts, '%Y%m%d')::INT AS day FROM events),
    docs AS (SELECT user_id AS doc_id, 'client_c.doctype_statement.v1.d' || user_id AS base, CASE WHEN user_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS level, min(event_type) AS least FROM e GROUP BY user_id),
    s AS (SELECT user_id AS doc_id, 'page ' || day AS title, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS place, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY event_id) AS body FROM e WHERE user_id % 5 > 0 AND day % 4 > 0 GROUP BY user_id, day
        UNION ALL SELECT doc_id, 'body', 0, least FROM docs WHERE doc_id % 10 = 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    f AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, props AS value, coalesce(n, 0) AS place FROM e LEFT JOIN n ON n.doc_id = user_id WHERE event_type = 'purchase')
    SELECT doc_id, base AS path, 'document' AS node_type, 0 AS seq, 4 AS depth, 'STATEMENT' AS title, NULL AS content, NULL AS attribute_key, NULL AS value_text, level AS sensitivity FROM docs
    UNION ALL SELECT doc_id, base || '.s' || place, 'section', place, 5, title, body, NULL, NULL, level FROM s JOIN docs USING (doc_id)
    UNION ALL SELECT doc_id, base || '.s' || place || '.c0', 'chunk', 0, 6, NULL, body, NULL, NULL, level FROM s JOIN docs USING (doc_id)
    UNION ALL SELECT doc_id, base || '.s' || place, 'section', place, 5, 'facts', NULL, NULL, NULL, 'LOW' FROM f JOIN docs USING (doc_id) WHERE k = 0
    UNION ALL SELECT doc_id, base || '.s' || place || '.f' || k, 'fact', k, 6, 'income.amount', NULL, 'income.amount', value, 'MEDIUM' FROM f JOIN docs USING (doc_id)"""

PLANS = {
    "hybrid_search": (hybrid_search, _HYBRID_SQL),
    "verdicts_recorded": (verdicts_recorded, f"""{_REQUESTS_SQL}, b AS (SELECT client_id, attribute_key, max(ts) AS created_at FROM o WHERE before = 'cleared' AND verdict <> 'cleared' GROUP BY ALL)
        SELECT client_id, attribute_key, verdict, override_text, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM o JOIN b USING (client_id, attribute_key) WHERE back = 1 AND verdict <> 'cleared'"""),
    "verdict_events": (verdict_events, f"{_REQUESTS_SQL} SELECT client_id, attribute_key, event_id, verdict FROM o WHERE verdict <> 'cleared' OR before <> 'cleared'"),
    "facts_listed": (facts_listed, f"WITH {_MERGE_SQL} SELECT attribute_key, instance_key, resolved_value FROM merged WHERE client_id = 7 ORDER BY 1, 2"),
    "node_provenance": (node_provenance, f"""WITH facts AS ({line_facts_sql()}), a AS (SELECT DISTINCT CASE WHEN fact_id % 7 = 0 THEN -fact_id ELSE fact_id END AS node_id, CASE WHEN fact_id % 5 = 0 THEN client_id + 1 ELSE client_id END AS client_id FROM facts)
        SELECT a.node_id, a.client_id, f.doc_id, f.attribute_key, f.confidence, CASE WHEN f.fact_id IS NOT NULL THEN '{{"page":' || (f.doc_id % 9) || ',"extractor":"regex"}}' END AS provenance, CASE WHEN f.fact_id IS NULL THEN 'not found' END AS problem
        FROM a LEFT JOIN facts f ON f.fact_id = a.node_id AND f.client_id = a.client_id"""),
    "documents_deleted": (documents_deleted, f"WITH facts AS ({line_facts_sql()}) {_counts_sql(_DOCUMENT_PARTS, f'doc_id IN {_GONE}')}"),
    "facts_after_delete": (facts_after_delete, f"WITH {_LEFT_SQL}, {_LEFT_ADJ_SQL} SELECT client_id, attribute_key, instance_key, resolved_value, value_date::VARCHAR AS value_date, value_num, confidence, verification_status, conflict, needs_review FROM settled"),
    "tenants_purged": (tenants_purged, f"WITH {_MERGE_SQL}, {_VERDICTS_SQL}, gone AS (SELECT DISTINCT o_orderkey % 500 AS client_id FROM orders WHERE o_orderkey % 500 % 9 = 4) {_counts_sql(_TENANT_PARTS, 'client_id IN (SELECT client_id FROM gone)')}"),
    "tree_pages": (tree_pages, _PAGES_SQL),
    "version_diff_last": (version_diff_last, """
        WITH a AS (SELECT o_custkey::VARCHAR AS path, arg_max(o_orderstatus || o_orderpriority, o_orderkey) AS hash FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1), b AS (SELECT o_custkey::VARCHAR AS path, arg_max(o_orderstatus || o_orderpriority, o_orderkey) AS hash FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1)
        SELECT path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.hash IS DISTINCT FROM b.hash"""),
}
