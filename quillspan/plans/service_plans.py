"""Queries over keys, audit, traces, layout and the smaller functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import ontology
from quillspan.functions import dates, vector
from quillspan.operators import extract, gate, merge, search, service, serving
from quillspan.plans.fact_plans import _MERGE_SQL, _MULTI
from quillspan.plans.gate_plans import _GATE_SQL
from quillspan.plans.version_plans import _lex_sql, _lexical, _vec_sql, _vector, areps_plan
from quillspan.sources.tables import kyc_documents, line_facts, table

NOW = "2024-01-20 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.when(F.pmod("event_id", F.lit(5)) == 0, F.col("ts")).alias("disabled_at"), F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("ts") + F.expr("interval 3 days")).alias("expires_at"), F.when(F.pmod("event_id", F.lit(4)) == 0, F.array(F.lit("*"))).otherwise(F.array(F.pmod("user_id", F.lit(10)).cast("string"))).alias("client_ids"), F.array("event_type").alias("scopes"))


_KEYS_SQL = "k AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN ts END AS disabled_at, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 3 DAY END AS expires_at, CASE WHEN event_id % 4 = 0 THEN ['*'] ELSE [(user_id % 10)::VARCHAR] END AS client_ids, event_type FROM events)"


def active_keys(spark: SparkSession, sf: str) -> DataFrame:
    return service.active(_keys(spark, sf), _now()).where(service.allowed(F.col("client_ids"), F.lit("3"))).select("id")


def key_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return service.rotate(_keys(spark, sf), _now(), 500).select("rotated_from", F.date_format("old_expires_at", "yyyy-MM-dd HH:mm:ss").alias("old_expires_at"))


def verdict_status(spark: SparkSession, sf: str) -> DataFrame:
    merged = merge.merge_facts(line_facts(spark, sf))
    asked = merged.select("client_id", "attribute_key", F.when(F.pmod("client_id", F.lit(3)) == 0, F.col("instance_key")).when(F.pmod("client_id", F.lit(3)) == 1, "").otherwise("nowhere").alias("instance_key")).distinct()
    return service.check_verdicts(asked, merged, ontology.MULTI_VALUED_KEYS)


def access_log_page(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("client_id"))
    return service.page_of_log(log, ("2024-01-10 00:00:00", 0), "7", 500).select("id", "client_id")


def audit_tenants(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", service.audit_tenant(F.when(e % 3 == 0, "path").when(e % 3 == 1, ""), F.when(e % 2 == 0, "query"), F.when(e % 5 == 0, "state")).alias("client_id"))


def decision_trace(spark: SparkSession, sf: str) -> DataFrame:
    return service.decision_trace(gate.run_gate(kyc_documents(spark, sf)))


def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as words of a page: block by order, line by number."""
    w = table(spark, sf, "lineitem").select(F.pmod("l_orderkey", F.lit(50)).alias("page"), F.col("l_orderkey").alias("block"), F.lit(1).alias("par"), (F.col("l_linenumber") % 2).alias("line"), F.struct("l_linenumber", "l_partkey").alias("word_no"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5).alias("x1"), F.col("l_linenumber").alias("y0"), (F.col("l_linenumber") + 1).alias("y1"), (F.pmod("l_suppkey", F.lit(102)) - 1).alias("conf"))
    return service.words_to_lines(w).select("block", "line", "text", "x0", "y0", "x1", "y1", "confidence")


def polygon_boxes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    p = F.array(*[F.pmod(F.col("c_custkey") * k, F.lit(97)) for k in (3, 5, 7, 11, 13, 17, 19, 23)])
    return c.select("c_custkey", service.polygon_box(p).alias("b")).select("c_custkey", "b.*")


def zone_dates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.format_string("%06d", F.pmod(F.col("c_custkey") * 7919, F.lit(1000000)))
    return table(spark, sf, "customer").select("c_custkey", dates.mrz_date(t, True, 2024).cast("string").alias("birth"), dates.mrz_date(t, False, 2024).cast("string").alias("expiry"))


def log_months(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").groupBy(dates.month_name(day).alias("month")).agg(F.count("*").alias("n"), F.count_if(day < dates.retention_cutoff(F.lit("1997-01-01").cast("date"), 90)).alias("beyond"))


def confidences(spark: SparkSession, sf: str) -> DataFrame:
    v = F.element_at(F.array(*[F.lit(x) for x in ("0.7", "1.5", "-2", "true", "many", "0")]), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", service.coerce_confidence(v).alias("confidence"))


def bilingual_profile(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.pmod("l_partkey", F.lit(3)) == 0, "es").otherwise("en").alias("lang"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).alias("end"), (1 - 5 * F.col("l_discount")).alias("confidence"))
    return service.language_profile(spans)


def labelled_tails(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), F.lit(1).alias("line_no"), F.concat(F.lit("Employer:  "), F.col("role"), F.lit(" Box 14 = "), F.col("turn").cast("string")).alias("line"))
    return service.anchor_tails(lines, ["employer", "box 14", "absent"])


def amount_totals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Total CAD $"), F.format_number(F.pmod("o_orderkey", F.lit(5000)), 0), F.lit(".50, code 12345.67")).alias("text"))
    return o.select("o_orderkey", F.array_join(F.transform(service.amounts(F.col("text")), lambda v: F.format_string("%.2f", v)), ";").alias("amounts"))


def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical and vector legs within a scope, fused, joined back to their documents."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scope"))
    inside = docs.where("scope <> 'src3'")
    return search.fuse([_lexical(spark, sf, inside), _vector(spark, sf, inside)], top=10).join(docs, "id").select("query_id", "id", "rnk", "score", "scope")


def document_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of one tenant's list, behind the cursor that the first page hands on."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("client_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("deleted_at"))
    _, after = service.document_list(o, "O", 40)
    return service.document_list(o, "O", 40, after)[0].select("id")


def document_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that go and stay when the documents of finished orders are deleted."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    return service.remove({"documents": orders, "facts": line_facts(spark, sf)}, orders.where("o_orderstatus = 'F'"), "doc_id")[1]


def tenant_purge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that go and stay when the tenants without an urgent order are purged."""
    o = table(spark, sf, "orders")
    jobs = table(spark, sf, "events").select(F.col("user_id").alias("client_id"))
    gone = table(spark, sf, "customer").select(F.col("c_custkey").alias("client_id")).join(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("client_id")), "client_id", "left_anti")
    return service.remove({"documents": o.select(F.col("o_custkey").alias("client_id")), "jobs": jobs}, gone, "client_id")[1]


def extract_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Every document behind an identifier, read by the finder of its class; a class without one yields nothing."""
    kinds = F.array(*[F.lit(x) for x in ("US_SSN_CARD", "CA_SIN", "US_EIN_LETTER", "MX_CURP", "UTILITY_BILL")])
    numbers = F.array(*[F.lit(x) for x in ("SSN 536-90-4399", "SIN 130-692-544", "EIN 12-3456789", "CURP BOXW310820HNERMN07", "SSN 536-90-4399")])
    at = F.pmod("o_orderkey", F.lit(5)).cast("int")
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.get(kinds, at).alias("doc_type"), F.concat(F.get(numbers, at), F.lit(" "), "o_orderpriority").alias("text"))
    return extract.extract_by_type(docs).select("doc_id", "attribute_key", "value")


def anchored_values(spark: SparkSession, sf: str) -> DataFrame:
    """Labels within the turns of conversations; every third conversation has no boxes."""
    c = table(spark, sf, "conversations")
    t = F.col("turn")
    head = F.get(F.array(*[F.lit(x) for x in ("Full Name: ", "Date of Birth ", "", "of Birth Date ", "Adress - ")]), F.pmod(F.col("conv_id") + t, F.lit(5)).cast("int"))
    box = lambda v: F.when(F.col("conv_id") % 3 > 0, v.cast("double"))
    lines = c.select(F.col("conv_id").alias("doc_id"), t.alias("line_no"), F.concat(head, "text").alias("text"), F.floor(t / 6).alias("page"), box(t % 2 * 50).alias("x0"), box(F.floor(t / 2) * 10).alias("y0"), box(t % 2 * 50 + 40).alias("x1"), box(F.floor(t / 2) * 10 + 8).alias("y1"))
    return extract.anchor_extract(lines, ["Full Name", "Date of Birth", "Address"], 60)


def soft_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as forms of three lines; the labels are those of the forms' classes."""
    k = F.col("c_custkey")
    at = F.pmod(k, F.lit(4)).cast("int")
    kinds, heads = (F.array(*[F.lit(x) for x in v]) for v in (("US_W2", "US_EIN_LETTER", "US_SSN_CARD", "UTILITY_BILL"), ("Employer: ", "Business name: ", "Name: ", "Name: ")))
    text = F.array(F.lit("Form"), F.concat(F.get(heads, at), F.lit("c"), k.cast("string")), F.concat(F.lit("Box 1 = "), k.cast("string")))
    forms = table(spark, sf, "customer").select(k.alias("doc_id"), F.get(kinds, at).alias("doc_type"), F.posexplode(text).alias("line_no", "text"))
    return extract.soft_fields(forms.select("*", *[F.lit(None).cast("double").alias(c) for c in ("page", "x0", "y0", "x1", "y1")])).select("doc_id", "attribute_key", "value", "confidence")


def facts_console(spark: SparkSession, sf: str) -> DataFrame:
    """Merged facts whose key or value holds some letters, whatever their case."""
    return serving.containing(merge.merge_facts(line_facts(spark, sf)), " NÉV a").select("client_id", "attribute_key", "instance_key")


def verdict_history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.pmod("user_id", F.lit(40)).alias("client_id"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(9)).cast("string")).alias("attribute_key"), F.lit("").alias("instance_key"), F.col("event_type").alias("verdict"), F.col("ts").alias("created_at"))
    return merge.verdict_history(e, 7, "k3").select("event_id", "verdict")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return service.answerable_questions(areps_plan(spark, sf))


def stub_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(F.aggregate(vector.stub_vector(F.col("text"), 48), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


PLANS = {
    "active_keys": (active_keys, f"WITH {_KEYS_SQL} SELECT id FROM k WHERE disabled_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND (list_contains(client_ids, '*') OR list_contains(client_ids, '3'))"),
    "key_rotation": (key_rotation, f"WITH {_KEYS_SQL} SELECT id AS rotated_from, strftime(least(coalesce(expires_at, TIMESTAMP '{NOW}' + INTERVAL 168 HOUR), TIMESTAMP '{NOW}' + INTERVAL 168 HOUR), '%Y-%m-%d %H:%M:%S') AS old_expires_at FROM k"),
    "verdict_status": (verdict_status, f"""WITH {_MERGE_SQL}, m AS (SELECT * FROM merged), a AS (SELECT DISTINCT client_id, attribute_key, CASE client_id % 3 WHEN 0 THEN instance_key WHEN 1 THEN '' ELSE 'nowhere' END AS instance_key FROM m)
        SELECT a.*, CASE WHEN a.attribute_key IN ({_MULTI}) AND instance_key = '' THEN '422' WHEN a.attribute_key NOT IN ({_MULTI}) AND instance_key <> '' THEN '422'
            WHEN a.attribute_key IN ({_MULTI}) AND (client_id, attribute_key, instance_key) NOT IN (SELECT (client_id, attribute_key, instance_key) FROM m) THEN '404' ELSE 'ok' END AS status FROM a"""),
    "access_log_page": (access_log_page, "SELECT event_id AS id, user_id::VARCHAR AS client_id FROM events WHERE user_id = 7 AND ts < TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 200"),
    "audit_tenants": (audit_tenants, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'path' WHEN event_id % 2 = 0 THEN 'query' WHEN event_id % 5 = 0 THEN 'state' END AS client_id FROM events"),
    "decision_trace": (decision_trace, f"""{_GATE_SQL} SELECT doc_id, printf('%s/%.4f', doc_type, doc_confidence::DOUBLE) AS classification, pii_types,
        CASE WHEN (doc_type = 'UNKNOWN' OR doc_confidence < 0.55) AND sensitivity <> 'LOW' THEN printf('low-confidence classification (confidence=%.2f < floor=0.55) and sensitivity=%s', doc_confidence::DOUBLE, sensitivity)
            WHEN sensitivity <> 'LOW' THEN printf('%s sensitivity and redaction inactive', sensitivity)
            WHEN doc_type = 'UNKNOWN' OR doc_confidence < 0.55 THEN printf('LOW sensitivity but low-confidence classification (confidence=%.2f < floor=0.55)', doc_confidence::DOUBLE)
            ELSE printf('LOW sensitivity, confident classification (confidence=%.2f >= floor=0.55), gate open', doc_confidence::DOUBLE) END AS rationale FROM routed"""),
    "ocr_lines": (ocr_lines, "SELECT l_orderkey AS block, l_linenumber % 2 AS line, string_agg(l_returnflag || l_partkey, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS text, min(l_quantity) AS x0, min(l_linenumber) AS y0, max(l_quantity + 5) AS x1, max(l_linenumber + 1) AS y1, round(avg(l_suppkey % 102 - 1) / 100, 6) AS confidence FROM lineitem WHERE l_suppkey % 102 - 1 >= 0 GROUP BY 1, 2"),
    "polygon_boxes": (polygon_boxes, "SELECT c_custkey, least(c_custkey * 3 % 97, c_custkey * 7 % 97, c_custkey * 13 % 97, c_custkey * 19 % 97) AS x0, least(c_custkey * 5 % 97, c_custkey * 11 % 97, c_custkey * 17 % 97, c_custkey * 23 % 97) AS y0, greatest(c_custkey * 3 % 97, c_custkey * 7 % 97, c_custkey * 13 % 97, c_custkey * 19 % 97) AS x1, greatest(c_custkey * 5 % 97, c_custkey * 11 % 97, c_custkey * 17 % 97, c_custkey * 23 % 97) AS y1 FROM customer"),
    "zone_dates": (zone_dates, "SELECT c_custkey, try_strptime(CASE WHEN left(t, 2)::INT > 24 THEN '19' ELSE '20' END || t, '%Y%m%d')::DATE::VARCHAR AS birth, try_strptime(CASE WHEN left(t, 2)::INT <= 74 THEN '20' ELSE '19' END || t, '%Y%m%d')::DATE::VARCHAR AS expiry FROM (SELECT c_custkey, printf('%06d', c_custkey * 7919 % 1000000) AS t FROM customer)"),
    "log_months": (log_months, "SELECT strftime(o_orderdate, '%Y_%m') AS month, count(*) AS n, count(*) FILTER (o_orderdate::DATE < DATE '1997-01-01' - INTERVAL 90 DAY) AS beyond FROM orders GROUP BY 1"),
    "confidences": (confidences, "SELECT event_id, [0.7, 1.0, 0.0, 0.5, 0.5, 0.0][event_id % 6 + 1]::DOUBLE AS confidence FROM events"),
    "bilingual_profile": (bilingual_profile, """
        WITH c AS (SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 3 = 0 THEN 'es' ELSE 'en' END AS lang, sum(l_linenumber + l_quantity - l_linenumber) AS chars, bool_or(l_linenumber + l_quantity - l_linenumber >= 25 AND 1 - 5 * l_discount >= 0.5) AS real FROM lineitem GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, lang = 'en' DESC) AS rn FROM c) SELECT doc_id, max(CASE WHEN rn = 1 THEN lang END) AS dominant, bool_or(rn > 1 AND real) AS bilingual FROM r GROUP BY 1"""),
    "labelled_tails": (labelled_tails, "SELECT conv_id || '/' || turn AS doc_id, 1 AS line_no, a AS anchor, CASE a WHEN 'employer' THEN role || ' Box 14 = ' || turn ELSE turn::VARCHAR END AS value FROM conversations, (VALUES ('employer'), ('box 14')) v(a)"),
    "amount_totals": (amount_totals, "SELECT o_orderkey, printf('%.2f', (o_orderkey % 5000)::DOUBLE + 0.5) || ';123.00' AS amounts FROM orders"),
    "search_hybrid": (search_hybrid, f"""WITH ok AS (SELECT doc_id AS id, source AS scope FROM documents), {_lex_sql("doc_id IN (SELECT id FROM ok WHERE scope <> 'src3')")}, {_vec_sql("e.vec_id IN (SELECT id FROM ok WHERE scope <> 'src3')")},
        f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rnk)), 9) AS score FROM (SELECT query_id, id, rnk FROM lex WHERE rnk <= 50 UNION ALL SELECT query_id, id, rnk FROM vec WHERE rnk <= 50) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk FROM f) SELECT query_id, id, rnk, score, scope FROM r JOIN ok USING (id) WHERE rnk <= 10"""),
    "document_page": (document_page, "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 7 <> 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40 OFFSET 40"),
    "document_delete": (document_delete, """WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT 'documents' AS table_name, count(*) FILTER (o_orderstatus = 'F') AS removed, count(*) FILTER (o_orderstatus <> 'F') AS kept FROM orders
        UNION ALL SELECT 'facts', count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM g)), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM g)) FROM lineitem"""),
    "tenant_purge": (tenant_purge, """WITH g AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))
        SELECT 'documents' AS table_name, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM g)) AS removed, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM g)) AS kept FROM orders
        UNION ALL SELECT 'jobs', count(*) FILTER (user_id IN (SELECT c_custkey FROM g)), count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM g)) FROM events"""),
    "extract_dispatch": (extract_dispatch, """SELECT o_orderkey AS doc_id, k AS attribute_key, v AS value FROM orders JOIN (VALUES (0, 'id.ssn', '536-90-4399'), (1, 'id.sin', '130-692-544'), (2, 'id.ein', '12-3456789'),
        (3, 'id.curp', 'BOXW310820HNERMN07'), (3, 'identity.date_of_birth', '1931-08-20'), (3, 'identity.sex', 'M')) t(i, k, v) ON o_orderkey % 5 = i"""),
    "anchored_values": (anchored_values, None),
    "soft_fields": (soft_fields, """SELECT c_custkey AS doc_id, k AS attribute_key, CASE WHEN n THEN 'c' || c_custkey ELSE c_custkey::VARCHAR END AS value, 0.6::DOUBLE AS confidence FROM customer
        JOIN (VALUES (0, 'income.employer', TRUE), (0, 'income.amount', FALSE), (1, 'entity.legal_name', TRUE), (1, 'entity.legal_name', TRUE), (2, 'identity.full_name', TRUE)) t(i, k, n) ON c_custkey % 4 = i"""),
    "facts_console": (facts_console, f"WITH {_MERGE_SQL} SELECT client_id, attribute_key, instance_key FROM merged WHERE contains(lower(attribute_key), 'név a') OR contains(lower(resolved_value), 'név a')"),
    "verdict_history": (verdict_history, "SELECT event_id, event_type AS verdict FROM events WHERE user_id % 40 = 7 AND event_id % 9 = 3"),
    "questions": (questions, "SELECT conv_id || '.' || turn AS path, '[stub:hypothetical_q] ' || substr(text, 1, 120) AS question FROM conversations WHERE trim(text) <> ''"),
    "stub_embeddings": (stub_embeddings, "SELECT conv_id, turn, round(list_sum(list_transform(range(48), lambda i: ('0x' || substr(sha256(text), (i % 32) * 2 + 1, 2))::INT / 127.5::DOUBLE - 1)), 6) AS total FROM conversations"),
}
