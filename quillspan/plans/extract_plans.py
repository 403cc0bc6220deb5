"""Queries over extraction: identifiers, machine-readable zones, boxes, replies, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import ids
from quillspan.functions import text as tx
from quillspan.functions.tables import kept
from quillspan.operators import extract, ranking
from quillspan.sources.tables import table


def _us(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    ssn = F.format_string("%03d-%02d-%04d", F.pmod(c * 7, F.lit(1000)), F.pmod(c, F.lit(100)), F.pmod(c * 13, F.lit(10000)))
    ein = F.format_string("%02d-%07d", F.pmod(c, F.lit(100)), F.pmod(c * 101, F.lit(10000000)))
    return table(spark, sf, "customer").select(c.alias("doc_id"), F.concat(F.lit("number: "), ssn, F.lit(" and "), ein, F.lit(".")).alias("text"))


def _canada(spark: SparkSession, sf: str) -> DataFrame:
    n = F.format_string("%09d", F.pmod(F.col("c_custkey") * 1234567, F.lit(1000000000)))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("SIN "), F.substring(n, 1, 3), F.lit(" "), F.substring(n, 4, 3), F.lit(" "), F.substring(n, 7, 3), F.lit(" BN "), n, F.lit("RT0001")).alias("text"))


_MX = ["BOXW310820HNERMN07 VACE860307JN1", "BOXW310820XNERMN01 VACE860307JNA", "SABC560626MDFLRN01 GMRRJL85031509H123", "PERJ820123HDFXXX08 GODE561231GR8"]


def _mexico(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.get(F.array(*[F.lit(x) for x in _MX]), F.pmod("c_custkey", F.lit(4)).cast("int")).alias("text"))


_ZONES = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10", "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C35UTO7408122F1204159ZE184226B<<<<<10", "no zone"]


def ids_us(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(_us(spark, sf), extract.us_ids).select("doc_id", "attribute_key", "value", "confidence")


def ids_ca(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(_canada(spark, sf), extract.canada_ids).select("doc_id", "attribute_key", "value", "confidence")


def ids_mx(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(_mexico(spark, sf), extract.mexico_ids).select("doc_id", "attribute_key", "value", "confidence", "checksum_ok")


def ids_mrz(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.get(F.array(*[F.lit(x) for x in _ZONES]), F.pmod("c_custkey", F.lit(3)).cast("int")).alias("text"))
    return extract.passport_zone(docs)


def passport_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A passport of each customer, every third with a wrong check digit, every fifth without such a birth date."""
    # The table is one small file, so its rows are dealt out before the work on them.
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").repartition(ranking.TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    k, pad = F.col("c_custkey"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    check = lambda c: ids.mrz_check(c).cast("string")
    number = F.rpad(F.concat(F.lit("K"), pad(k, 7)), 9, "<")
    birth = F.concat(pad(F.pmod(k, F.lit(100)), 2), F.when(k % 5 == 0, "13").otherwise(pad(F.pmod(k, F.lit(12)) + 1, 2)), F.lit("15"))
    expiry = F.concat(pad(F.pmod(k * 3, F.lit(100)), 2), F.lit("0630"))
    sex = F.when(k % 3 == 1, "M").when(k % 3 == 2, "F").otherwise("<")
    first = F.concat(number, check(number), F.lit("UTO"), birth, check(birth))
    second = F.concat(expiry, check(expiry), F.lit("<" * 14), F.lit("0"))
    whole = check(F.concat(number, check(number), birth, check(birth), second))
    last = F.when(k % 3 == 0, F.translate(whole, "0123456789", "1234567890")).otherwise(whole)
    names = F.rpad(F.concat(F.lit("P<UTOOF"), F.translate("c_mktsegment", " ", "<"), F.lit("<<ANNA<"), F.chr(F.pmod(k, F.lit(26)) + 65)), 44, "<")
    text = F.concat(F.lit("PASSPORT\n"), names, F.lit("\n"), first, sex, second, last, F.lit("\nend"))
    return rows.select(k.alias("doc_id"), text.alias("text"))


def passport_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the passports; texts are written, as their check digits would else be computed again for each field that is read."""
    return extract.passport_facts(kept(passport_texts(spark, sf)), 2024).withColumn("value_date", F.col("value_date").cast("string"))


def bbox_bind(spark: SparkSession, sf: str) -> DataFrame:
    """Labels are every fifth order; boxes come from its numbers."""
    o = F.col("o_orderkey")
    lines = table(spark, sf, "orders").select(o.alias("id"), o.cast("string").alias("text"), F.floor(o / 50).alias("page"), (F.pmod(o, F.lit(5)) * 20).alias("x0"), (F.pmod(o, F.lit(5)) * 20 + 15).alias("x1"), (F.floor(F.pmod(o, F.lit(50)) / 5) * 10).alias("y0"), (F.floor(F.pmod(o, F.lit(50)) / 5) * 10 + 8).alias("y1"))
    return extract.bind_values(lines, lines.where("id % 5 in (0, 4)"))


def json_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    """Replies around the events' properties: bare, fenced, inside prose, and broken."""
    p = F.col("props")
    reply = F.when(F.pmod("event_id", F.lit(4)) == 0, p).when(F.pmod("event_id", F.lit(4)) == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.pmod("event_id", F.lit(4)) == 2, F.concat(F.lit("Sure: "), p, F.lit(" done }"))).otherwise(F.lit("no object { here"))
    return extract.attributes(table(spark, sf, "events").select(F.col("event_id").alias("id"), reply.alias("reply")))


def page_keyset(spark: SparkSession, sf: str) -> DataFrame:
    """One page behind a cursor, newest first, with the cursor of each row."""
    events = table(spark, sf, "events")
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    page = events.where(F.struct("ts", "event_id") < F.struct(at, F.lit(10**9).cast("long"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(51)
    return page.select("event_id", tx.cursor(F.col("ts"), F.col("event_id")).alias("cursor"))


def path_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", tx.path_label(F.col("p_name")).alias("label"), tx.path_depth(F.concat_ws(".", F.lit("a"), tx.path_label(F.col("p_type")))).cast("long").alias("depth"), tx.blob_key(F.sha2("p_name", 256), F.concat(F.col("p_type"), F.lit("/x "), F.col("p_brand"), F.lit(".pdf"))).alias("blob_key"))


def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("content_hash"))


_LUHN = "(list_sum(list_transform(range(9), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN substr({0}, i + 1, 1)::INT * 2 > 9 THEN substr({0}, i + 1, 1)::INT * 2 - 9 ELSE substr({0}, i + 1, 1)::INT * 2 END) ELSE substr({0}, i + 1, 1)::INT END)) % 10 = 0)"
_MX_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_MX))

PLANS = {
    "ids_us": (ids_us, """
        WITH n AS (SELECT c_custkey AS doc_id, c_custkey * 7 % 1000 AS area, c_custkey % 100 AS grp, c_custkey * 13 % 10000 AS ser, c_custkey * 101 % 10000000 AS e FROM customer),
        s AS (SELECT doc_id, printf('%03d-%02d-%04d', area, grp, ser) AS v, area NOT IN (0, 666) AND area < 900 AND grp <> 0 AND ser <> 0 AND printf('%03d-%02d-%04d', area, grp, ser) NOT IN ('078-05-1120', '457-55-5462', '219-09-9999') AS ssn,
            area >= 900 AND (grp BETWEEN 70 AND 88 OR grp BETWEEN 90 AND 92 OR grp BETWEEN 94 AND 99) AS itin FROM n)
        SELECT doc_id, 'id.ein' AS attribute_key, printf('%02d-%07d', grp, e) AS value, 0.95 AS confidence FROM n
        UNION ALL SELECT doc_id, CASE WHEN ssn THEN 'id.ssn' ELSE 'id.itin' END, v, 0.95 FROM s WHERE ssn OR itin"""),
    "ids_ca": (ids_ca, f"""
        WITH n AS (SELECT c_custkey AS doc_id, printf('%09d', c_custkey * 1234567 % 1000000000) AS v FROM customer)
        SELECT doc_id, 'id.sin' AS attribute_key, substr(v, 1, 3) || '-' || substr(v, 4, 3) || '-' || substr(v, 7, 3) AS value, 0.95 AS confidence FROM n WHERE substr(v, 1, 1) NOT IN ('0', '8') AND {_LUHN.format('v')}
        UNION ALL SELECT doc_id, 'id.business_number', v || 'RT0001', 0.95 FROM n WHERE {_LUHN.format('v')}"""),
    "ids_mx": (ids_mx, """
        WITH t(at_, k, v, c, ok) AS (VALUES
            (0, 'id.curp', 'BOXW310820HNERMN07', 0.97, TRUE), (0, 'identity.date_of_birth', '1931-08-20', 0.95, TRUE), (0, 'identity.sex', 'M', 0.95, TRUE), (0, 'id.rfc', 'VACE860307JN1', 0.95, TRUE),
            (1, 'id.curp', 'BOXW310820XNERMN01', 0.97, TRUE), (1, 'identity.date_of_birth', '1931-08-20', 0.95, TRUE), (1, 'identity.sex', 'X', 0.95, TRUE), (1, 'id.rfc', 'VACE860307JNA', 0.6, FALSE),
            (2, 'id.curp', 'SABC560626MDFLRN01', 0.97, TRUE), (2, 'identity.date_of_birth', '1956-06-26', 0.95, TRUE), (2, 'identity.sex', 'F', 0.95, TRUE), (2, 'id.ine_clave_elector', 'GMRRJL85031509H123', 0.7, NULL),
            (3, 'id.rfc', 'GODE561231GR8', 0.95, TRUE))
        SELECT c_custkey AS doc_id, k AS attribute_key, v AS value, c AS confidence, ok AS checksum_ok FROM customer JOIN t ON c_custkey % 4 = at_"""),
    "ids_mrz": (ids_mrz, """
        SELECT c_custkey AS doc_id, 'L898902C3' AS number, 'ERIKSSON' AS surname, 'ANNA MARIA' AS given_names, 'UTO' AS nationality, '740812' AS birth, '120415' AS expiry, 'F' AS sex, c_custkey % 3 = 0 AS checks, CASE WHEN c_custkey % 3 = 0 THEN 0.99 ELSE 0.40 END AS confidence
        FROM customer WHERE c_custkey % 3 < 2"""),
    "passport_facts": (passport_facts, """
        WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS b, lpad((c_custkey * 3 % 100)::VARCHAR, 2, '0') AS e, lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') AS mm FROM customer),
        d AS (SELECT *, CASE WHEN k % 5 > 0 THEN (CASE WHEN k % 100 > 24 THEN '19' ELSE '20' END || b || '-' || mm || '-15')::DATE END AS born, (CASE WHEN k * 3 % 100 > 74 THEN '19' ELSE '20' END || e || '-06-30')::DATE AS ends FROM c),
        f AS (SELECT k, unnest([{'a': 'identity.surname', 'v': 'OF' || m, 'd': NULL::DATE, 's': 'HIGH'}, {'a': 'identity.given_names', 'v': 'ANNA ' || chr((k % 26 + 65)::INTEGER), 'd': NULL, 's': 'HIGH'},
            {'a': 'id.passport_number', 'v': 'K' || lpad(k::VARCHAR, 7, '0'), 'd': NULL, 's': 'HIGH'}, {'a': 'identity.nationality', 'v': 'UTO', 'd': NULL, 's': 'MEDIUM'},
            {'a': 'identity.date_of_birth', 'v': coalesce(born::VARCHAR, b || '1315'), 'd': born, 's': 'HIGH'}, {'a': 'identity.sex', 'v': CASE k % 3 WHEN 1 THEN 'M' WHEN 2 THEN 'F' END, 'd': NULL, 's': 'MEDIUM'},
            {'a': 'doc.expiry_date', 'v': ends::VARCHAR, 'd': ends, 's': 'LOW'}]) AS x FROM d)
        SELECT k AS doc_id, x.a AS attribute_key, x.v AS value, x.d::VARCHAR AS value_date, CASE WHEN k % 3 > 0 THEN 0.99 ELSE 0.40 END::DOUBLE AS confidence, k % 3 > 0 AS checksum_ok, CASE WHEN k % 3 > 0 THEN 'checksum_verified' ELSE 'unverified' END AS verification_status, x.s AS sensitivity FROM f"""),
    "bbox_bind": (bbox_bind, """
        WITH l AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR AS text, floor(o_orderkey / 50) AS page, o_orderkey % 5 * 20 AS x0, o_orderkey % 5 * 20 + 15 AS x1, floor(o_orderkey % 50 / 5) * 10 AS y0, floor(o_orderkey % 50 / 5) * 10 + 8 AS y1 FROM orders),
        c AS (SELECT a.id, a.text AS label, b.text AS value, b.id AS rid, CASE WHEN b.x0 >= a.x1 AND least(a.y1, b.y1) > greatest(a.y0, b.y0) THEN 0 ELSE 1 END AS side, CASE WHEN b.x0 >= a.x1 AND least(a.y1, b.y1) > greatest(a.y0, b.y0) THEN b.x0 - a.x1 ELSE b.y0 - a.y1 END AS gap
            FROM l a JOIN l b ON a.page = b.page AND a.id <> b.id AND ((b.x0 >= a.x1 AND least(a.y1, b.y1) > greatest(a.y0, b.y0)) OR (b.y0 >= a.y1 AND least(a.x1, b.x1) > greatest(a.x0, b.x0))) WHERE a.id % 5 IN (0, 4))
        SELECT label, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, gap, rid) AS rn FROM c) WHERE rn = 1"""),
    "json_tolerant": (json_tolerant, "SELECT event_id AS id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE event_id % 4 < 3) WHERE k <> 'confidence'"),
    "page_keyset": (page_keyset, "SELECT event_id, rtrim(translate(to_base64(encode(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || event_id)), '+/', '-_'), '=') AS cursor FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id < 1000000000) ORDER BY ts DESC, event_id DESC LIMIT 51"),
    "path_labels": (path_labels, r"""
        SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS label, 2 AS depth,
            sha256(p_name) || '/' || left(trim(regexp_replace('x ' || p_brand || '.pdf', '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), 80) AS blob_key FROM part"""),
    "token_estimates": (token_estimates, r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) // 4 AS tokens, sha256(text) AS content_hash FROM documents"),
}
