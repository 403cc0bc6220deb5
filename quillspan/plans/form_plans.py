"""Queries over forms by class: passports, statements, assessments, licences and electoral cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.tables import kept
from quillspan.operators import extract
from quillspan.plans.extract_plans import passport_texts
from quillspan.sources.tables import table

_KINDS = ["CA_T4", "CA_NOA", "CA_DRIVER_LICENSE", "CA_SIN", "CA_BUSINESS_NUMBER", "MX_INE", "UTILITY_BILL"]


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, doc_type, text): each customer's form of one of seven classes, its values made of the customer's row."""
    k, name, cents = F.col("c_custkey"), F.col("c_name"), F.format_string("%02d", F.pmod("c_custkey", F.lit(100)))
    whole = F.pmod(k * 7919, F.lit(1000000))
    amount = F.concat(F.format_number(whole, 0), F.lit("."), cents)
    other = F.when(k % 3 == 0, amount).otherwise(F.concat(F.format_number(F.pmod(k, F.lit(1000)), 0), F.lit(".25")))
    n = F.format_string("%09d", F.pmod(k * 1234567, F.lit(1000000000)))
    day, month = (F.lpad((F.pmod(k, F.lit(m)) + 1).cast("string"), 2, "0") for m in (28, 12))
    year = (1950 + F.pmod(k, F.lit(60))).cast("string")
    names = F.date_format(F.make_date(F.lit(2000), F.pmod(k, F.lit(12)).cast("int") + 1, F.lit(1)), "MMMM")
    date = F.get(F.array(F.concat_ws("-", year, month, day), F.concat_ws("/", month, day, year), F.concat(names, F.lit(" "), day, F.lit(", "), year), F.concat_ws(" ", day, F.substring(names, 1, 3), year), F.concat_ws("/", year, F.lit("13"), day)), F.pmod(F.floor(k / 7), F.lit(5)).cast("int"))

    def lines(*parts) -> Column:
        return F.concat_ws("\n", *[F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p]) for p in parts])

    texts = F.array(
        lines(("T4 statement",), ("Employer: $", amount), ("Employer's name: ", name), ("Box 14: $", amount), ("Total income - CAD ", other), ("SIN ", n)),
        lines(("Net income: none",), ("Balance ;; ", other), ("Refund = $", amount), ("Address: -",), ("Mailing address: ", name, ", ", F.col("c_mktsegment"))),
        lines(("Name: ", k.cast("string")), ("Surname:  ", name), ("Issued ", date)),
        lines(("SIN ", n, " BN ", n, "RT0001"),), lines(("SIN ", n, " BN ", n, "RT0001"),),
        lines(("curp boxw310820hnermn07",), ("key gmrrjl850315", F.format_string("%02d", F.pmod(k, F.lit(100))), F.when(k % 2 == 0, "h").otherwise("m"), F.format_string("%03d", F.pmod(k, F.lit(1000)))), ("IDMEX", n, "123456789012")),
        lines(("Name: ", name),),
    )
    at = F.pmod(k, F.lit(len(_KINDS))).cast("int")
    return table(spark, sf, "customer").select(k.alias("doc_id"), F.get(F.array(*[F.lit(x) for x in _KINDS]), at).alias("doc_type"), F.get(texts, at).alias("text"))


def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the forms by the finder of their class."""
    return extract.extract_by_type(_forms(spark, sf), year=2024).select("doc_id", "attribute_key", "value", "value_num", "confidence")


def passport_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of each customer's passport through the dispatch; every fourth is of a class that no finder reads."""
    docs = kept(passport_texts(spark, sf)).withColumn("doc_type", F.when(F.col("doc_id") % 4 > 0, "PASSPORT").otherwise("UTILITY_BILL"))
    return extract.extract_by_type(docs, year=2024).select("doc_id", "attribute_key", "value", "confidence", "checksum_ok", "sensitivity")


_DIGITS = "(list_sum(list_transform(range(9), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN substr(n, i + 1, 1)::INT * 2 > 9 THEN substr(n, i + 1, 1)::INT * 2 - 9 ELSE substr(n, i + 1, 1)::INT * 2 END) ELSE substr(n, i + 1, 1)::INT END)) % 10 = 0)"
_SIN = "substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7, 3)"
_FORMS_SQL = f"""
    WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_custkey % 7 AS kind, printf('%09d', c_custkey * 1234567 % 1000000000) AS n,
            lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS d, lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') AS m, (1950 + c_custkey % 60)::VARCHAR AS y,
            c_custkey * 7919 % 1000000 + (c_custkey % 100) / 100.0::DOUBLE AS amount, c_custkey % 1000 + 0.25::DOUBLE AS other FROM customer),
    p AS (SELECT *, {_DIGITS} AS checks, CASE WHEN k % 3 = 0 THEN amount ELSE other END AS second FROM c)
    SELECT k AS doc_id, 'income.employer' AS attribute_key, name AS value, NULL::DOUBLE AS value_num, 0.5::DOUBLE AS confidence FROM p WHERE kind = 0
    UNION ALL SELECT k, 'income.amount', NULL, amount, 0.6 FROM p WHERE kind IN (0, 1)
    UNION ALL SELECT k, 'income.amount', NULL, second, 0.6 FROM p WHERE kind IN (0, 1) AND second <> amount
    UNION ALL SELECT k, 'id.sin', {_SIN}, NULL, 0.95 FROM p WHERE kind IN (0, 3) AND checks AND substr(n, 1, 1) NOT IN ('0', '8')
    UNION ALL SELECT k, 'id.business_number', n || program, NULL, 0.95 FROM p, (VALUES (''), ('RT0001')) t(program) WHERE kind = 4 AND checks
    UNION ALL SELECT k, 'address.mailing', name || ', ' || seg, NULL, 0.4 FROM p WHERE kind = 1
    UNION ALL SELECT k, 'identity.full_name', name, NULL, 0.5 FROM p WHERE kind = 2
    UNION ALL SELECT k, 'identity.date_of_birth', CASE WHEN k // 7 % 5 = 4 THEN y || '/13/' || d ELSE y || '-' || m || '-' || d END, NULL, 0.4 FROM p WHERE kind = 2
    UNION ALL SELECT k, a, v, NULL, s FROM p, (VALUES ('id.curp', 'BOXW310820HNERMN07', 0.97), ('identity.date_of_birth', '1931-08-20', 0.95), ('identity.sex', 'M', 0.95)) t(a, v, s) WHERE kind = 5
    UNION ALL SELECT k, 'id.ine_clave_elector', 'GMRRJL850315' || lpad((k % 100)::VARCHAR, 2, '0') || CASE WHEN k % 2 = 0 THEN 'H' ELSE 'M' END || lpad((k % 1000)::VARCHAR, 3, '0'), NULL, CASE WHEN k % 2 = 0 THEN 0.8 ELSE 0.7 END FROM p WHERE kind = 5
    UNION ALL SELECT k, 'id.ine_clave_elector', 'IDMEX' || n, NULL, 0.75 FROM p WHERE kind = 5
"""

PLANS = {
    "form_fields": (form_fields, _FORMS_SQL),
    "passport_dispatch": (passport_dispatch, """
        WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS b, lpad((c_custkey * 3 % 100)::VARCHAR, 2, '0') AS e, lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') AS mm FROM customer WHERE c_custkey % 4 > 0),
        f AS (SELECT k, unnest([{'a': 'identity.surname', 'v': 'OF' || m, 's': 'HIGH'}, {'a': 'identity.given_names', 'v': 'ANNA ' || chr((k % 26 + 65)::INTEGER), 's': 'HIGH'},
            {'a': 'id.passport_number', 'v': 'K' || lpad(k::VARCHAR, 7, '0'), 's': 'HIGH'}, {'a': 'identity.nationality', 'v': 'UTO', 's': 'MEDIUM'},
            {'a': 'identity.date_of_birth', 'v': CASE WHEN k % 5 = 0 THEN b || '1315' ELSE CASE WHEN k % 100 > 24 THEN '19' ELSE '20' END || b || '-' || mm || '-15' END, 's': 'HIGH'},
            {'a': 'identity.sex', 'v': CASE k % 3 WHEN 1 THEN 'M' WHEN 2 THEN 'F' END, 's': 'MEDIUM'}, {'a': 'doc.expiry_date', 'v': CASE WHEN k * 3 % 100 > 74 THEN '19' ELSE '20' END || e || '-06-30', 's': 'LOW'}]) AS x FROM c)
        SELECT k AS doc_id, x.a AS attribute_key, x.v AS value, CASE WHEN k % 3 > 0 THEN 0.99 ELSE 0.40 END::DOUBLE AS confidence, k % 3 > 0 AS checksum_ok, x.s AS sensitivity FROM f"""),
}
