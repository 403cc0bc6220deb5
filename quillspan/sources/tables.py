"""Tables of a folder, tenant access, and the views that plans derive from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import ontology

#: Identifiers that the synthetic view adds, by the document's number modulo 5; the last adds none.
SAMPLE_IDS = ["SSN 536-90-4399", "SIN 130-692-544", "EIN 12-3456789", "CURP BOXW310820HNERMN07", ""]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def for_tenant(df: DataFrame, client_id: str | None) -> DataFrame:
    """Only the tenant's rows; without a tenant none."""
    return df.where(F.lit(False)) if client_id is None else df.where(F.col("client_id") == client_id)


def header(code_at: int) -> str:
    """The anchors of one class as a heading; the class behind the last has none."""
    if code_at >= len(ontology.DOCUMENT_TYPES):
        return ""
    _, _, _, en, es = ontology.DOCUMENT_TYPES[code_at]
    return " / ".join([*en, *es])


def kyc_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, client_id, text): documents behind a heading of one class and an identifier, so that every route occurs."""
    n = len(ontology.DOCUMENT_TYPES) + 1
    headings = F.get(F.array(*[F.lit(header(i)) for i in range(n)]), F.pmod("doc_id", F.lit(n)).cast("int"))
    numbers = F.get(F.array(*[F.lit(x) for x in SAMPLE_IDS]), F.pmod("doc_id", F.lit(len(SAMPLE_IDS))).cast("int"))
    return table(spark, folder, "documents").select("doc_id", F.col("source").alias("client_id"), F.concat_ws("\n", headings, numbers, "text").alias("text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def kyc_sql() -> str:
    """The same view in SQL."""
    n = len(ontology.DOCUMENT_TYPES) + 1
    heads = ", ".join(quoted(header(i)) for i in range(n))
    ids = ", ".join(quoted(x) for x in SAMPLE_IDS)
    return f"SELECT doc_id, source AS client_id, [{heads}][doc_id % {n} + 1] || chr(10) || [{ids}][doc_id % {len(SAMPLE_IDS)} + 1] || chr(10) || text AS text FROM documents"


def line_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of clients, one for each order line, in the shape that the merge takes."""
    keys = F.array(*[F.lit(k) for k in ontology.ATTRIBUTE_KEYS])
    status = F.array(*[F.lit(s) for s in ("unverified", "checksum_verified", "llm_unverified", "human_verified")])
    lines = table(spark, folder, "lineitem")
    at = F.pmod("l_suppkey", F.lit(5)).cast("int")
    return lines.select(
        F.pmod("l_orderkey", F.lit(500)).alias("client_id"), F.col("l_orderkey").alias("doc_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("fact_id"),
        F.get(keys, F.pmod("l_partkey", F.lit(len(ontology.ATTRIBUTE_KEYS))).cast("int")).alias("attribute_key"),
        F.when(F.pmod("l_partkey", F.lit(7)) == 0, F.lit(None)).otherwise(F.concat(F.lit(" Név "), "l_returnflag", F.lit("  "), "l_linestatus")).alias("value_text"),
        F.when(F.pmod("l_partkey", F.lit(3)) == 0, F.col("l_shipdate").cast("date")).alias("value_date"),
        F.when(F.pmod("l_partkey", F.lit(5)) == 0, F.col("l_quantity").cast("double")).alias("value_num"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.when(at < 4, F.get(status, at)).alias("verification_status"),
    )


def line_facts_sql() -> str:
    keys = ", ".join(quoted(k) for k in ontology.ATTRIBUTE_KEYS)
    n = len(ontology.ATTRIBUTE_KEYS)
    return f"""SELECT l_orderkey % 500 AS client_id, l_orderkey AS doc_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS fact_id,
        [{keys}][l_partkey % {n} + 1] AS attribute_key,
        CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE ' Név ' || l_returnflag || '  ' || l_linestatus END AS value_text,
        CASE WHEN l_partkey % 3 = 0 THEN l_shipdate::DATE END AS value_date,
        CASE WHEN l_partkey % 5 = 0 THEN l_quantity::DOUBLE END AS value_num,
        round(1 - l_discount, 2) AS confidence,
        CASE WHEN l_suppkey % 5 < 4 THEN ['unverified', 'checksum_verified', 'llm_unverified', 'human_verified'][l_suppkey % 5 + 1] END AS verification_status
        FROM lineitem"""
