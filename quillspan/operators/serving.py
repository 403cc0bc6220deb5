"""What readers see: sensitivity of keys, masking, verification, fact views, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan import ontology
from quillspan.functions.text import redact


def rank_of(bucket: Column) -> Column:
    order = F.array(*[F.lit(x) for x in ontology.SENSITIVITY])
    return F.array_position(order, F.coalesce(bucket, F.lit("LOW")))


def bucket_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in ontology.SENSITIVITY]), (rank - 1).cast("int"))


def key_sensitivity(key: Column) -> Column:
    spaces = ["identity.", "address.", "income.", "account.", "ownership."]
    inner = F.lit(False)
    for s in spaces:
        inner = inner | F.startswith(key, F.lit(s))
    return F.when(F.startswith(key, F.lit("id.")), "CRITICAL").when(inner, "HIGH").otherwise("LOW")


def effective_sensitivity(stored: Column, key: Column) -> Column:
    return bucket_of(F.greatest(rank_of(stored), rank_of(key_sensitivity(key))))


def verified(status: Column, confidence: Column, conflict: Column) -> Column:
    return (
        F.when(conflict, False)
        .when(status.isNull(), confidence >= 0.8)
        .when(status == "llm_unverified", False)
        .otherwise(status.isin("checksum_verified", "gov_verified", "human_verified"))
    )


def fact_view(merged: DataFrame, mask: bool = True, verified_only: bool = False) -> DataFrame:
    """Facts as served: instances counted before the filter, then values and identities of sensitive keys masked."""
    counted = merged.withColumn("instance_count", F.count("*").over(Window.partitionBy("client_id", "attribute_key")))
    seen = counted.withColumn("verified", verified(F.col("verification_status"), F.col("confidence"), F.col("conflict")))
    if verified_only:
        seen = seen.where("verified")
    level = key_sensitivity(F.col("attribute_key"))
    hidden = level.isin("HIGH", "CRITICAL") if mask else F.lit(False)
    if "identity_basis" in merged.columns:
        seen = seen.withColumn("identity_basis", F.when(hidden & F.col("identity_basis").isNotNull(), "***").otherwise(F.col("identity_basis")))
    return seen.withColumns({
        "sensitivity": level, "masked": hidden,
        "resolved_value": F.when(hidden, redact(F.col("resolved_value"))).otherwise(F.col("resolved_value")),
        "value_date": F.when(hidden, F.lit(None).cast("date")).otherwise(F.col("value_date")),
        "value_num": F.when(hidden, F.lit(None).cast("double")).otherwise(F.col("value_num")),
    })


def mask_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with values and content of sensitive ones hidden; titles stay."""
    level = effective_sensitivity(F.col("sensitivity"), F.coalesce("attribute_key", F.lit("")))
    hidden = level.isin("HIGH", "CRITICAL")
    return nodes.withColumn("effective", level).withColumns({
        "masked": hidden, "value_text": F.when(hidden, redact(F.col("value_text"))).otherwise(F.col("value_text")),
        "value_num": F.when(hidden, F.lit(None).cast("double")).otherwise(F.col("value_num")),
        "content": F.when(hidden & F.col("content").isNotNull(), "[REDACTED]").otherwise(F.col("content")),
    })


def document_sensitivity(gate: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, sensitivity): the gate's bucket, raised to the highest that the document's keys imply."""
    implied = facts.groupBy("doc_id").agg(F.max(rank_of(key_sensitivity(F.col("attribute_key")))).alias("r"))
    return gate.join(implied, "doc_id", "left").select("doc_id", bucket_of(F.greatest(rank_of(F.col("sensitivity")), F.coalesce("r", F.lit(1)))).alias("sensitivity"))


def manifest(nodes: DataFrame) -> DataFrame:
    """(doc_id, kind, name, n): nodes by type, facts by status, distinct attribute keys."""
    by = lambda kind, column, some=F.lit(True): nodes.where(some).groupBy("doc_id", F.col(column).alias("name")).agg(F.count("*").alias("n")).select("doc_id", F.lit(kind).alias("kind"), "name", "n")
    fact = F.col("node_type") == "fact"
    return by("node_type", "node_type").unionByName(by("verification_status", "verification_status", fact)).unionByName(by("attribute_key", "attribute_key", fact))


def containing(facts: DataFrame, letters: str) -> DataFrame:
    """Facts whose key or value holds the letters, whatever their case; blank letters keep all."""
    wanted = letters.strip().lower()
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return facts.where(holds("attribute_key") | holds("resolved_value")) if wanted else facts


#: What a node's provenance says beside its keys.
TRACED = ["doc_id", "version_id", "node_type", "attribute_key", "verification_status", "confidence", "provenance"]


def provenance(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (node_id, client_id and more) with where each node comes from.

    ``problem`` is 'not found' for a node that is not there or is another tenant's.
    """
    known = nodes.select(F.col("id").alias("node_id"), "client_id", *TRACED, F.lit(True).alias("_known"))
    found = asked.join(known, ["node_id", "client_id"], "left")
    return found.withColumn("problem", F.when(F.col("_known").isNull(), "not found")).drop("_known")
