"""Blobs of tenants on top of repeatable writes: puts and deletes are versions, reads see the last whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources import versions_store
from quillspan.sources.readers import blob_address

_OWN = ["client_id", "key"]


def _put(rows: DataFrame, folder: str, version: int, data: Column, kind: Column, deleted: bool) -> bool:
    table = rows.select(F.col("client_id").cast("string").alias("client_id"), F.col("key").cast("string").alias("key"), kind.cast("string").alias("content_type"), F.octet_length(data).cast("long").alias("size"), F.when(data.isNotNull(), F.sha2(data, 256)).alias("sha256"), F.lit(deleted).alias("deleted"), data.alias("data"))
    return versions_store.put(table, folder, version, _OWN)


def put(blobs: DataFrame, folder: str, version: int) -> bool:
    """Stores blobs (client_id, key, content_type, data) in place of those of their keys; false if the version was there.

    Rows without a client, key or data are left out. Of two blobs of one key in a version the one
    with the greatest SHA-256 holds.
    """
    return _put(blobs.where("client_id is not null and key is not null and data is not null"), folder, version, F.col("data"), F.col("content_type"), False)


def delete(keys: DataFrame, folder: str, version: int) -> bool:
    """Deletes blobs by (client_id, key); a null key deletes all that the client has before this version."""
    return _put(keys.where("client_id is not null"), folder, version, F.lit(None).cast("binary"), F.lit(None), True)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(client_id, key, content_type, size, sha256, data) as it is now.

    Which rows hold is decided without their bytes, in one aggregate by key; only those rows are read whole.
    """
    rows = versions_store.read(spark, folder)
    slim = rows.select(*_OWN, "version", "sha256", "deleted")
    last = slim.where("key is not null").groupBy(*_OWN).agg(F.max(F.struct("version", "deleted", F.coalesce("sha256", F.lit("")).alias("sha256"))).alias("l"))
    wiped = slim.where("key is null").groupBy("client_id").agg(F.max("version").alias("wiped"))
    held = last.join(wiped, "client_id", "left").where("not l.deleted and (wiped is null or l.version > wiped)").select(*_OWN, "l.version", "l.sha256")
    found = rows.where("not deleted").join(held, [*_OWN, "version", "sha256"], "left_semi")
    return found.dropDuplicates([*_OWN]).select(*_OWN, "content_type", "size", "sha256", "data")


def get(requests: DataFrame, folder: str) -> DataFrame:
    """``requests`` (client_id, uri, ...) with data, sha256 and problem: foreign, malformed, not an address, or missing."""
    parsed = requests.withColumn("_a", blob_address(F.col("uri"), F.col("client_id").cast("string")))
    held = current(requests.sparkSession, folder).select(F.col("client_id").alias("_client"), F.col("key").alias("_key"), "data", "sha256", F.lit(True).alias("_there"))
    joined = parsed.join(held, (F.col("_a.key") == F.col("_key")) & (F.col("_a.client") == F.col("_client")), "left")
    problem = F.when(F.col("uri").isNull(), "not an address").otherwise(F.coalesce("_a.problem", F.when(F.col("_there").isNull(), F.lit("missing"))))
    return joined.select(*[requests[c] for c in requests.columns], "data", "sha256", problem.alias("problem"))
