"""Versions of documents by content hash, their chains, change feeds and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(new_hash: Column, current_no: Column, current_hash: Column, complete: Column) -> Column:
    """(action, version_no, supersedes_no) of an upload: noop, resume or new."""
    same = F.coalesce(new_hash == current_hash, F.lit(False))
    none = F.lit(None).cast("int")
    return (
        F.when(same & complete, F.struct(F.lit("noop").alias("action"), F.coalesce(current_no, F.lit(0)).alias("version_no"), none.alias("supersedes_no")))
        .when(same, F.struct(F.lit("resume").alias("action"), F.coalesce(current_no, F.lit(0)).alias("version_no"), none.alias("supersedes_no")))
        .otherwise(F.struct(F.lit("new").alias("action"), (F.coalesce(current_no, F.lit(0)) + 1).alias("version_no"), current_no.alias("supersedes_no")))
    )


def version_chain(uploads: DataFrame) -> DataFrame:
    """Uploads (client_id, doc_key, content_hash, created_at, upload_id) as versions.

    An upload equal to the one before it makes no version. version_no counts from 1,
    supersedes_no is the version before, is_current marks the last, change_seq orders all
    versions of a client's documents. One shuffle by document.
    """
    order = Window.partitionBy("client_id", "doc_key").orderBy("created_at", "upload_id")
    fresh = uploads.withColumn("_before", F.lag("content_hash").over(order)).where(F.col("_before").isNull() | (F.col("_before") != F.col("content_hash"))).drop("_before")
    numbered = fresh.withColumn("version_no", F.row_number().over(order)).withColumn("is_current", F.lead("upload_id").over(order).isNull())
    return numbered.withColumn("supersedes_no", F.when(F.col("version_no") > 1, F.col("version_no") - 1)).withColumn("change_seq", F.col("upload_id"))


def change_feed(versions: DataFrame, documents: DataFrame, after_seq: int | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """A page of changes joined to their documents: after a sequence number ascending, or since a time descending."""
    joined = versions.join(documents, ["client_id", "doc_key"])
    if after_seq is not None:
        return joined.where(F.col("change_seq") > after_seq).orderBy("change_seq").limit(limit)
    if since is not None:
        joined = joined.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return joined.orderBy(F.desc("created_at"), F.desc("change_seq")).limit(limit)


def with_next_seq(page: DataFrame) -> DataFrame:
    """A page of changes, which its limit bounds, with the highest sequence number in it, which the next page follows."""
    return page.withColumn("next_seq", F.max("change_seq").over(Window.partitionBy()))


def current_only(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of versions that are current."""
    keys = ["client_id", "doc_key", "version_no"]
    return rows.join(versions.where("is_current").select(*keys), keys, "left_semi")


def duplicates(versions: DataFrame) -> DataFrame:
    """Version numbers that occur twice, with their uploads in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "upload_id"))), lambda x: x["upload_id"].cast("string"))
    return versions.groupBy("client_id", "doc_key", "version_no").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("upload_ids")).where("n > 1")


def renumber(versions: DataFrame) -> DataFrame:
    """Of uploads with one number the earliest keeps it; the others follow the highest number in their order."""
    same = Window.partitionBy("client_id", "doc_key", "version_no").orderBy("created_at", "upload_id")
    doc = Window.partitionBy("client_id", "doc_key")
    marked = versions.withColumn("_extra", F.row_number().over(same) > 1).withColumn("_top", F.max("version_no").over(doc))
    late = Window.partitionBy("client_id", "doc_key", "_extra").orderBy("created_at", "upload_id")
    return marked.withColumn("version_no", F.when(F.col("_extra"), F.col("_top") + F.row_number().over(late)).otherwise(F.col("version_no"))).drop("_extra", "_top")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two sets of (path, hash): added, removed or modified.

    Of rows with one path the last counts, in the order of ``seq`` if a set has that column.
    """
    last = lambda rows: rows.groupBy("path").agg(F.max_by("hash", "seq").alias("hash")) if "seq" in rows.columns else rows
    old, new = last(old), last(new)
    both = old.select("path", F.col("hash").alias("o")).join(new.select("path", F.col("hash").alias("n")), "path", "full_outer")
    return both.select("path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified").alias("change")).where("change is not null")
