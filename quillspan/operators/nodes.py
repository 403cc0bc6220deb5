"""Nodes as they are listed, merged, embedded and ranked again: projections, texts, logs of events, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import once
from quillspan.operators.tree import chunks

# The columns of a document list, of the facts that a merge reads, and of a node as it is served.
DOCUMENT_COLUMNS = [
    "id", "client_id", "document_name", "external_document_id", "doc_type", "doc_category", "subject",
    "jurisdiction", "sensitivity_bucket", "gate_decision", "confidence", "ocr_engine", "page_count",
    "sha256", "mime", "blob_uri", "blob_backend", "created_at", "updated_at",
]
MERGE_COLUMNS = ["id", "attribute_key", "value_text", "value_date", "value_num", "confidence", "verification_status"]
NODE_COLUMNS = [
    "id", "parent_id", "path", "node_type", "seq", "depth", "title", "content", "context_prefix",
    "attribute_key", "value_text", "value_date", "value_num", "verification_status", "confidence",
    "sensitivity", "valid_from", "valid_to", "provenance", "doc_id", "version_id",
]

_WHITE = " \t\n\x0b\x0c\r"


def project(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns alone, so that scans read no others; one that ``rows`` has not is a null string."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def merge_input(nodes: DataFrame) -> DataFrame:
    """What a merge reads of the nodes: current facts with a key that are not deleted, in the narrow columns."""
    return project(nodes.where("node_type = 'fact' and attribute_key is not null and deleted_at is null and is_current"), MERGE_COLUMNS)


def _filled(text: Column) -> Column:
    """The text without white space around it, null if nothing is left."""
    return F.nullif(F.trim(text, F.lit(_WHITE)), F.lit(""))


def shown_text(content: Column, title: Column, value: Column) -> Column:
    """The text that a node's representations are made of: its content, else its title, else its value, else empty."""
    return F.coalesce(_filled(content), _filled(title), _filled(value), F.lit(""))


def context_text(content: Column, title: Column, key: Column, value: Column) -> Column:
    """A node's text in a prompt: its content, else its title and ``key: value`` on lines of their own."""
    pair = F.when(key != "", _filled(F.concat(key, F.lit(": "), F.coalesce(value, F.lit("")))))
    return F.coalesce(_filled(content), F.concat_ws("\n", _filled(title), pair))


def embedded_text(node_type: Column, key: Column, value: Column, title: Column, prefix: Column, content: Column) -> Column:
    """The text that is embedded: ``key: value`` of a fact, of other nodes the prefix and the content."""
    body = F.coalesce(F.nullif(value, F.lit("")), title, F.lit(""))
    fact = F.trim(F.trim(F.concat(F.coalesce(key, F.lit("")), F.lit(": "), body), F.lit(": ")), F.lit(_WHITE))
    return F.when(node_type == "fact", fact).otherwise(F.concat_ws("\n\n", F.nullif(prefix, F.lit("")), F.nullif(content, F.lit(""))))


def titled_chunks(title: Column, body: Column, max_tokens: int = 512, overlap_tokens: int = 64) -> Column:
    """The chunks of a section; its title leads the first one, and stands alone if there is none."""
    head = F.trim(F.coalesce(title, F.lit("")), F.lit(_WHITE))
    alone = F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>"))
    led = lambda x, i: F.when((i == 0) & (head != ""), F.concat(head, F.lit("\n\n"), x)).otherwise(x)
    return once(chunks(body, max_tokens, overlap_tokens), lambda c: F.when(F.size(c) > 0, F.transform(c, led)).otherwise(alone))


def rerank(candidates: DataFrame, top: int = 20) -> DataFrame:
    """(query_id, id, score): the stub model keeps the order of (query_id, id, rnk) and takes 0.01 off for each place."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rnk", "id"))
    ranked = candidates.withColumn("_place", place).where(F.col("_place") <= top)
    return ranked.select("query_id", "id", F.round(1 - (F.col("_place") - 1) * F.lit(0.01), 6).alias("score"))


def oldest_queued(stats: DataFrame) -> DataFrame:
    """(kind, oldest_seconds): the longest that a queued job of each kind has waited; see ``queue.stats``."""
    return stats.where("status = 'queued'").groupBy("kind").agg(F.max(F.coalesce("oldest_seconds", F.lit(0))).alias("oldest_seconds"))


def append_events(jobs: DataFrame, calls: DataFrame) -> DataFrame:
    """``jobs`` (id, status, locked_by, attempts, events) with the stages that their workers report, in order of call_no.

    calls: id, call_no, worker, stage. A report counts only while the job runs and its worker holds
    it. Each event carries the attempt that it belongs to.
    """
    held = calls.join(jobs.where("status = 'running'").select("id", F.col("locked_by").alias("worker"), "attempts"), ["id", "worker"])
    event = F.struct("stage", F.col("attempts").alias("attempt"))
    told = held.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("call_no", event.alias("e")))), lambda x: x["e"]).alias("_new"))
    none = F.array().cast(f"array<struct<stage:string,attempt:{jobs.schema['attempts'].dataType.simpleString()}>>")
    added = F.concat(F.coalesce("events", none), F.coalesce("_new", none))
    return jobs.join(told, "id", "left").withColumn("events", added).drop("_new")


def event_log(jobs: DataFrame) -> DataFrame:
    """(id, no, stage, attempt): the events of all jobs as rows."""
    return jobs.select("id", F.posexplode("events").alias("no", "e")).select("id", "no", "e.stage", "e.attempt")


def within(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points (by, at) joined to the spans (by, start, end) that hold them: start <= at < end, as numbers.

    Spans are dealt over the slots of ``width`` that they touch, and meet points by an equi-join on
    key and slot; a width near the usual length of a span deals each over about two.
    """
    slot = lambda c: F.floor(F.col(c) / width)
    dealt = spans.where(F.col(start) < F.col(end)).withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    met = points.withColumn("_slot", slot(at)).join(dealt, [by, "_slot"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_slot")


def parents(leg: DataFrame, representations: DataFrame) -> DataFrame:
    """A ranking of representations (id, node_id) as one of their nodes: found by many, returned as the node."""
    return leg.join(representations.select("id", "node_id"), "id").select("query_id", F.col("node_id").alias("id"), "rnk", "score")


def pool_of(top: int) -> int:
    """How many of each leg are fused for so many results."""
    return max(5 * top, 50)
