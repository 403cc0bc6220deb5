"""Keys, authorization, verdict checks, audit, traces and layout: the smaller operators of the service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the pattern of a currency amount.
AMOUNT = r"(?<![\w.])(?:CAD\s*)?\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d+(?:\.\d{2})?)"


def active(keys: DataFrame, now: Column) -> DataFrame:
    return keys.where(F.col("disabled_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def allowed(grants: Column, wanted: Column) -> Column:
    return F.array_contains(grants, "*") | F.array_contains(grants, wanted)


def rotate(keys: DataFrame, now: Column, overlap_hours: int) -> DataFrame:
    """Successors of keys with the same grants, and the old ones' expiry: soon, within 1 to 168 hours, or sooner already."""
    hours = min(max(overlap_hours, 1), 168)
    soon = now + F.expr(f"interval {hours} hours")
    return keys.select(F.col("id").alias("rotated_from"), "client_ids", "scopes", F.least(F.coalesce("expires_at", soon), soon).alias("old_expires_at"))


def check_verdicts(verdicts: DataFrame, merged: DataFrame, multi: list[str]) -> DataFrame:
    """``verdicts`` with status: 422 if the instance doesn't fit the attribute's kind, 404 if there is no such instance, else ok."""
    keys = ["client_id", "attribute_key", "instance_key"]
    known = merged.select(*keys).distinct().withColumn("_known", F.lit(True))
    many = F.col("attribute_key").isin(multi)
    status = F.when(many & (F.col("instance_key") == ""), "422").when(~many & (F.col("instance_key") != ""), "422").when(many & F.col("_known").isNull(), "404").otherwise("ok")
    return verdicts.join(known, keys, "left").withColumn("status", status).drop("_known")


def audit_tenant(path: Column, query: Column, state: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (path, query, state)])


def page_of_log(log: DataFrame, before: tuple[str, int] | None, client_id: str | None, limit: int) -> DataFrame:
    """A page of an access log, newest first, behind a (ts, id) cursor."""
    out = log if client_id is None else log.where(F.col("client_id") == client_id)
    if before is not None:
        out = out.where(F.struct("ts", "id") < F.struct(F.lit(before[0]).cast("timestamp_ntz"), F.lit(before[1]).cast("long")))
    return out.orderBy(F.desc("ts"), F.desc("id")).limit(min(max(limit, 1), 200))


def decision_trace(gated: DataFrame) -> DataFrame:
    """(doc_id, classification, pii_types, rationale): why each document goes where it goes."""
    unsure = (F.col("doc_type") == "UNKNOWN") | (F.col("doc_confidence") < 0.55)
    why = (
        F.when(unsure & (F.col("sensitivity") != "LOW"), F.format_string("low-confidence classification (confidence=%.2f < floor=0.55) and sensitivity=%s", "doc_confidence", "sensitivity"))
        .when(F.col("sensitivity") != "LOW", F.format_string("%s sensitivity and redaction inactive", "sensitivity"))
        .when(unsure, F.format_string("LOW sensitivity but low-confidence classification (confidence=%.2f < floor=0.55)", "doc_confidence"))
        .otherwise(F.format_string("LOW sensitivity, confident classification (confidence=%.2f >= floor=0.55), gate open", "doc_confidence"))
    )
    return gated.select("doc_id", F.format_string("%s/%.4f", "doc_type", "doc_confidence").alias("classification"), F.array_join("pii_types", ",").alias("pii_types"), why.alias("rationale"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """OCR words (page, block, par, line, word_no, text, box, conf of 0 to 100) as lines: texts in order, hull, mean confidence."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ")
    return words.where((F.trim("text") != "") & (F.col("conf") >= 0)).groupBy("page", "block", "par", "line").agg(
        ordered.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.avg("conf") / 100, 6).alias("confidence")
    )


def polygon_box(polygon: Column) -> Column:
    """The upright box around a polygon x, y, x, y, ..."""
    even, odd = (F.filter(polygon, _parity(p)) for p in (0, 1))
    return F.struct(F.array_min(even).alias("x0"), F.array_min(odd).alias("y0"), F.array_max(even).alias("x1"), F.array_max(odd).alias("y1"))


def _parity(p: int):
    return lambda _, i: i % 2 == p


def coerce_confidence(value: Column, default: float = 0.5) -> Column:
    """A number between 0 and 1; truth values and garbage become the default."""
    number = F.when(~F.lower(value).isin("true", "false"), value.try_cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(number), number), F.lit(default))))


def language_profile(spans: DataFrame) -> DataFrame:
    """(doc_id, dominant, bilingual) of spans (doc_id, lang, start, end, confidence).

    Dominant is the language that covers most, English and then the alphabet on ties; bilingual
    if a span of another has 25 characters and half the confidence.
    """
    cover = spans.groupBy("doc_id", "lang").agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.bool_or((F.col("end") - F.col("start") >= 25) & (F.col("confidence") >= 0.5)).alias("real"))
    top = Window.partitionBy("doc_id").orderBy(F.desc("chars"), F.desc(F.col("lang") == "en"), F.desc("lang"))
    ranked = cover.withColumn("rn", F.row_number().over(top))
    return ranked.groupBy("doc_id").agg(F.max(F.when(F.col("rn") == 1, F.col("lang"))).alias("dominant"), F.bool_or((F.col("rn") > 1) & F.col("real")).alias("bilingual"))


def anchor_tails(lines: DataFrame, anchors: list[str]) -> DataFrame:
    """(doc_id, line_no, anchor, value): what stands behind an anchor in a line, without the separators."""
    hits = F.array(*[F.struct(F.lit(a).alias("anchor"), F.call_function("locate", F.lit(a.lower()), F.lower("line")).alias("at")) for a in anchors])
    each = lines.select("doc_id", "line_no", "line", F.explode(F.filter(hits, lambda h: h["at"] > 0)).alias("h"))
    tail = F.substr("line", F.col("h.at") + F.length("h.anchor"), F.length("line"))
    return each.select("doc_id", "line_no", F.col("h.anchor").alias("anchor"), F.trim(F.regexp_replace(tail, r"^[ \t:;.\-=]+", "")).alias("value"))


def amounts(text: Column) -> Column:
    """All currency amounts as numbers; without groups an amount ends after three digits, as its pattern has it."""
    found = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1))
    return F.transform(found, lambda v: F.regexp_replace(v, "[$,]", "").try_cast("double"))


def context_prefix(content: Column, document: Column) -> Column:
    """The stub model's answer: the first 120 characters of the prompt, which is the content within its document."""
    return F.when(F.trim(content) != "", F.concat(F.lit("[stub:contextual] "), F.substring(F.concat_ws("\n", F.substring(content, 1, 4000), F.substring(document, 1, 12000)), 1, 120)))


def next_page(rows: DataFrame, at: str, key: str, limit: int, after: str | None = None) -> tuple[DataFrame, str | None]:
    """Newest first: the rows behind a cursor, at most ``limit``, and the cursor of the next page if there is one."""
    from quillspan.functions.text import cursor, read_cursor

    if after is not None:
        when, last = read_cursor(after)
        kinds = rows.schema[at].dataType, rows.schema[key].dataType
        rows = rows.where(F.struct(at, key) < F.struct(F.lit(when).cast(kinds[0]), F.lit(last).cast(kinds[1])))
    # One sort for both; what comes to the driver is a page and one row.
    found = rows.orderBy(F.desc(at), F.desc(key)).limit(limit + 1).withColumn("_cursor", cursor(F.col(at), F.col(key)))
    ends = found.collect()
    page = rows.sparkSession.createDataFrame(ends[:limit], found.schema).drop("_cursor")
    return page, ends[limit - 1]["_cursor"] if len(ends) > limit else None


def document_list(documents: DataFrame, client_id: str, limit: int = 50, after: str | None = None) -> tuple[DataFrame, str | None]:
    """A tenant's documents that are not deleted, newest first, page by page; see ``next_page``."""
    return next_page(documents.where((F.col("client_id") == client_id) & F.col("deleted_at").isNull()), "created_at", "id", limit, after)


def answerable_questions(representations: DataFrame) -> DataFrame:
    """(path, question): the hypothetical questions among a document's representations."""
    return representations.where("rep_type = 'hypothetical_q'").select("path", F.col("rep_text").alias("question"))


#: The tables that go with a document, and those that go with a tenant; audit logs and histories of verdicts stay.
DOCUMENT_TABLES = ["representations", "nodes", "traces", "versions", "documents"]
TENANT_TABLES = [*DOCUMENT_TABLES, "merged_facts", "verdicts", "entities", "jobs", "blobs"]


def remove(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table without the rows of the given keys, and (table_name, removed, kept).

    For a document the key is doc_id, for a whole tenant client_id; pass the tables that go with
    it, and leave audit logs and histories of verdicts out. Merged facts are merged anew after it.
    """
    keys = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    marked = {name: df.join(keys, key, "left") for name, df in tables.items()}
    counts = [df.agg(F.count("_gone").alias("removed"), F.count_if(F.col("_gone").isNull()).alias("kept")).select(F.lit(name).alias("table_name"), "removed", "kept") for name, df in marked.items()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return {name: df.join(keys, key, "left_anti") for name, df in tables.items()}, total


def purge(tables: dict[str, DataFrame], clients: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables, those of ``TENANT_TABLES`` without the rows of the named clients, and how many rows went and stay."""
    left, counts = remove({name: tables[name] for name in TENANT_TABLES}, clients, "client_id")
    return tables | left, counts


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, multi: list[str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after documents (doc_id) are deleted with all that was made of them, and how many rows went and stay.

    Facts among the nodes that are left are merged anew for the clients that lost a document,
    with their live verdicts laid over; other clients' merged facts stay as they are.
    """
    from quillspan.operators import merge

    left, counts = remove({name: tables[name] for name in DOCUMENT_TABLES}, gone, "doc_id")
    clients = tables["documents"].join(gone.select("doc_id"), "doc_id", "left_semi").select("client_id").distinct()
    facts = left["nodes"].where("node_type = 'fact' and attribute_key is not null")
    return tables | left | {"merged_facts": merge.remerge(tables["merged_facts"], facts, clients, tables["verdicts"], multi)}, counts
