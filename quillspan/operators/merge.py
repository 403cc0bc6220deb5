"""Facts of many documents merged into one row for each attribute (and instance) of a client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan import ontology
from quillspan.functions.text import comparable, fingerprint, identity_form


#: How identity forms are made; stored beside each instance.
IDENTITY_RULE = "nfkd-casefold-ws-v1"
KEYS = ["client_id", "attribute_key", "instance_key"]


def identity_basis() -> Column:
    """What tells instances of a multi-valued attribute apart: the text's identity form, else the date, else the number.

    A text of white space alone has no identity, whatever date or number stands beside it.
    """
    digits = F.format_string("%.10g", F.col("value_num"))
    short = F.when(F.contains(digits, F.lit(".")) & ~F.contains(digits, F.lit("e")), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    other = F.coalesce(F.col("value_date").cast("string"), F.when(F.col("value_num").isNotNull(), short))
    return F.when(F.length("value_text") > 0, F.col("_form")).otherwise(other)


def keyed(facts: DataFrame, multi: list[str] | None = None) -> DataFrame:
    """``facts`` with instance_key and identity_basis, without multi-valued ones that have no identity; a narrow step."""
    many = F.col("attribute_key").isin(ontology.MULTI_VALUED_KEYS if multi is None else multi)
    formed = facts.withColumn("_form", F.when(many, identity_form(F.when(many, F.col("value_text")))))
    based = formed.withColumn("identity_basis", F.when(many, identity_basis())).where(~many | F.col("identity_basis").isNotNull())
    return based.withColumn("instance_key", F.when(many, fingerprint(F.col("identity_basis"))).otherwise("")).withColumn("_value", F.when(many, F.col("_form")).otherwise(comparable(F.col("value_text")))).drop("_form")


def merge_facts(facts: DataFrame, multi: list[str] | None = None) -> DataFrame:
    """One row for each (client_id, attribute_key, instance_key).

    ``facts``: client_id, fact_id, attribute_key, value_text, value_date, value_num, confidence,
    verification_status. The most confident candidate wins, the smallest fact_id on ties;
    differing non-empty values are a conflict that needs review. Multi-valued attributes are
    grouped by a fingerprint of their identity and lose candidates without any. Two shuffles:
    facts combine by key and value first, so a key that holds most facts is spread over its
    values and over map-side partial sums; the second moves one row for each distinct value.
    """
    alike = ["_value", "value_date", "value_num"]
    winner = F.max_by(F.struct("fact_id", "value_text", "confidence", "verification_status"), F.struct(F.col("confidence"), -F.col("fact_id")))
    values = keyed(facts, multi).groupBy(*KEYS, *alike).agg(winner.alias("_w"), F.count("*").alias("_n"), F.first("identity_basis").alias("identity_basis"))
    best = F.max_by(F.struct("_w", "value_date", "value_num"), F.struct(F.col("_w.confidence"), -F.col("_w.fact_id")))
    some = F.coalesce(*[F.col(c).cast("string") for c in alike]).isNotNull()
    merged = values.groupBy(*KEYS).agg(best.alias("b"), F.count_if(some).alias("distinct_values"), F.sum("_n").alias("n_sources"), F.first("identity_basis").alias("identity_basis"))
    conflict = F.col("distinct_values") > 1
    w = F.col("b._w")
    return merged.select(
        *KEYS, w["value_text"].alias("resolved_value"), F.col("b.value_date").alias("value_date"), F.col("b.value_num").alias("value_num"), w["confidence"].alias("confidence"),
        w["verification_status"].alias("verification_status"), conflict.alias("conflict"), conflict.alias("needs_review"), "n_sources", "distinct_values", w["fact_id"].alias("winning_fact_id"), "identity_basis",
    )


def rationale() -> Column:
    """Why a merged row holds what it holds, as a struct of its columns; identity parts are null for single-valued ones."""
    known = F.col("identity_basis").isNotNull()
    return F.struct(
        F.lit("max_confidence").alias("rule"), F.col("n_sources").alias("candidates"), F.col("confidence").alias("winner_confidence"), "distinct_values",
        F.when(known, F.col("instance_key")).alias("instance_key"), "identity_basis", F.when(known, F.lit(IDENTITY_RULE)).alias("identity_algo"),
    )


def sources(facts: DataFrame, multi: list[str] | None = None) -> DataFrame:
    """(client_id, attribute_key, instance_key, fact_id): the facts behind each merged row, as rows since a key may have any number."""
    return keyed(facts, multi).select(*KEYS, "fact_id")


def replace_set(old: DataFrame, new: DataFrame, clients: DataFrame) -> DataFrame:
    """The merged table after the named clients' rows became exactly ``new``; without new rows a client has none left."""
    return old.join(clients.select("client_id").distinct(), "client_id", "left_anti").unionByName(new.join(clients.select("client_id").distinct(), "client_id", "left_semi"))


def remerge(old: DataFrame, facts: DataFrame, clients: DataFrame, verdicts: DataFrame | None = None, multi: list[str] | None = None) -> DataFrame:
    """``old`` with the named clients merged anew from the facts that are left, their verdicts laid over; others untouched."""
    new = merge_facts(facts.join(clients.select("client_id").distinct(), "client_id", "left_semi"), multi)
    return replace_set(old, new if verdicts is None else adjudicate(new, verdicts, multi).drop("adjudicated"), clients)


def adjudicate(merged: DataFrame, verdicts: DataFrame, multi: list[str] | None = None) -> DataFrame:
    """Human verdicts over merged facts: override, accept and reject; a rejected instance of a multi-valued one goes.

    ``verdicts``: client_id, attribute_key, instance_key, verdict, override_text.
    """
    multi = ontology.MULTI_VALUED_KEYS if multi is None else multi
    keys = ["client_id", "attribute_key", "instance_key"]
    both = merged.join(verdicts.select(*keys, "verdict", "override_text"), keys, "left").where(~(F.coalesce(F.col("verdict") == "reject", F.lit(False)) & F.col("attribute_key").isin(multi)))
    is_ = lambda v: F.coalesce(F.col("verdict") == v, F.lit(False))
    settled = is_("override") | is_("accept")
    null = lambda c, kind: F.when(is_("override") | is_("reject"), F.lit(None).cast(kind)).otherwise(F.col(c))
    return both.withColumns({
        "resolved_value": F.when(is_("override"), F.col("override_text")).when(is_("reject"), F.lit(None)).otherwise(F.col("resolved_value")),
        "value_date": null("value_date", "date"), "value_num": null("value_num", "double"),
        "confidence": F.when(is_("override"), 1.0).when(is_("reject"), 0.0).otherwise(F.col("confidence")),
        "verification_status": F.when(settled, "human_verified").when(is_("reject"), "unverified").otherwise(F.col("verification_status")),
        "conflict": F.when(settled, False).otherwise(F.col("conflict")),
        "needs_review": F.when(settled, False).when(is_("reject"), True).otherwise(F.col("needs_review")),
        "adjudicated": F.col("verdict").isNotNull(),
    }).drop("verdict", "override_text")


def stale_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of merged rows that the new set no longer has."""
    keys = ["client_id", "attribute_key", "instance_key"]
    return old.select(*keys).join(new.select(*keys), keys, "left_anti")


def live_verdicts(events: DataFrame) -> DataFrame:
    """The latest event of each key, unless it cleared the verdict."""
    keys = ["client_id", "attribute_key", "instance_key"]
    latest = events.groupBy(*keys).agg(F.max_by(F.struct("verdict", "override_text"), "event_id").alias("v"))
    return latest.where("v.verdict <> 'cleared'").select(*keys, "v.verdict", "v.override_text")


def verdict_history(events: DataFrame, client_id, attribute_key: str | None = None, instance_key: str | None = None) -> DataFrame:
    """Every verdict ever recorded for a client, or for one of its keys, newest first; nothing is ever taken out of it."""
    for column, value in (("client_id", client_id), ("attribute_key", attribute_key), ("instance_key", instance_key)):
        events = events if value is None else events.where(F.col(column) == value)
    return events.orderBy(F.desc("created_at"), F.desc("event_id"))


def listed(merged: DataFrame, client_id, attribute_key: str | None = None) -> DataFrame:
    """A client's merged facts, or one attribute's, by key and instance."""
    mine = merged.where(F.col("client_id") == client_id)
    return (mine if attribute_key is None else mine.where(F.col("attribute_key") == attribute_key)).orderBy("attribute_key", "instance_key")


def record_verdicts(live: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The live verdicts after a batch of requests, and the events that the batch adds to the history.

    live: client_id, attribute_key, instance_key, verdict, override_text, created_at, updated_at,
    one row for each key. requests: the same keys, no (their order), verdict, override_text, at.
    The last verdict of a key is live; created_at is that of the first since the key had none.
    The verdict ``cleared`` takes a live one back; where none is live it changes nothing and is
    no event. One shuffle by key, whose rows are the verdicts that people gave on one value.
    """
    old = live.select(*KEYS, F.lit(False).alias("_new"), F.lit(None).cast(requests.schema["no"].dataType).alias("no"), "verdict", "override_text", F.col("created_at").alias("_since"), F.col("updated_at").alias("at"))
    both = old.unionByName(requests.select(*KEYS, F.lit(True).alias("_new"), "no", "verdict", "override_text", F.col("at").alias("_since"), "at"))
    order = F.struct("_new", "no")
    told = both.withColumn("_before", F.lag("verdict").over(Window.partitionBy(*KEYS).orderBy(order)))
    idle = F.coalesce(F.col("_before") == "cleared", F.lit(True))
    events = told.where(F.col("_new") & ~((F.col("verdict") == "cleared") & idle)).select(*KEYS, "no", "verdict", "override_text", "at")
    last = told.groupBy(*KEYS).agg(
        F.max_by(F.struct("verdict", "override_text", F.col("at").alias("updated_at")), order).alias("v"),
        F.max_by("_since", F.when(idle & (F.col("verdict") != "cleared"), order)).alias("created_at"),
    )
    return last.where("v.verdict <> 'cleared'").select(*KEYS, "v.verdict", "v.override_text", "created_at", "v.updated_at"), events
