"""Queries over merged facts: merging, verdicts, views, masks, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import ontology
from quillspan.operators import merge, serving
from quillspan.sources.tables import line_facts, line_facts_sql, quoted, table

_MULTI = ", ".join(quoted(k) for k in ontology.MULTI_VALUED_KEYS)
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_FORM = "nullif(" + _SQUEEZE.format("strip_accents(lower(value_text))") + ", '')"
_MERGE_SQL = f"""
    facts AS ({line_facts_sql()}),
    based AS (SELECT *, attribute_key IN ({_MULTI}) AS many, {_FORM} AS form,
        CASE WHEN length(value_text) > 0 THEN {_FORM} ELSE coalesce(value_date::VARCHAR, printf('%.10g', value_num)) END AS basis FROM facts),
    keyed AS (SELECT *, CASE WHEN many THEN left(sha256(basis), 16) ELSE '' END AS instance_key,
        CASE WHEN many THEN form ELSE nullif(lower({_SQUEEZE.format('value_text')}), '') END AS cmp FROM based WHERE NOT many OR basis IS NOT NULL),
    grouped AS (SELECT client_id, attribute_key, instance_key, arg_max({{'f': fact_id, 't': value_text, 'd': value_date, 'n': value_num, 'c': confidence, 's': verification_status}}, {{'c': confidence, 'i': -fact_id}}) AS w,
        count(DISTINCT {{'a': coalesce(cmp, '#'), 'b': coalesce(value_date::VARCHAR, '#'), 'c': coalesce(value_num, -1)}}) FILTER (cmp IS NOT NULL OR value_date IS NOT NULL OR value_num IS NOT NULL) AS distinct_values, count(*) AS n_sources,
        any_value(CASE WHEN many THEN basis END) AS identity_basis FROM keyed GROUP BY ALL),
    merged AS (SELECT client_id, attribute_key, instance_key, w.t AS resolved_value, w.d AS value_date, w.n AS value_num, w.c AS confidence, w.s AS verification_status,
        distinct_values > 1 AS conflict, distinct_values > 1 AS needs_review, n_sources, distinct_values, w.f AS winning_fact_id, identity_basis FROM grouped)"""
_OUT = "client_id, attribute_key, instance_key, resolved_value, value_date::VARCHAR AS value_date, value_num, confidence, verification_status, conflict, n_sources, winning_fact_id"


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_facts(line_facts(spark, sf))


def _shown(df: DataFrame, *also: str) -> DataFrame:
    return df.select("client_id", "attribute_key", "instance_key", "resolved_value", F.col("value_date").cast("string").alias("value_date"), "value_num", "confidence", "verification_status", "conflict", *also)


def facts_merge_single(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_merged(spark, sf).where(~F.col("attribute_key").isin(ontology.MULTI_VALUED_KEYS)), "n_sources", "winning_fact_id")


def facts_merge_multi(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_merged(spark, sf).where(F.col("attribute_key").isin(ontology.MULTI_VALUED_KEYS)), "n_sources", "winning_fact_id")


def _verdicts(merged: DataFrame) -> DataFrame:
    """A verdict for some rows, by client and key."""
    pick = F.pmod(F.col("client_id") + F.length("attribute_key"), F.lit(7))
    return merged.where(pick < 3).select("client_id", "attribute_key", "instance_key", F.when(pick == 0, "override").when(pick == 1, "accept").otherwise("reject").alias("verdict"), F.lit("Reviewed").alias("override_text"))


_VERDICTS_SQL = """verdicts AS (SELECT client_id, attribute_key, instance_key, ['override', 'accept', 'reject'][(client_id + length(attribute_key)) % 7 + 1] AS verdict FROM merged WHERE (client_id + length(attribute_key)) % 7 < 3)"""
_ADJ_SQL = f"""{_VERDICTS_SQL},
    settled AS (SELECT client_id, attribute_key, instance_key, CASE WHEN verdict = 'override' THEN 'Reviewed' WHEN verdict = 'reject' THEN NULL ELSE resolved_value END AS resolved_value,
        CASE WHEN verdict IN ('override', 'reject') THEN NULL ELSE value_date END AS value_date, CASE WHEN verdict IN ('override', 'reject') THEN NULL ELSE value_num END AS value_num,
        CASE WHEN verdict = 'override' THEN 1.0 WHEN verdict = 'reject' THEN 0.0 ELSE confidence END AS confidence,
        CASE WHEN verdict IN ('override', 'accept') THEN 'human_verified' WHEN verdict = 'reject' THEN 'unverified' ELSE verification_status END AS verification_status,
        CASE WHEN verdict IN ('override', 'accept') THEN FALSE ELSE conflict END AS conflict,
        CASE WHEN verdict IN ('override', 'accept') THEN FALSE WHEN verdict = 'reject' THEN TRUE ELSE needs_review END AS needs_review, verdict IS NOT NULL AS adjudicated
        FROM merged LEFT JOIN verdicts USING (client_id, attribute_key, instance_key) WHERE NOT (coalesce(verdict, '') = 'reject' AND attribute_key IN ({_MULTI})))"""


def _settled(spark: SparkSession, sf: str) -> DataFrame:
    merged = _merged(spark, sf)
    return merge.adjudicate(merged, _verdicts(merged))


def facts_merge_adjudicated(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_settled(spark, sf), "needs_review", "adjudicated")


_SENS_SQL = "CASE WHEN starts_with(attribute_key, 'id.') THEN 'CRITICAL' WHEN split_part(attribute_key, '.', 1) IN ('identity', 'address', 'income', 'account', 'ownership') THEN 'HIGH' ELSE 'LOW' END"
_VERIFIED_SQL = "CASE WHEN conflict THEN FALSE WHEN verification_status IS NULL THEN confidence >= 0.8 WHEN verification_status = 'llm_unverified' THEN FALSE ELSE verification_status IN ('checksum_verified', 'gov_verified', 'human_verified') END"
_REDACT = "CASE WHEN {0} IS NULL OR {0} = '' THEN {0} WHEN length({0}) <= 4 THEN '[REDACTED]' ELSE repeat('•', length({0}) - 4) || right({0}, 4) END"
_VIEW_SQL = f"""{_ADJ_SQL},
    viewed AS (SELECT *, count(*) OVER (PARTITION BY client_id, attribute_key) AS instance_count, {_VERIFIED_SQL} AS verified, {_SENS_SQL} AS sensitivity FROM settled)"""


def _view(spark: SparkSession, sf: str, verified_only: bool) -> DataFrame:
    seen = serving.fact_view(_settled(spark, sf), verified_only=verified_only)
    return seen.select("client_id", "attribute_key", "instance_key", "resolved_value", "value_num", "instance_count", "verified", "sensitivity", "masked")


def _view_out(where: str) -> str:
    hidden = "sensitivity IN ('HIGH', 'CRITICAL')"
    return f"SELECT client_id, attribute_key, instance_key, CASE WHEN {hidden} THEN {_REDACT.format('resolved_value')} ELSE resolved_value END AS resolved_value, CASE WHEN {hidden} THEN NULL ELSE value_num END AS value_num, instance_count, verified, sensitivity, {hidden} AS masked FROM viewed WHERE {where}"


def facts_view_masked(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, False)


def facts_view_verified(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, True)


def facts_rationale(spark: SparkSession, sf: str) -> DataFrame:
    """Why each merged fact holds what it holds, as readers see it: identities of sensitive keys hidden."""
    seen = serving.fact_view(_merged(spark, sf))
    return seen.select("client_id", "attribute_key", F.col("instance_key").alias("ikey"), merge.rationale().alias("r"), "instance_count").select("client_id", "attribute_key", "ikey", "r.*", "instance_count")


def fact_sources(spark: SparkSession, sf: str) -> DataFrame:
    return merge.sources(line_facts(spark, sf))


def facts_remerged(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of finished orders are deleted, and the clients that had any are merged anew."""
    facts, merged = line_facts(spark, sf), _merged(spark, sf)
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    clients = facts.join(gone, "doc_id", "left_semi").select("client_id").distinct()
    return _shown(merge.remerge(merged, facts.join(gone, "doc_id", "left_anti"), clients), "n_sources", "winning_fact_id")


def merged_stale_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that go when the facts of the second half of the documents are deleted."""
    facts = line_facts(spark, sf)
    return merge.stale_keys(merge.merge_facts(facts), merge.merge_facts(facts.where("doc_id % 2 = 0")))


def verdicts_live(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        F.pmod("user_id", F.lit(40)).alias("client_id"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(9)).cast("string")).alias("attribute_key"), F.lit("").alias("instance_key"), "event_id",
        F.when(F.col("event_type") == "click", "cleared").when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "error", "reject").otherwise("override").alias("verdict"), F.col("event_type").alias("override_text"),
    )
    return merge.live_verdicts(events)


def document_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    facts = line_facts(spark, sf)
    gate = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(*[F.lit(x) for x in ontology.SENSITIVITY]), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int")).alias("sensitivity"))
    return serving.document_sensitivity(gate, facts)


def tree_manifest(spark: SparkSession, sf: str) -> DataFrame:
    nodes = line_facts(spark, sf).select("doc_id", F.lit("fact").alias("node_type"), F.coalesce("verification_status", F.lit("none")).alias("verification_status"), "attribute_key")
    return serving.manifest(nodes)


def node_mask(spark: SparkSession, sf: str) -> DataFrame:
    nodes = line_facts(spark, sf).select(F.col("fact_id").alias("id"), "attribute_key", "value_text", "value_num", F.col("value_text").alias("content"), F.when(F.col("fact_id") % 11 == 0, "HIGH").otherwise("LOW").alias("sensitivity"))
    return serving.mask_nodes(nodes).select("id", "effective", "masked", "value_text", "value_num", "content")


def delete_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that deleting one client's documents removes, by table."""
    facts = line_facts(spark, sf)
    merged = merge.merge_facts(facts)
    rows = [("facts", facts), ("merged", merged)]
    out = None
    for name, df in rows:
        part = df.where("client_id = 7").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


PLANS = {
    "facts_merge_single": (facts_merge_single, f"WITH {_MERGE_SQL} SELECT {_OUT} FROM merged WHERE attribute_key NOT IN ({_MULTI})"),
    "facts_merge_multi": (facts_merge_multi, f"WITH {_MERGE_SQL} SELECT {_OUT} FROM merged WHERE attribute_key IN ({_MULTI})"),
    "facts_merge_adjudicated": (facts_merge_adjudicated, f"WITH {_MERGE_SQL}, {_ADJ_SQL} SELECT client_id, attribute_key, instance_key, resolved_value, value_date::VARCHAR AS value_date, value_num, confidence, verification_status, conflict, needs_review, adjudicated FROM settled"),
    "facts_view_masked": (facts_view_masked, f"WITH {_MERGE_SQL}, {_VIEW_SQL} {_view_out('TRUE')}"),
    "facts_view_verified": (facts_view_verified, f"WITH {_MERGE_SQL}, {_VIEW_SQL} {_view_out('verified')}"),
    "facts_rationale": (facts_rationale, f"""WITH {_MERGE_SQL}, v AS (SELECT *, count(*) OVER (PARTITION BY client_id, attribute_key) AS instance_count, {_SENS_SQL} AS s FROM merged)
        SELECT client_id, attribute_key, instance_key AS ikey, 'max_confidence' AS rule, n_sources AS candidates, confidence AS winner_confidence, distinct_values, CASE WHEN identity_basis IS NOT NULL THEN instance_key END AS instance_key,
            CASE WHEN identity_basis IS NOT NULL AND s <> 'LOW' THEN '***' ELSE identity_basis END AS identity_basis, CASE WHEN identity_basis IS NOT NULL THEN 'nfkd-casefold-ws-v1' END AS identity_algo, instance_count FROM v"""),
    "fact_sources": (fact_sources, f"WITH {_MERGE_SQL} SELECT client_id, attribute_key, instance_key, fact_id FROM keyed"),
    "facts_remerged": (facts_remerged, f"WITH {_MERGE_SQL.replace('FROM lineitem', 'FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = ' + quoted('F') + ')')} SELECT {_OUT} FROM merged"),
    "merged_stale_keys": (merged_stale_keys, f"WITH {_MERGE_SQL} SELECT client_id, attribute_key, instance_key FROM merged EXCEPT SELECT DISTINCT client_id, attribute_key, instance_key FROM keyed WHERE doc_id % 2 = 0"),
    "verdicts_live": (verdicts_live, """
        WITH e AS (SELECT user_id % 40 AS client_id, 'k' || (event_id % 9) AS attribute_key, '' AS instance_key, event_id,
            CASE event_type WHEN 'click' THEN 'cleared' WHEN 'view' THEN 'accept' WHEN 'error' THEN 'reject' ELSE 'override' END AS verdict, event_type AS override_text FROM events)
        SELECT client_id, attribute_key, instance_key, verdict, override_text FROM (SELECT *, row_number() OVER (PARTITION BY client_id, attribute_key, instance_key ORDER BY event_id DESC) AS rn FROM e) WHERE rn = 1 AND verdict <> 'cleared'"""),
    "document_sensitivity": (document_sensitivity, f"""
        WITH facts AS ({line_facts_sql()}), o(name, r) AS (VALUES ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)),
        f AS (SELECT doc_id, max(r) AS r FROM (SELECT doc_id, {_SENS_SQL} AS s FROM facts) JOIN o ON s = name GROUP BY 1)
        SELECT o_orderkey AS doc_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(o_custkey % 4 + 1, coalesce(r, 1))] AS sensitivity FROM orders LEFT JOIN f ON o_orderkey = doc_id"""),
    "tree_manifest": (tree_manifest, f"""
        WITH facts AS ({line_facts_sql()}) SELECT doc_id, 'node_type' AS kind, 'fact' AS name, count(*) AS n FROM facts GROUP BY ALL
        UNION ALL SELECT doc_id, 'verification_status', coalesce(verification_status, 'none') AS name, count(*) FROM facts GROUP BY ALL
        UNION ALL SELECT doc_id, 'attribute_key', attribute_key AS name, count(*) FROM facts GROUP BY ALL"""),
    "node_mask": (node_mask, f"""
        WITH facts AS ({line_facts_sql()}), e AS (SELECT *, CASE WHEN {_SENS_SQL} = 'CRITICAL' THEN 'CRITICAL' WHEN {_SENS_SQL} = 'HIGH' OR fact_id % 11 = 0 THEN 'HIGH' ELSE 'LOW' END AS effective FROM facts)
        SELECT fact_id AS id, effective, effective IN ('HIGH', 'CRITICAL') AS masked, CASE WHEN effective <> 'LOW' THEN {_REDACT.format('value_text')} ELSE value_text END AS value_text,
            CASE WHEN effective <> 'LOW' THEN NULL ELSE value_num END AS value_num, CASE WHEN effective <> 'LOW' AND value_text IS NOT NULL THEN '[REDACTED]' ELSE value_text END AS content FROM e"""),
    "delete_counts": (delete_counts, f"WITH {_MERGE_SQL} SELECT 'facts' AS table_name, count(*) AS n FROM facts WHERE client_id = 7 UNION ALL SELECT 'merged', count(*) FROM merged WHERE client_id = 7"),
}
