"""Gate queries: language, classes, findings, sensitivity, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import ontology
from quillspan.operators import gate
from quillspan.sources.tables import kyc_documents, kyc_sql, quoted, table

_EN = ", ".join(quoted(w) for w in ontology.ENGLISH_WORDS)
_ES = ", ".join(quoted(w) for w in ontology.SPANISH_WORDS)


def _language_sql(source: str) -> str:
    return f"""
        words AS (SELECT *, list_transform(regexp_extract_all(text, '[a-zA-ZñáéíóúüÑÁÉÍÓÚÜ]+'), lambda x: lower(x)) AS w FROM {source}),
        scored AS (SELECT * EXCLUDE (w), len(list_filter(w, lambda x: x IN ({_EN})))::DOUBLE AS en,
            len(list_filter(w, lambda x: x IN ({_ES}))) + 1.5 * len(regexp_extract_all(text, '[ñáéíóúüÑÁÉÍÓÚÜ¿¡]')) AS es FROM words),
        languages AS (SELECT * EXCLUDE (en, es), CASE WHEN es > en THEN 'es' ELSE 'en' END AS lang,
            CASE WHEN en + es > 0 THEN greatest(en, es) / (en + es) ELSE 0.5 END AS lang_confidence FROM scored)"""


def _anchors_sql() -> str:
    rows = ", ".join(f"({at}, {quoted(code)}, {quoted(lang)}, {quoted(a)}, {quoted(a.lower())}, {weight})" for at, (code, _, _, _, _) in enumerate(ontology.DOCUMENT_TYPES) for c, lang, a, weight in ontology.anchor_rows() if c == code)
    return f"""
        anchors(place, code, alang, anchor, needle, weight) AS (VALUES {rows}),
        hits AS (SELECT l.doc_id, l.lang, place, code, count(DISTINCT anchor) AS n_signals, sum(weight) AS score,
                bool_or(alang = l.lang) AS own, bool_or(alang = 'es') AS spanish
            FROM languages l JOIN anchors ON contains(lower(l.text), needle) GROUP BY ALL),
        ranked AS (SELECT *, round(least(0.97, 1 - pow(0.5, score)), 4) AS confidence FROM hits),
        classes AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, n_signals DESC, CASE WHEN own THEN place ELSE 100 + place END) AS rnk FROM ranked)"""


_FINDINGS = [(kind, pattern) for kind, pattern in gate.SWEEP if kind not in ("PHONE_NUMBER", "MX_RFC", "MX_CURP", "MX_INE_CLAVE_ELECTOR")]
_CURP_SQL = r"""len(list_filter(regexp_extract_all(text, '\b[A-Z][AEIOUX][A-Z]{2}\d{6}[HM][A-Z]{5}[0-9A-Z]\d\b'), lambda v:
    substr(v, 18, 1) = ((10 - list_sum(list_transform(range(17), lambda i: (instr('0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ', substr(v, i + 1, 1)) - 1) * (18 - i))) % 10) % 10)::BIGINT::VARCHAR))"""


def _findings_sql() -> str:
    cases = [f"CASE WHEN regexp_matches(text, {quoted(p)}) THEN {quoted(k)} END" for k, p in _FINDINGS]
    cases.append(f"CASE WHEN {_CURP_SQL} > 0 THEN 'MX_CURP' END")
    cases.append(r"CASE WHEN regexp_matches(text, '(^|[^\w-])(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-])\d{3}[\s.\-]\d{4}($|[^\w-])') THEN 'PHONE_NUMBER' END")
    return f"findings AS (SELECT doc_id, list_sort(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)) AS kinds FROM docs)"


_IDS = ", ".join(quoted(x) for x in ontology.NATIONAL_IDS)
_GATE_SQL = f"""
    WITH docs AS ({kyc_sql()}), {_language_sql("docs")}, {_anchors_sql()}, {_findings_sql()},
    gated AS (
        SELECT l.doc_id, l.client_id, l.lang, round(l.lang_confidence, 6) AS lang_confidence, coalesce(c.code, 'UNKNOWN') AS doc_type, coalesce(c.confidence, 0) AS doc_confidence,
            array_to_string(kinds, ',') AS pii_types, CASE WHEN len(list_filter(kinds, lambda x: x IN ({_IDS}))) > 0 THEN 'CRITICAL' ELSE 'LOW' END AS sensitivity
        FROM languages l JOIN findings USING (doc_id) LEFT JOIN (SELECT * FROM classes WHERE rnk = 1) c USING (doc_id)),
    routed AS (SELECT *, CASE WHEN sensitivity = 'LOW' AND doc_type <> 'UNKNOWN' AND doc_confidence >= 0.55 THEN 'SEND_TO_LLM' ELSE 'DETERMINISTIC_ONLY' END AS decision FROM gated)
"""


def gate_route(spark: SparkSession, sf: str) -> DataFrame:
    gated = gate.run_gate(kyc_documents(spark, sf))
    return gated.select("doc_id", "lang", F.round("lang_confidence", 6).alias("lang_confidence"), "doc_type", "doc_confidence", F.array_join("pii_types", ",").alias("pii_types"), "sensitivity", "decision")


def gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gate.run_gate(kyc_documents(spark, sf)).groupBy("decision", "sensitivity", "lang").agg(F.count("*").alias("n"))


def lang_profile(spark: SparkSession, sf: str) -> DataFrame:
    return gate.add_language(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "lang", F.round("lang_confidence", 6).alias("lang_confidence"))


def anchor_scores(spark: SparkSession, sf: str) -> DataFrame:
    return gate.anchor_classes(gate.add_language(kyc_documents(spark, sf)))


def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = kyc_documents(spark, sf)
    kinds = [kind for kind, _ in gate.SWEEP]
    each = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), F.size(gate.found(F.col("text"), k)).cast("long").alias("n")) for k in kinds])).alias("x"))
    return each.select("doc_id", "x.*").where("n > 0")


def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding with its place, score and language."""
    docs = gate.add_language(kyc_documents(spark, sf))
    each = docs.select("doc_id", F.explode(gate.finding_spans(F.col("text"), F.col("lang"))).alias("s"))
    return each.select("doc_id", F.col("s.kind").alias("entity_type"), F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.value").alias("value"), "s.score", "s.lang")


def sensitivity_score(spark: SparkSession, sf: str) -> DataFrame:
    """The bucket of each event, whose number chooses among four findings."""
    kinds = ["PERSON", "DATE_OF_BIRTH", "ADDRESS", "US_SSN"]
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id")).withColumn("kinds", F.array_compact(F.array(*[F.when(F.expr(f"(id & {1 << i}) <> 0"), F.lit(k)) for i, k in enumerate(kinds)])))
    return rows.select("id", gate.score_sensitivity(F.col("kinds")).alias("bucket"))


def route_table(spark: SparkSession, sf: str) -> DataFrame:
    """The decision for each event, whose number chooses bucket, certainty and switches."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id")).select("id", F.element_at(F.array(*[F.lit(x) for x in ontology.SENSITIVITY]), (F.col("id") % 4 + 1).cast("int")).alias("sensitivity"), F.expr("(id & 4) <> 0").alias("gate_open"), F.expr("(id & 8) <> 0").alias("redacting"), F.when(F.expr("(id & 16) <> 0"), "PASSPORT").otherwise(" Unknown ").alias("doc_type"), F.when(F.expr("(id & 32) <> 0"), 0.55).otherwise(0.54).alias("confidence"))
    return rows.select("id", gate.route(F.col("doc_type"), F.col("confidence"), F.col("sensitivity"), F.col("gate_open"), F.col("redacting")).alias("decision"))


PLANS = {
    "gate_route": (gate_route, f"{_GATE_SQL} SELECT doc_id, lang, lang_confidence, doc_type, doc_confidence, pii_types, sensitivity, decision FROM routed"),
    "gate_summary": (gate_summary, f"{_GATE_SQL} SELECT decision, sensitivity, lang, count(*) AS n FROM routed GROUP BY ALL"),
    "lang_profile": (lang_profile, f"WITH {_language_sql('documents')} SELECT doc_id, lang, round(lang_confidence, 6) AS lang_confidence FROM languages".replace("SELECT *, list_transform", "SELECT doc_id, text, list_transform")),
    "anchor_scores": (anchor_scores, f"WITH docs AS ({kyc_sql()}), {_language_sql('docs')}, {_anchors_sql()} SELECT doc_id, code AS doc_type, rnk, confidence, n_signals FROM classes"),
    "pii_counts": (pii_counts, None),
    "pii_spans": (pii_spans, None),
    "sensitivity_score": (sensitivity_score, "SELECT event_id AS id, CASE WHEN event_id & 8 <> 0 THEN 'CRITICAL' WHEN event_id & 7 = 7 THEN 'HIGH' WHEN event_id & 1 <> 0 AND event_id & 6 <> 0 THEN 'MEDIUM' WHEN event_id & 4 <> 0 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM events"),
    "route_table": (route_table, """
        WITH r AS (SELECT event_id AS id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][event_id % 4 + 1] AS s, event_id & 4 <> 0 AS o, event_id & 8 <> 0 AS red, (event_id & 16 = 0 OR event_id & 32 = 0) AS unsure FROM events)
        SELECT id, CASE WHEN unsure AND s <> 'LOW' THEN 'DETERMINISTIC_ONLY' WHEN s <> 'LOW' AND red THEN 'REDACT_THEN_SEND' WHEN s <> 'LOW' THEN 'DETERMINISTIC_ONLY' WHEN NOT unsure AND o THEN 'SEND_TO_LLM' ELSE 'DETERMINISTIC_ONLY' END AS decision FROM r"""),
}
