"""The gate: language, class, personal data, sensitivity and route of every document, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan import ontology
from quillspan.functions.ids import curp_valid, ein_valid, rfc_structure, sin_valid, ssn_valid
from quillspan.functions.text import once

CEILING, FLOOR = 0.97, 0.55

# Patterns of the personal-data sweep, in order of precedence.
SWEEP = [
    ("MX_CURP", r"\b([A-Z][AEIOUX][A-Z]{2}\d{6}[HM][A-Z]{5}[0-9A-Z]\d)\b"),
    ("MX_INE_CLAVE_ELECTOR", r"\b([A-Z]{6}\d{8}[HM]\d{3})\b"),
    ("MX_RFC", r"\b([A-ZÑ&]{3,4}\d{6}[0-9A-Z]{2}[0-9A])\b"),
    ("US_SSN", r"\b(\d{3}-\d{2}-\d{4})\b"),
    ("CA_SIN", r"\b(\d{3}-\d{3}-\d{3})\b"),
    ("US_EIN", r"\b(\d{2}-\d{7})\b"),
    ("EMAIL_ADDRESS", r"\b([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"),
    ("PHONE_NUMBER", r"(?<![\w-])((?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-])\d{3}[\s.\-]\d{4})(?![\w-])"),
]

# Fixed values: (score of a value that holds up, score of another, language of the finding, null for the document's).
SCORES = {
    "MX_CURP": (0.95, 0.95, "es"), "MX_INE_CLAVE_ELECTOR": (0.85, 0.45, "es"), "MX_RFC": (0.9, 0.9, "es"), "US_SSN": (0.95, 0.5, "en"),
    "CA_SIN": (0.9, 0.45, "en"), "US_EIN": (0.85, 0.4, "en"), "EMAIL_ADDRESS": (0.8, 0.8, None), "PHONE_NUMBER": (0.6, 0.6, None),
}
# What stands in the 60 characters before an electoral key that is surely one.
ELECTORAL_CONTEXT = ["clave de elector", "credencial para votar", "instituto nacional electoral"]


def language_scores(text: Column) -> Column:
    """(en, es): stopword hits, and for Spanish 1.5 for each of its own characters."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-ZñáéíóúüÑÁÉÍÓÚÜ]+"), F.lit(0)), F.lower)
    own = 1.5 * F.regexp_count(text, F.lit("[ñáéíóúüÑÁÉÍÓÚÜ¿¡]"))
    hits = lambda w, known: F.size(F.filter(w, lambda x: x.isin(known))).cast("double")
    return once(words, lambda w: F.struct(hits(w, ontology.ENGLISH_WORDS).alias("en"), (hits(w, ontology.SPANISH_WORDS) + own).alias("es")))


def add_language(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang (Spanish only if it scores strictly more) and lang_confidence, the winner's share or 0.5."""

    def judged(s: Column) -> Column:
        total = s["en"] + s["es"]
        share = F.when(total > 0, F.greatest(s["en"], s["es"]) / total).otherwise(0.5)
        return F.struct(F.when(s["es"] > s["en"], "es").otherwise("en").alias("lang"), share.alias("confidence"))

    scored = docs.withColumn("_s", once(language_scores(F.col(text)), judged))
    return scored.withColumns({"lang": F.col("_s.lang"), "lang_confidence": F.col("_s.confidence")}).drop("_s")


def class_scores(text: Column) -> Column:
    """For each class: (confidence, signals, order in an English sweep, in a Spanish sweep, code), null without a hit.

    The text is lowered once and every anchor sought in it once.
    """
    anchors = list(dict.fromkeys(a for _, _, _, en, es in ontology.DOCUMENT_TYPES for a in (*en, *es)))
    place = {a: i for i, a in enumerate(anchors)}

    def classes(hit: Column) -> Column:
        found = lambda group: F.exists(F.array(*[F.get(hit, F.lit(place[a])) for a in group]), lambda x: x) if group else F.lit(False)
        out = []
        for at, (code, _, _, en, es) in enumerate(ontology.DOCUMENT_TYPES):
            score = sum((F.when(F.get(hit, F.lit(place[a])), ontology.specificity(a)).otherwise(0.0) for a in (*en, *es)), F.lit(0.0))
            signals = sum((F.get(hit, F.lit(place[a])).cast("int") for a in dict.fromkeys((*en, *es))), F.lit(0))
            confidence = F.round(F.least(F.lit(CEILING), 1 - F.pow(F.lit(0.5), score)), 4)
            order = [(-F.when(found(group), at).otherwise(100 + at)).alias(lang) for lang, group in (("en", en), ("es", es))]
            out.append(F.when(found((*en, *es)), F.struct(confidence.alias("confidence"), signals.alias("signals"), *order, found(es).alias("spanish"), F.lit(code).alias("code"))))
        return F.array_compact(F.array(*out))

    return once(F.lower(text), lambda low: once(F.array(*[F.contains(low, F.lit(a.lower())) for a in anchors]), classes))


def _swept(text: str) -> Column:
    """The classes of a document beside its language, so that neither is computed again for each class."""
    return F.struct(class_scores(F.col(text)).alias("all"), F.col("lang").alias("lang"))


def add_class(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_type and doc_confidence of the best class, UNKNOWN and 0 without any, and its jurisdiction.

    Anchors count as case-insensitive substrings, in both languages. Ties go to more signals,
    then to the class met first when the document's own language is swept first.
    """
    ranked = once(_swept(text), lambda s: F.array_max(F.transform(s["all"], lambda c: F.struct(c["confidence"], c["signals"], F.when(s["lang"] == "es", c["es"]).otherwise(c["en"]).alias("order"), c["spanish"], c["code"]))))
    nations = F.create_map(*[F.lit(x) for code, _, where, _, _ in ontology.DOCUMENT_TYPES for x in (code, where[0])])
    several = [code for code, _, where, _, _ in ontology.DOCUMENT_TYPES if len(where) > 1 and "MX" in where]
    return docs.withColumn("_best", ranked).withColumns({
        "doc_type": F.coalesce("_best.code", F.lit("UNKNOWN")),
        "doc_confidence": F.coalesce("_best.confidence", F.lit(0.0)),
        "jurisdiction": F.when(F.col("_best.spanish") & F.col("_best.code").isin(several), "MX").otherwise(F.try_element_at(nations, F.col("_best.code"))),
    }).drop("_best")


def anchor_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, doc_type, rnk, confidence, n_signals): all classes of a document in their order."""
    row = lambda s: lambda c: F.struct((-c["confidence"]).alias("c"), (-c["signals"]).alias("n"), (-F.when(s["lang"] == "es", c["es"]).otherwise(c["en"])).alias("o"), c["code"].alias("code"))
    ordered = docs.withColumn("_all", once(_swept(text), lambda s: F.array_sort(F.transform(s["all"], row(s)))))
    # The outer form keeps the planner from asking for the array's size first, which computes it twice more.
    each = ordered.select("doc_id", F.posexplode_outer("_all").alias("at", "x")).where("at is not null")
    return each.select("doc_id", F.col("x.code").alias("doc_type"), (F.col("at") + 1).cast("long").alias("rnk"), (-F.col("x.c")).alias("confidence"), (-F.col("x.n")).cast("long").alias("n_signals"))


def found(text: Column, kind: str) -> Column:
    """All values of one kind of personal data; CURP and RFC only if they hold up."""
    values = F.regexp_extract_all(text, F.lit(dict(SWEEP)[kind]), F.lit(1))
    return F.filter(values, {"MX_CURP": curp_valid, "MX_RFC": rfc_structure}[kind]) if kind in ("MX_CURP", "MX_RFC") else values


def add_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """pii_types (sorted) and sensitivity: CRITICAL with any national identifier, else LOW.

    A kind counts if one of its spans stays (see ``finding_spans``).
    """
    kinds = once(finding_spans(F.col(text)), lambda spans: F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["kind"]))))
    return docs.withColumn("pii_types", kinds).withColumn("sensitivity", score_sensitivity(F.col("pii_types")))


def score_sensitivity(kinds: Column) -> Column:
    """The bucket of a set of findings: identifiers, then person, date of birth and address together."""
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    person, born, address = has("PERSON", "PERSON_NAME"), has("DATE_OF_BIRTH", "DOB", "DATE_TIME"), has("ADDRESS", "LOCATION", "US_ADDRESS")
    return F.when(has(*ontology.NATIONAL_IDS), "CRITICAL").when(person & born & address, "HIGH").when(person & (born | address), "MEDIUM").when(address, "MEDIUM").otherwise("LOW")


_SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double,lang:string>>"


def _located(text: Column, kind: str, lang: Column) -> Column:
    """The values of one kind where its pattern matches: behind all pieces between matches, and all matches, before."""
    pattern = dict(SWEEP)[kind]
    sure, other, own = SCORES[kind]

    def place(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.array().cast(_SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["next"] + F.length(x["piece"])
            value = x["value"]
            if kind == "MX_INE_CLAVE_ELECTOR":
                before = F.lower(F.substr(text, F.greatest(at - 59, F.lit(1)), F.least(at, F.lit(60))))
                holds = F.exists(F.array(*[F.lit(c) for c in ELECTORAL_CONTEXT]), lambda c: F.contains(before, c))
            else:
                check = {"US_SSN": ssn_valid, "CA_SIN": sin_valid, "US_EIN": ein_valid}.get(kind)
                holds = check(value) if check else F.lit(True)
            score = F.when(holds, sure).otherwise(other)
            span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"), score.alias("score"), (lang if own is None else F.lit(own)).alias("lang"))
            return F.struct((at + F.length(value)).alias("next"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.filter(F.arrays_zip(both["pieces"].alias("piece"), both["values"].alias("value")), lambda x: x["value"].isNotNull()), start, step)["out"]

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("values"))
    placed = once(both, lambda b: place(b))
    valid = {"MX_CURP": curp_valid, "MX_RFC": rfc_structure}.get(kind)
    placed = F.filter(placed, lambda s: valid(s["value"])) if valid else placed
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(_SPANS))


def finding_spans(text: Column, lang: Column | None = None) -> Column:
    """(kind, start, end, value, score, lang) of the findings that stay, by start.

    A span that overlaps one of an earlier kind, or an earlier one of its own, is dropped. The
    language of mail and phone findings is that of the document, ``lang``, English if not given.
    A null text has none.
    """
    lang = F.lit("en") if lang is None else lang
    kept = F.aggregate(
        F.concat(*[_located(F.coalesce(text, F.lit("")), kind, lang) for kind, _ in SWEEP]),
        F.array().cast(_SPANS),
        lambda acc, s: F.when(F.exists(acc, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"])), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


def route(doc_type: Column, confidence: Column, sensitivity: Column, gate_open: Column, redacting: Column, floor: float = FLOOR) -> Column:
    """The decision table: uncertain or sensitive documents never leave unless redaction is on."""
    unknown = F.lower(F.trim(F.coalesce(doc_type, F.lit("")))).isin("", "unknown", "unclassified")
    unsure = unknown | (confidence < floor)
    local, redact = F.lit("DETERMINISTIC_ONLY"), F.lit("REDACT_THEN_SEND")
    sensitive = sensitivity.isin("MEDIUM", "HIGH", "CRITICAL")
    return (
        F.when(unsure & (sensitivity != "LOW"), local)
        .when(sensitive & redacting, redact)
        .when(sensitive, local)
        .when((sensitivity == "LOW") & ~unsure & gate_open, F.lit("SEND_TO_LLM"))
        .otherwise(local)
    )


def run_gate(docs: DataFrame, gate_open: bool = True, redacting: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) with language, class, findings, sensitivity and decision, in one narrow stage."""
    gated = add_findings(add_class(add_language(docs)))
    return gated.withColumn("decision", route(F.col("doc_type"), F.col("doc_confidence"), F.col("sensitivity"), F.lit(gate_open), F.lit(redacting)))
