"""Identifiers, machine-readable zones, labelled values and JSON replies found in texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillspan.functions import dates, ids
from quillspan.functions.text import once
from quillspan.operators.service import AMOUNT

# The patterns that identifiers and machine-readable lines have in texts.
SSN = r"(?<!\d)(\d{3}-\d{2}-\d{4})(?!\d)"
EIN = r"(?<!\d)(\d{2}-\d{7})(?!\d)"
SIN = r"\b(\d{3}[ \-]?\d{3}[ \-]?\d{3})\b"
BUSINESS_NUMBER = r"\b(\d{9}\s?(?:RC|RM|RP|RT)\s?\d{4}|\d{9})\b"
CURP = r"\b([A-Z]{4}\d{6}[HMX][A-Z]{5}[0-9A-Z]\d)\b"
RFC = r"\b([A-ZÑ&]{3,4}\d{6}[0-9A-Z]{2,3})\b"
ELECTORAL_KEY = r"\b([A-Z]{6}\d{8}[HM]\d{3})\b"
ELECTORAL_ZONE = r"IDMEX(\d{9})\d{12,13}"
ZONE_LINE, ZONE_FIRST = "^[A-Z0-9<]{44}$", "^P[A-Z<][A-Z<]{3}"

# The labels behind which fields of Canadian forms stand in a line.
EMPLOYER = ["employer's name", "employer name", "employer", "nom de l'employeur"]
INCOME = ["employment income", "box 14", "total income", "net income", "taxable income", "revenu d'emploi", "revenu total"]
ASSESSED = ["total income", "net income", "taxable income", "balance", "refund", "amount owing", "revenu total", "solde"]
HOLDER = ["name", "surname", "given name", "last name", "first name", "nom", "prénom"]
MAILING = ["mailing address", "address", "adresse"]


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _fact(key, value: Column, confidence, ok: Column, sensitivity: str, number: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    number = F.lit(None).cast("double") if number is None else number
    return F.struct(
        lit(key).alias("attribute_key"), value.cast("string").alias("value"), lit(confidence).cast("double").alias("confidence"), ok.cast("boolean").alias("checksum_ok"),
        F.lit(sensitivity).alias("sensitivity"), number.alias("value_num"),
    )


def us_ids(text: Column) -> Column:
    """EIN, SSN and ITIN with valid parts, between characters that are no digits."""
    ssn = F.filter(_found(text, SSN), lambda v: ids.ssn_valid(v) | ids.itin_valid(v))
    ein = _found(text, EIN)
    people = F.transform(ssn, lambda v: _fact(F.when(ids.ssn_valid(v), "id.ssn").otherwise("id.itin"), v, 0.95, F.lit(True), "CRITICAL"))
    return F.concat(F.transform(ein, lambda v: _fact("id.ein", v, 0.95, F.lit(True), "HIGH")), people)


def sin_ids(text: Column) -> Column:
    """SIN as ddd-ddd-ddd by their check digits; others are dropped."""
    digits = lambda v: F.regexp_replace(v, r"[ \-]", "")
    dashed = lambda v: F.concat_ws("-", F.substring(digits(v), 1, 3), F.substring(digits(v), 4, 3), F.substring(digits(v), 7, 3))
    sins = F.filter(_found(text, SIN), ids.sin_valid)
    return F.array_distinct(F.transform(sins, lambda v: _fact("id.sin", dashed(v), 0.95, F.lit(True), "CRITICAL")))


def business_ids(text: Column) -> Column:
    """Business numbers by their check digits, without blanks; others are dropped."""
    bns = F.filter(_found(text, BUSINESS_NUMBER), ids.bn_valid)
    return F.array_distinct(F.transform(bns, lambda v: _fact("id.business_number", F.regexp_replace(v, r"\s", ""), 0.95, F.lit(True), "HIGH")))


def canada_ids(text: Column) -> Column:
    return F.concat(sin_ids(text), business_ids(text))


def behind_labels(text: Column, labels: list[str]) -> Column:
    """What stands behind labels in the lines of a text, line by line and in the labels' order; empty rests are left out."""
    wanted = F.array(*[F.lit(x) for x in labels])

    def of_line(line: Column) -> Column:
        def rest(low: Column, label: Column) -> Column:
            at = F.call_function("locate", label, low)
            behind = F.ltrim(F.substr(line, at + F.length(label), F.length(line)), F.lit(" \t:;.-="))
            return F.when(at > 0, F.nullif(F.trim(behind, F.lit(" \t")), F.lit("")))

        return once(F.lower(line), lambda low: F.transform(wanted, lambda label: rest(low, label)))

    lines = F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]")
    return F.filter(F.flatten(F.transform(lines, of_line)), lambda v: v.isNotNull())


def _is_number(value: Column) -> Column:
    """Whether a value is an amount alone, with or without its currency."""
    bare = F.trim(F.regexp_replace(value, r"CAD|[$,]", ""))
    return bare.rlike(r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf|infinity)$")


def _first_of(values: Column, key: str, confidence: float, sensitivity: str) -> Column:
    """A fact of the first value, none if there is no value."""
    return F.transform(F.slice(values, 1, 1), lambda v: _fact(key, v, confidence, F.lit(None), sensitivity))


def _amount_facts(text: Column, labels: list[str]) -> Column:
    """Different amounts behind labels, as numbers."""
    found = F.transform(behind_labels(text, labels), lambda v: F.regexp_replace(F.regexp_extract(v, AMOUNT, 1), ",", "").try_cast("double"))
    return F.transform(F.array_distinct(F.filter(found, lambda v: v.isNotNull())), lambda v: _fact("income.amount", F.lit(None), 0.6, F.lit(None), "MEDIUM", v))


def t4_fields(text: Column) -> Column:
    """Statement of remuneration: the first employer that is no amount, different amounts of income, valid SIN."""
    employers = F.filter(behind_labels(text, EMPLOYER), lambda v: ~_is_number(v))
    return F.concat(_first_of(employers, "income.employer", 0.5, "LOW"), _amount_facts(text, INCOME), sin_ids(text))


def assessment_fields(text: Column) -> Column:
    """Notice of assessment: different amounts, and the first address longer than three characters."""
    addresses = F.filter(behind_labels(text, MAILING), lambda v: F.length(v) > 3)
    return F.concat(_amount_facts(text, ASSESSED), _first_of(addresses, "address.mailing", 0.4, "MEDIUM"))


def licence_fields(text: Column) -> Column:
    """Canadian driver's licence: the first name that is not digits alone, and the first date of the text."""
    names = F.filter(behind_labels(text, HOLDER), lambda v: ~v.rlike(r"^\d+$"))
    born = F.filter(F.array(dates.first_date(text)), lambda d: d.isNotNull())
    return F.concat(_first_of(names, "identity.full_name", 0.5, "MEDIUM"), _first_of(born, "identity.date_of_birth", 0.4, "MEDIUM"))


def mexico_ids(text: Column) -> Column:
    """CURP with date of birth and sex, RFC graded by check digit, electoral keys and zones, unverified, in any case of letters.

    A key whose sex is not that of the text's first CURP is less sure.
    """
    text = F.upper(F.regexp_replace(text, r"[ \t]+", " "))
    rfcs = F.filter(_found(text, RFC), ids.rfc_structure)
    sex = lambda code: F.translate(code, "HM", "MF")
    of_curp = lambda v: F.array(_fact("id.curp", v, 0.97, F.lit(True), "CRITICAL"), _fact("identity.date_of_birth", ids.curp_birth(v), 0.95, F.lit(True), "HIGH"), _fact("identity.sex", sex(F.substring(v, 11, 1)), 0.95, F.lit(True), "LOW"))
    graded = F.transform(rfcs, lambda v: _fact("id.rfc", v, F.when(ids.rfc_check(v), 0.95).otherwise(0.6), ids.rfc_check(v), "CRITICAL"))
    zones = F.transform(F.regexp_extract_all(text, F.lit(ELECTORAL_ZONE), F.lit(1)), lambda v: _fact("id.ine_clave_elector", F.concat(F.lit("IDMEX"), v), 0.75, F.lit(None), "CRITICAL"))

    def all_of(curps: Column) -> Column:
        holder = F.substring(F.get(curps, F.lit(0)), 11, 1)
        surety = lambda v: F.when(holder != F.substring(v, 15, 1), 0.7).otherwise(0.8)
        keys = F.transform(_found(text, ELECTORAL_KEY), lambda v: _fact("id.ine_clave_elector", v, surety(v), F.lit(None), "CRITICAL"))
        return F.concat(F.flatten(F.transform(curps, of_curp)), graded, keys, zones)

    return once(F.filter(_found(text, CURP), ids.curp_valid), all_of)


def extract(docs: DataFrame, finder) -> DataFrame:
    """(doc_id, attribute_key, value, confidence, checksum_ok, sensitivity) of a finder over (doc_id, text)."""
    return docs.select("doc_id", F.explode(finder(F.col("text"))).alias("f")).select("doc_id", "f.*")


def zone_of(text: Column) -> Column:
    """The two lines (a, b) of a text's first machine-readable zone of a passport, null if there is none."""
    lines = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.upper(F.regexp_replace(x, r"\s", ""))), lambda x: x.rlike(ZONE_LINE))
    pairs = once(lines, lambda all_: F.transform(all_, lambda x, i: F.struct(x.alias("a"), F.get(all_, i + 1).alias("b"))))
    return F.get(F.filter(pairs, lambda p: p["a"].rlike(ZONE_FIRST) & p["b"].isNotNull()), F.lit(0))


def _zone_fields(a: Column, b: Column) -> dict[str, Column]:
    part = lambda start, n: F.substring(b, start, n)
    same = lambda text, at: ids.mrz_check(text).cast("string") == part(at, 1)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<", " "), " +", " "))
    names, sex = F.substring(a, 6, 39), part(21, 1)
    return {
        "number": F.rtrim(part(1, 9), F.lit("<")), "surname": clean(F.split(names, "<<")[0]), "given_names": clean(F.get(F.split(names, "<<", 2), F.lit(1))), "nationality": F.rtrim(part(11, 3), F.lit("<")),
        "birth": part(14, 6), "expiry": part(22, 6), "sex": F.when(sex.isin("M", "F"), sex),
        "checks": same(part(1, 9), 10) & same(part(14, 6), 20) & same(part(22, 6), 28) & same(F.concat(part(1, 10), part(14, 7), part(22, 22)), 44),
    }


def passport_zone(docs: DataFrame) -> DataFrame:
    """Fields of the first two-line machine-readable zone of a passport in (doc_id, text).

    Confidence is .99 if number, birth, expiry and the whole line check, else .40.
    """
    zones = docs.select("doc_id", zone_of(F.col("text")).alias("z")).where("z is not null")
    fields = _zone_fields(F.col("z.a"), F.col("z.b"))
    return zones.select("doc_id", *[c.alias(name) for name, c in fields.items()]).withColumn("confidence", F.when(F.col("checks"), 0.99).otherwise(0.40))


def zone_date(yymmdd: Column, birth: bool, year: int | Column) -> Column:
    """The date of six digits: births lie up to the end of ``year``'s century part, other dates up to 50 years ahead; null if there is none."""
    yy = F.substring(yymmdd, 1, 2).try_cast("int")
    century = F.when(yy > year % 100 + (0 if birth else 50), 1900).otherwise(2000)
    parts = [(century + yy).cast("string"), F.substring(yymmdd, 3, 2), F.substring(yymmdd, 5, 2)]
    return F.when(yymmdd.rlike("^[0-9]{6}$"), F.concat_ws("-", *parts).try_cast("date"))


# The fields of a passport by attribute key: (key, field, sensitivity).
_PASSPORT = [
    ("identity.surname", "surname", "HIGH"), ("identity.given_names", "given_names", "HIGH"), ("id.passport_number", "number", "HIGH"), ("identity.nationality", "nationality", "MEDIUM"),
    ("identity.date_of_birth", "birth", "HIGH"), ("identity.sex", "sex", "MEDIUM"), ("doc.expiry_date", "expiry", "LOW"),
]


def passport_facts(docs: DataFrame, year: int | Column) -> DataFrame:
    """(doc_id, attribute_key, value, value_date, confidence, checksum_ok, verification_status, sensitivity) of passports' zones.

    Dates are written as dates, or as they stand where there is no such date; ``year`` is the
    clock that decides their century. Fields that are empty have a null value.
    """
    at = {"birth": zone_date(F.col("birth"), True, year), "expiry": zone_date(F.col("expiry"), False, year)}
    value = lambda f: F.coalesce(at[f].cast("string"), F.col(f)) if f in at else F.col(f)
    facts = F.array(*[F.struct(F.lit(k).alias("attribute_key"), F.nullif(value(f), F.lit("")).alias("value"), (at[f] if f in at else F.lit(None).cast("date")).alias("value_date"), F.lit(s).alias("sensitivity")) for k, f, s in _PASSPORT])
    each = passport_zone(docs).select("doc_id", "confidence", "checks", F.explode(facts).alias("f"))
    status = F.when(F.col("checks"), "checksum_verified").otherwise("unverified")
    return each.select("doc_id", "f.attribute_key", "f.value", "f.value_date", "confidence", F.col("checks").alias("checksum_ok"), status.alias("verification_status"), "f.sensitivity")


def passport_fields(text: Column, year: int | Column) -> Column:
    """The same facts as one column, which a dispatch by class can choose; dates are their values."""

    def facts(z: Column) -> Column:
        fields = _zone_fields(z["a"], z["b"])

        def of(checks: Column) -> Column:
            def fact(key: str, name: str, level: str) -> Column:
                value = fields[name]
                if name in ("birth", "expiry"):
                    value = F.coalesce(zone_date(value, name == "birth", year).cast("string"), value)
                return _fact(key, F.nullif(value, F.lit("")), F.when(checks, 0.99).otherwise(0.40), checks, level)

            return F.array(*[fact(*row) for row in _PASSPORT])

        return F.when(z.isNotNull(), once(fields["checks"], of))

    return once(zone_of(text), facts)


def bind_values(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, value): for each label line the nearest line to its right, else the nearest below, on one page.

    Boxes: page, x0, y0, x1, y1. To the right means overlapping in height, below in width. The
    page is the join key and the gap orders, so only lines of one page meet.
    """
    l_, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    both = labels.alias("l").join(lines.alias("r"), (l_("page") == r("page")) & (l_("id") != r("id")))
    tall = F.least(l_("y1"), r("y1")) - F.greatest(l_("y0"), r("y0"))
    wide = F.least(l_("x1"), r("x1")) - F.greatest(l_("x0"), r("x0"))
    right = (r("x0") >= l_("x1")) & (tall > 0)
    below = (r("y0") >= l_("y1")) & (wide > 0)
    ranked = both.where(right | below).select(l_("id").alias("id"), l_("text").alias("label"), r("text").alias("value"), F.when(right, 0).otherwise(1).alias("side"), F.when(right, r("x0") - l_("x1")).otherwise(r("y0") - l_("y1")).alias("gap"), r("id").alias("rid"))
    return ranked.groupBy("id", "label").agg(F.min_by("value", F.struct("side", "gap", "rid")).alias("value")).select("label", "value")


def first_object(reply: Column) -> Column:
    """The first JSON object in a model's reply: behind a code fence, or the first balanced braces, else null.

    A fold over the characters that knows strings and escapes finds where the braces close.
    """
    bare = F.trim(F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1"))

    def scan(text: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("open"), F.lit(0).alias("close"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

        def step(s: Column, c: Column) -> Column:
            live = (s["close"] == 0) & ((s["open"] > 0) | (c == "{"))
            opens, closes = live & ~s["quoted"] & (c == "{"), live & ~s["quoted"] & (c == "}")
            depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
            at = s["at"] + 1
            return F.struct(
                at.alias("at"), depth.alias("depth"), F.when((s["open"] == 0) & opens, at).otherwise(s["open"]).alias("open"), F.when(closes & (depth == 0), at).otherwise(s["close"]).alias("close"),
                F.when(live & (c == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (live & s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            )

        return once(F.aggregate(F.split(text, ""), start, step), lambda s: F.when(s["close"] > 0, F.substr(text, s["open"], s["close"] - s["open"] + 1)))

    return F.when(F.try_parse_json(bare).isNotNull() & F.startswith(bare, F.lit("{")), bare).otherwise(scan(bare))


def attributes(replies: DataFrame) -> DataFrame:
    """(id, key, value): the attributes of JSON replies (id, reply).

    They are those of an object under ``attributes``, else all of the reply but its confidence;
    values that are lists or objects stay JSON.
    """
    maps = replies.select("id", F.from_json(first_object(F.col("reply")), "map<string,string>").alias("m")).where("m is not null")
    inner = F.try_element_at("m", F.lit("attributes"))
    nested = F.when(F.ltrim(inner).startswith("{"), F.from_json(inner, "map<string,string>"))
    flat = F.map_filter("m", lambda k, _: k != "confidence")
    return maps.select("id", F.explode(F.coalesce(nested, flat)).alias("key", "value"))


#: Which finder reads which classes; classes that none reads yield nothing.
FINDERS = [
    (us_ids, ["US_SSN_CARD", "US_EIN_LETTER", "US_W2", "US_1099", "US_DRIVER_LICENSE"]),
    (sin_ids, ["CA_SIN"]),
    (business_ids, ["CA_BUSINESS_NUMBER"]),
    (t4_fields, ["CA_T4"]),
    (assessment_fields, ["CA_NOA"]),
    (licence_fields, ["CA_DRIVER_LICENSE"]),
    (mexico_ids, ["MX_INE", "MX_CURP", "MX_RFC_CSF"]),
]


def extract_by_type(docs: DataFrame, finders: list | None = None, year: int | Column | None = None) -> DataFrame:
    """Facts of (doc_id, doc_type, text) by the finder of each document's class, in one narrow pass.

    Without ``finders`` those of ``FINDERS`` and that of passports, for whose centuries ``year``
    is the clock, by default this year. Null texts and classes yield nothing.
    """
    if finders is None:
        clock = F.year(F.current_date()) if year is None else year
        finders = [*FINDERS, (lambda text: passport_fields(text, clock), ["PASSPORT"])]
    found = None
    for finder, classes in finders:
        hit = F.col("doc_type").isin(classes)
        found = F.when(hit, finder(F.col("text"))) if found is None else found.when(hit, finder(F.col("text")))
    return docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def indel(a: str, b: str) -> int:
    """Insertions and deletions that turn one text into the other, by the longest common subsequence in one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        kept = rows & where.get(c, 0)
        rows = ((rows + kept) | (rows - kept)) & full
    return len(a) + len(b) - 2 * (len(a) - rows.bit_count())


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: how alike two texts are as sets of words, 100 if one's words are all in the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and not (only_a and only_b):
        return 100.0
    gap = len(shared) + bool(shared)
    out = [100 - 100 * indel(only_a, only_b) / (2 * gap + len(only_a) + len(only_b))]
    if shared:
        out += [100 - 100 * (1 + len(rest)) / (len(shared) + gap + len(rest)) for rest in (only_a, only_b)]
    return max(out)


@F.pandas_udf(ArrayType(DoubleType()))
def _scores(text: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([[token_set_ratio(x, t) for x in some] for t, some in zip(text, labels, strict=True)], dtype=object)


def _tail(text: Column, label: Column) -> Column:
    """What stands behind a label in a line, without separators; null if nothing does."""
    at = F.call_function("locate", F.lower(label), F.lower(text))
    rest = F.regexp_replace(F.substr(text, at + F.length(label), F.length(text)), r"^[ :\t\-=–—]+", "")
    return F.when(at > 0, F.nullif(F.trim(rest), F.lit("")))


def anchor_extract(lines: DataFrame, labels: list[str] | str, threshold: float = 85) -> DataFrame:
    """(doc_id, label, value): for each label of a document the value bound to the line most like it.

    ``lines``: doc_id, line_no, text, page, x0, y0, x1, y1; boxes may be null. The best line by
    token set ratio, the first on ties, takes the nearest line to its right on its page, else
    the nearest below, else what stands behind the label in it. In a document without any box
    the first line that has something behind the label gives it; if no label finds such a line,
    the line most like any label is the value itself, the earliest line and label on ties.
    Null and blank texts are no lines. The labels are one list for all, or a column of arrays
    that is alike on all lines of a document; a document's lines meet only those chosen for its labels.
    """
    asked = F.col(labels) if isinstance(labels, str) else F.array(*[F.lit(x) for x in labels])
    some = lines.where((F.length(F.trim("text")) > 0) & (F.size(asked) > 0))
    boxed = F.col("x0").isNotNull()
    each = some.withColumn("_s", _scores(F.col("text"), asked)).select("*", F.posexplode(F.arrays_zip(asked.alias("label"), F.col("_s").alias("score"))).alias("label_no", "_l")).select("*", "_l.label", "_l.score").drop("_s", "_l")
    place = F.struct("page", "x0", "y0", "x1", "y1")
    fits = F.col("score") >= threshold
    chosen = each.withColumn("_tail", _tail(F.col("text"), F.col("label"))).groupBy("doc_id", "label_no", "label").agg(
        F.min_by(F.when(fits, F.struct("line_no", "text", "score", place.alias("box"))), F.when(fits, F.struct(-F.col("score"), F.col("line_no")))).alias("best"),
        F.min_by("_tail", F.when(F.col("_tail").isNotNull(), F.col("line_no"))).alias("tail"), F.bool_or(boxed).alias("has_boxes"),
    )
    at = chosen.where("has_boxes and best is not null").alias("c")
    l_, r = (lambda c: F.col(f"c.best.box.{c}")), (lambda c: F.col(f"r.{c}"))
    both = at.join(some.where(boxed).alias("r"), (F.col("c.doc_id") == r("doc_id")) & (l_("page") == r("page")) & (F.col("c.best.line_no") != r("line_no")), "left")
    right = (r("x0") >= l_("x1") - 1e-9) & (F.least(l_("y1"), r("y1")) > F.greatest(l_("y0"), r("y0")))
    below = (r("y0") >= l_("y1") - 1e-9) & (F.least(l_("x1"), r("x1")) > F.greatest(l_("x0"), r("x0")))
    order = F.when(right, F.struct(F.lit(0).alias("side"), (r("x0") - l_("x1")).cast("double").alias("gap"), r("line_no"))).when(below, F.struct(F.lit(1).alias("side"), (r("y0") - l_("y1")).cast("double").alias("gap"), r("line_no")))
    bound = both.groupBy("c.doc_id", "c.label").agg(F.min_by(F.when(order.isNotNull(), r("text")), order).alias("near"), F.first("c.best.text").alias("own"))
    boxes = bound.select("doc_id", "label", F.coalesce("near", _tail(F.col("own"), F.col("label"))).alias("value")).where("value is not null")
    plain = chosen.where("not has_boxes")
    whole = plain.groupBy("doc_id").agg(F.max(F.col("tail").isNotNull()).alias("any_tail"), F.min_by(F.struct("label", F.col("best.text").alias("value")), F.when(F.col("best").isNotNull(), F.struct(-F.col("best.score"), F.col("best.line_no"), F.col("label_no")))).alias("w"))
    return (
        boxes.unionByName(plain.where("tail is not null").select("doc_id", "label", F.col("tail").alias("value")))
        .unionByName(whole.where("not any_tail and w.value is not null").select("doc_id", "w.label", "w.value"))
    )


# The labels beside which fields of a class stand, (class, attribute key, labels).
SOFT_LABELS = [
    ("US_DRIVER_LICENSE", "identity.full_name", ["Name", "LN", "FN"]),
    ("US_DRIVER_LICENSE", "identity.date_of_birth", ["DOB", "Date of Birth"]),
    ("US_DRIVER_LICENSE", "address.residential", ["Address", "ADDR"]),
    ("US_DRIVER_LICENSE", "doc.expiry_date", ["EXP", "Expires", "Expiration"]),
    ("US_DRIVER_LICENSE", "id.driver_license", ["DL", "License", "License No", "DL No"]),
    ("US_EIN_LETTER", "entity.legal_name", ["Legal name", "Name", "Business name"]),
    ("US_W2", "income.employer", ["Employer", "Employer's name", "Employer name"]),
    ("US_W2", "income.amount", ["Wages", "Wages, tips", "Box 1"]),
    ("US_1099", "income.amount", ["Nonemployee compensation", "Box 1", "Amount"]),
    ("US_SSN_CARD", "identity.full_name", ["Name"]),
]


def soft_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, doc_type, attribute_key, value, confidence, sensitivity) bound to the labels of each document's class.

    ``lines`` as for ``anchor_extract``, with doc_type; classes without labels yield nothing.
    """
    known = F.array(*[F.struct(F.lit(c).alias("doc_type"), F.lit(k).alias("key"), F.lit(x).alias("label")) for c, k, group in SOFT_LABELS for x in group])
    mine = F.filter(known, lambda e: e["doc_type"] == F.col("doc_type"))
    found = anchor_extract(lines.withColumn("_labels", F.transform(mine, lambda e: e["label"])), "_labels")
    typed = found.join(lines.groupBy("doc_id").agg(F.first("doc_type").alias("doc_type")), "doc_id")
    key = F.filter(known, lambda e: (e["doc_type"] == F.col("doc_type")) & (e["label"] == F.col("label")))[0]["key"]
    return typed.select("doc_id", "doc_type", key.alias("attribute_key"), "value", F.lit(0.6).alias("confidence"), F.lit("MEDIUM").alias("sensitivity"))
