"""Known answers and properties of single operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspan.functions import ids, text, vector
from quillspan.operators import gate, merge, queue, serving, tree, versions


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "check,value,want",
    [
        ("ssn_valid", "536-90-4399", True), ("ssn_valid", "234-56-7890", True), ("ssn_valid", "000-12-3456", False), ("ssn_valid", "078-05-1120", False),
        ("itin_valid", "911-70-1234", True), ("sin_valid", "130692544", True), ("sin_valid", "193-456-787", True), ("sin_valid", "046454286", False),
        ("bn_valid", "100000009RT0001", True), ("bn_valid", "123456789", False),
        ("curp_valid", "BOXW310820HNERMN07", True), ("curp_valid", "BOXW310820XNERMN01", True), ("curp_valid", "SABC560626MDFLRN01", True), ("curp_valid", "PERJ820123HDFXXX08", False), ("curp_valid", "VECA871012HMNAGS00", False),
        ("rfc_structure", "GODE561231GR8", True), ("rfc_structure", "VECA871012X29", True), ("rfc_check", "VACE860307JN1", True), ("rfc_check", "VACE860307JNA", False),
    ],
)
def test_identifiers(spark, check, value, want):
    assert values(spark, [(value,)], "v string", getattr(ids, check)(F.col("v"))) == [(want,)]


def test_birth_date_and_machine_readable_digits(spark):
    assert values(spark, [("BOXW310820HNERMN07",)], "v string", ids.curp_birth(F.col("v"))) == [(datetime.date(1931, 8, 20),)]
    # The published example's number, date of birth, expiry and personal number.
    rows = [("L898902C3", 6), ("740812", 2), ("120415", 9), ("ZE184226B<<<<<", 1)]
    assert [g == w for g, w in values(spark, rows, "v string, d int", ids.mrz_check(F.col("v")), "d")] == [True] * 4


def test_text_functions(spark):
    rows = [(None,), ("",), ("abcd",), ("X1234567",)]
    assert [r[0] for r in values(spark, rows, "v string", text.redact(F.col("v")))] == [None, "", "[REDACTED]", "••••4567"]
    assert [r[0] for r in values(spark, [(" A--b  C_",), ("***",)], "v string", text.path_label(F.col("v")))] == ["a_b_c", "x"]
    assert [r[0] for r in values(spark, [("José  PÉREZ ",), ("jose perez",)], "v string", text.identity_form(F.col("v")))] == ["jose perez"] * 2
    import hashlib
    import hmac

    assert values(spark, [("value",)], "v string", text.keyed_fingerprint(F.col("v"), b"key")) == [(hmac.new(b"key", b"value", hashlib.sha256).hexdigest()[:16],)]
    assert values(spark, [("AB", "../a b.pdf")], "s string, n string", text.blob_key(F.col("s"), F.col("n"))) == [("ab/a_b.pdf",)]


def test_stub_vector(spark):
    import hashlib

    want = [b / 127.5 - 1 for b in hashlib.sha256(b"t").digest()]
    got = values(spark, [("t",)], "v string", vector.stub_vector(F.col("v"), 40))[0][0]
    assert got == pytest.approx((want * 2)[:40])


def test_gate_samples(spark):
    docs = spark.createDataFrame(
        [(1, "SOCIAL SECURITY ADMINISTRATION\n536-90-4399"), (2, "INSTITUTO NACIONAL ELECTORAL CREDENCIAL PARA VOTAR CLAVE DE ELECTOR"), (3, "nothing here"), (4, None)],
        "doc_id int, text string",
    )
    got = {r.doc_id: r for r in gate.run_gate(docs).collect()}
    assert (got[1].doc_type, got[1].sensitivity, got[1].decision) == ("US_SSN_CARD", "CRITICAL", "DETERMINISTIC_ONLY")
    assert (got[2].doc_type, got[2].doc_confidence, got[2].decision) == ("MX_INE", 0.875, "SEND_TO_LLM")
    assert (got[3].doc_type, got[3].lang, got[3].lang_confidence) == ("UNKNOWN", "en", 0.5)
    assert got[4].doc_type == "UNKNOWN"


def test_finding_spans_keep_the_first_of_overlapping_ones(spark):
    got = values(spark, [("a 536-90-4399 b 536-90-4399 x@y.org",)], "t string", gate.finding_spans(F.col("t")))[0][0]
    assert [(s.kind, s.start, s.end) for s in got] == [("US_SSN", 2, 13), ("US_SSN", 16, 27), ("EMAIL_ADDRESS", 28, 35)]


FACT = "client_id long, fact_id long, attribute_key string, value_text string, value_date date, value_num double, confidence double, verification_status string"


def test_merge_cases(spark):
    rows = [
        (1, 1, "identity.full_name", "John  SMITH", None, None, 0.5, None), (1, 2, "identity.full_name", "john smith", None, None, 0.9, None),
        (1, 3, "identity.date_of_birth", None, datetime.date(1990, 1, 1), None, 0.4, None), (1, 4, "identity.date_of_birth", None, datetime.date(1991, 2, 2), None, 0.95, None),
        (1, 5, "ownership.director", "José Pérez", None, None, 0.9, None), (1, 6, "ownership.director", "jose perez", None, None, 0.8, None), (1, 7, "ownership.director", "Ana", None, None, 0.7, None), (1, 8, "ownership.director", " ", None, None, 0.7, None),
    ]
    got = {(r.attribute_key, r.resolved_value): r for r in merge.merge_facts(spark.createDataFrame(rows, FACT)).collect()}
    assert len(got) == 4
    assert not got["identity.full_name", "john smith"].conflict
    born = got["identity.date_of_birth", None]
    assert born.conflict and born.value_date == datetime.date(1991, 2, 2)
    assert got["ownership.director", "José Pérez"].n_sources == 2 and not got["ownership.director", "José Pérez"].conflict


def test_merge_does_not_depend_on_partitions(spark):
    rows = [(i % 3, i, "account.number", f"n{i % 5}", None, float(i % 2), 0.5, None) for i in range(60)]
    facts = spark.createDataFrame(rows, FACT)
    one, many = (sorted(map(str, merge.merge_facts(facts.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_masked_views_hide_identifiers(spark):
    rows = [(1, 1, "id.ssn", "536-90-4399", None, None, 0.9, "checksum_verified"), (1, 2, "doc.issue_date", "2020", None, None, 0.9, None)]
    got = {r.attribute_key: r for r in serving.fact_view(merge.merge_facts(spark.createDataFrame(rows, FACT))).collect()}
    assert got["id.ssn"].resolved_value == "•••••••4399" and got["id.ssn"].masked and got["id.ssn"].verified
    assert got["doc.issue_date"].resolved_value == "2020" and not got["doc.issue_date"].masked


def test_chunks(spark):
    body = "\n\n".join(["word " * 300] * 3)
    rows = [("",), ("short",), (body,), ("w" * 40 + " " + "x " * 3000,)]
    got = [r[0] for r in values(spark, rows, "t string", tree.chunks(F.col("t"), 512, 64))]
    assert got[0] == [] and got[1] == ["short"]
    assert all(len(c) <= 512 * 4 + 2 for c in got[2] + got[3]) and len(got[2]) == 3 and len(got[3]) > 2
    with pytest.raises(ValueError):
        tree.chunks(F.col("t"), 0)


def test_version_decisions(spark):
    rows = [("a", None, None, True), ("a", 2, "a", True), ("a", 2, "a", False), ("b", 2, "a", True)]
    got = [r[0] for r in values(spark, rows, "h string, n int, c string, ok boolean", versions.decide(*map(F.col, ("h", "n", "c", "ok"))))]
    assert [tuple(x) for x in got] == [("new", 1, None), ("noop", 2, None), ("resume", 2, None), ("new", 3, 2)]


def test_token_bucket(spark):
    rows = [("k", float(t)) for t in (0, 0, 0, 0, 1, 1)]
    got = queue.token_bucket(spark.createDataFrame(rows, "key string, at double"), rate=1.0, burst=3).collect()
    assert [tuple(r) for r in got] == [("k", 6, 4)]


def test_claims_keep_to_the_cap(spark):
    rows = [(i, 1, "queued", 0) for i in range(10)] + [(i, 2, "running", 0) for i in range(10, 13)] + [(i, 2, "queued", 0) for i in range(13, 20)]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    jobs = spark.createDataFrame(rows, "id long, client_id long, status string, priority int").withColumns({"run_after": at, "created_at": at})
    got = queue.claim(jobs, at, batch=20).collect()
    assert sorted((r.client_id, r.id) for r in got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 13)]


def test_narrow_gate_has_no_shuffle_and_no_python(spark, sf):
    from quillspan.sources.tables import kyc_documents

    plan = gate.run_gate(kyc_documents(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_chunks_add_estimates_and_fold_slivers(spark):
    from quillspan.operators import tree

    def chunked(text, **sizes):
        return spark.createDataFrame([(text,)], "t string").select(tree.chunks(F.col("t"), **sizes).alias("c")).first().c

    estimates = ["a" * 1967, "b" * 84]
    assert chunked("\n\n".join(estimates)) == ["\n\n".join(estimates)]
    full, tiny = "c" * 2040, "d" * 40
    assert chunked(f"{full}\n\n{tiny}") == [full, tiny]
    assert chunked(f"{tiny}\n\n{full}") == [tiny, full]
    middle = "e" * 2000
    assert chunked(f"{middle}\n\n{'f' * 60}\n\n{full}") == [middle, "f" * 60, full]
    words = [f"w{i:04d}" for i in range(400)]
    parts = chunked(" ".join(words), max_tokens=40, overlap_tokens=10)
    assert len(parts) > 2 and all(len(p) <= 160 for p in parts)
    for one, other in zip(parts, parts[1:], strict=False):
        shared = [w for w in other.split() if w in one.split()]
        assert shared and other.split()[: len(shared)] == shared == one.split()[-len(shared) :] and len(" ".join(shared)) <= 40
    assert chunked(" \n\n\t ") == [] and all(len(p) <= 80 for p in chunked(" ".join(words), max_tokens=20, overlap_tokens=999))


def test_findings_hide_each_other_and_are_all_counted(spark, sf):
    import re

    from quillspan.operators import gate
    from quillspan.plans import gate_plans
    from quillspan.sources.tables import kyc_documents

    row = gate.add_findings(spark.createDataFrame([("536-90-4399@x.com",), ("a@b.org 536-90-4399",)], "text string")).select("pii_types").collect()
    assert [r.pii_types for r in row] == [["US_SSN"], ["EMAIL_ADDRESS", "US_SSN"]]
    plain = {k: p for k, p in gate.SWEEP if k not in ("MX_CURP", "MX_RFC")}
    want = {(r.doc_id, k, n) for r in kyc_documents(spark, sf).collect() for k, p in plain.items() if (n := len(re.findall(p, r.text or "", re.ASCII)))}
    got = {(r.doc_id, r.entity_type, r.n) for r in gate_plans.pii_counts(spark, sf).collect()}
    assert {x for x in got if x[1] in plain} == want and any(k == "MX_CURP" for _, k, _ in got)


def test_trees_of_any_depth_nest(spark):
    from quillspan.operators import tree

    chain = [(str(i), str(i - 1) if i else None, ".".join(map(str, range(i + 1))), i) for i in range(7)]
    got = tree.nest(spark.createDataFrame(chain, "id string, parent_id string, path string, seq int")).collect()
    assert sorted(r.level for r in got) == list(range(7))


def test_identity_forms_fold_every_script(spark):
    import unicodedata

    def plain(v):
        bare = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
        return " ".join(bare.casefold().split()) or None

    rows = ["José  PÉREZ", "Straße", "ＡＢＣ　Ltd", "ﬁnal ﬂow", "ΆΛΦΑ Σίσυφος", "Ёлкин Й", "İstanbul ıI", "Łódź", "a b\x1fc", "Kelvin", "", "   ", None, "plain\tASCII\n x"]
    got = [r[0] for r in values(spark, [(r,) for r in rows], "v string", text.identity_form(F.col("v")))]
    assert got == [None if r is None else plain(r) for r in rows]


def test_cursors_come_back(spark):
    at = datetime.datetime(2024, 1, 15, 1, 2, 3, 4)
    made = spark.createDataFrame([(at, "id|7")], "t timestamp_ntz, k string").select(text.cursor(F.col("t"), F.col("k"))).first()[0]
    assert text.read_cursor(made) == (at, "id|7")
    for bad in ("", "%%%", "YWJj", made[:-6] + "!", "bm90IGEgZGF0ZXx4"):
        with pytest.raises(ValueError):
            text.read_cursor(bad)


def test_blank_texts_have_no_identity_and_identities_are_hidden(spark):
    rows = [
        (1, 1, "ownership.director", " ", datetime.date(2020, 1, 1), None, 0.9, None), (1, 2, "ownership.director", "", datetime.date(2020, 1, 1), None, 0.9, None),
        (1, 3, "ownership.director", "Łukasz", None, 1.0, 0.9, None), (1, 4, "ownership.director", "łukasz", None, 2.0, 0.8, None),
    ]
    merged = merge.merge_facts(spark.createDataFrame(rows, FACT))
    got = {r.identity_basis: r for r in merged.collect()}
    assert set(got) == {"2020-01-01", "łukasz"} and got["łukasz"].conflict and got["łukasz"].distinct_values == 2 and got["łukasz"].winning_fact_id == 3
    assert {r.identity_basis for r in serving.fact_view(merged).collect()} == {"***"}
    assert sorted(r.fact_id for r in merge.sources(spark.createDataFrame(rows, FACT)).collect()) == [2, 3, 4]


def test_replacing_a_set_leaves_other_clients(spark):
    rows = [(c, c * 10 + i, "doc.issue_date", f"v{i}", None, None, 0.5 + i / 10, None) for c in (1, 2, 3) for i in (0, 1)]
    facts = spark.createDataFrame(rows, FACT)
    clients = spark.createDataFrame([(1,), (2,), (2,)], "client_id long")
    got = merge.remerge(merge.merge_facts(facts), facts.where("fact_id in (10, 30)"), clients).collect()
    assert sorted((r.client_id, r.resolved_value, r.n_sources) for r in got) == [(1, "v0", 1), (3, "v1", 2)]


def test_token_set_ratio_is_exact():
    from functools import cache

    from quillspan.operators import extract

    def longest(a, b):
        @cache
        def go(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

        return go(0, 0)

    for a, b in [("", ""), ("abc", ""), ("date of birth", "dale of bith 1990"), ("kitten", "sitting"), ("aaaa", "aa")]:
        assert extract.indel(a, b) == len(a) + len(b) - 2 * longest(a, b)
    assert extract.token_set_ratio("Date of Birth", "Birth of Date 1990") == 100 and extract.token_set_ratio("x", " ") == 0
    # No shared word: 2 of 12 letters differ by indel; one shared word: the better of three comparisons.
    assert extract.token_set_ratio("abcdef", "abcdxf") == pytest.approx(100 - 100 * 2 / 12)
    assert extract.token_set_ratio("name ab", "name cd") == pytest.approx(max(100 - 100 * 4 / 14, 100 - 100 * 3 / 11))


def test_anchored_values_equal_loops_over_lines(spark, sf):
    from quillspan.operators import extract
    from quillspan.plans import service_plans

    seen = {}

    def spy(lines, labels, threshold):
        seen.update(lines=lines, labels=labels, threshold=threshold)
        return real(lines, labels, threshold)

    real, extract.anchor_extract = extract.anchor_extract, spy
    try:
        got = sorted(map(tuple, service_plans.anchored_values(spark, sf).collect()))
    finally:
        extract.anchor_extract = real

    def tail(text, label):
        at = text.lower().find(label.lower())
        return "" if at < 0 else text[at + len(label) :].lstrip(" :\t-=–—").strip(" ")

    def likeliest(lines, labels):
        best = None
        for x in lines:
            for label in labels:
                score = extract.token_set_ratio(label, x.text)
                if score >= seen["threshold"] and (best is None or score > best[0]):
                    best = (score, label, x)
        return best

    docs, want = {}, []
    for x in sorted(seen["lines"].collect(), key=lambda x: (x.doc_id, x.line_no)):
        if x.text and x.text.strip():
            docs.setdefault(x.doc_id, []).append(x)
    for doc, lines in docs.items():
        if any(x.x0 is not None for x in lines):
            for label in seen["labels"]:
                if best := likeliest(lines, [label]):
                    a, near = best[2], []
                    for x in lines:
                        if x.line_no != a.line_no and x.page == a.page:
                            if x.x0 >= a.x1 and min(x.y1, a.y1) > max(x.y0, a.y0):
                                near.append((0, x.x0 - a.x1, x.line_no, x.text))
                            elif x.y0 >= a.y1 and min(x.x1, a.x1) > max(x.x0, a.x0):
                                near.append((1, x.y0 - a.y1, x.line_no, x.text))
                    if value := min(near)[3] if near else tail(a.text, label):
                        want.append((doc, label, value))
        else:
            tails = [(doc, label, next((t for x in lines if (t := tail(x.text, label))), None)) for label in seen["labels"]]
            found = [t for t in tails if t[2]]
            if not found and (best := likeliest(lines, seen["labels"])):
                found = [(doc, best[1], best[2].text)]
            want += found
    assert got == sorted(want) and len(want) > 20


def test_findings_stand_where_their_patterns_match(spark, sf):
    import re

    from quillspan.functions import ids
    from quillspan.operators import gate
    from quillspan.sources.tables import kyc_documents

    texts = ["ref X536-90-4399 then 536-90-4399", "000-12-3456 046-454-286 046-454-287 07-1234567 12-1234567", "clave de elector ABCDEF12345678H123", "ABCDEF12345678H123", "call +1 555-123-4567 or (555) 123-4567", "é 😀 a@b.org,a@b.org", "536-90-4399@x.com", "", None]
    rows = [(-1 - i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in kyc_documents(spark, sf).select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    candidates = {(k, m.group(1)) for k, p in gate.SWEEP for _, t in rows for m in re.finditer(p, t or "", re.ASCII)}
    frame = spark.createDataFrame(sorted(candidates), "kind string, value string")
    checks = {"MX_CURP": ids.curp_valid, "MX_RFC": ids.rfc_structure, "US_SSN": ids.ssn_valid, "CA_SIN": ids.sin_valid, "US_EIN": ids.ein_valid}
    holds = {(k, r.value): r.ok for k, check in checks.items() for r in frame.where(F.col("kind") == k).select("value", check(F.col("value")).alias("ok")).collect()}
    want = {}
    for k, text in rows:
        kept = []
        for kind, pattern in gate.SWEEP:
            for m in re.finditer(pattern, text or "", re.ASCII):
                ok = holds.get((kind, m.group(1)), True)
                if kind == "MX_INE_CLAVE_ELECTOR":
                    ok = any(c in text[max(0, m.start(1) - 60) : m.start(1)].lower() for c in gate.ELECTORAL_CONTEXT)
                if (ok or kind not in ("MX_CURP", "MX_RFC")) and not any(m.start(1) < e and m.end(1) > s for _, s, e, _, _ in kept):
                    kept.append((kind, m.start(1), m.end(1), m.group(1), gate.SCORES[kind][0 if ok else 1]))
        want[k] = sorted(kept, key=lambda x: x[1])
    got = {r.doc_id: [tuple(x)[:5] for x in r.s] for r in docs.select("doc_id", gate.finding_spans(F.col("text")).alias("s")).collect()}
    assert got == want and [x[1:3] for x in got[-1]] == [(22, 33)] and sum(map(len, want.values())) > 50


def test_language_is_found_once(spark, sf):
    from quillspan.plans import gate_plans

    plan = gate_plans.anchor_scores(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-zA-Z") == 1


def test_nested_attributes_are_unwrapped(spark):
    from quillspan.operators import extract

    replies = ['{"attributes": {"a": "x", "b": [1,2]}, "confidence": 0.5}', '{"a": "y", "confidence": 1}', 'text {"attributes": "none", "c": {"d": 1}}', '{"attributes": {}}', "no", None]
    got = {(r.id, r.key): r.value for r in extract.attributes(spark.createDataFrame(list(enumerate(replies)), "id int, reply string")).collect()}
    assert got == {(0, "a"): "x", (0, "b"): "[1,2]", (1, "a"): "y", (2, "attributes"): "none", (2, "c"): '{"d":1}'}
