"""Personal data, the filter audit and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspan.llm import filter_audit, importance, personal_data, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_spans(text):
    """The four patterns as they are written."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 13 <= len(digits(m.group())) <= 19 and plain_luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_as_the_patterns_say():
    rng = random.Random(1)
    alphabet = ["a", "B", "7", "0", ".", "@", "-", "+", " ", "(", ")", "_", "%", "é", "1.2.3.4", "x@y.z", "4041894974608795", "256", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert personal_data.base_spans(text) == plain_spans(text), text
    known = "mail Bob.x@a-b.example.org, 10.0.0.255 and 10.0.0.256, 4041 8949-7460 8795, 4041894974608796, +1 (988) 555-2485 or +1 2"
    assert [(k, known[s:e]) for k, s, e in personal_data.base_spans(known)] == [
        ("email", "Bob.x@a-b.example.org"), ("ip", "10.0.0.255"), ("card", "4041 8949-7460 8795"), ("phone", "+1 (988) 555-2485"),
    ]
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1(" * 100_000, "a@" * 100_000, "1 " * 100_000 + "@"):
        personal_data.base_spans(long)


def brute_terms(rows, window, share):
    """For each row the spans of terms and what they become, from counts of all rows held at once."""
    n, texts = len(rows), [t or "" for _, t in rows]
    words, beside = [], []
    for text in texts:
        base = plain_spans(text)
        free = [m for m in re.finditer(r"\w+", text) if not any(m.start() < e and m.end() > s for _, s, e in base)]
        words.append({m.group() for m in re.finditer(r"\w+", text)})
        near = set()
        for kind, s, e in base:
            value = re.sub("[^0-9]", "", text[s:e]) if kind in ("card", "phone") else text[s:e].lower()
            for m in [m for m in free if m.end() <= s][-window:] + [m for m in free if m.start() >= e][:window]:
                if len(m.group()) > 1:
                    near.add((f"{kind}:{value}", m.group(), m.start(), m.end()))
        beside.append(near)
    label = lambda w: "<NUMBER>" if w.isdigit() else "<NAME>" if w[0].isupper() else "<WORD>"
    holds, with_both, evidence, entities = Counter(), Counter(), defaultdict(set), Counter()
    for text, ws, near in zip(texts, words, beside, strict=True):
        holds.update({w.lower() for w in ws} | {label(w) for w in ws})
        entities.update({c for c, *_ in near})
        both = {(c, w.lower()) for c, w, *_ in near} | {(c, label(w)) for c, w, *_ in near}
        with_both.update(both)
        for x in both:
            evidence[x].add(text)

    def tells(c, t):
        k = with_both[c, t]
        information = math.log(n / entities[c])
        return len(evidence[c, t]) > 1 and information > 0 and math.log(n * k / (entities[c] * holds[t])) >= share * information

    for near in beside:
        spans = defaultdict(bool)
        for c, w, s, e in near:
            if tells(c, w.lower()):
                spans[s, e, label(w)] |= tells(c, label(w))
        yield sorted((s, e, "" if told else k) for (s, e, k), told in spans.items())


@pytest.fixture(scope="module")
def people(documents, texts):
    """The awkward rows with people, whose names stand beside their addresses in several texts, and a copied one."""
    rng = random.Random(4)
    filler = [w for w in texts[1].split() + texts[2].split() + texts[4].split() if w]
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    for person in range(6):
        name, value = f"Zork{chr(97 + person) * 3}", [f"u{person}@mail.example.com", f"10.2.3.{person}", "4041894974608795", f"+1 (988) 555-248{person}"][person % 4]
        for i in range(4):
            around = [rng.choice(filler) for _ in range(12)]
            rows.append((1000 + 10 * person + i, f"{' '.join(around[:6])} {name} {value} {' '.join(around[6:])}"))
    rows += [(2000, rows[-1][1]), (2001, "only 7.7.7.7 here once"), (2002, "only 7.7.7.7 here once"), (None, f"Zorkaaa u0@mail.example.com {rng.choice(filler)}"), (2003, "8.8.8.8"), (2004, "x" * 5_000 + " u1@mail.example.com"), (1000, rows[-24][1])]
    return rows


def test_personal_data(spark, people, nothing):
    docs = spark.createDataFrame([(k, t, "old", [1]) for k, t in people], "doc_id long, text string, spans string, base array<int>").repartition(3)
    terms = list(brute_terms(people, personal_data.WINDOW, personal_data.SHARE))
    want = Counter()
    for (k, t), extra in zip(people, terms, strict=True):
        base = plain_spans(t or "")
        want[k, tuple(base), tuple([(*s, f"<{s[0].upper()}>") for s in base] + [("term", *x) for x in extra])] += 1
    got = Counter((r.doc_id, tuple(map(tuple, r.base)), tuple(map(tuple, r.spans))) for r in personal_data.find_personal(docs).collect())
    assert got == want and sum(len(x) for x in terms) > 20
    named = {k: x for (k, _), x in zip(people, terms, strict=True)}
    assert any(to == "<NAME>" for _, _, to in named[1000]) and not named[2001] and not named[2003]
    clean = personal_data.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(people)
    for r in clean.where("doc_id >= 1000 and doc_id < 1060").collect():
        assert "Zork" not in r.text and "@" not in r.text and "<NAME>" in r.text
    assert {r.doc_id: r.text for r in clean.where("doc_id < 40").collect()} == {k: t for k, t in people if k is not None and k < 40}
    assert personal_data.find_personal(nothing).count() == 0 and personal_data.sanitise(nothing).count() == 0


def test_every_word_counted_gives_the_same(spark, people, monkeypatch):
    docs = spark.createDataFrame(people, "doc_id long, text string")
    show = lambda: sorted(str(r) for r in personal_data.find_personal(docs).collect())
    sent = show()
    monkeypatch.setattr(personal_data, "SENT_TERMS", 0)
    monkeypatch.setattr(personal_data, "COUNTED_AT_ONCE", 50)
    assert show() == sent


def test_a_class_that_tells_is_no_generalisation(spark):
    rows = [(i, f"word{i} plain text {chr(97 + i % 26)}{i}q") for i in range(60)] + [(100, "seen Quux 9.9.9.9 there"), (101, "then Quux 9.9.9.9 again")]
    spans = {r.doc_id: [x["to"] for x in r.spans if x["kind"] == "term"] for r in personal_data.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[100] == spans[101] == [""]
    assert personal_data.replaced("seen Quux 9.9.9.9 there", [(10, 17, "<IP>"), (5, 9, ""), (12, 19, "<CARD>")]) == "seen  <IP>here"


def test_digest_of_personal_data(spark, sf):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_personal_data(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain_spans(rows[r.doc_id])
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and r.spans.startswith(shown)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in personal_data.KINDS]


# --- 12


def test_filter_audit(spark, documents, nothing):
    rng = random.Random(3)
    plain = " ".join(f"w{i}" for i in range(120))
    rows = [(r.doc_id, r.text, rng.choice(["en", "de", None])) for r in documents.collect()]
    rows += [(100 + i, rng.choice([plain, "A" * 30, "word " * 200, "a # b", plain + " #", plain.upper()]), rng.choice(["en", "fr"])) for i in range(60)]
    rows += [(100, plain, "en"), (100, plain, "fr"), (None, plain, "en"), (None, None, None)]
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, 160, 2)] + [(102, 1, 0), (102, 0, 1), (None, 1, 1), (5, None, None)]
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))

    def fails(k, t):
        w = (t or "").encode().split()
        out = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w))
        out += "C" * (100 * sum("A" <= c <= "Z" for c in t or "") > 10 * len(t or "")) + "D" * bool(set(t or "") & set("#$%&*|"))
        return set(out + "E" * (k is not None and k > least[t or ""]))

    judged = [(lang or "", fails(k, t), k in good, k in toxic) for k, t, lang in rows]
    want, removed_by = {}, Counter()
    for part in {p for p, *_ in judged}:
        own = [x for x in judged if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_by[part, f] += len(gone)
                want[part, order, step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want and len(got) == len(want)
    assert all(r.shapley == removed_by[r.part, r.filter_order[r.step - 1]] for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_cube_has_totals_over_all_parts(spark):
    flags = spark.createDataFrame([("x", True, False, False, False, False, 3, 1, 0), ("y", False, False, False, False, True, 5, 0, 2)], "part string, a boolean, b boolean, c boolean, d boolean, e boolean, n long, good long, toxic long")
    got = {(r.part, r.passed): (r.n, r.good, r.toxic) for r in filter_audit.survivors(flags).collect()}
    assert got[None, 0] == (8, 1, 2) and got[None, 1] == (5, 0, 2) and got[None, 16] == (3, 1, 0) and (None, 31) not in got
    assert got["x", 16] == (3, 1, 0) and ("x", 1) not in got


# --- 13


@pytest.mark.parametrize("longest,buckets", [(1, 10000), (3, 64)])
def test_importance_resampling(spark, documents, nothing, longest, buckets):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    target = [rows[3][1], rows[4][1], None, "", "Ünï 12'll don't"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    features = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(words(x))) for texts in ([t for _, t in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    want, fit = [], []
    for k, text in rows:
        f = features(words(text))
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        row = (k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        want.append(row)
        if len(words(text)) >= 20:
            fit.append((-row[3], k is not None, k or 0, row[1], row[2]))
    fit.sort()
    drawn = [(k if known else None, -score, i + 1) for i, (score, known, k, *_) in enumerate(fit[: 30 * len(fit) // 100])]
    docs = documents.withColumn("rank", F.lit("x")).withColumn("weight", F.lit(1))
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), longest, buckets, percent=30).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    assert sorted((r.rank, r.doc_id, r.score) for r in got if r["rank"]) == [(i, k, s) for k, s, i in drawn] and len(drawn) > 5
    assert importance.resample(nothing, docs).count() == 0
    assert importance.resample(docs, nothing).where("n_features > 0 and weight is null").count() == 0
