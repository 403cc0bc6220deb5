"""Personal data: patterned values, and the terms beside them that the corpus shows to reveal them.

The second part is information-theoretic sanitisation. A value found by pattern is a protected
entity c with the information IC(c) = ln(N / n(c)) over N documents. A term t beside it gives
PMI(c; t) = ln(N n(c, t) / (n(c) n(t))) of that away. Where this is a share of IC(c) or more the
term goes: it becomes the name of its class if the class itself stays under the threshold, else
it is removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import written
from quillspan.llm.ordered import NULL_KEY

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of a value that may reveal it, and the share of its information that a term may not give away.
WINDOW, SHARE = 5, 0.8
#: Candidate terms that are sent to the workers, so that only they are counted; beyond it every word is counted and joined.
SENT_TERMS = 100_000
#: Different terms that a worker counts at a time.
COUNTED_AT_ONCE = 500_000
#: Classes that a term may be generalised to.
CLASSES = ("<NUMBER>", "<NAME>", "<WORD>")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails at its other digits too, so each is tried once.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\w+")

_SCANNED = "doc_id long, tid string, base array<struct<kind:string,start:int,end:int>>, near array<struct<c:string,term:string,class:string,start:int,end:int>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards, so that a long run of letters costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterned values, by kind as listed and then start."""
    out = [("email", *s) for s in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if 13 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """One name for all spellings of a value."""
    if kind in ("card", "phone"):
        value = "".join(_DIGIT.findall(value))
    return f"{kind}:{value.lower()}"


def class_of(word: str) -> str:
    return "<NUMBER>" if word.isdigit() else "<NAME>" if word[0].isupper() else "<WORD>"


def beside(text: str, base: list[tuple[str, int, int]], window: int) -> list[tuple[str, str, str, int, int]]:
    """(entity, term, class, start, end): the words around each value, of which none is part of a value."""
    places = [m.span() for m in _WORD.finditer(text)]
    if not places or not base:
        return []
    covered = sorted((s, e) for _, s, e in base)
    first = np.array([s for s, _ in covered])
    reach = np.maximum.accumulate([e for _, e in covered])
    start, end = np.array(places).T
    at = np.searchsorted(first, end, "left") - 1
    free = (at < 0) | (reach[np.maximum(at, 0)] <= start)
    words = list(zip(start[free].tolist(), end[free].tolist(), strict=True))
    starts, ends, out = [s for s, _ in words], [e for _, e in words], set()
    for kind, s, e in base:
        behind, ahead = bisect_left(ends, s + 1), bisect_left(starts, e)
        for a, b in words[max(0, behind - window) : behind] + words[ahead : ahead + window]:
            if b - a > 1:
                out.add((entity(kind, text[s:e]), text[a:b].lower(), class_of(text[a:b]), a, b))
    return sorted(out)


def _key() -> Column:
    """doc_id as a number that a null one has too, for joins."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scanned(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tid, base, near) of every row: a digest of the text, its values, and the words around them."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            base = [base_spans(t or "") for t in x["text"]]
            near = [beside(t, b, window) if b else [] for t, b in zip(x["text"], base, strict=True)]
            named = lambda rows, names: [[dict(zip(names, r, strict=True)) for r in row] for row in rows]
            yield x[["doc_id", "tid"]].assign(base=named(base, ("kind", "start", "end")), near=named(near, ("c", "term", "class", "start", "end")))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest(F.col("text")).alias("tid"))
    return written(rows.mapInPandas(scan, _SCANNED), "scanned")


def document_counts(docs: DataFrame, terms: set[str] | None) -> DataFrame:
    """(term, n): in how many rows of ``docs`` each of the terms and classes occurs; every word if ``terms`` is None."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for x in batches:
            for text in x["text"]:
                words = set(_WORD.findall(text or ""))
                found = {w.lower() for w in words}
                seen.update(found if terms is None else found & terms)
                seen.update(c for c in CLASSES if any(class_of(w) == c for w in words))
            if len(seen) > COUNTED_AT_ONCE:
                yield pd.DataFrame(list(seen.items()), columns=["term", "n"])
                seen.clear()
        if seen:
            yield pd.DataFrame(list(seen.items()), columns=["term", "n"])

    return docs.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(c, term) of the terms that give an entity away, and (c, class) of the classes that do.

    Probabilities are shares of all rows. A term counts only with evidence from two different
    texts, as every rare word of a single text goes along with all of its values.
    """
    held = rows.where(F.size("base") > 0)
    named = lambda what: F.transform("near", lambda x: F.struct(x["c"].alias("c"), x[what].alias("term")))
    both = held.select("tid", F.explode(F.array_distinct(F.concat(named("term"), named("class")))).alias("x")).select("tid", "x.c", "x.term")
    pairs = both.groupBy("c", "term").agg(F.count("*").alias("n_both"), (F.min("tid") != F.max("tid")).alias("several"))
    pairs = written(pairs.where("several").drop("several"), "pairs")
    terms = pairs.select("term").distinct()
    sent = {r["term"] for r in terms.limit(SENT_TERMS + 1).collect()}
    counts = document_counts(docs, sent if len(sent) <= SENT_TERMS else None)
    entities = held.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["c"]))).alias("c")).groupBy("c").agg(F.count("*").alias("n_c"))
    total = F.lit(float(max(1, rows.count())))
    told = F.log(total * F.col("n_both") / (F.col("n_c") * F.col("n")))
    information = F.log(total / F.col("n_c"))
    judged = pairs.join(entities, "c").join(counts, "term").where((information > 0) & (told >= share * information))
    out = written(judged.select("c", "term"), "disclosing")
    is_class = F.col("term").isin(*CLASSES)
    return out.where(~is_class), out.where(is_class).withColumnRenamed("term", "class")


def find_personal(docs: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, tid, base, spans) of every row of ``docs`` (doc_id, text); other columns are left out.

    ``base`` holds the patterned values as (kind, start, end) in code points, by kind and start.
    ``spans`` has them and then the terms that reveal one of the values they stand beside, as
    (kind, start, end, to): kind is ``term``, ``to`` what it is replaced by, its class or nothing.
    A null text is empty and has no spans, ``tid`` is a SHA-256 of the text. Repeated rows have
    the same spans, count as documents of their own and are no evidence for each other. An empty
    table gives no rows. Texts are judged one by one; only the words around values are shuffled.
    """
    rows = scanned(docs, window)
    terms, classes = disclosing(docs, rows, share)
    where = ["_doc", "tid"]
    near = rows.where(F.size("near") > 0).select(_key().alias("_doc"), "tid", F.explode("near").alias("x")).select(*where, "x.*")
    hits = near.join(terms, ["c", "term"]).join(classes.withColumn("told", F.lit(True)), ["c", "class"], "left")
    each = hits.groupBy(*where, "start", "end", "class").agg(F.max(F.coalesce("told", F.lit(False))).alias("told"))
    found = F.struct(F.lit("term").alias("kind"), "start", "end", F.when(F.col("told"), "").otherwise(F.col("class")).alias("to"))
    extra = each.groupBy(*where).agg(F.sort_array(F.collect_list(found)).alias("terms"))
    known = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("to")))
    some = rows.where(F.size("near") > 0).withColumn("_doc", _key()).join(extra, where, "left")
    some = some.select("doc_id", "tid", "base", F.when(F.col("terms").isNull(), known).otherwise(F.concat(known, "terms")).alias("spans"))
    return some.unionByName(rows.where(F.size("near") == 0).select("doc_id", "tid", "base", known.alias("spans")))


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """A text with its spans replaced, the earliest first; one that overlaps an earlier one only lengthens it."""
    out, at = [], 0
    for start, end, to in sorted(spans):
        if start >= at:
            out += [text[at:start], to]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``docs`` with every value and revealing term of the texts replaced; other columns and null texts stay as they are.

    Only rows with a span are joined with their texts again; repeated rows stay as many as they are.
    """
    found = find_personal(docs, window, share).where(F.size("spans") > 0)
    found = found.select(_key().alias("_doc"), F.col("tid").alias("_tid"), F.col("spans").alias("_spans")).dropDuplicates(["_doc", "_tid"])

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else replaced(t, [(x["start"], x["end"], x["to"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)

    keyed = docs.withColumns({"_doc": _key(), "_tid": _digest(F.col("text"))})
    some = keyed.join(found, ["_doc", "_tid"])
    rest = keyed.join(found.select("_doc", "_tid"), ["_doc", "_tid"], "left_anti")
    text = rewrite("text", "_spans").alias("text")
    return some.select(*[text if c == "text" else c for c in docs.columns]).unionByName(rest.select(*docs.columns))
