"""Suffix-array dedup: bytes covered by long strings that start more than once in the corpus.

A suffix array over all suffixes would hold many times the input, so suffixes enter it in three
steps, each exact:

* Content picks anchors: the window of starts s .. s+W-1 has its anchor at the least hash of 16
  bytes, so equal strings of LENGTH bytes have the same anchor at the same distance. Starts with
  one anchor form a run, and its context holds all their strings. An anchor whose next bytes are
  unique ends here, and so does one whose contexts are all equal: every start in it repeats.
* Starts of the other contexts (one context of each kind) become suffix records of their leading
  eight bytes and a key of the whole LENGTH bytes: two hashes of 64 bits, built of the hashes of
  halves by a mixer that is not linear. Contexts are told apart by 128 bits as well, of which 64
  are those of the bytes that follow the anchor, so equality is never judged by 64 bits alone.
  Splitters sampled from the records
  range-partition them by leading bytes, then key, so equal suffixes meet in one bucket however
  many begin alike, and no bucket holds an unbounded group.
* A bucket sorts its records and compares neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import forget, mix, partitions, word_hashes, written
from quillspan.llm.ordered import NULL_KEY

#: Texts whose ids may be broadcast to keep the others from being shuffled; beyond it all are shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes whose anchors are found at a time, and records that the splitters are taken from.
BLOCK, SAMPLED = 4 << 20, 40_000
#: Runs of repeated starts that a bucket hands on in one row.
RUNS_IN_ROW = 8192
#: Records that a task deals out at a time.
RECORDS_AT_ONCE = 400_000
_GRAM_1, _GRAM_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def _joined_hashes(left: np.ndarray, right: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Hashes of two strings made those of the strings in a row; both are mixed already, so that no structure of texts collides."""
    return mix(left * _GRAM_1 + right * seed)


class Scheme:
    """Sizes for strings of ``length`` units (bytes, or the eights of bytes that words become): starts per window (a power of two) and units sure to follow an anchor."""

    def __init__(self, length: int, width: int = 1):
        if not 32 <= length <= 4096:
            raise ValueError("length must be 32 to 4096 units")
        self.length, self.width = length, width
        self.window = 1 << (2 * length // 3).bit_length() - 1
        self.core = length - self.window + 1
        # Bytes whose hash chooses an anchor.
        self.gram = 16 if width == 1 else 2

    def raw(self, text: str | bytes | None) -> bytes:
        """What is searched: a text's bytes, or the 64 bits of each of its words."""
        return _raw(text) if self.width == 1 else word_hashes(_raw(text)).tobytes()

    def units(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=np.uint8 if self.width == 1 else "<u8")

    def cut(self, raw: bytes, start: int, end: int) -> bytes:
        return raw[start * self.width : end * self.width]

    def anchors(self, raw: bytes) -> np.ndarray:
        """(anchor, first start, last start) of every run of starts that share an anchor."""
        found = []
        n = len(raw) // self.width
        last = n - self.length
        for at in range(0, last + 1, BLOCK):
            part = self.cut(raw, at, min(n, at + BLOCK + self.length - 1))
            size = len(part) // self.width
            words = np.ndarray((size - 7,), dtype="<u8", buffer=part, strides=(1,)) if self.width == 1 else self.units(part)
            half = self.gram // 2
            h = mix(words[:-half] * _GRAM_1 + words[half:] * _GRAM_2)
            least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            reach = 1
            while reach < self.window:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            own = (least[: size - self.length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            cut = np.flatnonzero(np.diff(own)) + 1
            first, end = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(own) - 1]))
            found.append(np.stack([own[first], first, end], axis=1) + at)
        return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)

    def suffixes(self, raw: bytes, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leading units in their order, two halves of the whole string's key) of the starts first .. last.

        A key is made of those of its string's parts, whose lengths are powers of two. Bytes are taken eight at
        a time, and what is left of ``length`` behind the last eight is told by the string's last eight bytes.
        """
        n, part = last - first + 1, self.cut(raw, first, last + self.length)
        if self.width == 1:
            least, base = 8, np.ndarray((len(part) - 7,), dtype="<u8", buffer=part, strides=(1,))
        else:
            least, base = 1, self.units(part)
        keys = []
        for seed in _SEEDS:
            size, now, out, used = least, mix((base + np.uint64(1)) * seed), None, 0
            tail = now[self.length - least :][:n]
            while size <= self.length:
                if self.length & size:
                    piece = now[used : used + n]
                    out = piece if out is None else _joined_hashes(out, piece, seed)
                    used += size
                if 2 * size <= self.length:
                    now = _joined_hashes(now[:-size], now[size:], seed)
                size *= 2
            keys.append(out if used == self.length else _joined_hashes(out, tail, seed))
        lead = base[:n].byteswap() if self.width == 1 else base[:n]
        return lead, *keys

    def records(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(context number, distance from its anchor, leading units, key's halves) of all starts of a text's contexts.

        Contexts whose strings overlap are hashed as one stretch of the text, so that no unit is hashed for each of them.
        """
        p, low, high = at >> 24, at >> 12 & 4095, at & 4095
        number = np.argsort(p - low, kind="stable")
        first, last = (p - low)[number], (p - high)[number]
        reach = np.maximum.accumulate(last)
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] >= reach[:-1] + self.length) | (first[1:] // BLOCK != first[:-1] // BLOCK)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(first))
        many = last - first + 1
        # Where each start's place in its context is counted from.
        before = np.cumsum(many) - many
        starts = np.repeat(first - before, many) + np.arange(many.sum())
        parts = []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            own = starts[before[a] : before[b - 1] + many[b - 1]] - first[a]
            parts.append([c[own] for c in self.suffixes(raw, int(first[a]), int(last[a:b].max()))])
        distance = np.repeat(p[number], many) - starts
        return np.repeat(number, many).astype(np.int32), distance.astype(np.int16), *(np.concatenate(c) for c in zip(*parts, strict=True))


def _raw(text: str | bytes | None) -> bytes:
    return bytes(text) if isinstance(text, (bytes, bytearray)) else (text or "").encode()


def _i64(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _digest(raw: bytes) -> int:
    return _i64(xxhash.xxh3_64_intdigest(raw))


def _anchor_rows(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc, tid, f, c, ats): digests of what follows an anchor and of its context; each of ats packs an anchor and its run.

    Anchors of one text with equal contexts, as in a text that repeats itself, are one row.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for k, text in zip(x["k"].tolist(), x["text"].tolist(), strict=True):
                raw = scheme.raw(text)
                if len(raw) < scheme.length * scheme.width:
                    continue
                tid, kinds = _digest(raw), {}
                for p, a, b in scheme.anchors(raw).tolist():
                    kinds.setdefault((_digest(scheme.cut(raw, p, p + scheme.core)), _digest(scheme.cut(raw, a, b + scheme.length))), []).append(p << 24 | p - a << 12 | p - b)
                out.extend((k, tid, f, c, ats) for (f, c), ats in kinds.items())
            if out:
                yield pd.DataFrame(out, columns=["doc", "tid", "f", "c", "ats"])

    return docs.select(_key(), "text").mapInPandas(rows, "doc long, tid long, f long, c long, ats array<long>")


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k")


def _texts_of(docs: DataFrame, ids: DataFrame, kept: bool = True, also: list[str] | None = None) -> DataFrame:
    """Documents whose key is in ``ids`` (or is not); the ids are broadcast only while they are few."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select(_key(), "text", *(also or [])).join(few.select(F.col("doc").alias("k")), "k", "left_semi" if kept else "left_anti")


def _joined(runs):
    """Runs (low, high) of one context with those that touch made one; a context has at most a window of starts."""
    none = F.array().cast("array<struct<low:int,high:int>>")

    def add(acc, run):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["low"].alias("low"), F.greatest(last["high"], run["high"]).alias("high"))
        touches = (F.size(acc) > 0) & (run["low"] <= last["high"] + 1)
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(run)))

    return F.aggregate(F.array_sort(runs), none, add)


def _repeated_starts(docs: DataFrame, mixed: DataFrame, scheme: Scheme) -> DataFrame:
    """(f, c, runs): for contexts that repeat in part, the distances from the anchor (from, to) of repeated starts."""
    spark = docs.sparkSession
    n = partitions(spark)
    kinds = mixed.groupBy("f", "c").agg(F.sum(F.size("ats")).alias("n"), F.min(F.struct("doc", "tid", F.get("ats", F.lit(0)).alias("at"))).alias("rep"))
    kinds = written(kinds.select("f", "c", "n", "rep.*"), "contexts")
    lists = kinds.groupBy("doc", "tid").agg(F.array_sort(F.collect_list(F.struct("at", "f", "c", "n"))).alias("contexts"))
    lists = written(lists.select("doc", "tid", *[F.col(f"contexts.{c}").alias(c) for c in ("at", "f", "c", "n")]), "context-lists")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for x in batches:
            raw = [scheme.raw(t) for t in x["text"]]
            yield pd.DataFrame({"doc": x["k"], "tid": [_digest(r) for r in raw], "z": [pack.compress(r) for r in raw]})

    few = _texts_of(docs, lists.select("doc").distinct()).mapInPandas(packed, "doc long, tid long, z binary")
    texts = written(lists.select("doc", "tid", "at").join(few, ["doc", "tid"]).dropDuplicates(["doc", "tid"]), "context-texts")

    rows = texts.count()
    every = max(1, rows // 400)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for x in batches:
            for z, at in zip(x["z"], x["at"], strict=True):
                _, _, lead, key, _ = scheme.records(unpack.decompress(z), np.asarray(at))
                step = max(1, len(key) // (SAMPLED // 400))
                yield pd.DataFrame({"lead": lead[::step].view(np.int64), "key": key[::step].view(np.int64)})

    drawn = texts.where(F.pmod(F.xxhash64("doc", "tid"), F.lit(every)) == 0).select("z", "at").limit(1000).mapInPandas(sample, "lead long, key long").toPandas()
    lead, key = drawn["lead"].to_numpy(np.int64).view(np.uint64), drawn["key"].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort((key, lead))
    buckets = 4 * n
    at = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) else order
    split_lead, split_key = lead[at], key[at]

    def bucket_of(lead: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The number of splitters at or below a record, by leading bytes and then key."""
        out = np.searchsorted(split_lead, lead, "right")
        if len(split_lead):
            tied = np.flatnonzero(split_lead[np.maximum(out, 1) - 1] == lead)
            for top in np.unique(out[tied]).tolist():
                some = tied[out[tied] == top]
                low = np.searchsorted(split_lead, split_lead[top - 1], "left")
                out[some] = low + np.searchsorted(split_key[low:top], key[some], "right")
        # Numbers of 16 bits are sorted by radix.
        return out.astype(np.uint16) if buckets <= 1 << 16 else out

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        docs, got, waiting = [], [], 0

        def out() -> pd.DataFrame:
            size = np.array([len(g[0]) for g in got])
            number, distance, lead, key, second = (np.concatenate(c) for c in zip(*got, strict=True))
            doc, tid = np.array(docs, dtype=np.int64).T
            row = np.repeat(np.arange(len(got)), size)
            bucket = bucket_of(lead, key)
            order = np.argsort(bucket, kind="stable")
            cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order].astype(np.int64))) + 1, [len(order)]))
            rows = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                o = order[a:b]
                own = row[o]
                begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                r, times = own[begin], np.diff(np.append(begin, len(own)))
                rows.append((int(bucket[o[0]]), doc[r], tid[r], times.astype(np.int32), number[o], distance[o], key[o].view(np.int64), second[o].view(np.int64)))
            return pd.DataFrame(rows, columns=["bucket", "doc", "tid", "times", "number", "distance", "key", "second"])

        for x in batches:
            for k, t, z, at in zip(x["doc"].tolist(), x["tid"].tolist(), x["z"], x["at"], strict=True):
                docs.append((k, t))
                got.append(scheme.records(unpack.decompress(z), np.asarray(at)))
                waiting += len(got[-1][0])
                if waiting > RECORDS_AT_ONCE:
                    yield out()
                    docs, got, waiting = [], [], 0
        if got:
            yield out()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def finish() -> pd.DataFrame:
            key, second = (np.concatenate([h[i] for h in held]) for i in (5, 6))
            order = np.argsort(key)
            same = np.diff(key[order]) == 0
            if (np.diff(second[order])[same] != 0).any():
                order = np.lexsort((second, key))
                same = (np.diff(key[order]) == 0) & (np.diff(second[order]) == 0)
            again = np.zeros(len(key), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            times = np.concatenate([h[2] for h in held])
            doc, tid = (np.repeat(np.concatenate([h[i] for h in held]), times)[again] for i in (0, 1))
            number, distance = (np.concatenate([h[i] for h in held])[again] for i in (3, 4))
            # Neighbours in one context become runs; runs of other buckets join theirs later.
            order = np.lexsort((distance, number, tid, doc))
            doc, tid, number, distance = (c[order] for c in (doc, tid, number, distance.astype(np.int32)))
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (np.diff(distance) != 1) | (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]) | (number[1:] != number[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc))[: len(first)] - 1
            runs = (doc[first], tid[first], number[first], distance[first], distance[last])
            cuts = range(0, len(first), RUNS_IN_ROW)
            return pd.DataFrame([[c[i : i + RUNS_IN_ROW] for c in runs] for i in cuts], columns=["doc", "tid", "number", "low", "high"])

        for x in batches:
            for r in zip(x["bucket"].tolist(), x["doc"], x["tid"], x["times"], x["number"], x["distance"], x["key"], x["second"], strict=True):
                if r[0] != now:
                    if held:
                        yield finish()
                    now, held = r[0], []
                held.append([np.asarray(c) for c in r[1:]])
        if held:
            yield finish()

    dealt = texts.select("doc", "tid", "at", "z").mapInPandas(deal, "bucket int, doc array<long>, tid array<long>, times array<int>, number array<int>, distance array<short>, key array<long>, second array<long>")
    sorted_buckets = dealt.repartition(n, "bucket").sortWithinPartitions("bucket")
    found = sorted_buckets.mapInPandas(compare, "doc array<long>, tid array<long>, number array<int>, low array<int>, high array<int>")
    runs = found.select(F.explode(F.arrays_zip("doc", "tid", "number", "low", "high")).alias("r")).select("r.*")
    named = lists.select("doc", "tid", F.posexplode(F.arrays_zip("f", "c", "n")).alias("number", "x")).select("doc", "tid", "number", "x.f", "x.c", "x.n")
    partly = runs.groupBy("doc", "tid", "number").agg(_joined(F.collect_list(F.struct("low", "high"))).alias("runs"))
    out = written(named.join(partly, ["doc", "tid", "number"], "left").where("n > 1 or runs is not null").select("f", "c", F.when(F.col("n") == 1, F.col("runs")).alias("runs")), "repeated-starts")
    forget(spark, texts, lists, kinds)
    return out


def repeated_spans(docs: DataFrame, length: int = 400, width: int = 1) -> DataFrame:
    """(doc, tid, starts, ends): sorted ranges of repeated starts' strings, by document key and text digest.

    Units are bytes; with a ``width`` of 8 they are words, which each task makes into eights of bytes where it reads a text.
    """
    spark = docs.sparkSession
    scheme = Scheme(length, width)
    anchors = written(_anchor_rows(docs, scheme), "anchors")
    seen = anchors.groupBy("f").agg(F.sum(F.size("ats")).alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1").select("f", (F.col("c1") != F.col("c2")).alias("mixed"))
    flagged = written(anchors.join(seen, "f"), "repeated-anchors")
    forget(spark, anchors)
    partly = _repeated_starts(docs, flagged.where("mixed"), scheme)
    anchor = F.shiftright("at", 24)
    whole = F.array(F.struct(F.shiftright("at", 0).bitwiseAND(4095).cast("int").alias("low"), F.shiftright("at", 12).bitwiseAND(4095).cast("int").alias("high")))
    plain = flagged.where("not mixed").select("doc", "tid", F.explode("ats").alias("at")).select("doc", "tid", "at", whole.alias("runs"))
    other = flagged.where("mixed").join(partly, ["f", "c"]).select("doc", "tid", F.explode("ats").alias("at"), "runs").select("doc", "tid", "at", F.coalesce("runs", whole).alias("runs"))
    spans = plain.unionByName(other).select("doc", "tid", anchor.alias("p"), F.explode("runs").alias("r"))
    spans = spans.select("doc", "tid", F.struct((F.col("p") - F.col("r.high")).alias("start"), (F.col("p") - F.col("r.low") + length).alias("end")).alias("s"))
    out = written(spans.groupBy("doc", "tid").agg(F.array_sort(F.collect_set("s")).alias("s")).select("doc", "tid", F.col("s.start").alias("starts"), F.col("s.end").alias("ends")), "spans")
    forget(spark, flagged, partly)
    return out


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by start, with those that touch or overlap made one."""
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def cut_repeats(docs: DataFrame, length: int = 400, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, other columns) of every row of ``docs`` (doc_id, text, ...).

    Texts are bytes in UTF-8, null counts as empty. Every byte covered by a string of ``length``
    bytes that also starts anywhere else, in the same text or another row's, is removed; matches
    never cross texts, and are judged on the input. n_spans counts maximal removed runs, kept
    is what is left: bytes, or with ``as_text`` a string without the characters that were cut in
    two. Texts shorter than ``length`` stay whole. Repeated rows keep their rows and count as
    documents of their own, and so do rows with a null doc_id. Columns with the result's names
    are replaced.
    """
    spans = repeated_spans(docs, length)
    ids = written(spans.select("doc").distinct(), "span-documents")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    carried = [f for f in docs.schema if f.name not in ("text", *names)]
    also = [f.name for f in carried]
    tail = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)
    few, rest = (_texts_of(docs, ids, kept, also) for kept in (True, False))
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}{tail}"
    finish = (lambda raw: raw.decode(errors="ignore")) if as_text else (lambda raw: raw)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for x in batches:
            raw = [_raw(t) for t in x["text"]]
            yield x[["k", *also]].rename(columns={"k": "_doc"}).assign(_tid=[_digest(r) for r in raw], _z=[pack.compress(r) for r in raw])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for x in batches:
            out = []
            for k, z, starts, ends in zip(x["_doc"].tolist(), x["_z"], x["_starts"], x["_ends"], strict=True):
                raw = unpack.decompress(z)
                if starts is None or not len(starts):
                    out.append((k, len(raw), 0, 0, finish(raw)))
                    continue
                start, end = _merged(np.asarray(starts), np.asarray(ends))
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                out.append((k, len(raw), len(raw) - len(kept), len(start), finish(kept)))
            yield pd.DataFrame(out, columns=names).assign(**{c: x[c].to_numpy() for c in also})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            raw = [_raw(t) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["k"].to_numpy(), "n_bytes": [len(r) for r in raw], "n_removed": 0, "n_spans": 0, "kept": [finish(r) for r in raw]}).assign(**{c: x[c].to_numpy() for c in also})

    named = spans.select(F.col("doc").alias("_doc"), F.col("tid").alias("_tid"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
    moved = few.mapInPandas(packed, f"_doc long{tail}, _tid long, _z binary").join(named, ["_doc", "_tid"], "left")
    both = moved.mapInPandas(cut, schema).unionByName(rest.mapInPandas(whole, schema))
    return both.withColumn("doc_id", F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """``docs`` without the words of passages of so many that occur more than once; n_words and n_cut are added.

    Suffixes are those of a text's words, white space apart: a word is 64 bits of it as it is
    written. Every word covered by a string of ``words`` words that also starts anywhere else, in
    the same text or another row's, is removed with the white space up to the next of them; a
    passage is judged whole, never by pieces of it. Null texts stay null; texts of fewer words
    stay whole. Repeated rows count as documents of their own. All rows and other columns stay.
    """

    own = [c for c in docs.columns if c not in ("n_words", "n_cut")]
    keyed = docs.select(*own).withColumn("_doc", _key())
    spans = repeated_spans(docs.select("doc_id", "text"), words, width=8)
    marks = spans.select(F.col("doc").alias("_doc"), F.col("tid").alias("_tid"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
    scheme = Scheme(words, 8)

    @F.pandas_udf("long")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _digest(scheme.raw(t))).astype("int64")

    @F.pandas_udf("text string, n_words long, n_cut long")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for text, first, end in zip(texts, starts, ends, strict=True):
            raw = _raw(text)
            places = [m.span() for m in _WORD.finditer(raw)]
            at, kept, n = 0, [], 0
            for a, b in zip(*_merged(np.asarray(first), np.asarray(end)), strict=True):
                kept.append(raw[at : places[a][0]])
                at, n = places[b - 1][1], n + int(b - a)
            out.append(("".join(x.decode() for x in (*kept, raw[at:])), len(places), n))
        return pd.DataFrame(out, columns=["text", "n_words", "n_cut"])

    # Only texts of keys with a span are handed over to be cut. Both functions are marked as not
    # deterministic, so that no filter on their results computes them once more.
    ids = written(spans.select(F.col("doc").alias("_doc")).distinct(), "passage-documents")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    n_words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    some = keyed.join(few, "_doc", "left_semi").withColumn("_tid", digest.asNondeterministic()(F.coalesce("text", F.lit("")))).join(marks, ["_doc", "_tid"], "left")
    hit = some.where("_starts is not null").withColumn("_cut", cut.asNondeterministic()("text", "_starts", "_ends"))
    hit = hit.select(*["_cut.text" if c == "text" else c for c in own], "_cut.n_words", "_cut.n_cut")
    rest = keyed.join(few, "_doc", "left_anti").select(*own).unionByName(some.where("_starts is null").select(*own))
    return hit.unionByName(rest.select(*own, n_words.alias("n_words"), F.lit(0).cast("long").alias("n_cut")))
