"""N-gram Jaccard join: exact links between shingle sets by skipping on set relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import components, forget, partitions, shingle_set, written

#: Common shingles that the order knows; any order gives the same links, so this bounds only its memory.
ORDERED_COMMON = 200_000
#: Bits of a set's sketch.
SKETCH_BITS = 2048
#: Shingles that one worker counts at a time, and partners of a set that are verified in one group.
COUNTED_AT_ONCE, PARTNERS = 4_000_000, 256
#: Visits of sets, 16 bytes each, that may be broadcast to keep other texts from being shuffled; beyond it both sides are.
BROADCAST_VISITS = 1_000_000


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles over all documents, sorted, with a rank that rises with their number.

    Each task counts the shingles of its different sets and passes on those that it met twice,
    so a shingle in more sets than there are tasks is never missed, and what is shuffled is
    small. The driver gets ORDERED_COMMON of them at most.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, seen = [], 0, set()

        def out() -> pd.DataFrame:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times > 1
            return pd.DataFrame({"g": values[keep].view(np.int64), "n": times[keep].astype(np.int64)})

        for x in batches:
            for text in x["text"]:
                s = shingle_set((text or "").encode(), words)
                digest = xxhash.xxh3_64_intdigest(s.tobytes())
                if len(s) and digest not in seen:
                    seen.add(digest)
                    held.append(s)
                    n += len(s)
            if n > COUNTED_AT_ONCE:
                yield out()
                held, n, seen = [], 0, set()
        if held:
            yield out()

    counted = docs.select("text").mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 3")
    top = counted.orderBy(F.desc("n"), "g").limit(ORDERED_COMMON).toPandas()
    values = top["g"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(values) - np.arange(len(values), dtype=np.int64))[order]


def in_order(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set with the rare shingles first (by hash), then the common ones by rising number."""
    values, ranks = common
    if not len(values) or not len(s):
        return s
    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
    rank = np.where(values[at] == s, ranks[at], 0)
    return s[np.argsort(rank, kind="stable")]


def prefix_length(n: int, percent: int) -> int:
    """How many leading elements of a set of n must include one of any set it links with."""
    return n - -(-percent * n // 100) + 1 if n else 0


def sketch(s: np.ndarray) -> bytes:
    """Of each of SKETCH_BITS classes of elements, whether the set has an odd number."""
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def shingle_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, same, prefix, sketch) of every row: the size of its set, a 128-bit digest of it, its leading shingles."""
    common = common_shingles(docs, words)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for k, text in zip(x["doc_id"].astype(object).tolist(), x["text"].tolist(), strict=True):
                s = shingle_set((text or "").encode(), words)
                lead = in_order(s, common)[: prefix_length(len(s), percent)]
                out.append((None if k is None or k != k else int(k), len(s), xxhash.xxh3_128_digest(s.tobytes()), lead.view(np.int64), sketch(s)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "same", "prefix", "sketch"]).astype({"doc_id": "Int64"})

    return written(docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, n long, same binary, prefix array<long>, sketch binary"), "shingles")


def _lists(classes: DataFrame, *also: str) -> DataFrame:
    """Index entries (g, rep, n, i, before, others): each leading shingle with its place and the one before it."""
    steps = F.transform("prefix", lambda g, i: F.struct(g.alias("g"), i.alias("i"), F.when(i > 0, F.get("prefix", i - 1)).alias("before")))
    return classes.where("n > 0").select("rep", "n", *also, F.explode(steps).alias("s")).select("rep", "n", *also, "s.g", "s.i", "s.before")


def _sizes_fit(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def leader_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): in every index list the set with the earliest place, a, with each other of a size that may link.

    Rare elements come first, so the earliest place is that of the set with the fewest elements
    of its own: of a group of edited copies the one most like the rest. The pairs are as many as
    index entries at most.
    """
    lists = _lists(classes).select("g", "rep", "n", "i")
    leaders = lists.groupBy("g").agg(F.min_by("rep", "i").alias("a"), F.min_by("n", "i").alias("n_a"), F.count("*").alias("entries")).where("entries > 1").drop("entries")
    return lists.join(leaders, "g").where((F.col("rep") != F.col("a")) & _sizes_fit("n", "n_a", percent)).select("a", F.col("rep").alias("b")).distinct()


def other_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of different groups so far (``near``) that share a leading shingle and may be similar enough.

    Within an index list a pair is skipped if it is in one group already, so that its answer
    follows from another's; if the sizes are too far apart; if what is left behind the two
    places can't reach the overlap; or if the elements just before are equal, as the pair then
    meets in their list as well. At the first shingle that two linked sets of different groups
    share none of these holds, so no link that would join groups is lost.
    """
    lists = _lists(classes, "near")
    x, y = (lists.select("g", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "i", "before", "near")]) for side in "xy")
    reach = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    close = (
        (F.col("rep_x") < F.col("rep_y"))
        & (F.col("near_x") != F.col("near_y"))
        & _sizes_fit("n_x", "n_y", percent)
        & ((100 + percent) * reach >= percent * (F.col("n_x") + F.col("n_y")))
        & ~F.coalesce(F.col("before_x") == F.col("before_y"), F.lit(False))
    )
    return x.join(y, [x["g"] == y["g"], close]).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, far): the pairs whose sketches don't rule out a link.

    Sets whose sketches differ in ``far`` bits differ in at least as many elements, and linked
    sets differ in (size + size) * (100 - percent) / (100 + percent) at most. The distance is
    marked as not deterministic, so that a filter on it doesn't compute it a second time in
    another Python worker.
    """

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        bits = [np.frombuffer(b"".join(c), dtype=np.uint64).reshape(len(c), -1) for c in (x, y)]
        return pd.Series(np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(np.int32))

    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    far = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("far", distance.asNondeterministic()("s_a", "s_b"))
    return far.where((100 + percent) * F.col("far") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b", "far")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a)) and 100 * both >= percent * (len(a) + len(b) - both)


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets.

    The sets of all b travel to their a, some PARTNERS of them to a task's group, so a set with
    very many partners is dealt over many groups; a group is streamed and holds one set. A set's
    own journeys are dealt over rows of some PARTNERS as well, and are never gathered whole.
    """
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    fan = lambda c: pairs.groupBy(c).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias(f"fan_{c}"))
    dealt = lambda c, by: F.pmod(F.xxhash64(c), F.col(by)).cast("int")
    placed = pairs.join(fan("a"), "a").join(fan("b"), "b").select("a", "b", dealt("b", "fan_a").alias("salt"), dealt("a", "fan_b").alias("part"))
    visits = placed.select(F.col("b").alias("rep"), "part", F.struct("a", "salt", F.lit(1).alias("kind")).alias("v")).unionByName(
        placed.select(F.col("a").alias("rep"), (-1 - F.floor(F.col("salt") / PARTNERS)).cast("int").alias("part"), F.struct("a", "salt", F.lit(0).alias("kind")).alias("v")).distinct()
    )
    ends = visits.groupBy("rep", "part").agg(F.collect_list("v").alias("v")).select("rep", *[F.col(f"v.{c}").alias(c) for c in ("a", "salt", "kind")])
    ends = written(ends, "ends")
    held = ends.agg(F.sum(F.size("a") + 1)).first()[0] or 0
    few = F.broadcast(ends) if held <= BROADCAST_VISITS else ends
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(few, "rep")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for rep, text, a, salt, kind in zip(x["rep"].tolist(), x["text"], x["a"], x["salt"], x["kind"], strict=True):
                s = shingle_set((text or "").encode(), words).tobytes()
                out.extend((*v, rep, s) for v in zip(a, salt, kind, strict=True))
            yield pd.DataFrame(out, columns=["a", "salt", "kind", "b", "s"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, []
        for x in batches:
            out = []
            for a, salt, kind, b, s in zip(x["a"].tolist(), x["salt"].tolist(), x["kind"].tolist(), x["b"].tolist(), x["s"], strict=True):
                if (a, salt) != now:
                    now, own = (a, salt), []
                if kind == 0:
                    own.append(np.frombuffer(s, dtype=np.uint64))
                elif any(similar(p, q, percent) for q in (np.frombuffer(s, dtype=np.uint64),) for p in own):
                    out.append((a, b))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    travelling = texts.mapInPandas(sets, "a long, salt int, kind int, b long, s binary")
    sorted_groups = travelling.repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "kind", "b")
    found = written(sorted_groups.mapInPandas(verify, "a long, b long"), "links")
    forget(spark, pairs, ends)
    return found


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    A set holds the distinct shingles of so many words ``[^\\x20\\x09-\\x0D]+``, A-Z
    lower-cased; a text with fewer words is one shingle; null texts and texts without words
    have an empty set and link with nothing. Two sets link when 100 * intersection >= percent *
    union. component_id is the smallest doc_id reachable by links. Rows with equal sets form a
    class, and only classes are joined, so any number of copies costs one set. Rows with a null
    doc_id get a null component and take no part; rows of one doc_id each keep their row, and
    different texts of one doc_id count as one document that links if any of them does.

    Sets are joined in two rounds over an index of leading shingles. In the first each list is
    compared with one set of it only, which gathers groups of highly similar sets at once; in
    the second what those answers decide is skipped, and only pairs that may join two groups are
    verified. So a group of many near copies costs about one comparison for each copy. A shingle
    is 64 bits everywhere.
    """
    rows = shingle_rows(docs, words, percent)
    members = rows.where("doc_id is not null and n > 0")
    classes = members.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    # Of its lists' leaders each set is compared with the one that seems closest.
    closest = plausible(leader_pairs(classes, percent), classes, percent).groupBy("b").agg(F.min_by("a", "far").alias("a")).select("a", "b")
    first = verified(docs, closest, words, percent)
    near = components(first, "near")
    grouped = classes.join(near.withColumnRenamed("node", "rep"), "rep", "left").withColumn("near", F.coalesce("component", "rep"))
    second = verified(docs, plausible(other_pairs(grouped, percent), classes, percent).select("a", "b"), words, percent)
    groups = components(first.unionByName(second))
    forget(docs.sparkSession, classes, first, second)
    reps = members.groupBy("same").agg(F.min("doc_id").alias("rep"))
    named = reps.join(groups, reps["rep"] == groups["node"], "left").select(F.col("same").alias("_same"), F.coalesce("component", "rep").alias("_component"))
    return rows.join(named, (rows["same"] == named["_same"]) & (rows["n"] > 0) & rows["doc_id"].isNotNull(), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id")
    )
