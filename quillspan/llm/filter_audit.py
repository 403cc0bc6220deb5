"""Filter interaction audit: what each of five filters removes, alone and behind others, from one cube over their flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import written

#: The filters in the order of their bits, A lowest.
LETTERS = "ABCDE"
ALL = (1 << len(LETTERS)) - 1
_WORD_GAP = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, tid, a, b, c, d) of every row: which of the filters on a text alone it fails, and a SHA-256 of the text.

    a: under 100 words; b: under 80 different words in 100; c: over 10 capital letters A-Z in
    100 code points; d: a character of ``#$%&*|``. A null text is empty, a null lang the part ''.
    """
    text = F.coalesce("text", F.lit(""))
    worded = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, _WORD_GAP), "").alias("words"))
    n = F.size("words")
    return worded.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("tid"),
        (n < 100).alias("a"),
        (100 * F.size(F.array_distinct("words")) < 80 * n).alias("b"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 10 * F.length("text")).alias("c"),
        F.col("text").rlike("[#$%&*|]").alias("d"),
    )


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a .. e, n, good, toxic): rows by part and failures; e: the text is that of a row with a smaller doc_id.

    Equal rows combine before every shuffle, so neither a text nor a doc_id that many rows have
    is gathered. A row with a null doc_id has no smaller one and no labels. A doc_id with
    several labels is good, or toxic, if one of them says so.
    """
    key = ["doc_id", "part", "tid", "a", "b", "c", "d"]
    rows = written(failures(docs).groupBy(*key).agg(F.count("*").alias("n")), "failures")
    known = rows.where("doc_id is not null")
    firsts = known.groupBy("tid").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    judged = known.join(firsts, ["doc_id", "tid"], "left").join(marks, "doc_id", "left").select(*key, "n", F.col("first").isNull().alias("e"), "good", "toxic")
    nobody = rows.where("doc_id is null").select(*key, "n", F.lit(False).alias("e"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return judged.unionByName(nobody).groupBy("part", "a", "b", "c", "d", "e").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def survivors(flags: DataFrame) -> DataFrame:
    """(part, passed, n, good, toxic): rows that fail none of a subset of the filters, for every subset and part.

    One cube over part and flags; of its rows those whose selected flags are all false are the
    survivors of the selected subset. ``part`` is null for all parts together. A subset that
    nothing survives has no row.
    """
    cells = flags.cube("part", "a", "b", "c", "d", "e").agg(F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    clean = ~F.coalesce(F.greatest("a", "b", "c", "d", "e"), F.lit(False))
    # The grouping id has the bit of each column that is rolled up, the first column's highest.
    selected = [F.when(F.col("g").bitwiseAND(1 << 4 - i) == 0, 1 << i).otherwise(0) for i in range(len(LETTERS))]
    some = cells.where(clean & (F.col("part").isNotNull() | (F.col("g").bitwiseAND(32) > 0)))
    return some.select("part", sum(selected[1:], selected[0]).alias("passed"), "n", "good", "toxic")


def _ways(size: Column) -> Column:
    """Orders of all filters in which a given subset of so many comes first and a given filter next."""
    return F.factorial(size) * F.factorial(F.lit(len(LETTERS) - 1) - size)


def pairs(alive: DataFrame) -> DataFrame:
    """For every part, subset and filter outside it: what the filter removes behind the subset, and what it does on its own.

    (part, before, bit, kept, removed, good_lost, toxic_lost, fails, unique_fails, shapley); a join
    of each subset with the one that has the filter as well. Zeros are included.
    """
    counts = ["n", "good", "toxic"]
    every = alive.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("passed"))
    whole = every.join(alive, ["part", "passed"], "left").select("part", "passed", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    before = whole.select("part", F.col("passed").alias("before"), *[F.col(c).alias(f"{c}_0") for c in counts], F.explode(F.array(*[F.lit(1 << i) for i in range(len(LETTERS))])).alias("bit"))
    steps = before.where(F.col("before").bitwiseAND(F.col("bit")) == 0).withColumn("passed", F.col("before").bitwiseOR(F.col("bit"))).join(whole, ["part", "passed"])
    lost = steps.select("part", "before", "bit", F.col("n").alias("kept"), (F.col("n_0") - F.col("n")).alias("removed"), (F.col("good_0") - F.col("good")).alias("good_lost"), (F.col("toxic_0") - F.col("toxic")).alias("toxic_lost"))
    own = lost.groupBy("part", "bit").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.bit_count("before") == len(LETTERS) - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * _ways(F.bit_count("before"))).alias("shapley"),
    )
    return lost.join(own, ["part", "bit"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), one row for each.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are left out. Every
    order of the five filters is applied to each part, which is a value of lang. Repeated rows
    count each, and none of them is a copy of another with the same doc_id. An empty table has
    no part and so no rows.
    """
    spark = docs.sparkSession
    flags = written(flagged(docs, labels), "failure-flags")
    steps = written(pairs(survivors(flags).where("part is not null")), "audit-steps")
    orders = []
    for order in permutations(LETTERS):
        bits = [1 << LETTERS.index(x) for x in order]
        orders += [("".join(order), i + 1, sum(bits[:i]), bits[i]) for i in range(len(LETTERS))]
    walks = spark.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    return steps.join(walks, ["before", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
