"""What several operators share: the shared folder, written tables, numpy text helpers, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session names none, a local master gets one beside its warehouse; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    The table survives the loss of any executor. It is compressed by zstandard, whose buffers
    are freed with each page; Snappy's direct buffers wait for a collection of the heap. Columns
    of hashes are written faster without trying a ``dictionary``.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one partition as stars: every node with the least node that it reaches inside the partition.

    Works through a bounded number of edges at a time.
    """
    group: dict[int, int] = {}

    def root(k: int) -> int:
        while group.setdefault(k, k) != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    def out() -> pd.DataFrame:
        return pd.DataFrame([(k, r) for k in group if (r := root(k)) != k], columns=["a", "b"])

    for x in batches:
        for a, b in zip(x["a"].tolist(), x["b"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                group[max(ra, rb)] = min(ra, rb)
        if len(group) > 500_000:
            yield out()
            group.clear()
    if group:
        yield out()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b).

    Only nodes with an edge are returned. Partitions first make stars of their own edges. Then
    every round gives each node's label, and the label's label, the least grandparent label of
    its neighbours, and jumps to grandparents (hooking and shortcutting as in FastSV), which
    needs a logarithmic number of rounds. Minima combine before each shuffle, each round is a
    written table, and nothing is collected. No edges give no rows; loops, repeated edges and
    nulls are ignored.
    """
    spark = edges.sparkSession
    clean = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    stars = written(clean.mapInPandas(_stars, "a long, b long").distinct(), f"{name}-edges")
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("f")), f"{name}-labels")
    while True:
        up = labels.select(F.col("node").alias("f"), F.col("f").alias("g"))
        grand = written(labels.join(up, "f").select("node", "f", "g"), f"{name}-grand")
        near = both.join(grand.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("m"))
        told = written(grand.join(near, "node"), f"{name}-told")
        offers = told.select(F.col("f").alias("node"), "m").unionByName(told.select("node", F.least("m", "g", "f").alias("m")))
        after = written(offers.groupBy("node").agg(F.min("m").alias("f")), f"{name}-labels")
        moved = after.join(labels.withColumnRenamed("f", "was"), "node").where("f <> was").limit(1).count()
        forget(spark, labels, grand, told)
        labels = after
        if not moved:
            forget(spark, stars)
            return labels.select("node", F.col("f").alias("component"))


# --- numpy helpers for batches of texts ---------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words, of so many bytes at most, whose hashes a worker remembers.
REMEMBERED_WORDS, REMEMBERED_BYTES = 300_000, 40


class _Hashes(dict):
    """64 bits of XXH3 of each word's bytes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of every word ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, as it is written."""
    words = text.split()
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of so many words, A-Z lower-cased.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    h = word_hashes(text.translate(_LOWER))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _STEP + h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return np.unique(out)
