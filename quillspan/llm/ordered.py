"""Rows in ascending key order over many partitions: ranges by sampled quantiles, texts moved compressed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import partitions, written

#: Stands for a null key, so that it sorts first.
NULL_KEY = -(2**63)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their places 1, 2, 3 ... in an order as a column.

    Rows are range-partitioned and sorted in their ranges; a place is that in the range behind
    the sizes of the ranges before, of which the driver holds one number each.
    """
    at = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(ranges.select("*", F.shiftright(at, 33).cast("int").alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "numbered")
    before, total = {}, 0
    for r in sorted(placed.groupBy("_range").count().collect()):
        before[r["_range"]], total = total, total + r["count"]
    starts = F.split(F.lit(",".join(str(before.get(i, 0)) for i in range(max(before, default=0) + 1))), ",").cast("array<bigint>")
    return placed.withColumn(name, F.get(starts, F.col("_range")) + F.col("_at") + 1).drop("_range", "_at")


def in_ranges(docs: DataFrame, fan: int = 4, guests: bool = False) -> tuple[DataFrame, list[int]]:
    """(b, guest, k, h, z) of (key, text) rows, dealt by range and sorted in it; the ranges in order.

    ``b`` is the range, ``k`` the key (NULL_KEY for null), ``h`` a digest of the text that
    orders rows of one key, ``z`` the text as a zstandard frame. There are about ``fan`` ranges
    for each shuffle partition, cut at sampled quantiles of the key. With ``guests`` the first
    rows of every range also go to the range before it (those of the first to the last), with
    guest = 1 and sorted behind its own rows. The driver holds one number for each range.
    """
    spark = docs.sparkSession
    rows = docs.toDF("k", "t").select(F.coalesce(F.col("k").cast("long"), F.lit(NULL_KEY)).alias("k"), "t")
    n = max(1, partitions(spark) * fan)
    asked = rows.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = np.unique(np.array(asked, dtype=np.float64).astype(np.int64))

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(b=np.searchsorted(cuts, x["k"].to_numpy(), side="right")).groupby("b", as_index=False).agg(k=("k", "min"))[["b", "k"]]

    firsts = {r["b"]: r["k"] for r in rows.select("k").mapInPandas(least, "b int, k long").groupBy("b").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for x in batches:
            keys = x["k"].to_numpy()
            out = []
            for b, k, t in zip(np.searchsorted(cuts, keys, side="right").tolist(), keys.tolist(), x["t"].tolist(), strict=True):
                raw = (t or "").encode()
                row = (k, xxhash.xxh3_128_digest(raw), pack.compress(raw))
                out.append((b, 0, *row))
                if guests and firsts[b] == k:
                    out.append((before[b], 1, *row))
            yield pd.DataFrame(out, columns=["b", "guest", "k", "h", "z"])

    moved = rows.mapInPandas(placed, "b int, guest int, k long, h binary, z binary")
    return moved.repartition(partitions(spark), "b").sortWithinPartitions("b", "guest", "k", "h"), order


def key_of(k: int) -> int | None:
    return None if k == NULL_KEY else k


def with_next(docs: DataFrame, run: Callable[[int | None, str, str], tuple], schema: str, fan: int = 4) -> DataFrame:
    """A row ``run(key, text, next text)`` for each (key, text) row; after the last row comes the first.

    The order is ascending key, nulls first, then a digest of the text. An empty table gives no rows.
    """
    moved, _ = in_ranges(docs, fan, guests=True)
    names = [x.split()[0] for x in schema.split(",")]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        held, done = None, False  # the row that waits for its next; whether its range has met a guest
        for x in batches:
            out = []
            for b, guest, k, z in zip(x["b"].tolist(), x["guest"].tolist(), x["k"].tolist(), x["z"].tolist(), strict=True):
                if guest and done:
                    continue
                text = unpack.decompress(z).decode()
                if held is not None and held[0] == b:
                    out.append(run(key_of(held[1]), held[2], text))
                held, done = (b, k, text), bool(guest)
            if out:
                yield pd.DataFrame(out, columns=names)

    return moved.mapInPandas(pairs, schema)
