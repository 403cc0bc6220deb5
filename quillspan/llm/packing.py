"""Best-fit packing: hierarchical residual packing of token pieces into sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import written
from quillspan.llm.tokens import crc32, encoder, with_end

#: Groups whose open bins are packed together in one task, and the bins over half full that one carries on;
#: the second must be FAN_IN times the rounds at least, which 2048 is for any number of partitions.
FAN_IN, CARRIED = 8, 2048


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item. Sizes are 1 to capacity.

    Bins wait in stacks by free space and a bit for each stack, so an item finds the fullest
    bin that holds it in a few operations.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    waiting, made = 0, 0
    for i in order.tolist():
        size = int(sizes[i])
        fitting = waiting >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                waiting &= ~(1 << free)
        else:
            free, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if left:
            stacks[left].append(b)
            waiting |= 1 << left
    return bins, offsets


def pieces_of(length: int, capacity: int) -> list[int]:
    """The lengths that a document is cut into: only longer ones are cut, the first piece takes the remainder."""
    if length <= capacity:
        return [length]
    first = length % capacity
    return [first] * bool(first) + [capacity] * (length // capacity)


def piece_cutter(vocabulary: str, capacity: int, with_ids: bool = False) -> tuple[Callable, str]:
    """What makes pieces of batches of (doc_id, text), and the columns that it makes."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for x in batches:
            out = []
            for k, ids in zip(x["doc_id"].astype(object).tolist(), encode.encode(x["text"].tolist()), strict=True):
                ids, start = with_end(ids), 0
                for piece, n in enumerate(pieces_of(len(ids), capacity)):
                    part = ids[start : start + n]
                    out.append((None if k is None or k != k else int(k), piece, start, n, crc32(part), *[part] * with_ids))
                    start += n
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return cut, schema


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every (doc_id, text) row, in one narrow pass.

    A document's ids end with id 0, so a null or empty text is one piece of one id.
    """
    return docs.select("doc_id", "text").mapInPandas(*piece_cutter(vocabulary, capacity, with_ids))


def still_open(fill: np.ndarray, capacity: int, carried: int = CARRIED) -> np.ndarray:
    """Which bins of one packed group may still gain from another group's bins.

    Any two bins of a group that is packed best-fit overfill one bin, so at most one of them is
    up to half full, and only such a bin can join another. A round brings at most FAN_IN of them
    together, so all rounds use up at most FAN_IN bins each of what a group carries. A joining
    bin takes the fullest that holds it: one that is carried and not the emptiest, unless no
    other bin of the group, carried or not, would hold it. So the emptiest ones decide how many
    join, and leaving out the nearly full ones behind them never costs a sequence.
    """
    out = fill < capacity
    fuller = np.flatnonzero(out & (2 * fill > capacity))
    out[fuller[np.argsort(fill[fuller], kind="stable")[carried:]]] = False
    return out


def _merge(level: int, capacity: int):
    """Packs the open bins of one group of one round: where each goes and what its bin then holds."""

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["fill", "now"], ignore_index=True)
        fills, part = x["fill"].to_numpy(dtype=np.int64), int(x["part"].iloc[0])
        bins, offsets = best_fit(fills, capacity)
        total = np.bincount(bins, weights=fills).astype(np.int64)
        now = x["now"].to_numpy(dtype=np.int64)
        after = np.where(np.bincount(bins)[bins] > 1, (np.int64(level) << 56) + (np.int64(part) << 32) + bins, now)
        return pd.DataFrame({"before": now, "after": after, "more": offsets, "total": np.where(still_open(total, capacity), total, 0)[bins], "place": np.int32(part)})

    return merge


def pack(pieces: DataFrame, capacity: int, length: str = "length", make: tuple[Callable, str] | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece in one sequence, gapless from 0.

    Every input partition packs its pieces best-fit decreasing. Full bins and the fullest of the
    rest are done. The others are items of the next round, which packs those of FAN_IN groups together,
    until one group is left. What moves between rounds is a few numbers for each bin that may
    still be joined, and a group carries a bounded number of them. Rows keep their columns, but
    columns named sequence_id and offset are replaced. Pieces must have 1 to ``capacity`` ids.
    An empty table gives no rows; the first round is written down, so later ones see the same bins.
    With ``make``, as of ``piece_cutter``, the pieces are made of the given rows where they are
    packed, so that a task needs one Python worker and not two in a row.
    """
    if make:
        rows, (cut, schema) = pieces, make
        own = [c.split()[0] for c in schema.split(", ")]
    else:
        own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
        rows, cut = pieces.select(*own), iter
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        some = [x for x in cut(batches) if len(x)]
        if not some:
            return
        x = pd.concat(some, ignore_index=True)
        sizes = x[length].to_numpy(dtype=np.int64)
        bins, offsets = best_fit(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        yield x.assign(_bin=(np.int64(part) << 32) + bins, offset=offsets, _fill=np.where(still_open(fill, capacity), fill, 0)[bins], _part=part)

    placed = written(rows.mapInPandas(first, f"{schema}, _bin long, offset long, _fill long, _part int"), "packed")
    open_bins = placed.where("_fill > 0").groupBy("_bin").agg(F.first("_fill").alias("fill"), F.first("_part").alias("part"))
    # origin: a bin of the first round; now: the bin that holds it, at shift.
    where = written(open_bins.select(F.col("_bin").alias("origin"), F.col("_bin").alias("now"), F.lit(0).cast("long").alias("shift"), "fill", "part"), "packed-open")
    last = where.agg(F.max("part")).first()[0]
    groups, level = (0 if last is None else last + 1), 0
    while groups > 1:
        groups, level = -(-groups // FAN_IN), level + 1
        items = where.where("fill > 0").groupBy("now").agg(F.first("fill").alias("fill"), F.floor(F.first("part") / FAN_IN).cast("int").alias("part"))

        moves = items.groupBy("part").applyInPandas(_merge(level, capacity), "before long, after long, more long, total long, place int")
        moved = where.join(moves, where["now"] == moves["before"], "left")
        where = written(moved.select("origin", F.coalesce("after", "now").alias("now"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), F.coalesce("total", F.lit(0)).alias("fill"), F.coalesce("place", "part").alias("part")), "packed-open")
    return (
        placed.join(where.select("origin", "now", "shift"), placed["_bin"] == where["origin"], "left")
        .select(*[placed[c] for c in own], F.coalesce("now", "_bin").alias("sequence_id"), (placed["offset"] + F.coalesce("shift", F.lit(0))).alias("offset"))
    )
