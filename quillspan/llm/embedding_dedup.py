"""Embedding near-dedup: a subspace pigeonhole join on cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import components, partitions, written

#: Axes of a block, and vectors of a cell that one unit of work holds.
BLOCK_AXES, CHUNK = 8, 4096
#: Distances compared at a time, and what single precision may add to one of unit vectors.
AT_ONCE, ROUNDING = 1 << 20, 1e-5


def grid_axes(vectors: int) -> int:
    """Axes of a block that the grid is laid on: another one for each 64-fold of vectors, so that cells stay small."""
    return int(min(BLOCK_AXES, 1 + max(0, np.ceil(np.log(max(1, vectors) / (2 * CHUNK)) / np.log(64)))))


def _vectors(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors from their bytes, each in single precision where that holds it exactly, or in double."""
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), dtype="<f4").astype(np.float64).reshape(-1, dim)
    return np.stack([np.frombuffer(r, dtype="<f4" if len(r) == 4 * dim else "<f8").astype(np.float64) for r in raw])


def _valid(v) -> np.ndarray | None:
    """A vector in double precision, or None where it can link with nothing."""
    if v is None or len(v) == 0 or any(c is None for c in v):
        return None
    x = np.asarray(v, dtype=np.float64)
    return x if np.isfinite(x).all() and np.any(x) else None


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that very small or large components don't vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coordinates(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """u @ axes, added up in one fixed order, so a vector has the same coordinates in every task."""
    out = np.zeros((len(u), axes.shape[1]))
    for k in range(len(axes)):
        out += u[:, k : k + 1] * axes[k]
    return out


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added up in one fixed order."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        out += d * d
    return out


class Blocks:
    """A rotation, its axes dealt over blocks, and each block's share of the squared-distance budget."""

    def __init__(self, moments: np.ndarray, cosine: float, vectors: int = 0):
        self.grid = grid_axes(vectors)
        values, vectors = np.linalg.eigh(moments)
        order = np.argsort(-values)
        self.count = max(1, len(values) // BLOCK_AXES)
        self.axes = [vectors[:, order[b :: self.count]] for b in range(self.count)]
        share = np.array([values[order[b :: self.count]].clip(1e-9).sum() for b in range(self.count)])
        # A little above the exact budget, for rounding.
        self.budgets = (2 - 2 * cosine + 1e-9) * share / share.sum()

    def cells(self, u: np.ndarray) -> np.ndarray:
        """(vector, block, axis) grid cells as wide as the block's radius."""
        out = np.zeros((len(u), self.count, self.grid), dtype=np.int64)
        for b in range(self.count):
            c = _coordinates(u, self.axes[b][:, : self.grid])
            out[:, b, : c.shape[1]] = np.floor(c / (np.sqrt(self.budgets[b]) * (1 + 1e-9)))
        return out

    def pairs(self, left: np.ndarray, right: np.ndarray, block: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Links between rows of two groups (or inside one) whose first block within its budget is this one."""
        a, b = _unit(left), _unit(right)
        x, y = a @ self.axes[block], b @ self.axes[block]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # |x|^2 + |y|^2 - 2xy as one product in single precision; what it lets through is compared in double.
        one = lambda z: np.ones((len(z), 1))
        square = lambda z: (z * z).sum(axis=1, keepdims=True)
        wide = np.hstack([-2 * x, square(x), one(x)]).astype(np.float32)
        high = np.hstack([y, one(y), square(y)]).astype(np.float32)
        # Filled up with rows far from everything, so that eight answers are looked at as one number.
        far = np.zeros((-len(y) % 8, high.shape[1]), dtype=np.float32)
        far[:, -1] = 1e9
        high = np.ascontiguousarray(np.vstack([high, far]).T)
        limit, width = np.float32(self.budgets[block] + ROUNDING), len(y) + len(far)
        step = max(1, AT_ONCE // max(1, width))
        for at in range(0, len(x), step):
            behind = at // 8 * 8 if same else 0
            hit = (wide[at : at + step] @ high[:, behind:] <= limit).ravel()
            eights = np.flatnonzero(hit.view(np.uint64))
            r, c = np.nonzero(hit.reshape(-1, 8)[eights])
            near = eights[r] * 8 + c
            i, j = near // (width - behind) + at, near % (width - behind) + behind
            if same:
                i, j = i[i < j], j[i < j]
            for cut in range(0, len(i), 1 << 17):
                ii, jj = i[cut : cut + (1 << 17)], j[cut : cut + (1 << 17)]
                keep = (_near(_coordinates(a[ii], self.axes[block]), _coordinates(b[jj], self.axes[block])) <= self.budgets[block]) & ((a[ii] * b[jj]).sum(axis=1) >= cosine)
                ii, jj = ii[keep], jj[keep]
                for earlier in range(block):
                    if len(ii):
                        far = _near(_coordinates(a[ii], self.axes[earlier]), _coordinates(b[jj], self.axes[earlier])) > self.budgets[earlier]
                        ii, jj = ii[far], jj[far]
                found.append((ii, jj))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component, over links inside one unit of work."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def moments(classes: DataFrame, dim: int) -> np.ndarray:
    """The sum of outer products of all unit vectors, added up inside each partition first."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for x in batches:
            u = _unit(_vectors(x["v"].tolist(), dim))
            total += u.T @ u
        yield pd.DataFrame({"at": np.arange(dim * dim), "s": total.ravel()})

    out = np.zeros(dim * dim)
    for at, s in classes.mapInPandas(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[at] = s
    return out.reshape(dim, dim) / max(1.0, np.trace(out.reshape(dim, dim)))


def _joined(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(rid, links, buddy) from every unit of work: links found there by members, and a member linked through others."""
    spark = classes.sparkSession
    blocks = Blocks(moments(classes, dim), cosine, classes.count())

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at = blocks.cells(_unit(_vectors(x["v"].tolist(), dim)))
            yield x.assign(cells=[list(c) for c in at])

    flat = written(classes.mapInPandas(cells, "rid long, members long, v binary, cells array<array<long>>"), "vectors")
    rows = flat.select("rid", "members", "v", F.posexplode("cells").alias("b", "a"))
    counts = written(rows.groupBy("b", "a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("s")), "cells")
    # A cell is compared with itself and its later neighbours, so each pair of cells meets once.
    forward = [o for o in product((-1, 0, 1), repeat=blocks.grid) if o >= (0,) * blocks.grid]
    offsets = F.explode(F.array(*[F.array(*[F.lit(d).cast("long") for d in o]) for o in forward]))
    first = counts.select("b", "a", F.col("s").alias("sa"), offsets.alias("o")).select("b", "a", "sa", F.zip_with("a", "o", lambda c, d: c + d).alias("z"))
    both = first.join(counts.select("b", F.col("a").alias("z"), F.col("s").alias("sz")), ["b", "z"])
    plan = written(both.select(F.monotonically_increasing_id().alias("id"), "b", "a", "z", "sa", "sz", (F.col("a") == F.col("z")).alias("alone")), "cell-pairs")
    chunk = lambda s: F.pmod(F.xxhash64("rid"), F.col(s)).cast("int")
    alone = F.col("alone")
    key = ["id", "i", "j"]
    left = rows.join(plan, ["b", "a"]).select("*", chunk("sa").alias("own"), F.explode(F.sequence(F.lit(0), F.col("sz") - 1)).alias("other"))
    left = left.select("id", "b", "alone", F.when(alone, F.least("own", "other")).otherwise(F.col("own")).alias("i"), F.when(alone, F.greatest("own", "other")).otherwise(F.col("other")).alias("j"), F.when(alone & (F.col("other") < F.col("own")), 1).otherwise(0).alias("side"), "rid", "members", "v")
    right = rows.withColumnRenamed("a", "z").join(plan.where(~alone), ["b", "z"]).select("*", chunk("sz").alias("own"), F.explode(F.sequence(F.lit(0), F.col("sa") - 1)).alias("other"))
    right = right.select("id", "b", "alone", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "rid", "members", "v")

    def unit(b: int, inside: bool, side: np.ndarray, rid: np.ndarray, members: np.ndarray, v: list[bytes]) -> pd.DataFrame | None:
        at = [np.flatnonzero(side == s) for s in (0, 1)]
        if inside:
            at[1] = at[0]
        if not len(at[0]) or not len(at[1]):
            return None
        vs = _vectors(v, dim)
        i, j = blocks.pairs(vs[at[0]], vs[at[1]], b, cosine, inside)
        if not len(i):
            return None
        i, j = at[0][i], at[1][j]
        n = np.bincount(i, weights=members[j], minlength=len(rid)) + np.bincount(j, weights=members[i], minlength=len(rid))
        label = _labels(len(rid), i, j)
        some = np.flatnonzero(n)
        return pd.DataFrame({"rid": rid[some], "links": n[some].astype(np.int64), "buddy": rid[label[some]]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def done() -> Iterator[pd.DataFrame]:
            if held:
                side, rid, members = (np.concatenate([h[c].to_numpy() for h in held]) for c in ("side", "rid", "members"))
                inside = bool(held[0]["alone"].iat[0]) and now[1] == now[2]
                out = unit(int(held[0]["b"].iat[0]), inside, side, rid, members, [v for h in held for v in h["v"]])
                if out is not None:
                    yield out

        for x in batches:
            keys = x[key].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(x)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a < z:
                    if (k := tuple(keys[a].tolist())) != now:
                        yield from done()
                        now, held = k, []
                    held.append(x.iloc[a:z])
        yield from done()

    units = left.unionByName(right).repartition(partitions(spark), *key).sortWithinPartitions(*key)
    return units.mapInPandas(join, "rid long, links long, buddy long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Rows link when the cosine of their vectors in double precision is at least ``cosine``.
    n_links counts other rows linked directly, component_id is the smallest vec_id reachable,
    itself included, and kept says whether that is the row's own.

    Equal vectors form a class that is joined once. The vectors are rotated onto the axes of
    their second moments, which are dealt over blocks; a pair within the squared distance 2 - 2 *
    cosine is within its share of it in some block. Each block is range-joined on a grid as wide
    as its radius; crowded cells are dealt over several units of work. A unit verifies its pairs
    on the whole vectors, counts a pair only in the first block that finds it, and returns counts
    and one neighbour for each vector, not pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    and so do rows with a null vec_id (their component_id is null, kept false). Vectors of
    different lengths are compared among their own length, one length after the other. Rows of one
    vec_id keep their rows; an empty table gives none.

    Without structure in the vectors the pairs within a block's budget are a fixed share of all
    pairs, some 1e-4 for 64 even axes, so the cost of a very large table is theirs, however fine
    the grid.
    """

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for k, v in zip(x["vec_id"].astype(object).tolist(), x["embedding"].tolist(), strict=True):
                u = None if k is None or k != k else _valid(v)
                raw = None if u is None else (u + 0.0).astype("<f8").tobytes()
                with np.errstate(over="ignore"):
                    small = None if u is None else (u + 0.0).astype("<f4")
                held = raw if u is None or (small != u).any() else small.tobytes()
                out.append((None if k is None or k != k else int(k), 0 if u is None else len(u), held, None if raw is None else xxhash.xxh3_128_digest(raw)))
            yield pd.DataFrame(out, columns=["vec_id", "dim", "v", "same"]).astype({"vec_id": "Int64"})

    rows = written(vectors.select("vec_id", "embedding").mapInPandas(classed, "vec_id long, dim int, v binary, same binary"), "vector-rows")
    classes = rows.where("dim > 0").groupBy("same", "dim").agg(F.min("vec_id").alias("rid"), F.count("*").alias("members"), F.first("v").alias("v"))
    classes = written(classes, "vector-classes")
    found = None
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        part = _joined(classes.where(F.col("dim") == dim).select("rid", "members", "v"), dim, cosine)
        found = part if found is None else found.unionByName(part)
    spark = vectors.sparkSession
    found = written(found if found is not None else spark.createDataFrame([], "rid long, links long, buddy long"), "vector-links")
    groups = components(found.select(F.col("rid").alias("a"), F.col("buddy").alias("b")))
    sums = found.groupBy("rid").agg(F.sum("links").alias("links"))
    named = classes.select("same", "rid", "members").join(sums, "rid", "left").join(groups.withColumnRenamed("node", "rid"), "rid", "left")
    out = rows.select("vec_id", "same").join(named, "same", "left")
    component = F.coalesce("component", "rid", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("members") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
