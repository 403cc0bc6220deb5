"""The best of each query inside one task, so that what a task ranks and drops is never written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Tasks for each core that share the nodes: each returns up to a pool of rows for every query, so they don't grow with the nodes.
TASKS_A_CORE = 3


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero by the shortest decimal that names the number, as the function ``round`` of SQL."""
    y = np.abs(x) * 1e6 + 0.5
    out = np.floor(y)
    for i in np.flatnonzero(np.abs(y - np.rint(y)) < 1e-3):
        out[i] = float(Decimal(repr(float(abs(x[i])))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
    return np.copysign(out / 1e6, np.where(out == 0, 1.0, x))


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as an array that can be compared: numbers as they are, others as objects."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def _first(keys: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which ``n`` rows have the least keys, and the least ids among equal ones."""
    if ids.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (keys[i], ids[i]))[:n], dtype=np.int64)
    return np.lexsort((ids, keys))[:n]


class Best:
    """The ``pool`` least (key, id) of each of ``n`` queries; ``bound`` is the key beyond which a row can't be one of them."""

    def __init__(self, n: int, pool: int) -> None:
        self.pool, self.bound = pool, np.full(n, np.inf)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, query: int, keys: np.ndarray, ids: np.ndarray) -> None:
        if query in self.held:
            k, i = self.held[query]
            keys, ids = np.concatenate([k, keys]), np.concatenate([i, ids])
        if len(keys) > self.pool:
            some = np.flatnonzero(keys <= np.partition(keys, self.pool - 1)[self.pool - 1])
            if len(some) > self.pool:
                some = some[_first(keys[some], ids[some], self.pool)]
            keys, ids = keys[some], ids[some]
        if len(keys) == self.pool:
            self.bound[query] = keys.max()
        self.held[query] = keys, ids

    def batches(self, schema: pa.Schema, query_ids: list, score: Callable[[int, np.ndarray], list], at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
        """Rows (query_id, id, score), the score made of a query's number and its keys."""
        rows: tuple[list, list, list] = [], [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

        for query, (keys, ids) in self.held.items():
            rows[0].extend([query_ids[query]] * len(keys))
            rows[1].extend(ids.tolist())
            rows[2].extend(score(query, keys))
            if len(rows[0]) >= at_once:
                yield batch()
                rows = [], [], []
        if rows[0]:
            yield batch()


def by_task(nodes: DataFrame, queries: DataFrame, work: Callable[[pa.Schema], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """(query_id, id, score) of a function over the batches of each task's nodes, which ``work`` makes for the schema of its rows."""
    kinds = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", nodes.schema["id"].dataType), StructField("score", DoubleType())])
    tasks = TASKS_A_CORE * nodes.sparkSession.sparkContext.defaultParallelism
    return nodes.coalesce(tasks).mapInArrow(work(to_arrow_schema(kinds)), kinds)
