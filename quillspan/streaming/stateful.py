"""Keyed state with timers: a cache of refused keys that expires, and a buffer that flushes by size or time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and lists need; the setting is restored behind."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Refusals(StatefulProcessor):
    """One value for a key: until when it is refused without a lookup, in microseconds. A timer forgets it."""

    def __init__(self, seconds: float):
        self.span = int(seconds * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        x = pd.concat(list(rows))[["at", "known"]].assign(us=lambda d: d["at"].astype("datetime64[us]").astype("int64")).sort_values("us", kind="stable")
        before = until = self.until.get()[0] if self.until.exists() else None
        outcomes = []
        for us, known in zip(x["us"].tolist(), x["known"].tolist(), strict=True):
            if until is not None and us < until:
                outcomes.append("refused again")
            elif known:
                outcomes.append("accepted")
            else:
                outcomes.append("refused")
                until = us + self.span
        if until != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.until.update((until,))
            self.handle.registerTimer(-(-until // 1000))
        yield pd.DataFrame({"key": key[0], "at": x["at"].to_numpy(), "outcome": outcomes})

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def refusals(requests: DataFrame, seconds: float, late: str = "1 hour") -> DataFrame:
    """(key, at, outcome) of requests (key, at timestamp, known): ``refused again`` is answered without a lookup.

    An unknown key is remembered as refused for so many seconds from its lookup on; behind that
    it is looked up anew, known by then or not. A trigger's requests of a key are decided in
    order of time. State is forgotten when the watermark passes its end, so it holds the keys
    refused lately; requests later than the watermark are dropped. Null keys are one key. Start
    it inside ``keyed_state``.
    """
    kind = requests.schema["key"].dataType.simpleString()
    timed = requests.select("key", "at", "known").withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(_Refusals(seconds), f"key {kind}, at timestamp, outcome string", "append", "EventTime")


class BufferFull(RuntimeError):
    """A strict buffer got more rows than it may hold."""


class _Buffer(StatefulProcessor):
    """The rows that wait, as a list, the number of the next batch, and a timer of the oldest row."""

    def __init__(self, size: int, wait_ms: int, capacity: int, strict: bool):
        self.size, self.wait_ms, self.capacity, self.strict = size, wait_ms, capacity, strict

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.next = handle.getValueState("next", "n long")

    def _flushed(self, key: Any, rows: list[str], full: bool, reason: str) -> tuple[list[tuple], list[str]]:
        """Batches of ``size`` rows, the last one shorter unless only full ones go, and the rows left."""
        n, out = self.next.get()[0] if self.next.exists() else 0, []
        while rows and (len(rows) >= self.size or not full):
            out += [(key, n, reason, r) for r in rows[: self.size]]
            rows, n = rows[self.size :], n + 1
        self.next.update((n,))
        return out, rows

    def _keep(self, rows: list[str]) -> None:
        if rows:
            self.waiting.put([(r,) for r in rows])
        else:
            self.waiting.clear()

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        came = [r for x in rows for r in x["row"].tolist()]
        room = max(0, self.capacity - len(held))
        lost = came[room:]
        if lost and self.strict:
            raise BufferFull(f"{len(lost)} rows more than the buffer's {self.capacity}")
        out, left = self._flushed(key[0], held + came[:room], True, "size")
        for timer in list(self.handle.listTimers()) if len(left) != len(held) + len(came) or not left else []:
            self.handle.deleteTimer(timer)
        if left and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        self._keep(left)
        yield pd.DataFrame(out + [(key[0], None, "dropped", r) for r in lost], columns=["key", "batch", "reason", "row"]).astype({"batch": "Int64"})

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        out, _ = self._flushed(key[0], held, False, "time")
        self._keep([])
        yield pd.DataFrame(out, columns=["key", "batch", "reason", "row"]).astype({"batch": "Int64"})

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, size: int = 500, wait_ms: int = 1000, capacity: int = 10_000, strict: bool = False) -> DataFrame:
    """(key, batch, reason, row) of rows (key, row string): batches of a key by ``size``, or what waits by time.

    A row waits at most ``wait_ms`` and the time of a trigger. A key holds ``capacity`` rows with
    those of a trigger: further ones come out as ``dropped``, without a batch, or fail the query
    if ``strict``. Run it with a trigger by time: one that ends with the input never ends, as a
    timer may still fire. A key is a shard of a log, so its rows are as many as its reader asks for in a
    trigger. Start it inside ``keyed_state``.
    """
    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", F.col("row").cast("string")).groupBy("key").transformWithStateInPandas(_Buffer(size, wait_ms, capacity, strict), f"key {kind}, batch long, reason string, row string", "append", "ProcessingTime")
