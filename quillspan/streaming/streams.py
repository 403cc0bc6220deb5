"""Streaming forms: windows with watermarks, deduplication, a token bucket with state, sinks.

Each function takes and returns streaming DataFrames; ``drain`` runs one over what a source has now.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.tables import shared_folder


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """New Parquet files at a path (or pattern) as a stream, with the schema of those there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def windowed(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(started, event_type, n) of windows that the watermark has closed; later rows are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def first_of_key(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """One row for each key while the watermark remembers it."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(key, at, allowed) of requests (key of any type, at in seconds): the bucket of each key is state, and starts full at time 0.

    A trigger's requests of a key are decided in order of time, however many Arrow batches they
    come in; only their times are held. A request older than one decided by an earlier trigger
    finds the bucket as it is and leaves its clock alone.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(burst), 0.0)
        times = np.sort(np.concatenate([x["at"].to_numpy(dtype=float) for x in batches]))
        passed = np.empty(len(times), dtype=bool)
        for i, at in enumerate(times.tolist()):
            tokens = min(float(burst), tokens + max(0.0, at - last) * rate)
            last = max(last, at)
            passed[i] = tokens >= 1
            tokens -= bool(passed[i])
        state.update((float(tokens), float(last)))
        for i in range(0, len(times), 10_000):
            yield pd.DataFrame({"key": key[0], "at": times[i : i + 10_000], "allowed": passed[i : i + 10_000]})

    kind = requests.schema["key"].dataType.simpleString()
    return requests.groupBy("key").applyInPandasWithState(step, f"key {kind}, at double, allowed boolean", "tokens double, last double", "append", "NoTimeout")


def append_log(log: DataFrame, path: str, every: str = "1 second", rows: int | None = None):
    """A writer that appends micro-batches to a log by month."""
    from quillspan.sources.readers import append_by_month

    return log.writeStream.trigger(processingTime=every).foreachBatch(lambda batch, _: append_by_month(batch, path))


def drain(stream: DataFrame, mode: str = "append", sink: Callable | None = None) -> DataFrame:
    """What the stream makes of everything its source has now, as a written table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query = writer.format("parquet").start(f"{folder}/rows") if sink is None else writer.foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
