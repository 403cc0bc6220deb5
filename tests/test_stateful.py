"""Streams with state: expiry over triggers, buffers by size and time, feeds that resume."""

import random
import time
import uuid
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspan.functions.tables import shared_folder
from quillspan.streaming import feed, stateful, streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def test_refusals_expire_over_three_triggers(spark):
    rng = random.Random(2)
    path, rows = folder(spark), []
    for trigger in range(3):
        own = [("a", 100 * trigger + s, False) for s in (0, 10, 59)] + [(k, 100 * trigger + s, rng.random() < 0.3) for k in "bcd" for s in rng.sample(range(100), 20)]
        rng.shuffle(own)
        rows.append(own)
        data = [(k, START + timedelta(seconds=s), known) for k, s, known in own]
        spark.createDataFrame(data, "key string, at timestamp, known boolean").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times
    with stateful.keyed_state(spark):
        got = streams.drain(stateful.refusals(streams.source(spark, path, files=1), seconds=60, late="1 second")).collect()
    want, until = Counter(), {}
    for own in rows:
        for k, s, known in sorted(own, key=lambda r: r[1]):
            if s < until.get(k, -1):
                outcome = "refused again"
            elif known:
                outcome = "accepted"
            else:
                outcome, until[k] = "refused", s + 60
            want[k, s, outcome] += 1
    found = Counter((r.key, int((r.at.replace(tzinfo=timezone.utc) - START).total_seconds()), r.outcome) for r in got)
    seconds = lambda c: Counter((k, s) for k, s, _ in c.elements())
    assert seconds(found) == seconds(want) and any(o == "accepted" for _, _, o in found)
    assert {x: n for x, n in found.items() if x[0] == "a"} == {("a", 100 * t + s, "refused again" if s else "refused"): 1 for t in range(3) for s in (0, 10, 59)}
    assert found == want


@pytest.mark.parametrize("strict", [False, True])
def test_a_buffer_flushes_by_size_and_time(spark, strict):
    source, out = folder(spark), folder(spark)
    rows = [("x", f"x{i}") for i in range(7)] + [("y", "y0"), (None, "n0")] + [("z", f"z{i}") for i in range(13 if strict else 9)]
    spark.createDataFrame(rows, "key string, row string").coalesce(1).write.parquet(source)
    stream = stateful.buffered(streams.source(spark, source), size=3, wait_ms=1500, capacity=9 if not strict else 12, strict=strict)
    with stateful.keyed_state(spark):
        query = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(processingTime="500 milliseconds").format("parquet").start(f"{out}/rows")
    try:
        if strict:
            with pytest.raises(Exception, match="BufferFull"):
                query.awaitTermination(60)
            return
        end = time.time() + 60
        while time.time() < end:
            time.sleep(1)
            got = spark.read.schema(stream.schema).parquet(f"{out}/rows").collect() if query.lastProgress else []
            if len(got) >= len(rows):
                break
    finally:
        query.stop()
    assert Counter(r.row for r in got) == Counter(r for _, r in rows)
    batches = {(r.key, r.batch): [] for r in got}
    for r in got:
        batches[r.key, r.batch].append(r.reason)
    assert batches["x", 0] == batches["x", 1] == ["size"] * 3 and batches["x", 2] == batches["y", 0] == batches[None, 0] == ["time"]
    assert [batches["z", i] for i in range(3)] == [["size"] * 3] * 3


def test_rows_beyond_the_capacity_come_out_as_dropped(spark):
    source = folder(spark)
    spark.createDataFrame([("x", f"x{i}") for i in range(8)], "key string, row string").coalesce(1).write.parquet(source)
    out = folder(spark)
    stream = stateful.buffered(streams.source(spark, source), size=3, wait_ms=3_600_000, capacity=6)
    with stateful.keyed_state(spark):
        query = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(processingTime="500 milliseconds").format("parquet").start(f"{out}/rows")
    end, got = time.time() + 60, []
    while len(got) < 8 and time.time() < end:
        time.sleep(1)
        got = spark.read.schema(stream.schema).parquet(f"{out}/rows").collect() if query.lastProgress else []
    query.stop()
    assert Counter((r.batch, r.reason) for r in got) == {(0, "size"): 3, (1, "size"): 3, (None, "dropped"): 2}


def test_a_feed_resumes_without_loss_or_repeat(spark, monkeypatch):
    monkeypatch.setattr(feed, "IN_ONE_PARTITION", 7)
    log, own = folder(spark), folder(spark)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("change_seq"), F.concat(F.lit("v"), "id").alias("name")).repartition(2)
    seen = lambda df: sorted((r.change_seq, r.name) for r in df.collect())
    rows(1, 50).write.parquet(log)
    stream = lambda after=0: feed.changes(spark, f"file://{log.removeprefix('file://')}", after)
    assert seen(feed.consume(stream(), own)) == [(i, f"v{i}") for i in range(1, 50)]
    assert len(seen(feed.consume(stream(), own))) == 49
    rows(50, 90).write.mode("append").parquet(log)
    assert seen(feed.consume(stream(), own)) == [(i, f"v{i}") for i in range(1, 90)]
    assert seen(feed.consume(stream(60), folder(spark))) == [(i, f"v{i}") for i in range(61, 90)]
