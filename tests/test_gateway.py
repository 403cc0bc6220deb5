"""Calls of a model: batches, retries, failures that stay alone, facts of replies."""

import threading
import time

import pytest

from quillspan.operators import gateway
from quillspan.operators.gateway import Limits


def test_batches_are_retried_and_bad_texts_stay_alone():
    calls, lock = [], threading.Lock()

    def client(texts):
        with lock:
            calls.append(len(texts))
        if "bad" in texts or (len(texts) == 4 and calls.count(4) == 1):
            raise ValueError("no")
        return [t.upper() for t in texts]

    assert gateway.replies_of(client, ["a", "b", "c", "d"], Limits(wait=0)) == [(x, None) for x in "ABCD"] and calls == [4, 4]
    calls.clear()
    got = gateway.replies_of(client, ["a", "bad", "c"], Limits(attempts=2, wait=0))
    assert got == [("A", None), (None, "ValueError: no"), ("C", None)] and max(calls) == 3 and calls.count(3) == 2
    short = gateway.replies_of(lambda texts: texts[1:], ["a", "b"], Limits(attempts=1))
    assert short == [(None, "0 replies to 1 texts")] * 2


def test_rows_are_asked_in_batches(spark):
    def client(texts):
        time.sleep(0.01)
        if len(texts) > 5 or any(t.startswith("x") for t in texts):
            raise RuntimeError("refused")
        return [[len(t), len(texts)] for t in texts]

    rows = [(i, None if i % 10 == 0 else "x" if i % 10 == 1 else "y" * i, "old") for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, p string, extra string").repartition(3)
    got = {r.id: r for r in gateway.ask(frame, "p", client, "array<long>", Limits(batch=5, together=2, attempts=1)).collect()}
    assert len(got) == 60 and list(got[5].asDict()) == ["id", "p", "extra", "reply", "problem"]
    for i, r in got.items():
        if i % 10 == 0:
            assert r.reply is None and r.problem is None
        elif i % 10 == 1:
            assert r.reply is None and r.problem == "RuntimeError: refused"
        else:
            assert r.reply[0] == i and 1 <= r.reply[1] <= 5 and r.problem is None
    assert gateway.ask(frame.where("false"), "p", client).count() == 0


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"attributes": {"a": "1", "b": [1,2]}, "confidence": 0.7}', {("a", "1", 0.7), ("b", "[1,2]", 0.7)}),
        ('```json\n{" a ": "1", "confidence": "2"}\n```', {("a", "1", 1.0)}),
        ('{"a": 1, "confidence": true}', {("a", "1", 0.5)}),
        ('{"a": null, "confidence": -1}', {("a", None, 0.0)}),
        ('so: {"": "x", "a": "{"}', {("a", "{", 0.5)}),
        ("nothing", set()), ("", set()), (None, set()),
    ],
)
def test_facts_of_replies(spark, reply, want):
    got = gateway.facts(spark.createDataFrame([(1, reply), (1, reply)], "id long, reply string")).collect()
    assert {(r.attribute_key, r.value, r.confidence) for r in got} == want and len(got) == 2 * len(want)
    assert all((r.source, r.verification_status) == ("llm", "llm_unverified") for r in got)
