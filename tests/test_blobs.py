"""Blobs: put, get, delete, foreign tenants, aborted writes."""

import random
import uuid

from quillspan.functions.tables import shared_folder
from quillspan.sources import blobs, versions_store

ROW = "client_id string, key string, content_type string, data binary"


def test_blobs_against_a_dictionary(spark):
    rng, path, want = random.Random(11), f"{shared_folder(spark)}/test-{uuid.uuid4().hex}", {}
    for version in range(6):
        if version % 3 == 2:
            gone = [("a", "k1"), ("b", None), ("nobody", "k1"), (None, "k2")]
            assert blobs.delete(spark.createDataFrame(gone, "client_id string, key string"), path, version)
            want = {k: v for k, v in want.items() if k != ("a", "k1") and k[0] != "b"}
        else:
            new = {(c, f"k{rng.randint(0, 4)}"): rng.randbytes(rng.choice([0, 9, 5000])) for c in "abc" for _ in range(3)}
            rows = [(c, k, "x", v) for (c, k), v in new.items()] + [(None, "k", "x", b"1"), ("a", None, "x", b"1"), ("a", "k9", "x", None)]
            rows += [("c", k, "x", v) for (c, k), v in new.items() if c == "c"]
            assert blobs.put(spark.createDataFrame(rows, ROW).repartition(3), path, version)
            assert not blobs.put(spark.createDataFrame([("a", "k7", "x", b"late")], ROW), path, version)
            want |= new
        got = blobs.current(spark, path).collect()
        assert {(r.client_id, r.key): bytes(r.data) for r in got} == want and len(got) == len(want)
        assert all(r.size == len(r.data) for r in got)
    versions_store.put_rows(spark.createDataFrame([("a", "k8", "x", 1, "s", False, b"1")], "client_id string, key string, content_type string, size long, sha256 string, deleted boolean, data binary"), path, 99, ["client_id", "key"])
    assert ("a", "k8") not in {(r.client_id, r.key) for r in blobs.current(spark, path).collect()}
    there = next(k for k in want if k[0] == "c")
    asked = [("c", f"pg://c/{there[1]}"), ("a", f"pg://c/{there[1]}"), ("c", "pg://c/none"), ("c", "pg://c"), ("c", "s3://x"), ("c", None)]
    found = {(r.client_id, r.uri): (None if r.data is None else bytes(r.data), r.problem) for r in blobs.get(spark.createDataFrame(asked, "client_id string, uri string"), path).collect()}
    assert found == dict(zip(asked, [(want[there], None), (None, "foreign"), (None, "missing"), (None, "malformed"), (None, "not an address"), (None, "not an address")], strict=True))
