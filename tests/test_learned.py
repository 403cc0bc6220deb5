"""The trained classifier, sketches, repeatable writes and table functions against brute force."""

import math
import random
import re
import uuid
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import tabular
from quillspan.functions.tables import kept, shared_folder
from quillspan.operators import classifier, sketches
from quillspan.sources import versions_store


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


@pytest.mark.parametrize("text", ["", None, "a", "Ab  cd\tefghij", "año Ünïcode 😀😀x ab", "one two one two one", " x " * 50])
def test_features_are_those_of_words(text):
    low = (text or "").lower()
    chars = Counter(f" {w} "[i : i + n] for w in low.split() for n in (3, 4, 5) for i in range(len(w) + 3 - n))
    words = re.findall(r"\b\w\w+\b", low)
    pairs = Counter(words) + Counter(zip(words, words[1:], strict=False))
    idx, tf = classifier.features(text, 1 << 30)
    assert sorted(tf[idx < 1 << 30]) == sorted(chars.values()) and sorted(tf[idx >= 1 << 30]) == sorted(pairs.values())
    v = classifier.weighed(idx, tf, np.ones(1), 1 << 30) if not len(idx) else None
    assert v is None or not len(v)


def test_machine_and_curve_are_at_their_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 8)), np.where(rng.random(60) < 0.4, 1.0, -1.0)
    x[y > 0, 0] += 1
    w = classifier.fit_svm([(np.arange(8), r) for r in x], y, 8, rounds=5000, enough=1e-9)
    one = np.hstack([x, np.ones((60, 1))])
    slope = w - 2 * (np.maximum(0, 1 - y * (one @ w)) * y) @ one
    assert np.abs(slope).max() < 1e-6
    scores = one @ w
    a, b = classifier.calibrated(scores, y)
    loss = lambda a, b: sum(-t * math.log(p) - (1 - t) * math.log(1 - p) for s, t in zip(scores, np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2)), strict=True) for p in [1 / (1 + math.exp(-a * s - b))])
    assert a > 0 and all(loss(a, b) <= loss(a + d, b + e) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


@pytest.mark.parametrize("classes", [2, 3])
def test_a_model_is_fitted_saved_and_loaded(spark, classes):
    rng = random.Random(4)
    about = {"PASSPORT": "passport nationality surname given names authority", "US_W2": "wages tips employer federal withheld", "MX_CURP": "clave unica registro poblacion nacimiento"}
    names = sorted(about)[:classes]
    text = lambda c: " ".join(rng.choice(about[c].split() + ["the", "of"]) for _ in range(12))
    rows = [(i, text(names[i % classes])) for i in range(90)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "wages")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([*[(i, names[i % classes]) for i in range(60)], (60, None), (None, names[0]), (10**6, names[0])], "doc_id long, label string")
    path = folder(spark)
    classifier.train(docs, labels, kept, buckets=1 << 12).write.parquet(path)
    model = classifier.load(spark.read.parquet(path))
    assert model.labels == names and abs(model.confidences("wages tips").sum() - 1) < 1e-9
    extra = docs.withColumn("label", F.lit(1)).withColumn("fold", F.lit("x"))
    got = classifier.classify(extra, model)
    assert got.columns == [*extra.columns, "doc_type", "doc_confidence"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == 93 and all(0 < r.doc_confidence <= 1 for r in found.values())
    assert sum(found[i].doc_type == names[i % classes] for i in range(60, 90)) >= 29
    assert found[900][-2:] == found[901][-2:]
    with pytest.raises(ValueError, match="five|5 rows"):
        classifier.train(docs, labels.where("doc_id < 6"), kept)


def test_without_a_model_anchors_decide(spark):
    docs = spark.createDataFrame([(1, "WAGE AND TAX STATEMENT form W-2"), (2, "nothing of the kind"), (3, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], classifier._ROW)
    got = {r.doc_id: (r.doc_type, r.doc_confidence) for r in classifier.classify(docs, classifier.load(empty)).collect()}
    assert got[1][0] == "US_W2" and got[2] == got[3] == ("UNKNOWN", 0.0)


def test_quality_is_learnt(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = classifier.load(classifier.train(docs, labels.where("pmod(doc_id, 5) <> 0"), kept, sample=400))
    held = classifier.classify(docs.join(labels.where("pmod(doc_id, 5) = 0"), "doc_id"), model).toPandas()
    right = (held["doc_type"] == held["label"].astype(str)).mean()
    most = held["label"].value_counts(normalize=True).max()
    print("held-out accuracy", right, "majority", most, len(held))
    assert right >= most


def test_quantiles_of_united_days_stay_within_the_error(spark):
    rng = random.Random(6)
    values = [rng.choice([-1, 1, 1]) * math.exp(rng.gauss(0, 9)) for _ in range(3000)] + [0.0] * 200 + [5e-324, 1.7e308, -1.7e308]
    rows = [("a", f"d{i % 7}", v) for i, v in enumerate(values)] + [("a", "d0", None), ("a", "d0", float("nan")), ("a", "d1", float("inf")), ("b", "d0", -2.0), ("c", "d0", None)]
    stored = sketches.quantile_sketches(spark.createDataFrame(rows, "k string, day string, v double"), ["k", "day"], "v")
    values.sort()
    for q in (0.0, 0.05, 0.33, 0.5, 0.9, 0.999, 1.0):
        got = {r.k: r.value for r in sketches.quantiles_united(stored, ["k"], q).collect()}
        want = values[math.floor(q * (len(values) - 1))]
        assert abs(got["a"] - want) <= sketches.ERROR * abs(want) * (1 + 1e-9) + 5e-324 and abs(got["b"] + 2) <= 0.02 and "c" not in got
    assert sketches.quantiles_united(stored.where("false"), ["k"], 0.5).count() == 0


def test_distinct_keys_of_united_days_stay_within_the_error(spark):
    rows = spark.range(90_000).selectExpr("pmod(id, 9) as day", "case when id < 89000 then pmod(id * 7919, 40000) end as key")
    stored = kept(sketches.distinct_sketches(rows, ["day"], "key"))
    got = sketches.distinct_united(stored.withColumn("all", F.lit(1)), ["all"]).first().n
    exact = rows.agg(F.count_distinct("key")).first()[0]
    assert abs(got - exact) <= sketches.distinct_error() * exact and stored.count() == 9


def test_versions_are_whole_or_unseen(spark):
    path = folder(spark)
    rows = lambda a, b: spark.range(a, b).withColumn("name", F.concat(F.lit("n"), "id"))
    seen = lambda: sorted((r.version, r.id) for r in versions_store.read(spark, path).collect())
    versions_store.put_rows(rows(0, 40), path, 7, ["id"], buckets=4)
    assert seen() == [] and not versions_store.is_complete(spark, path, 7)
    assert versions_store.put(rows(5, 8), path, 7, ["id"], buckets=4)
    assert seen() == [(7, 5), (7, 6), (7, 7)]
    assert not versions_store.put(rows(0, 99), path, 7, ["id"], buckets=4) and len(seen()) == 3
    write = versions_store.batches(path, ["id"], buckets=4)
    for number in (8, 9, 8):
        write(rows(number, number + 2), number)
    assert seen() == [(7, 5), (7, 6), (7, 7), (8, 8), (8, 9), (9, 9), (9, 10)]
    assert versions_store.put(rows(0, 0), path, 10, ["id"]) and versions_store.is_complete(spark, path, 10) and len(seen()) == 7


def test_a_replayed_stream_changes_nothing(spark):
    path = folder(spark)
    spark.range(50).write.parquet(f"{path}/source")
    for run in ("first", "again"):
        stream = spark.readStream.schema("id long").parquet(f"{path}/source")
        stream.writeStream.foreachBatch(versions_store.batches(f"{path}/out", ["id"])).option("checkpointLocation", f"{path}/{run}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in versions_store.read(spark, f"{path}/out").collect()) == list(range(50))


def test_sets_are_replaced_whole(spark):
    rng, path, want = random.Random(8), folder(spark), {}
    for _ in range(4):
        owners = rng.sample("abcdefgh", 4)
        own = {o: sorted(rng.sample(range(30), rng.choice([0, 0, 3]))) for o in owners}
        rows = spark.createDataFrame([(o, v) for o, vs in own.items() for v in vs], "owner string, v long")
        versions_store.replace_sets(rows, spark.createDataFrame([(o,) for o in owners], "owner string"), path, "owner", buckets=3)
        want |= own
        got = sorted((r.owner, r.v) for r in versions_store.sets(spark, path).collect())
        assert got == sorted((o, v) for o, vs in want.items() for v in vs)
    with pytest.raises(ValueError, match="not replaced"):
        versions_store.replace_sets(spark.createDataFrame([("a", 1), (None, 2)], "owner string, v long"), spark.createDataFrame([("a",)], "owner string"), path, "owner", buckets=3)


def test_runs_by_a_table_function(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["x", "y", None])) for i in range(200)]
    spark.createDataFrame(rows, "who string, at int, state string").repartition(5).createOrReplaceTempView("run_rows")
    tabular.register(spark)
    got = spark.sql("SELECT * FROM state_runs(TABLE(run_rows) PARTITION BY who ORDER BY at, key => 'who', at => 'at', state => 'state')")
    assert dict(got.dtypes) == {"who": "string", "state": "string", "started": "int", "ended": "int", "n": "bigint"}
    want = Counter()
    for who in ("a", "b", None):
        for state, run in groupby([r for r in rows if r[0] == who], key=lambda r: r[2]):
            at = [r[1] for r in run]
            want[who, state, at[0], at[-1], len(at)] += 1
    assert Counter(tuple(r) for r in got.collect()) == want
    with pytest.raises(Exception, match="no column nowhere"):
        spark.sql("SELECT * FROM state_runs(TABLE(run_rows) PARTITION BY who, key => 'who', at => 'at', state => 'nowhere')").collect()


def test_extractors_are_called_in_sql(spark):
    rows = [("k1", "A", "1 2", 5), ("k2", "B", "3", 6), ("k3", None, "4", 7), ("k4", "A", None, 8), (None, "A", "9", 9)]
    spark.createDataFrame(rows, "ref string, doc_type string, text string, value int").createOrReplaceTempView("typed")
    tabular.register_extractors(spark, {"A": lambda t: [("n", x) for x in t.split()]}, "facts_here")
    got = spark.sql("SELECT * FROM facts_here(TABLE(typed), key => 'ref')")
    assert got.columns == ["ref", "attribute_key", "value"] and sorted(map(tuple, got.collect()), key=str) == [("k1", "n", "1"), ("k1", "n", "2"), (None, "n", "9")]
