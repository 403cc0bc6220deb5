"""Dates of machine-readable zones."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspan.functions import ids
from quillspan.operators import extract


@pytest.mark.parametrize(
    ("digits", "birth", "want"),
    [
        ("740812", True, date(1974, 8, 12)), ("240101", True, date(2024, 1, 1)), ("250101", True, date(1925, 1, 1)), ("740101", False, date(2074, 1, 1)), ("750101", False, date(1975, 1, 1)),
        ("000229", True, date(2000, 2, 29)), ("010229", True, None), ("991301", True, None), ("<<<<<<", True, None), ("7408", True, None), ("", False, None), (None, True, None),
    ],
)
def test_zone_dates(spark, digits, birth, want):
    rows = spark.createDataFrame([(digits,)], "d string")
    assert rows.select(extract.zone_date(F.col("d"), birth, 2024)).first()[0] == want


def test_documents_without_a_zone_have_no_facts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "P<UTO"), (None, "x\n" * 50)], "doc_id long, text string")
    assert extract.passport_facts(docs, 2024).count() == 0


def test_check_digits_compute_their_text_once(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<") for _ in range(rng.randint(1, 45))) for _ in range(200)]
    value = lambda c: int(c, 36) if c != "<" else 0
    want = {t: sum(value(c) * (7, 3, 1)[i % 3] for i, c in enumerate(t)) % 10 for t in texts}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", ids.mrz_check(F.upper("t")).alias("n"))
    assert {r.t: r.n for r in found.collect()} == want
    assert found._jdf.queryExecution().analyzed().toString().count("upper(") == 1
    odd = spark.createDataFrame([("",), (None,), ("a",), ("9\n",)], "t string").select(ids.mrz_check(F.col("t")))
    assert [r[0] for r in odd.collect()] == [None, None, -7, 0]
