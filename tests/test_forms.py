"""Finders of forms by class, on texts that are awkward."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions.dates import first_date
from quillspan.operators import extract

TEXTS = [
    (1, "CA_T4", "EMPLOYER :\r\nEmployer: 12,000.00\nNom de l'employeur = Acme\nBox 14 none\nBox 14 CAD $12.50\ntotal income 12.50"),
    (2, "CA_NOA", "Balance\nAddress: x\nAdresse -- 1 rue"),
    (3, "CA_DRIVER_LICENSE", "Name 77\nno date"),
    (4, "CA_T4", ""),
    (5, "CA_T4", None),
    (6, None, "Employer: Acme"),
    (7, "PASSPORT", "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"),
    (8, "PASSPORT", "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"),
    (9, "CA_SIN", "130-692-544 130692544"),
]


def test_fields_by_class(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, doc_type string, text string")
    rows = extract.extract_by_type(docs, year=2024).select("doc_id", "attribute_key", "value", "value_num").collect()
    got = {n: sorted((r.attribute_key, r.value if r.value_num is None else r.value_num) for r in rows if r.doc_id == n) for n in range(1, 10)}
    assert got[1] == [("income.amount", 12.5), ("income.employer", "Acme")]
    # "Address" stands in "Mailing address" alone; the second address has more than three characters.
    assert got[2] == [("address.mailing", "1 rue")]
    assert got[3] == []
    assert got[4] == got[5] == got[6] == got[8] == []
    assert ("identity.date_of_birth", "1974-08-12") in got[7] and ("doc.expiry_date", "2012-04-15") in got[7] and len(got[7]) == 7
    assert got[9] == [("id.sin", "130-692-544")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("on 2024/02/30 it", "2024/02/30"), ("at 03/25/1980", "1980-03-25"), ("at 25/03/1980", "1980-03-25"), ("Sept. 4, 1980", "1980-09-04"), ("4 March 1980", "1980-03-04"),
        ("Foo 4, 1980", "Foo 4, 1980"), ("31 February 1980", "31 February 1980"), ("none", None), ("", None), (None, None),
    ],
)
def test_first_date(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(first_date(F.col("t"))).first()[0] == want
