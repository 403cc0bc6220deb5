"""Readers, tenant access, audit files, and streams against their batch forms."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.operators import queue, service
from quillspan.sources import readers, tables
from quillspan.streaming import streams


def docx(paragraphs, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    xml = f'<w:document xmlns:w="{w}"><w:body>{"".join(map(para, paragraphs))}<w:tbl>{table}</w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\n\r\n  two ñ \n".encode())
    (tmp_path / "b.docx").write_bytes(docx(["First", ""], [["x", "y"], ["", "z"]]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.bin").write_bytes(bytes(range(256)))
    (tmp_path / "e").write_bytes(b"%PDF-1.7")
    uploads = readers.read_uploads(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in uploads.collect()} == {"a.txt": "text", "b.docx": "docx", "c.docx": "docx", "d.bin": "unknown", "e": "pdf"}
    lines = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in readers.upload_lines(uploads).collect())
    assert [(p, line) for p, _, line in lines] == [("a.txt", "one"), ("a.txt", "two ñ"), ("b.docx", "First"), ("b.docx", "x  y"), ("b.docx", "z")]


def test_tenants_see_their_rows_only(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "client_id string, n int")
    assert [r.n for r in tables.for_tenant(df, "a").collect()] == [1] and tables.for_tenant(df, None).count() == 0


def test_audit_log_appends_and_exports(spark, tmp_path):
    log = spark.sql("select 1L as id, timestamp'2024-01-31 10:00:00' as ts union all select 2L, timestamp'2024-02-01 00:00:00'")
    for _ in range(2):
        readers.append_by_month(log, f"{tmp_path}/log")
    again = spark.read.parquet(f"{tmp_path}/log")
    assert again.count() == 4 and again.where("month = '2024-01'").count() == 2
    readers.export_month(log, "2024-02", f"{tmp_path}/out")
    assert [r.id for r in spark.read.option("header", True).csv(f"{tmp_path}/out").collect()] == ["2"]


@pytest.mark.parametrize("files", [1, 5])
def test_stream_of_requests_equals_the_batch(spark, tmp_path, files):
    rows = spark.range(300).select((F.col("id") % 7).alias("key"), F.col("id").cast("double").alias("at"))
    for i in range(files):
        rows.where((F.col("at") >= 300 * i / files) & (F.col("at") < 300 * (i + 1) / files)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.source(spark, f"{tmp_path}/in", files=None)
    got = streams.drain(streams.token_bucket(stream, 0.1, 2)).groupBy("key").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))
    want = queue.token_bucket(rows, 0.1, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("key", "n", "allowed").collect()))


def test_amounts_end_after_three_digits_without_groups(spark):
    got = spark.createDataFrame([("$54,321.00 and 12345.67",)], "t string").select(service.amounts(F.col("t"))).first()[0]
    assert got == [54321.0, 123.0]


def test_stream_bucket_takes_a_trigger_in_order_of_time_with_any_key(spark, tmp_path):
    rows = [("k", float(t)) for t in (10, 0, 5, 30)] + [("other", 1.0)]
    spark.createDataFrame(rows, "key string, at double").coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = streams.drain(streams.token_bucket(streams.source(spark, f"{tmp_path}/in"), 0.1, 1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.key, r.at, r.allowed) for r in got) == [("k", 0.0, True), ("k", 5.0, False), ("k", 10.0, True), ("k", 30.0, True), ("other", 1.0, True)]
