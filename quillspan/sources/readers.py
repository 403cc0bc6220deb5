"""Uploads as lines: kinds by content, texts, word-processor files; blob addresses; audit exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".heic"]
_WORDS_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _ends(name: Column, *endings: str) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | F.endswith(name, F.lit(e))
    return out


def readable(content: Column, mime: Column) -> Column:
    """The text of UTF-8 bytes of which nine tenths are printable, or of anything called text; else null."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    bad = F.regexp_count(text, F.lit(r"[\p{Cntrl}\p{Cn}\p{Co}\p{Cs}&&[^\s]]"))
    plain = (F.trim(text, F.lit(" \t\r\n")) != "") & (bad <= 0.1 * F.length(text))
    return F.when(F.startswith(F.lower(mime), F.lit("text")), F.make_valid_utf8(content.cast("string"))).when(plain, text)


def kind(content: Column, name: Column, mime: Column) -> Column:
    """pdf, docx, image, text or unknown, by magic numbers, type and file name, in this order."""
    low, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda magic: F.startswith(head, F.lit(magic))
    return (
        F.when(starts("255044462D") | F.contains(m, F.lit("pdf")) | _ends(low, ".pdf"), "pdf")
        .when(_ends(low, ".docx") | F.contains(m, F.lit("word")), "docx")
        .when(starts("89504E47") | starts("FFD8FF") | F.startswith(m, F.lit("image/")) | _ends(low, *IMAGE_ENDINGS), "image")
        .when(F.startswith(m, F.lit("text")) | readable(content, F.coalesce(mime, F.lit(""))).isNotNull(), "text")
        .otherwise("unknown")
    )


def docx_parts(content: bytes) -> list[str]:
    """Paragraphs outside tables, then table rows with two blanks between cells; nothing for broken files."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_WORDS_XML}body")
    except Exception:  # noqa: BLE001 - any broken file is an empty document
        return []
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORDS_XML}t")).strip()
    out = [said(p) for p in body.findall(f"{_WORDS_XML}p")]
    for row in body.iter(f"{_WORDS_XML}tr"):
        out.append("  ".join(c for c in map(said, row.findall(f"{_WORDS_XML}tc")) if c))
    return [x for x in out if x]


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: path, content, kind."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", kind(F.col("content"), F.col("path"), F.lit(None).cast("string")).alias("kind"))


def upload_lines(uploads: DataFrame) -> DataFrame:
    """(path, line_no, line): trimmed lines of texts by columns, of word-processor files by a batch function; others have none."""
    texts = uploads.where("kind = 'text'").select("path", F.posexplode(F.split(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n"), "\n")).alias("line_no", "line"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(p, i, line) for p, c in zip(x["path"], x["content"], strict=True) for i, line in enumerate(docx_parts(c))]
            yield pd.DataFrame(rows, columns=["path", "line_no", "line"])

    both = texts.unionByName(uploads.where("kind = 'docx'").select("path", "content").mapInPandas(words, "path string, line_no int, line string"))
    return both.withColumn("line", F.trim("line", F.lit(" \t\r"))).where("line <> ''")


def blob_address(uri: Column, client_id: Column) -> Column:
    """(client, key, problem) of ``pg://client/key``; another tenant's address has no key."""
    owner, key = (F.regexp_extract(uri, "(?s)^pg://([^/]*)/?(.*)$", i) for i in (1, 2))
    problem = F.when(~F.startswith(uri, F.lit("pg://")), "not an address").when((owner == "") | (key == ""), "malformed").when(owner != client_id, "foreign")
    return F.struct(owner.alias("client"), F.when(problem.isNull(), key).alias("key"), problem.alias("problem"))


def export_month(log: DataFrame, month: str, path: str) -> None:
    """One month (yyyy-MM) of an audit log as CSV with a heading, in the order of (ts, id)."""
    log.where(F.date_format("ts", "yyyy-MM") == month).orderBy("ts", "id").write.option("header", True).csv(path)


def append_by_month(log: DataFrame, path: str) -> None:
    """Append to an audit log that is laid out by month; nothing here overwrites."""
    log.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)
