"""A training-corpus pipeline over ``documents``: five stages, each one operator of quillspan.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read back as the next one's docs. All but the last return the columns of ``documents``; other
columns of the input are left out. An empty table passes through all stages as an empty table.
Null, empty and blank texts are kept by the four filtering stages, as nothing speaks against
them, and are packed as an end token alone; a text that passage cutting empties is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from quillspan.llm.common import written
from quillspan.llm.queries import SEQUENCE, table
from quillspan.llm.tokens import vocabulary_path

#: Words of a shingle and least Jaccard similarity, in percent, of near copies.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Words of a passage that repeats.
PASSAGE_WORDS = 51
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. Each row is judged by its own text, repeated rows alike."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of lines go; every document stays.

    A document that would keep no line with a word is a copy as a whole and not by its lines: it
    is left whole to the next stage, which decides on documents. Rows of one doc_id lose the
    same lines; a null doc_id sorts first; null texts stay null.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS, F.col("text").alias("_whole")), SHINGLE_WORDS, SIMILAR_PERCENT)
    text = F.when(F.ltrim("text", F.lit(" \t\n\x0b\x0c\r")) == "", F.col("_whole")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: the one with the smallest doc_id.

    Rows with a null doc_id belong to no group and stay. Of rows with one doc_id and one text the
    one with the least (lang, source, n_chars), nulls first, stays; different texts of a doc_id
    that stays all stay.
    """
    table(spark, sf_dir, "documents")
    joined = ngram_join.similar_documents(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = written(joined.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    again = written(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "repeated-ids")
    if not again.limit(1).count():
        return kept
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_row")).select("doc_id", "text", "_row.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(one.select(*COLUMNS))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 51 words and more that occur more than once are cut from every document that has them.

    A document that has no word left behind its cuts goes; one that was blank before stays, and
    so does every other. Repeated rows count as documents of their own.
    """
    table(spark, sf_dir, "documents")
    cut = suffix_dedup.cut_passages(docs.select(*COLUMNS), PASSAGE_WORDS)
    left = cut.where("n_cut = 0 or n_cut < n_words").withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences; those longer than a sequence are cut, repeated rows are packed each."""
    table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", "text"), SEQUENCE, make=packing.piece_cutter(vocabulary_path(), SEQUENCE))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_copies),
    ("suffix_array_dedup", cut_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the language model, the tokenizer and the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
