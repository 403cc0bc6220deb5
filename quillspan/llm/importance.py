"""Importance resampling: documents drawn by how much their hashed n-grams look like a target's."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import written
from quillspan.llm.ordered import numbered

#: Memory of the database that each Python worker holds; it spills nowhere.
DATABASE_MEMORY = "700MB"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _crc32(features: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(f.encode()) for f in features.to_pylist()], pa.int64())


def count_sql(longest: int, buckets: int) -> str:
    """DuckDB SQL over ``rows`` (i, doc_id, text): words unnested, n-grams by windows, distinct features hashed once."""
    grams = []
    for n in range(1, longest + 1):
        feature = "word" + "".join(f" || ' ' || lead(word, {k}) OVER g" for k in range(1, n))
        grams.append(f"SELECT i, {feature} AS feature FROM words" + (" WINDOW g AS (PARTITION BY i ORDER BY nth)" if n > 1 else ""))
    return f"""
        WITH words AS MATERIALIZED (
            SELECT i, unnest(w) AS word, generate_subscripts(w, 1) AS nth
            FROM (SELECT i, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM rows)),
        grams AS (SELECT i, feature, count(*) AS n FROM ({" UNION ALL ".join(grams)}) WHERE feature IS NOT NULL GROUP BY i, feature),
        hashed AS (SELECT feature, (crc32(feature) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT feature FROM grams)),
        counted AS (SELECT i, bucket, sum(n)::BIGINT AS n FROM grams JOIN hashed USING (feature) GROUP BY i, bucket),
        lists AS (SELECT i, sum(n)::BIGINT AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM counted GROUP BY i),
        sizes AS (SELECT i, count(*) AS n_words FROM words GROUP BY i)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
        FROM rows LEFT JOIN lists USING (i) LEFT JOIN sizes USING (i)
    """


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts) of every row of (doc_id, text), spilled to Parquet in the shared folder.

    Each task counts its batches in a DuckDB of its own, so a task holds one batch, or one text
    where that is larger.
    """
    sql = count_sql(longest, buckets)
    schema = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DATABASE_MEMORY, "temp_directory": ""})
        con.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            rows = pa.table([pa.array(range(batch.num_rows), pa.int64()), *batch.columns], names=["i", "doc_id", "text"])
            con.register("rows", rows)
            yield from con.sql(sql).to_arrow_table().cast(pa.schema(list(zip(names, types, strict=True)))).to_batches()
        con.close()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, schema), "bucket-counts")


def merged(counts: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of a spilled table; at most as many rows as there are buckets."""
    return counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """For each bucket floor(1000 ln of its share of the target over its share of the raw rows), both smoothed by one.

    The driver gets as many numbers as there are buckets, which is a parameter.
    """
    none = F.lit(0).cast("long")
    both = merged(raw).select("bucket", F.col("n").alias("s"), none.alias("t")).unionByName(merged(target).select("bucket", none.alias("s"), F.col("n").alias("t")))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), none.alias("s"), none.alias("t"))
    totals = written(both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "bucket-totals")
    all_s, all_t = totals.agg(F.sum("s"), F.sum("t")).first()
    share = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    found = {r["bucket"]: r["gain"] for r in totals.select("bucket", F.floor(1000 * F.ln(share)).alias("gain")).collect()}
    return [found[b] for b in range(buckets)]


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, a function of seed and doc_id; a null doc_id hashes as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); other columns are left out.

    ``target`` (text) is the distribution to draw for. Features are all runs of up to
    ``longest`` words, hashed into ``buckets``; weight sums the gains of a text's features, score
    adds the noise of its doc_id. Of the N rows with at least ``least_words`` words the
    floor(percent * N / 100) best scores are drawn and ranked, ties to the smaller doc_id, null
    first. A null or empty text has no feature and weight 0; repeated rows rank each. An empty
    table gives no rows, an empty target leaves all gains to the smoothing.
    """
    raw = bucket_counts(docs, longest, buckets)
    aim = bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gain = F.split(F.lit(",".join(map(str, gains(raw, aim, buckets)))), ",").cast("array<bigint>")
    weight = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: n * F.get(gain, b)), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = raw.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least_words
    drawn = percent * raw.where(fit).count() // 100
    best = numbered(scored.where(fit), [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("n_features"), F.col("weight")], "rank")
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
