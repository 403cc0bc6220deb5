"""URL filters: host-suffix and path-prefix expressions against hashed rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import ascii_lower, written

#: (verdict, host, path)
Rule = tuple[str, str, str]

#: Hex digits of a digest that the equi-join compares: 32 bits.
PREFIX_DIGITS = 8

#: Rows of a url from which on they are dealt over SALTS tasks; fewer are at home in one.
HOT_ROWS = 1 << 16
SALTS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Every host suffix of at most ``labels`` labels, joined to every path prefix of one of ``lengths``.

    Longer suffixes and other prefixes equal no rule, so leaving them out loses nothing and
    bounds the number of expressions for any url.
    """
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, -n, n), "."),
    )
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    return F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(s, p))))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rule, verdict, rule_digest, prefix): one row for each rule string; of equal ones the first counts."""
    first = {f"{host}{path}": verdict for verdict, host, path in reversed(rules)}
    table = spark.createDataFrame(list(first.items()), "rule string, verdict string")
    digest = F.sha2("rule", 256)
    return table.select("rule", "verdict", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict added (columns of those names are replaced).

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the
    rule with the longest string wins. Where none fits, rule is null and the verdict ``default``.

    Distinct urls are expanded, so a url that holds a third of all rows is expanded once. Its
    rows are dealt over salts by the partition they come in before they meet its verdict; urls
    so frequent are at most one for each HOT_ROWS rows. The
    expressions meet the rules on the first 32 bits of their SHA-256 digests; equal full digests
    then confirm. The rule side is small in any real list and its size is known to the optimizer,
    which broadcasts it below the threshold and shuffles both sides beyond it.

    Null urls and urls without ``://`` have an empty host and path and no rule. Empty tables give
    no rows; repeated rows each keep their own row; other columns pass through.
    """
    spark = pages.sparkSession
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if not rules:
        return pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = max(host.count(".") + 1 for _, host, _ in rules)
    lengths = sorted({len(path) for _, _, path in rules})
    urls = written(pages.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).groupBy("_url").agg(F.count("*").alias("_n")), "urls")
    wanted = urls.select("_url", F.explode(expressions(host_of(F.col("_url")), path_of(F.col("_url")), labels, lengths)).alias("expression"))
    hashed = wanted.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    fits = hashed.join(rule_table(spark, rules), "prefix").where(F.col("digest") == F.col("rule_digest"))
    best = fits.groupBy("_url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("_best"))
    hot = written(urls.where(F.col("_n") > HOT_ROWS).select("_url"), "hot-urls")
    found = best.select("_url", F.lit(0).alias("_salt"), "_best").unionByName(
        best.join(hot, "_url", "left_semi").select("_url", F.explode(F.sequence(F.lit(1), F.lit(SALTS - 1))).alias("_salt"), "_best")
    )
    rows = pages.select(F.struct(*own).alias("_row"), F.col(url).alias("_key"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_part"))
    dealt = rows.join(hot.withColumnRenamed("_url", "_hot"), F.col("_key") == F.col("_hot"), "left").withColumn("_dealt", F.when(F.col("_hot").isNotNull() | F.col("_key").isNull(), F.col("_part")).otherwise(0))
    judged = dealt.join(found, (F.col("_key") == F.col("_url")) & (F.col("_dealt") == F.col("_salt")), "left")
    return judged.select("_row.*", host_of(F.col("_key")).alias("host"), path_of(F.col("_key")).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
