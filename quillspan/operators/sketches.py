"""Sketches that are stored by day and united later: distinct keys and quantiles within stated bounds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Base-2 logarithm of the registers; the relative standard error of distinct counts is 1.04 / sqrt(2 ** REGISTERS).
REGISTERS = 14
#: Largest relative error of a quantile.
ERROR = 0.01


def distinct_error(deviations: float = 3) -> float:
    return deviations * 1.04 / math.sqrt(2**REGISTERS)


def distinct_sketches(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, keys): one binary sketch of the distinct values of a column for each group; nulls don't count."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(key, F.lit(REGISTERS)).alias("keys"))


def distinct_united(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): about how many distinct values the sketches of each group have seen together."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("n"))


def value_bucket(value: Column, error: float = ERROR) -> Column:
    """The number of the interval (g^(i-1), g^i] with g = (1 + error) / (1 - error) that has a value's size.

    0 has a bucket of its own, below all positive ones and above all negative ones, whose numbers
    are mirrored. Null for null and non-finite values.
    """
    width, low = math.log((1 + error) / (1 - error)), 1 << 20
    size = F.ceil(F.ln(F.abs(value)) / width).cast("long") + low
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(value.isNull() | bad, F.lit(None)).when(value == 0, F.lit(0)).otherwise(F.when(value > 0, size).otherwise(-size)).cast("long")


def bucket_value(bucket: int, error: float = ERROR) -> float:
    """The value of a bucket that is nowhere in it farther off than the error."""
    if not bucket:
        return 0.0
    g = (1 + error) / (1 - error)
    return math.copysign(math.exp((abs(bucket) - (1 << 20)) * math.log(g) - math.log((g + 1) / 2)), bucket)


def quantile_sketches(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, bucket, n): how many values of each group a bucket has. A group has at most some 142 000 buckets, all doubles together."""
    return rows.groupBy(*by, value_bucket(F.col(value).cast("double")).alias("bucket")).agg(F.count("*").alias("n")).where("bucket is not null")


@F.pandas_udf(DoubleType())
def sketch_quantile(bucket: pd.Series, n: pd.Series, q: pd.Series) -> float:
    """The quantile of a group's buckets: the value with floor(q * (rows - 1)) values before it, within the error."""
    if not len(bucket):
        return float("nan")
    counts = n.groupby(bucket).sum().sort_index()
    rank = math.floor(float(q.iloc[0]) * (int(counts.sum()) - 1))
    return bucket_value(int(counts.index[(counts.cumsum() > rank).to_numpy().argmax()]))


def register(spark: SparkSession) -> None:
    """``sketch_quantile(bucket, n, q)`` as an aggregate of SQL."""
    spark.udf.register("sketch_quantile", sketch_quantile)


def quantiles_united(sketches: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by, value): a quantile of all values that the sketches of each group have seen together."""
    united = sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    return united.groupBy(*by).agg(sketch_quantile("bucket", "n", F.lit(q)).alias("value"))
