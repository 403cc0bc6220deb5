"""Relational operators that a complete engine has beside those of the document domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row's time, for equal ``by``.

    One shuffle: both sides are stacked and the last value is carried along the time order, the
    right side first among equal times.
    """
    own = left.columns
    stacked = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    other = right.select(by, at, F.col(value).alias("_v")).withColumn("_left", F.lit(0))
    both = stacked.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("_left = 1").select(*own, value)


def histogram(rows: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts of values up to each bound, by group, from one aggregate."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*counts)
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)])).alias("h")).select(*by, "h.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key over both sides; incoming rows win over equal ages."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("r")).select(*keys, "r.*").select(*existing.columns)


def runs(rows: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """``rows`` with first_of_run: the key differs from the row before."""
    before = F.lag(key).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("first_of_run", ~F.coalesce(before.eqNullSafe(F.col(key)), F.lit(False)))


def sessions(events: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """(by, started, ended, n): events of a key no further apart than the gap."""
    window = F.session_window(F.col(at).cast("timestamp"), f"{gap_seconds} seconds")
    return events.groupBy(by, window.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def tumbling(events: DataFrame, at: str, width: str, *measures: Column) -> DataFrame:
    return events.groupBy(F.window(F.col(at).cast("timestamp"), width).alias("w")).agg(*measures)
