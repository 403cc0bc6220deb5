"""Tables of versions whose writes can be repeated: rows by hash bucket, a mark when a version is whole.

One writer at a time. A version is seen by readers when its mark is there; a write that stopped
before leaves rows that no reader sees and that the next attempt replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.tables import kept

BUCKETS = 32
_MARKS = "version long, n_rows long"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table of a folder, or None where there is none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def is_complete(spark: SparkSession, folder: str, version: int) -> bool:
    marks = _read(spark, f"{folder}/marks", _MARKS)
    return marks is not None and bool(marks.where(F.col("version") == version).limit(1).count())


def put_rows(rows: DataFrame, folder: str, version: int, keys: list[str], buckets: int = BUCKETS) -> None:
    """The rows of a version without its mark; those of an earlier attempt go, whatever buckets they had."""
    rows.withColumn("bucket", _bucket(keys, buckets)).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{folder}/rows/version={version}")


def complete(spark: SparkSession, folder: str, version: int) -> None:
    """Marks a version as whole, with the number of its rows."""
    rows = _read(spark, f"{folder}/rows/version={version}")
    n = 0 if rows is None else rows.count()
    spark.createDataFrame([(version, n)], _MARKS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/mark={version}")


def put(rows: DataFrame, folder: str, version: int, keys: list[str], buckets: int = BUCKETS) -> bool:
    """Writes and marks a version; false, and nothing done, if it is whole already."""
    if is_complete(rows.sparkSession, folder, version):
        return False
    put_rows(rows, folder, version, keys, buckets)
    complete(rows.sparkSession, folder, version)
    return True


def batches(folder: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a micro-batch is a version by its number, so a repeated one changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        put(batch, folder, number, keys, buckets)

    return write


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all whole versions with their version; raises if no version was ever written."""
    marks = _read(spark, f"{folder}/marks", _MARKS)
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").withColumn("version", F.col("version").cast("long")).drop("bucket")
    return rows.where(F.lit(False)) if marks is None else rows.join(marks.select("version").distinct(), "version", "left_semi")


def replace_sets(rows: DataFrame, owners: DataFrame, folder: str, owner: str, buckets: int = BUCKETS) -> None:
    """Makes ``rows`` the full set of every owner in ``owners`` (one column), which may leave an owner none.

    Only the buckets of those owners are written again. A bucket that loses its last row keeps
    one row that marks it, as dynamic overwrite leaves buckets without rows alone. Rows of an
    owner that isn't in ``owners`` are refused. All buckets of a write become visible one by one.
    """
    spark = rows.sparkSession
    named = kept(owners.select(owner).distinct())
    if rows.join(named, owner, "left_anti").limit(1).count():
        raise ValueError("rows of an owner that is not replaced")
    touched = named.select(_bucket([owner], buckets).alias("bucket")).distinct()
    new = rows.withColumn("bucket", _bucket([owner], buckets)).withColumn("is_mark", F.lit(False))
    old = _read(spark, f"{folder}/sets")
    if old is not None:
        others = old.where("not is_mark").join(F.broadcast(touched), "bucket", "left_semi").join(named, owner, "left_anti")
        new = new.unionByName(others.select(new.columns))
    marks = touched.select(*[("bucket" if c == "bucket" else F.lit(True).alias(c) if c == "is_mark" else F.lit(None).cast(new.schema[c].dataType).alias(c)) for c in new.columns])
    staged = kept(new.unionByName(marks))
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/sets")


def sets(spark: SparkSession, folder: str) -> DataFrame:
    """All sets as they are now."""
    return spark.read.parquet(f"{folder}/sets").where("not is_mark").drop("is_mark", "bucket")
