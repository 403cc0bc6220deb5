"""A change log as a streaming source whose offsets are sequence numbers, so that a consumer resumes where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Sequence numbers of a partition of a micro-batch.
IN_ONE_PARTITION = 100_000


def _log(path: str) -> ds.Dataset:
    """The Parquet files of a log that are there now; committed ones only, as names with a leading _ or . are left out."""
    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return ds.dataset(inside, filesystem=system, format="parquet", exclude_invalid_files=False)


class SequenceRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class ChangeLogReader(DataSourceStreamReader):
    """Offsets are the last sequence number read; a batch is the rows behind one and up to the other."""

    def __init__(self, options: dict):
        self.path, self.after = options["path"], int(options.get("after", 0))
        self.names = options["columns"].split(",")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = [pc.max(b["change_seq"]).as_py() for b in _log(self.path).to_batches(columns=["change_seq"]) if b.num_rows]
        return {"seq": max([self.after, *[n for n in newest if n is not None]])}

    def partitions(self, start: dict, end: dict) -> list[SequenceRange]:
        return [SequenceRange(a, min(a + IN_ONE_PARTITION, end["seq"])) for a in range(start["seq"], end["seq"], IN_ONE_PARTITION)]

    def read(self, partition: SequenceRange) -> Iterator:
        seq = ds.field("change_seq")
        yield from _log(self.path).to_batches(columns=self.names, filter=(seq > partition.first) & (seq <= partition.last))

    def commit(self, end: dict) -> None:
        """Nothing is held for a consumer: its checkpoint has the offset."""


class ChangeLog(DataSource):
    """``format("change_log")`` with the options path, after and columns, and the schema of those columns."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def streamReader(self, schema) -> ChangeLogReader:  # noqa: N802
        return ChangeLogReader(dict(self.options))


def changes(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """A log folder (Parquet with change_seq, a number that grows) as a stream of the rows behind ``after``.

    Rows of one sequence number have to be written together, as offsets lie between numbers. Null
    numbers are in no range and are left out. The log is read by Arrow on the executors: the
    path is of a file system that Arrow knows, such as one that all of them mount.
    """
    spark.dataSource.register(ChangeLog)
    known = spark.read.parquet(path).schema
    return spark.readStream.format("change_log").schema(known).options(path=path, after=str(after), columns=",".join(known.names)).load()


def consume(stream: DataFrame, folder: str) -> DataFrame:
    """What a consumer has after it read all that is there now; a second call with the same folder goes on where this one ended."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
