"""Table functions for SQL: extractors of users by document class, and runs of equal states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SelectedColumn, udtf
from pyspark.sql.types import LongType, StringType, StructType

#: What an extractor makes of a text: pairs of attribute key and value.
Extractor = Callable[[str], list[tuple[str, str]]]


def _named(rows: AnalyzeArgument, *names: str) -> list:
    missing = [n for n in names if n not in rows.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return [rows.dataType[n] for n in names]


def register_extractors(spark: SparkSession, extractors: dict[str, Extractor], name: str = "facts_of") -> None:
    """``facts_of(TABLE(t), key => 'doc_id')``: facts of t (key, doc_type, text) by the extractor of each row's class.

    Result (key, attribute_key, value), the key with its own name and type. Rows are independent,
    so no class has to fit into a task; classes without an extractor, null classes and null texts yield nothing.
    """

    class Facts:
        @staticmethod
        def analyze(rows: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
            own, _, _ = _named(rows, key.value, "doc_type", "text")
            chosen = [SelectedColumn(f"`{n}`") for n in (key.value, "doc_type", "text")]
            return AnalyzeResult(StructType([own]).add("attribute_key", StringType()).add("value", StringType()), select=chosen)

        def eval(self, row: Row, key: str) -> Iterator[tuple]:
            extractor = extractors.get(row["doc_type"])
            if extractor and row["text"] is not None:
                for attribute, value in extractor(row["text"]):
                    yield row[key], attribute, value

    spark.udtf.register(name, udtf(Facts))


class StateRuns:
    """``state_runs(TABLE(t) PARTITION BY key ORDER BY (at, id), key => 'key', at => 'at', state => 'state')``.

    One row for each longest run of rows with one state (nulls are one state): (key, state, started,
    ended, n), with the types of the input. Holds one run, however many rows a key has.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, state: AnalyzeArgument) -> AnalyzeResult:
        own, when, what = _named(rows, key.value, at.value, state.value)
        return AnalyzeResult(StructType([own, what]).add("started", when.dataType).add("ended", when.dataType).add("n", LongType()))

    def __init__(self) -> None:
        self.run: list | None = None

    def eval(self, row: Row, key: str, at: str, state: str) -> Iterator[tuple]:
        if self.run and self.run[1] == row[state]:
            self.run[3:] = row[at], self.run[4] + 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row[key], row[state], row[at], row[at], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    spark.udtf.register("state_runs", udtf(StateRuns))
