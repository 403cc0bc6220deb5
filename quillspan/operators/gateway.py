"""Calls of a model for many rows: batches, bounded calls at a time, retries, and nulls where a call fails for good."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import extract

#: Takes texts and returns as many replies in their order, or raises.
Client = Callable[[list[str]], list]


@dataclass(frozen=True)
class Limits:
    """Texts of a call, calls of one task at a time, attempts of a call, and seconds before the second one, doubled each time."""

    batch: int = 32
    together: int = 4
    attempts: int = 3
    wait: float = 0.2


def _tried(client: Client, texts: list[str], limits: Limits) -> list[tuple]:
    """(reply, problem) for each text."""
    problem = ""
    for n in range(limits.attempts):
        if n:
            time.sleep(limits.wait * 2 ** (n - 1))
        try:
            replies = list(client(texts))
            if len(replies) == len(texts):
                return [(r, None) for r in replies]
            problem = f"{len(replies)} replies to {len(texts)} texts"
        except Exception as e:  # noqa: BLE001 - whatever a client raises is a failed call
            problem = f"{type(e).__name__}: {e}"
    return [(None, problem)] * len(texts)


def replies_of(client: Client, texts: list[str], limits: Limits) -> list[tuple]:
    """(reply, problem) for each text; a batch that fails is asked in halves, so that one bad text takes no other with it."""
    out = _tried(client, texts, limits)
    if len(texts) > 1 and out[0][1] is not None:
        half = len(texts) // 2
        return replies_of(client, texts[:half], limits) + replies_of(client, texts[half:], limits)
    return out


def ask(rows: DataFrame, prompt: str, client: Client, kind: str = "string", limits: Limits = Limits()) -> DataFrame:
    """``rows`` with reply (of the type ``kind``) and problem, the last error of a text that failed in every attempt.

    Null prompts are not sent and get nulls. The client travels to the executors, so it has to be
    picklable. Tasks that are run again ask again: write the result before it is used twice. As
    many calls run at a time as ``limits.together`` times the tasks that run.
    """

    @F.pandas_udf(f"reply {kind}, problem string")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(limits.together) as pool:
            for texts in batches:
                at = [i for i, t in enumerate(texts) if t is not None]
                parts = [at[i : i + limits.batch] for i in range(0, len(at), limits.batch)]
                reply, problem = [None] * len(texts), [None] * len(texts)
                for part, got in zip(parts, pool.map(lambda p: replies_of(client, [texts.iloc[i] for i in p], limits), parts), strict=True):
                    for i, (r, e) in zip(part, got, strict=True):
                        reply[i], problem[i] = r, e
                yield pd.DataFrame({"reply": pd.Series(reply, dtype=object), "problem": pd.Series(problem, dtype=object)})

    done = rows.withColumn("_asked", asked(F.col(prompt)))
    return done.withColumns({"reply": F.col("_asked.reply"), "problem": F.col("_asked.problem")}).drop("_asked")


def facts(replies: DataFrame) -> DataFrame:
    """(id, attribute_key, value, confidence, source, verification_status) of replies (id, reply).

    The confidence is that of the reply, drawn into 0 to 1, or 0.5 without a number. Blank keys are left
    out; replies that are null or hold no object yield nothing.
    """
    given = F.get_json_object(extract.first_object(F.col("reply")), "$.confidence").try_cast("double")
    drawn = F.coalesce(F.when(given.isNotNull() & ~F.isnan(given), F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0))), F.lit(0.5))
    found = extract.attributes(replies.select(F.struct("id", drawn.alias("confidence")).alias("id"), "reply")).where(F.trim("key") != "")
    return found.select("id.id", F.trim("key").alias("attribute_key"), "value", "id.confidence", F.lit("llm").alias("source"), F.lit("llm_unverified").alias("verification_status"))
