"""Retrieval for a stream of query records: the index is static, a query's candidates depend on no other
query, so each micro-batch is a stream-static join.  Entity context needs all claims of a batch and
is computed per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinlink.operators import retrieval
from kinlink.plans.scratch import keep


def candidates_of_stream(index: DataFrame, queries: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Start a query that hands the candidates of every micro-batch of ``queries`` to ``sink``.

    Both sides are normalised records.  ``checkpoint`` keeps the progress of the stream.  The index side's
    weighted postings and capped keys are written once, not computed again in every micro-batch.
    """
    prepared = retrieval.prepare(index, **options)

    def batch(rows: DataFrame, number: int) -> None:
        sink(retrieval.candidates_from(prepared, rows), number)

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def key_matches_of_stream(index: DataFrame, queries: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """A streaming DataFrame of (qi, si) that share an exact key: a plain stream-static join.

    Keys that more than ``cap`` index records of the country hold (the batch operator's cap unless given)
    are left out of the static side, so no key can multiply a query beyond it.
    """
    cap = retrieval.KEY_CAPS[key] if cap is None else cap
    held = index.select(F.col("id").alias("si"), "country", F.col(f"key_{key}").alias("key")).filter("key is not null")
    few = held.groupBy("country", "key").count().filter(F.col("count") <= cap).drop("count")
    held = keep(held.join(few, ["country", "key"]), "stream-keys")  # not counted again in every micro-batch
    return queries.select(F.col("id").alias("qi"), "country", F.col(f"key_{key}").alias("key")).join(held, ["country", "key"]).select("qi", "si")
