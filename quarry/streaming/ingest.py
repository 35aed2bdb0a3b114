"""Structured Streaming: ingestion into a table folder, event-time windows and sessions, and
state of our own.

Each micro-batch is written under its own number, so that a batch that runs again after a
failure replaces what it had written, and rows count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, hook: Callable[[DataFrame, int], None] | None = None, every: str | None = None, mode: str = "append", seconds: float | None = None) -> list[dict]:
    """Takes all that is there into target/batch=n, and returns the batches' row counts.
    every: instead goes on and writes what came in each such time ("5 seconds"), for
    `seconds` or until the query is stopped."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if hook is not None:
            hook(batch, number)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
    if query.awaitTermination(seconds) is False:
        query.stop()
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]


def latest(rows: DataFrame, key: list[str], batch: str = "batch") -> DataFrame:
    """Of each key the row of the last batch: an upsert stream's table."""
    newest = F.max(F.struct(batch, *[c for c in rows.columns if c not in (*key, batch)])).alias("_r")
    return rows.groupBy(*key).agg(newest).select(*key, "_r.*").select(rows.columns)


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: list[str], *measures: Column) -> DataFrame:
    """Aggregates by event-time window; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(*measures)


def sessions(stream: DataFrame, time: str, gap: str, late: str, keys: list[str], *measures: Column) -> DataFrame:
    """Aggregates by session: events of a key with less than `gap` between them. Spark also
    joins what is exactly `gap` apart, so its sessions end a microsecond early here, which
    their ends get back."""
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, f"{gap} -1 microseconds").alias("session"), *keys).agg(*measures)
    whole = F.struct("session.start", (F.col("session.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"))
    return rows.withColumn("session", whole.alias("session", metadata=rows.schema["session"].metadata))


def _totals(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The count and the largest value of all rows of a key so far."""
    n, best = state.get if state.exists else (0, float("-inf"))
    for part in parts:
        n, best = n + len(part), max(best, part["value"].max())
    state.update((n, best))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "best": [best]})


def totals(stream: DataFrame) -> DataFrame:
    """(user_id, n, best) after each micro-batch for users who have rows in it."""
    return stream.groupBy("user_id").applyInPandasWithState(_totals, "user_id long, n long, best double", "n long, best double", "update", GroupStateTimeout.NoTimeout)


def ingest_state(stream: DataFrame, target: str, checkpoint: str) -> list[dict]:
    return ingest(totals(stream), target, checkpoint, mode="update")


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """The whole result after the last micro-batch, which executors write; `run_to_memory`
    is for results that fit on the driver."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(target)
