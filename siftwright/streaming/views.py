"""Streams of view scores: idempotent intake and emission of complete rows.

A row is emitted once, when all its views have arrived, whatever batches they
came in; repeated deliveries change nothing. State is one struct per open row,
partitioned by row id; of a complete row only a mark is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DONE = "id string, views int, top1 array<int>"


def once(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark, however often it is delivered."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def complete_views(stream: DataFrame, views: int = 4, patience_ms: int | None = None) -> DataFrame:
    """``stream (id, view, top1)`` to one row per id, when ``views`` distinct views have arrived.

    With ``patience_ms`` the state of a row is dropped after so long without
    news (for continuous triggers); without it state is kept, which suits runs
    over what is there.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if patience_ms and state.hasTimedOut:
            state.remove()
            return
        seen = dict(zip(*state.get)) if state.exists else {}
        closed = seen.get(-1) == 1
        for pdf in batches:
            for v, t in zip(pdf["view"], pdf["top1"]):
                if not closed and v == v and v is not None:
                    seen.setdefault(int(v), int(t))
        if not closed and len(seen) >= views:
            yield pd.DataFrame({"id": [key[0]], "views": [len(seen)], "top1": [[seen[v] for v in sorted(seen)]]})
            seen = {-1: 1}
        state.update(([*seen], [*seen.values()]))
        if patience_ms:
            state.setTimeoutDuration(patience_ms)

    return stream.where("id is not null").groupBy("id").applyInPandasWithState(
        step, DONE, "views array<int>, tops array<int>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if patience_ms else GroupStateTimeout.NoTimeout,
    )


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per tumbling window and key, rows later than ``late`` dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), *keys, "n"
    )


def label_batches(stream: DataFrame, write_batch, checkpoint: str, mode: str = "append"):
    """Runs ``write_batch(batch, batch_id)`` on what is there, resuming from ``checkpoint``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write_batch).start()


def keep_updates(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation in update mode and returns the last state of every key.

    Each batch is written to a folder of its own number, so a batch that runs
    again replaces itself; nothing is held by the driver.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    label_batches(stream, write, checkpoint, "update").awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    seen = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", out).parquet(out)
    last = seen.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in values])
