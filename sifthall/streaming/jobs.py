"""Stateful operators over event streams, in Structured Streaming.

Sources are folders or globs of files read with a given schema; sinks are folders or keyed tables. A stream that is given the same
checkpoint and output again goes on where it stopped; without them it starts anew, in fresh folders of the shared folder. Each sink
write is idempotent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sifthall.plans.merge import BucketedTable, VersionedTable
from sifthall.plans.stage import fresh_path


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, key: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once: discovery as an idempotent insert. With ``time`` and ``delay`` the state is bounded by a watermark."""
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """Counts per key and tumbling window, closed by the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


RUN_SCHEMA = "run_id bigint, event_id bigint, length bigint"
RUN_STATE = "length bigint"


def failure_alarms(stream: DataFrame, alarm: int = 3) -> DataFrame:
    """(run_id, event_id, length) of each failure from the ``alarm``-th in a row on, by state per run. Rows of a batch are
    put in order of time; a success resets the count."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        failed, at = rows["failed"].to_numpy(dtype=bool), np.arange(len(rows))
        last_success = np.maximum.accumulate(np.where(failed, -1, at))
        length = np.where(last_success < 0, at + 1 + before, at - last_success)
        state.update((int(length[-1]),))
        alarms = failed & (length >= alarm)
        yield pd.DataFrame({"run_id": key[0], "event_id": rows["event_id"].to_numpy()[alarms], "length": length[alarms]})

    return stream.groupBy("run_id").applyInPandasWithState(step, RUN_SCHEMA, RUN_STATE, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now: run to its end, written to the shared folder and read back. With ``folder``,
    output and checkpoint lie there, and a later call reads only what has come since."""
    spark = stream.sparkSession
    out, checkpoint = (f"{folder}/{name}", f"{folder}/{name}-checkpoint") if folder else (fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint"))
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upserted(stream: DataFrame, table: VersionedTable | BucketedTable, key: list[str], order: str, checkpoint: str | None = None, **kinds) -> None:
    """A keyed table kept up to date from a stream: each batch is merged as a whole, and merging it again changes nothing. With the
    same ``checkpoint`` a later call goes on where this one stopped."""

    def merge(batch: DataFrame, _: int) -> None:
        table.upsert(batch, key, [F.col(order)], **kinds)

    spark = stream.sparkSession
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or fresh_path(spark, "upsert-checkpoint")).trigger(availableNow=True).start().awaitTermination()
