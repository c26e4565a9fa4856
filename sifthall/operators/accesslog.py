"""Operators on an access log (run, time, outcome): runs of failures, rests, gaps, elapsed time, counters.

Running values of a run are not windows over the whole run, which would bring a run with very many accesses to one task.
Windows cover a run's accesses of one ``chunk`` of time; one row per run and chunk then carries what the chunks before it
leave over (a small window over those rows), and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def accesses(events: DataFrame) -> DataFrame:
    """(run_id, event_id, ts, status, failed) of an event table: errors fail, sign-ups are refused, the rest succeed."""
    status = F.when(F.col("event_type") == "error", F.lit(None).cast("int")).when(F.col("event_type") == "signup", 403).otherwise(200)
    return events.select(F.col("user_id").alias("run_id"), "event_id", "ts", status.alias("status"), (F.col("event_type") == "error").alias("failed"))


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _chunked(log: DataFrame, seconds: int) -> DataFrame:
    return log.withColumn("at", _micros(F.col("ts"))).withColumn("chunk", F.floor(F.col("at") / (seconds * 1_000_000)))


_WITHIN = ("run_id", "chunk")


def _order() -> Window:
    return Window.partitionBy(*_WITHIN).orderBy("at", "event_id")


def _before() -> Window:
    return Window.partitionBy("run_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def failure_runs(log: DataFrame, alarm: int = 3, chunk_seconds: int = 24 * HOUR) -> DataFrame:
    """Accesses from the ``alarm``-th failure in a row of their run on: (event_id, run_id, length)."""
    ok = (~F.col("failed")).cast("bigint")
    rows = _chunked(log, chunk_seconds).withColumn("n_ok", F.sum(ok).over(_order())).withColumn("of_all", F.sum(ok).over(Window.partitionBy(*_WITHIN)))
    rows = rows.withColumn("length", F.when(F.col("failed"), F.row_number().over(Window.partitionBy(*_WITHIN, "n_ok", "failed").orderBy("at", "event_id"))))
    left = rows.groupBy(*_WITHIN).agg(F.count_if(F.col("failed") & (F.col("n_ok") == F.col("of_all"))).alias("trailing"), F.max("of_all").alias("of_all"))
    # failures left over: of the last chunk with a success, and of all chunks of failures only since
    upto = left.withColumn("sum_before", F.coalesce(F.sum("trailing").over(_before()), F.lit(0)))
    since = F.max(F.when(F.col("of_all") > 0, F.col("sum_before"))).over(_before())
    carried = upto.withColumn("carried", F.col("sum_before") - F.coalesce(since, F.lit(0))).select(*_WITHIN, "carried")
    whole = rows.where("failed").join(carried, list(_WITHIN)).withColumn("length", (F.col("length") + F.when(F.col("n_ok") == 0, F.col("carried")).otherwise(0)).cast("bigint"))
    return whole.where(F.col("length") >= alarm).select("event_id", "run_id", "length")


def rest_points(log: DataFrame, every: int = 5, chunk_seconds: int = 24 * HOUR) -> DataFrame:
    """Successful accesses after which a run rests: each ``every``-th of it."""
    rows = _chunked(log.where("NOT failed"), chunk_seconds).withColumn("n", F.row_number().over(_order()))
    counts = rows.groupBy(*_WITHIN).agg(F.count(F.lit(1)).alias("own"))
    carried = counts.withColumn("carried", F.coalesce(F.sum("own").over(_before()), F.lit(0))).select(*_WITHIN, "carried")
    return rows.join(carried, list(_WITHIN)).withColumn("n", (F.col("n") + F.col("carried")).cast("bigint")).where(F.col("n") % every == 0).select("event_id", "run_id", "n")


def short_gaps(log: DataFrame, least_seconds: float, chunk_seconds: int = 24 * HOUR) -> DataFrame:
    """Accesses that follow the one before them in their run in less than the least delay: (event_id, run_id, wait_us)."""
    least = int(least_seconds * 1_000_000)
    rows = _chunked(log, chunk_seconds).withColumn("previous", F.lag("at").over(_order()))
    last = rows.groupBy(*_WITHIN).agg(F.max("at").alias("last"))
    carried = last.withColumn("carried", F.max("last").over(_before())).select(*_WITHIN, "carried")
    gap = F.col("at") - F.coalesce("previous", "carried")
    return rows.join(carried, list(_WITHIN)).withColumn("gap", gap).where(F.col("gap") < least).select("event_id", "run_id", (F.lit(least) - F.col("gap")).cast("bigint").alias("wait_us"))


def elapsed(log: DataFrame) -> DataFrame:
    """(run_id, n, elapsed_us) of each run."""
    return log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), (_micros(F.max("ts")) - _micros(F.min("ts"))).alias("elapsed_us"))


def counters(log: DataFrame) -> DataFrame:
    """Per run: all accesses, failed, refused, and those worth an event."""
    refused: Column = F.coalesce(F.col("status").isin(403, 429), F.lit(False))
    return log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_accesses"), F.count_if("failed").alias("n_failed"), F.count_if(refused).alias("n_refused"), F.count_if(refused | F.col("failed")).alias("n_events"))


def backoff(attempt: Column) -> Column:
    """struct(least, most) seconds to wait before a retry; null beyond the last."""
    return F.when(attempt == 1, F.struct(F.lit(30).alias("least"), F.lit(60).alias("most"))).when(attempt == 2, F.struct(F.lit(120).alias("least"), F.lit(300).alias("most")))


def cooling(log: DataFrame, alarm: int = 3, seconds: int = 1800) -> DataFrame:
    """(event_id, run_id, length, until_us) of each access that makes a run cool down: the ``alarm``-th failure in a row or a later
    one, and the time until which nothing more is asked for."""
    return failure_runs(log, alarm).join(log.select("event_id", _micros(F.col("ts")).alias("at")), "event_id").select("event_id", "run_id", "length", (F.col("at") + seconds * 1_000_000).alias("until_us"))


def retries(log: DataFrame, most: int = 2) -> DataFrame:
    """(event_id, run_id, attempt, least, most) of failures that are tried again, with the seconds to wait first."""
    failed = failure_runs(log, 1).where(F.col("length") <= most)
    wait = backoff(F.col("length"))
    return failed.select("event_id", "run_id", F.col("length").alias("attempt"), wait["least"].cast("bigint").alias("least"), wait["most"].cast("bigint").alias("most"))
