"""Workdays between dates, as a prefix sum over a calendar: one join per date instead of a loop per row."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: date, last: date, overrides: DataFrame | None = None) -> DataFrame:
    """(day, is_workday, n_workdays): Monday to Friday unless ``overrides`` (day, is_workday) says otherwise; n_workdays
    counts from ``first`` to the day. As many rows as days, so that it is always small enough to broadcast."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    weekday = F.weekday("day") < 5
    if overrides is None:
        days = days.withColumn("is_workday", weekday)
    else:
        days = days.join(F.broadcast(overrides.select("day", F.col("is_workday").alias("own"))), "day", "left").select("day", F.coalesce("own", weekday).alias("is_workday"))
    return days.withColumn("n_workdays", F.sum(F.col("is_workday").cast("bigint")).over(Window.orderBy("day")))


def calendar_of(df: DataFrame, *columns: str, overrides: DataFrame | None = None) -> DataFrame:
    """A calendar from the least to the greatest of the dates of ``columns``; of one day if there is none. Dates have few
    thousand days between them, and no more than the type allows, which is less than four million."""
    ends = df.agg(*[F.min(c).alias(f"low_{c}") for c in columns], *[F.max(c).alias(f"high_{c}") for c in columns]).first()
    known = [d for d in ends if d is not None] or [date(2000, 1, 1)]
    return calendar(df.sparkSession, min(known), max(known), overrides)


def with_gap(df: DataFrame, start: str, end: str, days: DataFrame, name: str = "workday_gap") -> DataFrame:
    """``df`` with the workdays in (start, end]: 0 if the end is not later, null if a date is null.

    A date outside the calendar fails loudly rather than being counted by another rule."""
    upto = lambda column, alias: F.broadcast(days.select(F.col("day").alias(f"__{alias}"), F.col("n_workdays").alias(f"__n_{alias}")))
    joined = df.join(upto(start, "start"), F.col(start) == F.col("__start"), "left").join(upto(end, "end"), F.col(end) == F.col("__end"), "left")
    outside = (F.col(start).isNotNull() & F.col("__start").isNull()) | (F.col(end).isNotNull() & F.col("__end").isNull())
    gap = F.when(F.col(start).isNull() | F.col(end).isNull(), F.lit(None)).when(outside, F.raise_error(F.lit("a date lies outside the calendar")).cast("bigint")).when(F.col(end) <= F.col(start), F.lit(0)).otherwise(F.col("__n_end") - F.col("__n_start"))
    return joined.withColumn(name, gap.cast("bigint")).drop("__start", "__n_start", "__end", "__n_end")


def timeliness(gap: Column, start: Column, end: Column, limit: int = 20) -> Column:
    """Label of a gap: unknown, reversed, late or in time."""
    return F.when(start.isNull() | end.isNull(), "待复核").when(end < start, "日期倒置").when(gap > limit, "超期").otherwise("合规")


def stated_gap(text: Column) -> Column:
    """The number of workdays that a text states."""
    return F.regexp_extract(text, r"(?U)相隔\s*(\d+)\s*个工作日", 1).try_cast("int")
