"""Generated calendars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.timekeys import with_day_keys


def calendar(spark: SparkSession, start: str | date, end: str | date) -> DataFrame:
    """One row per day of [start, end] with its period labels."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
        ).alias("day")
    )
    return with_day_keys(days, "day")


def days_spanned(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day between the least `first` and the greatest `last` of a table."""
    bounds = df.agg(F.min(first).cast("date").alias("lo"), F.max(last).cast("date").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return with_day_keys(days, "day")
