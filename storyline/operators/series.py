"""Time series: buckets, calendars, zero fill, forward fill, latest snapshots, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}


def bucket(ts: Column, size: str, tz: str = "UTC") -> Column:
    """Start of the hour, day, week (Monday) or month, in a time zone."""
    local = ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)
    return F.date_trunc(size, local).cast("timestamp_ntz")


def calendar(df: DataFrame, column: str, size: str) -> DataFrame:
    """All buckets from the first to the last of df: a frame that grows with time, not with rows."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.select(F.explode(F.expr(f"sequence(a, b, {STEPS[size]})")).alias(column))


def zero_filled(counts: DataFrame, column: str, size: str, value: str) -> DataFrame:
    """counts (bucket, value) over the whole calendar, 0 where a bucket has none."""
    return calendar(counts, column, size).join(counts, column, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def forward_filled(df: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per key the row with the largest order columns: an aggregate with partial maxima, no sort."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def share(condition: Column) -> Column:
    """Share of rows that fulfil a condition, null without rows."""
    return F.try_divide(F.count_if(condition).cast("double"), F.count("*"))
