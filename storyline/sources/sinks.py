"""Sinks: deduplicated append, line export, exposition text, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key of the batch (by order) that the history lacks."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return batch.withColumn("_first", first).filter("_first").drop("_first").join(history.select(*keys), keys, "left_anti")


def append(batch: DataFrame, path: str, partition: list[str]) -> None:
    batch.write.mode("append").partitionBy(*partition).parquet(path)


def export_lines(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    df.write.mode("overwrite").json(path)


def exposition(df: DataFrame, name: str, label: Column, value: Column) -> DataFrame:
    """Gauge lines of a monitoring text format, one per row."""
    return df.select(F.format_string(f'{name}{{component="%s"}} %s', label.cast("string"), value.cast("string")).alias("line"))


def expired(df: DataFrame, key: list[str], order: list[Column], keep: int) -> DataFrame:
    """Rows that retention removes: all but the newest `keep` of a key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") > keep).drop("_r")
