"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds of a time stamp without a zone, taken as UTC."""
    return F.unix_timestamp(ts.cast("timestamp"))


def story_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, story (k of props), source (user), sec, event_type, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("story"), F.col("user_id").alias("source"), seconds(F.col("ts")).alias("sec"), "event_type", "value")


def latest_second(events: DataFrame) -> int:
    """`now` of a stored stream: one number to the driver."""
    return events.agg(F.max("sec")).first()[0] or 0


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pub_id"), F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("platform"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("published"), F.col("o_totalprice").alias("price"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric snapshots; (pub_id, age_h, part, supplier) is a key."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("pub_id"), (F.col("l_linenumber") * 24).alias("age_h"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("views"), F.col("l_quantity").alias("likes"), "l_discount", "l_returnflag")
