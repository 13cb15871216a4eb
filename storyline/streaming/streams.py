"""Structured Streaming forms: velocity, deduplication within a horizon, decayed preferences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.sources.scratch import TABLES, shared_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of files: event_id, ts (UTC), user_id, event_type, value, props."""
    name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = source.parquet(f"{name[0]}/{name[2][:-8]}*.parquet")  # a glob: the table may be a file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def velocity(events: DataFrame, horizon: str = "72 hours", width: str = "1 day") -> DataFrame:
    """Arrivals and sources per story and window of event time; late rows beyond the horizon are left out."""
    story = F.get_json_object("props", "$.k").cast("int")
    return events.withWatermark("ts", horizon).groupBy(F.window("ts", width), story.alias("story")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("sources"))


def deduplicated(events: DataFrame, keys: list[str], horizon: str = "72 hours") -> DataFrame:
    """First row of each key within the horizon."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


def preferences(events: DataFrame, half_life_days: float = 90.0) -> DataFrame:
    """story, alpha, n, last_sec: state of (alpha, n, last time) per story, decayed to each new row's time."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        alpha, n, last = state.get if state.exists else (0.0, 0, 0)
        for pdf in pdfs:
            for sec, delta in sorted(zip(pdf.sec.tolist(), pdf.delta.tolist())):
                age = (sec - last) / 86_400 if n else 0.0
                if age >= 0:
                    alpha, last = alpha * 0.5 ** (age / half_life_days) + delta, sec
                else:  # late: decayed as if it had come in time
                    alpha += delta * 0.5 ** (-age / half_life_days)
                n += 1
        state.update((alpha, n, last))
        yield pd.DataFrame({"story": [key[0]], "alpha": [alpha], "n": [n], "last_sec": [last]})

    delta = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.3).otherwise(0.0)
    rows = events.select(F.get_json_object("props", "$.k").cast("int").alias("story"), F.unix_timestamp("ts").alias("sec"), delta.alias("delta"))
    return rows.groupBy("story").applyInPandasWithState(fold, "story int, alpha double, n long, last_sec long", "alpha double, n long, last long", "update", "NoTimeout")


def run_once(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder."""
    import uuid

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    TABLES.append(path)

    def keep(batch: DataFrame, epoch: int) -> None:
        # a batch that runs again overwrites its own folder: exactly once
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data/*")
