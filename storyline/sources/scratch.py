"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode where the session names no spark.checkpoint.dir, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/storyline"

#: Paths of the tables that this process has written and not removed.
TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.conf.get("spark.master", "local").startswith("local"):
        return LOCAL_SHARED
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Narrow rows of a written table that are sent to every task, so that texts stay where they are; more are joined by hash.
FEW = 2_000_000


def few(table: DataFrame) -> DataFrame:
    """A written table of narrow rows as one side of a join with texts: broadcast if it has no more than FEW rows."""
    return F.broadcast(table) if table.count() <= FEW else table


def folder_of(spark: SparkSession, path: str):
    """File system and path object of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = folder_of(spark, path)
    return system.exists(where)


def discard(*tables: DataFrame | None) -> None:
    """Removes written tables that no plan reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path in TABLES:
            system, where = folder_of(df.sparkSession, path)
            system.delete(where, True)
            TABLES.remove(path)


def clear(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Removes all tables written so far but `keep`: for when their results have been saved."""
    for path in [p for p in TABLES if p != getattr(keep, "_scratch", None)]:
        system, where = folder_of(spark, path)
        system.delete(where, True)
        TABLES.remove(path)


def clear_since(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Removes the tables written since TABLES had `mark` entries but `keep`: what a finished step has left."""
    for path in [p for p in TABLES[mark:] if p != getattr(keep, "_scratch", None)]:
        system, where = folder_of(spark, path)
        system.delete(where, True)
        TABLES.remove(path)
