"""Held-out figures of the toxicity query, as README states them: python -m storyline.llm.report FOLDER..."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import toxicity
from storyline.llm.common import clear, table


def held_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score and toxic of the labelled rows that the model doesn't learn from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("toxic IN (0, 1)")
    return toxicity.query(spark, sf_dir).filter("held_out").join(labels, "doc_id").select("score", "toxic")


def area(rows: list[tuple[float, int]]) -> float:
    """Share of pairs of both labels that the scores order rightly."""
    ranks, at, ordered = 0.0, 0, sorted(rows)
    while at < len(ordered):
        end = at
        while end < len(ordered) and ordered[end][0] == ordered[at][0]:
            end += 1
        ranks += (at + end + 1) / 2 * sum(t for _, t in ordered[at:end])
        at = end
    ones = sum(t for _, t in rows)
    return (ranks - ones * (ones + 1) / 2) / max(1, ones * (len(rows) - ones))


def main(folders: list[str]) -> None:
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.local.dir": local, "spark.checkpoint.dir": f"{local}/shared"}
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print("| Table | Area under the curve | Label 1 caught at 0.7 | False alarms at 0.7 |")
    print("| --- | --- | --- | --- |")
    for folder in folders:
        rows = [(r.score, int(r.toxic)) for r in held_out_rows(spark, folder).collect()]
        ones = [s for s, t in rows if t]
        zeros = [s for s, t in rows if not t]
        over = [sum(s >= toxicity.THRESHOLD for s in part) for part in (ones, zeros)]
        print(f"| {os.path.basename(folder.rstrip('/'))} ({len(rows):,} rows) | {area(rows):.3f} | {over[0]} of {len(ones)} | {over[1]} of {len(zeros):,} |")
        clear(spark)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
