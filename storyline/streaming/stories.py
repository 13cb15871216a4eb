"""Incremental grouping of reports to events over micro-batches, with versioned state.

Every batch reads the state that the batch before it has left and writes its own version, named by the batch: live
reports with their events, item frequencies, the events' moves. A batch that runs again overwrites its own version and
reads the same one as before, so a restart from the checkpoint gives the same tables (exactly once).

A batch's reports meet each other and the live ones; attached pairs, contracted to events, are the edges of a small
graph, whose components move events to the smallest one. Reports leave the state when the watermark (the latest time
before the batch less the allowed delay) has passed them by a horizon: no later report may attach to them. Reports before
the watermark are late: they are counted and left out. Within these bounds the events don't depend on how the reports
were cut into batches.

The frequencies that weigh a batch are those of all reports before it, or a frozen table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.operators import profiles, stories
from storyline.operators.graph import connected_components
from storyline.sources.scratch import TABLES, clear_since, exists, folder_of, shared_dir, written

ARRAYS = ("title", "terms", "entities", "title_entities", "numbers", "quotes", "dates")
REPORT = "id long, lang string, sec long, " + ", ".join(f"{c} array<string>" for c in ARRAYS)
LIVE = REPORT + ", event long"
PART = "path string"
FREQUENCY = "kind string, lang string, key string, df long"


class EventState:
    """The tables of a stream's folder, by batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def put(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.path(name, batch))

    def get(self, name: str, batch: int, schema: str) -> DataFrame:
        """The version that a batch has left; empty before the first."""
        if batch < 0 or not exists(self.spark, self.path(name, batch)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name, batch))

    def all(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{name}")

    def drop(self, name: str, batch: int) -> None:
        system, where = folder_of(self.spark, self.path(name, batch))
        system.delete(where, True)


def added(before: DataFrame, items: DataFrame) -> DataFrame:
    """Frequencies after a batch, of what they weigh."""
    weighing = items.filter(F.col("kind").isin(*stories.OF_LANGUAGE))
    both = before.unionByName(stories.frequencies(weighing))
    return both.groupBy("kind", "lang", "key").agg(F.sum("df").alias("df"))


def advance(batch: DataFrame, number: int, state: EventState, horizon: int = stories.HORIZON, delay: int = stories.HORIZON, frozen: tuple[DataFrame, int] | None = None) -> None:
    """One micro-batch of reports (REPORT). frozen: frequencies (kind, lang, key, df, or profiles.frequencies) and number of reports
    that weigh every batch."""
    marks = state.get("marks", number - 1, "latest long, reports long").first()
    latest, before = (marks.latest, marks.reports) if marks else (None, 0)
    watermark = None if latest is None else latest - delay
    columns = ["id", "lang", "sec", *ARRAYS]
    on_time = batch.select(*columns) if watermark is None else batch.select(*columns).filter(F.col("sec") >= watermark)
    new = written(on_time.dropDuplicates(["id"]), "batch-reports")
    live = state.get("live", number - 1, LIVE)
    if watermark is not None:
        live = live.filter(F.col("sec") >= watermark - horizon)
    new = new.join(live.select("id"), "id", "left_anti")  # sent again
    counts = state.get("frequencies", number - 1, FREQUENCY)
    df, n = frozen or (counts, before)
    df = df if "h" in df.columns else profiles.hashed_frequencies(df)
    both = new.unionByName(live.drop("event"))
    given = profiles.packed(profiles.hashed(both), df, n, all_counted=False)
    given = profiles.Packed(written(given.rows, "live-profiles"), given.idf)
    links = profiles.attaching(given, stories.rules, horizon, new.select("id"))
    links = written(links.select("v", "p", "score", "cos"), "batch-links")

    event = live.select("id", "event").unionByName(new.select("id", F.col("id").alias("event")))
    edges = links.join(event.toDF("v", "a"), "v").join(event.toDF("p", "b"), "p").select("a", "b")
    moves = connected_components(edges).select(F.col("node").alias("event"), F.col("component").alias("into")).filter("event <> into")
    moves = written(moves, "batch-moves")
    labelled = both.join(event, "id").join(moves, "event", "left").withColumn("event", F.coalesce("into", "event"))
    top = new.agg(F.max("sec").alias("latest"), F.count("*").alias("n")).first()
    ends = [x for x in (latest, top.latest) if x is not None]
    if ends:  # what the next batch may still meet
        labelled = labelled.filter(F.col("sec") >= max(ends) - delay - horizon)
    state.put(labelled.select(*columns, "event"), "live", number)
    state.put(moves, "moves", number)
    state.put(new.select("id", F.col("id").alias("event")), "assigned", number)
    state.put(links, "links", number)
    state.put(added(counts, stories.report_items(new)), "frequencies", number)
    state.put(state.spark.createDataFrame([(max(ends, default=None), before + top.n)], "latest long, reports long").coalesce(1), "marks", number)
    state.put(state.spark.createDataFrame([(batch.count() - on_time.count(),)], "late long").coalesce(1), "late", number)
    for name in ("live", "frequencies"):
        state.drop(name, number - 3)  # older than any batch that can run again


def events_of(state: EventState) -> DataFrame:
    """id, event of all reports that the stream has seen."""
    moves = state.all("moves", "event long, into long").select(F.col("event").alias("a"), F.col("into").alias("b"))
    roots = connected_components(moves)
    found = state.all("assigned", "id long, event long").select("id", "event")
    return found.join(roots.withColumnRenamed("node", "event"), "event", "left").select("id", F.coalesce("component", "event").alias("event"))


def run_available(spark: SparkSession, source: str, state: EventState, parts: bool = False, **options) -> None:
    """Runs the stream over the files that have come since the checkpoint, one file a batch: reports, or (parts) rows that name
    the folder of a batch's reports, which many tasks then read."""
    stream = spark.readStream.schema(PART if parts else REPORT).option("maxFilesPerTrigger", 1).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        mark = len(TABLES)
        if parts:
            batch = spark.read.schema(REPORT).parquet(*sorted(r.path for r in batch.collect()))
        advance(batch, number, state, **options)
        clear_since(spark, mark)  # all that a batch leaves is in its state

    query = stream.writeStream.option("checkpointLocation", f"{state.folder}/checkpoint").trigger(availableNow=True)
    query = query.foreachBatch(step).start()
    query.awaitTermination()


def arrivals(reports: DataFrame, batches: int, tag: str) -> tuple[str, list[str]]:
    """A folder of files in the order of time, by cut points of their time, one file a batch (PART); and the folders of reports
    that these name, each written by all tasks."""
    spark = reports.sparkSession
    source = f"{shared_dir(spark)}/{tag}"
    cuts = reports.approxQuantile("sec", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    folders = []
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = reports if low is None else reports.filter(F.col("sec") >= low)
        part = part if high is None else part.filter(F.col("sec") < high)
        folders.append(f"{source}-{k}")
        part.select("id", "lang", "sec", *ARRAYS).write.parquet(folders[-1])
        spark.createDataFrame([(folders[-1],)], PART).coalesce(1).write.mode("append").parquet(source)
    return source, folders


__all__ = ["EventState", "advance", "arrivals", "events_of", "run_available"]
