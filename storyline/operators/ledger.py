"""Append-only ledgers: hash chains in segments with linked heads, verification in parallel, replay of logs over snapshots.

A chain over all rows would be written by one task. Rows are chained inside segments of SEGMENT rows; the last hash and
the number of rows of every segment are its head, heads are rows of the next level and are chained in segments in turn,
until one segment is left. Its last hash covers every row. A segment is a bounded group; segments are written and checked
in parallel.

Defined results: positions are gapless from 0 when they are written; null payloads are empty; an empty table has no heads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.sources.scratch import written

SEGMENT = 256


def link_hash(before: Column, pos: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, pos.cast("string"), payload), 256)


def chained(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """rows (pos, payload) with segment, prev_hash and hash: every row's hash covers its segment up to it."""
    given = rows.select("pos", F.coalesce("payload", F.lit("")).alias("payload"), F.floor(F.col("pos") / size).alias("segment"))
    lists = given.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("rows"))  # `size` rows

    def step(state: Column, r: Column) -> Column:
        h = link_hash(state["last"], r["pos"], r["payload"])
        # the hash is worked out once: an array of one, mapped
        return F.get(F.transform(F.array(h), lambda x: F.struct(x.alias("last"), F.concat(state["out"], F.array(F.struct(r["pos"].alias("pos"), r["payload"].alias("payload"), state["last"].alias("prev_hash"), x.alias("hash")))).alias("out"))), 0)

    empty = F.array().cast("array<struct<pos:bigint,payload:string,prev_hash:string,hash:string>>")
    start = F.struct(F.concat(F.lit("segment "), F.col("segment").cast("string")).alias("last"), empty.alias("out"))
    return lists.select("segment", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("r")).select("segment", "r.*")


def heads(log: DataFrame) -> DataFrame:
    """pos (the segment), payload (number of rows and last hash): the heads of a level's segments."""
    last = log.groupBy("segment").agg(F.count("*").alias("n"), F.max_by("hash", "pos").alias("hash"))
    return last.select(F.col("segment").alias("pos"), F.concat_ws(" ", F.col("n").cast("string"), "hash").alias("payload"))


def ledger(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """level, segment, pos, payload, prev_hash, hash: the rows (level 0) and the heads of all levels. rows: pos (gapless
    from 0), payload."""
    parts, level, left = [], 0, rows.count()
    current = rows
    while left:
        log = written(chained(current, size), "ledger")
        parts.append(log.withColumn("level", F.lit(level)))
        segments = -(-left // size)
        if segments == 1:
            break
        current, left, level = heads(log), segments, level + 1
    if not parts:
        return chained(rows, size).withColumn("level", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verified(log: DataFrame, size: int = SEGMENT) -> DataFrame:
    """level, pos, reason of everything that is wrong with a ledger: edited (a hash doesn't cover the row), link (it isn't
    the hash that the next row names), gap (a row is missing before another), head (a segment's end or length isn't what
    its head says: a cut tail, say), lost (a head without its segment).

    Every row meets its neighbour by a join on position, every segment its head; nothing is read in order.
    """
    mine = log.withColumn("first", F.col("pos") % size == 0)
    start = F.concat(F.lit("segment "), F.col("segment").cast("string"))
    edited = mine.filter(link_hash(F.col("prev_hash"), F.col("pos"), F.col("payload")) != F.col("hash")).select("level", "pos", F.lit("edited").alias("reason"))
    before = log.select("level", (F.col("pos") + 1).alias("pos"), F.col("hash").alias("before"))
    joined = mine.join(before, ["level", "pos"], "left")
    wanted = F.when(F.col("first"), start).otherwise(F.col("before"))
    linked = joined.filter(wanted.isNotNull() & (wanted != F.col("prev_hash"))).select("level", "pos", F.lit("link").alias("reason"))
    gaps = joined.filter(~F.col("first") & F.col("before").isNull()).select("level", (F.col("pos") - 1).alias("pos"), F.lit("gap").alias("reason"))
    ends = log.groupBy("level", "segment").agg(F.count("*").alias("n"), F.max_by("hash", "pos").alias("hash"))
    ends = ends.select((F.col("level") + 1).alias("level"), F.col("segment").alias("pos"), F.concat_ws(" ", F.col("n").cast("string"), "hash").alias("now"))
    named = log.filter("level > 0").select("level", "pos", "payload").join(ends, ["level", "pos"], "left")
    wrong = named.filter("now IS NULL OR now <> payload").select(F.col("level") - 1, "pos", F.when(F.col("now").isNull(), "lost").otherwise("head").alias("reason")).toDF("level", "pos", "reason")
    return edited.unionByName(linked).unionByName(gaps).unionByName(wrong).distinct()


# ---- replay ---------------------------------------------------------------------------------------------------------


def folded(log: DataFrame) -> DataFrame:
    """key, value, added, revoked, last: what the entries of each key come to. log: seq, key, op (set, add, revoke), value.

    Entries of a key fold without being read in order: those after the first revocation don't count; the last `set` before
    it gives the value (null: none), and what is added after that `set` adds up.
    """
    ends = log.groupBy("key").agg(F.min(F.when(F.col("op") == "revoke", F.col("seq"))).alias("revoked"), F.max("seq").alias("last"))
    live = log.join(ends, "key").filter(F.col("revoked").isNull() | (F.col("seq") < F.col("revoked")))
    sets = live.filter("op = 'set'").groupBy("key").agg(F.max("seq").alias("since"), F.max_by("value", "seq").alias("value"))
    adds = live.filter("op = 'add'").join(sets.select("key", "since"), "key", "left").filter("since IS NULL OR seq > since")
    added = adds.groupBy("key").agg(F.sum("value").alias("added"))
    out = ends.join(sets, "key", "left").join(added, "key", "left")
    return out.select("key", "value", F.coalesce("added", F.lit(0).cast("decimal(38, 6)")).alias("added"), F.col("revoked").isNotNull().alias("revoked"), "last")


def replayed(snapshot: DataFrame, log: DataFrame, since: int) -> DataFrame:
    """State by key after a log's entries of a higher seq than `since` over a snapshot taken at `since`.

    snapshot: key, value, revoked. What the snapshot says is revoked stays revoked; an entry that the snapshot holds already
    changes nothing.
    """
    news = folded(log.filter(F.col("seq") > since)).withColumnsRenamed({"value": "new", "revoked": "gone"})
    both = snapshot.select("key", F.col("value").alias("old"), F.col("revoked").alias("was")).join(news, "key", "full")
    was = F.coalesce("was", F.lit(False))
    zero = F.lit(0).cast("decimal(38, 6)")
    value = F.when(was, F.col("old")).otherwise(F.coalesce("new", "old", zero) + F.coalesce("added", zero))
    return both.select("key", value.cast("decimal(38, 6)").alias("value"), (was | F.coalesce("gone", F.lit(False))).alias("revoked"))


def missing(log: DataFrame) -> DataFrame:
    """first, last of the runs of seq that a log lacks between its ends. Neighbours are found in ranges of seq, so that no
    task orders the whole log."""
    width = 1 << 16
    rows = log.select("seq").distinct().withColumn("part", F.floor(F.col("seq") / width))
    inside = F.sort_array(F.collect_list("seq"))  # at most `width` numbers
    lists = rows.groupBy("part").agg(inside.alias("s"))
    holes = lambda s: F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last"))), lambda h: h["first"] <= h["last"])
    within = lists.select(F.explode(holes(F.col("s"))).alias("h")).select("h.*")
    ends = lists.select(F.element_at("s", 1).alias("low"), F.element_at("s", -1).alias("high"))
    # a row for each range of numbers
    between = ends.withColumn("next", F.lead("low").over(Window.orderBy("low"))).filter(F.col("next") > F.col("high") + 1)
    return within.unionByName(between.select((F.col("high") + 1).alias("first"), (F.col("next") - 1).alias("last")))
