"""Sharding by fixed virtual slots.

A record hashes to one of `slots` virtual slots by its doc_id (without one: by its text); the slots never change. Bytes
and rows are added up per slot, and a slot-to-shard map says which shard holds a slot. Maps are stored by version: a
run reads the last version (the first is an even map), rebalances it for the bytes that the slots hold now, and appends
the next version if that moved a slot. Rebalancing edits the map: slots move (or change places) from the fullest to the
emptiest shard until no move makes the two more equal; all others stay where they are.

What reaches the driver is one row per slot and part, whatever the input; the map goes back into the plan as a literal.
A record's place in its shard is its rank in its part of its slot plus the sizes of the parts and slots before it in the
shard. Parts deal the rows of a slot evenly, so that a doc_id that repeats without end is no task of its own.

Law `bytes`: shard sizes near equal. DataFrame functions only.

Defined results: null text counts as empty; repeated rows get places of their own (all rows of one doc_id lie in one
slot, and so in one shard); equally good moves: the smaller slot; an empty table gives an empty result and leaves the
map as it is; columns other than doc_id and text are not read. A run that dies leaves a version without its mark, which
later runs pass over; of two runs at once both store a version, and the higher number is the next run's predecessor.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import exists, folder_of, shared_dir, table, written

SHARDS, SLOTS, PARTS = 16, 4096, 8


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.coalesce(F.when(doc_id.isNotNull(), F.xxhash64(doc_id)), F.xxhash64(text)), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot and part; written, so that parts stay what they are."""
    text = F.coalesce("text", F.lit(""))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), text, slots).alias("vslot"), part.alias("part"))
    return written(rows, "sized")


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """slot -> (bytes, rows of each part): at most slots * PARTS rows to the driver."""
    totals = rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in totals.collect():
        size, parts = out.get(r.vslot, (0, [0] * PARTS))
        parts[r.part] = r.rows
        out[r.vslot] = size + r.bytes, parts
    return out


def even_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The first version: shard of each slot, round robin."""
    return [s % shards for s in range(slots)]


def rebalance(shard_of: list[int], size: dict[int, int], shards: int) -> list[int]:
    """The next version: slots moved or exchanged between the fullest and the emptiest shard while that evens them."""
    out = list(shard_of)
    held: dict[int, set[int]] = defaultdict(set)
    for slot, shard in enumerate(out):
        held[shard].add(slot)
    total = [sum(size.get(s, 0) for s in held[k]) for k in range(shards)]
    for _ in range(50 * len(out)):
        full, empty = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[full] - total[empty]
        # the best single move brings half the gap; an exchange may come closer
        moves = [(abs(gap - 2 * size.get(s, 0)), s, None) for s in held[full] if 0 < size.get(s, 0) < gap]
        best = min(moves, default=(gap, None, None))
        if best[0] > gap / 8:
            small = sorted(held[empty], key=lambda s: size.get(s, 0))
            for s in held[full]:
                want, lo, hi = size.get(s, 0) - gap / 2, 0, len(small)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if size.get(small[mid], 0) < want else (lo, mid)
                for t in small[max(0, lo - 1) : lo + 1]:
                    if 0 < (d := size.get(s, 0) - size.get(t, 0)) < gap:
                        best = min(best, (abs(gap - 2 * d), s, t), key=lambda b: b[0])
        left, s, t = best
        if s is None or left >= gap:
            return out
        for slot, source, target in ((s, full, empty), (t, empty, full)):
            if slot is not None:
                held[source].remove(slot)
                held[target].add(slot)
                out[slot] = target
                total[source] -= size.get(slot, 0)
                total[target] += size.get(slot, 0)
    return out


def grow(shard_of: list[int], size: dict[int, int], shards: int) -> list[int]:
    """A map with one more shard, which takes slots of the fullest shards until it has its share; no other slot moves."""
    out, total = list(shard_of), [0] * (shards + 1)
    held: dict[int, list[int]] = defaultdict(list)
    for slot, shard in enumerate(out):
        held[shard].append(slot)
        total[shard] += size.get(slot, 0)
    share = sum(total) / (shards + 1)
    while total[shards] < share:
        full = max(range(shards), key=total.__getitem__)
        fits = [s for s in held[full] if 0 < size.get(s, 0) <= 2 * (share - total[shards])]
        if not fits or total[full] <= share:
            break
        s = min(fits, key=lambda s: (abs(total[full] - share - size.get(s, 0)), s))
        held[full].remove(s)
        out[s] = shards
        total[full] -= size.get(s, 0)
        total[shards] += size.get(s, 0)
    return out


def lookup(values: list[int], at: Column, kind: str) -> Column:
    """The value at a slot, as an array that the optimizer folds into a constant."""
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), at)


def map_frame(spark: SparkSession, shard_of: list[int]) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(shard_of)), "array<int>")).alias("slot", "shard"))


def numbers_in(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers N of the entries `prefix`N under path, rising."""
    system, where = folder_of(spark, path)
    if not system.exists(where):
        return []
    names = (status.getPath().getName() for status in system.listStatus(where))
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def claim(spark: SparkSession, path: str) -> int:
    """The next version's number, for this run alone: the file system makes a claim's file for one of two runs.

    A number whose run has died stays claimed; versions may have gaps.
    """
    number = max(numbers_in(spark, path, "claim-") + numbers_in(spark, path, "version="), default=0) + 1
    while True:
        system, where = folder_of(spark, f"{path}/claim-{number}")
        try:
            system.create(where, False).close()
            return number
        except Exception:  # a Java exception of one of several kinds, by the file system
            if not system.exists(where):
                raise
            number += 1


def save_map(spark: SparkSession, shard_of: list[int], path: str) -> int:
    """Stores a new version and returns its number; an existing one is never overwritten."""
    version = claim(spark, path)
    map_frame(spark, shard_of).coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    return [r.shard for r in spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()]


def last_version(spark: SparkSession, path: str) -> int:
    """Number of the newest map that was written whole, 0 if there is none."""
    for version in reversed(numbers_in(spark, path, "version=")):
        if exists(spark, f"{path}/version={version}/_SUCCESS"):
            return version
    return 0


def place(rows: DataFrame, shard_of: list[int], totals: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot (the place in the shard, gapless from 0)."""
    slots, used = len(shard_of), defaultdict(int)
    before = [0] * (slots * PARTS)
    for s in range(slots):
        for part, n in enumerate(totals.get(s, (0, [0] * PARTS))[1]):
            before[s * PARTS + part] = used[shard_of[s]]
            used[shard_of[s]] += n
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY vslot, part ORDER BY doc_id, text_crc32, size) - 1 AS nth")
    first = lookup(before, F.col("vslot") * PARTS + F.col("part"), "bigint")
    return ranked.select("doc_id", "size", "text_crc32", "vslot", lookup(shard_of, F.col("vslot"), "int").alias("shard"), (first + F.col("nth")).alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Placed records by the last map under path, rebalanced for the records' bytes and stored as the next version.

    A stored map of other numbers of slots or shards is no predecessor: an even map takes its place.
    """
    spark, rows = docs.sparkSession, sized(docs, slots)
    totals = slot_totals(rows)
    version = last_version(spark, path) if path else 0
    last = load_map(spark, path, version) if version else None
    if last is None or len(last) != slots or max(last) >= shards:
        last = even_map(shards, slots)
        if path:
            save_map(spark, last, path)
    now = rebalance(last, {s: b for s, (b, _) in totals.items()}, shards)
    if path and now != last:
        save_map(spark, now, path)
    return place(rows, now, totals)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]  # each folder of tables has its own map
    placed = shard(table(spark, sf_dir, "documents"), path=f"{shared_dir(spark)}/slot-map-{own}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
