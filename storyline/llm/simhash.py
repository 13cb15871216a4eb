"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). Each is a word of the perfect binary Golay code
[23, 12, 7] (padded with zeros); decoding gives the index of the only codeword within three bits, and a word and its
neighbours at one bit give at most six indices, which any word at one bit shares.

Pigeonhole over at most three differing bits:
  * a segment is equal, and of the other two one differs in at most one bit: the keys join an exact segment with a
    Golay index of another one (six ordered pairs of segments);
  * else each segment differs in exactly one bit: then one half of every segment is equal (eight choices of halves).
Keys hold 32 to 34 bits, so that buckets stay small at 10^9 fingerprints. Buckets are compared in sorted partitions
without building groups: a bucket emits the links of a spanning forest only, never all its pairs, and holds eight
bytes a fingerprint. A key that over SPLIT fingerprints have (of one template with a varying part, say) is counted
first and dealt to tiles: its fingerprints are hashed to parts of about SPLIT / 2, and every pair of parts is a bucket
of its own, so that no task compares more than SPLIT or so at once and no link is lost.

Equal fingerprints are merged before keys are made (a group of copies counts once). Links are joined to components by
large-star / small-star rounds on DataFrames (storyline.operators.graph), each round written to the shared folder.

Defined results: null or empty text has fingerprint zero, linked like any other; repeated rows and equal doc_ids give
one row each; an empty table gives an empty result; null doc_ids keep a fingerprint and take part in the components,
whose id is the smallest doc_id that is not null; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import few, lower_bytes, map_rows, private, table, written
from storyline.operators.graph import connected_components

MAX_BITS = 3
SHINGLE = 3
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width

#: Fingerprints of a key beyond which its bucket is dealt to tiles.
SPLIT = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: 1 where over half of the shingles' hashes have a 1."""
    words = lower_bytes(text).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, 65_536):  # bounded memory for very long texts
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > hashes.size).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a signed long)."""

    def rows(cols: dict[str, list]) -> dict:
        prints = np.array([fingerprint(t, shingle) for t in cols["text"]], dtype=np.uint64)
        return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "fp": prints.view(np.int64)}

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "text_hash", "fp")])
    return map_rows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), schema, rows)


# ---- the Golay code -------------------------------------------------------------------------------------------------

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_table() -> np.ndarray:
    """For each of the 2048 syndromes the only error of at most three bits that has it."""
    bits = [1 << i for i in range(23)]
    errors = [0, *bits]
    errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    out = np.zeros(2048, dtype=np.int64)
    out[syndromes(np.array(errors))] = errors
    return out


ERRORS = error_table()


def golay_index(words: np.ndarray) -> np.ndarray:
    """Twelve-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[syndromes(words)]) >> 11


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Indices of each word and of its 23 neighbours at one bit: n x 24, at most six different in a row."""
    around = np.concatenate(([0], 1 << np.arange(23)))
    return golay_index(words[:, None] ^ around)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) arrays: all keys of the fingerprints, a key is a long that names the kind and its bits."""
    prints = prints.view(np.uint64)
    parts = [((prints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows, keys = [], []
    everything = np.arange(prints.size)
    for b in range(3):
        near = np.sort(golay_indices(parts[b]), axis=1)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(new)
        index = near[row, column]
        for a in range(3):
            if a != b:
                kind = 3 * a + b
                rows.append(row)
                keys.append((kind << 40) | (parts[a][row] << 12) | index)
    halves = []
    for (_, width), part in zip(SEGMENTS, parts):
        low = width // 2
        halves.append((part & ((1 << low) - 1), part >> low))
    for choice in range(8):
        key = np.zeros(prints.size, dtype=np.int64)
        for i in range(3):
            key = (key << 11) | halves[i][choice >> i & 1]
        rows.append(everything)
        keys.append((16 + choice << 40) | key)
    return np.concatenate(rows), np.concatenate(keys)


def forest(prints: np.ndarray, max_bits: int = MAX_BITS, tile: int = 1024) -> list[tuple[int, int]]:
    """Links (pairs of places in prints) of a spanning forest of the graph of fingerprints at max_bits or fewer."""
    prints = prints.view(np.uint64)
    parent = np.arange(prints.size)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(0, prints.size, tile):
        for j in range(i, prints.size, tile):
            apart = np.bitwise_count(prints[i : i + tile, None] ^ prints[None, j : j + tile])
            for x, y in zip(*np.nonzero(apart <= max_bits)):
                x, y = int(x) + i, int(y) + j
                if x < y and (rx := root(x)) != (ry := root(y)):
                    parent[max(rx, ry)] = min(rx, ry)
                    links.append((x, y))
    return links


def tiled(keyed: DataFrame, split: int = SPLIT) -> DataFrame:
    """keyed (key, fp) with the rows of frequent keys dealt to the tiles of all pairs of parts, as keys of their own."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split)
    hot = written(counts.select("key", F.ceil(F.col("n") * 2 / split).cast("int").alias("parts")), "hot-keys")
    if hot.isEmpty():
        return keyed
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(hot, "key", "left").withColumn("part", part)
    others = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("other", others)
    tile = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))  # two tiles of one hash only add comparisons
    return dealt.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(tile).alias("key"), "fp")


def link_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, each once) that connect all at max_bits or fewer."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, values.size, 4096):
                part = values[at : at + 4096]
                rows, keys = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key: a key's run may cross batches, so the last run waits for the next batch."""
        kept_keys, kept_prints = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if keys.size else np.zeros(1, int)
            a, b = [], []
            long_runs = np.flatnonzero(np.diff(bounds) > 1)
            for start, end in zip(bounds[long_runs].tolist(), bounds[long_runs + 1].tolist()):
                run = values[start:end]
                for x, y in forest(run, max_bits):
                    a.append(run[x])
                    b.append(run[y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((kept_keys, batch.column(0).to_numpy(zero_copy_only=False)))
            values = np.concatenate((kept_prints, batch.column(1).to_numpy(zero_copy_only=False)))
            if not keys.size:
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            yield links(keys[:last], values[:last])
            kept_keys, kept_prints = keys[last:], values[last:]
        yield links(kept_keys, kept_prints)

    keyed = written(prints.select("fp").mapInArrow(expand, "key long, fp long"), "fingerprint-keys")
    found = tiled(keyed, split).repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp, class, component_id (smallest doc_id reachable over links of max_bits or fewer bits)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys are complete for at most three differing bits")
    prints = written(fingerprints(docs, shingle), "fingerprints")
    unique = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "unique")
    linked = connected_components(link_fingerprints(unique, max_bits))
    classes = unique.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    ids = written(classes.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    classes = classes.join(ids, "component").select("fp", F.col("component").alias("class"), "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "class", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each class, all columns: that with the smallest doc_id (null ones last), then the smallest text hash;
    of equal rows one."""
    return keep_of_classes(docs, written(near_duplicates(docs, max_bits, shingle), "classes"))


def united(found: DataFrame, more: DataFrame) -> DataFrame:
    """found (doc_id, text_hash, class) with classes united that texts of one class of `more` (text_hash, class) are in.

    Only classes of `more` that hold several of found's make links, one star each; the rest takes no part.
    """
    others = more.select("text_hash", F.col("class").alias("other"))
    pairs = written(found.select("text_hash", "class").distinct().join(others, "text_hash").select("class", "other").distinct(), "class-pairs")
    several = pairs.groupBy("other").agg(F.min("class").alias("a"), F.max("class").alias("most")).filter("a <> most")
    links = pairs.join(several, "other").filter("class <> a").select("a", F.col("class").alias("b"))
    into = written(connected_components(links), "united-classes")
    rows = found.join(into, F.col("class") == F.col("node"), "left")
    return written(rows.select("doc_id", "text_hash", F.coalesce("component", "class").alias("class")), "classes")


def keep_of_classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keep_one for given classes (doc_id, text_hash, class), a written table.

    What to drop is decided on the narrow table and written: up to FEW ids are broadcast, so that texts stay where they
    are, more are joined by hash.
    """
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    best = written(best, "best")  # else the join would keep the aggregate's partitions, which Spark can't split
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_hash").eqNullSafe(F.col("best.text_hash"))
    judged = found.join(best, "class").select("doc_id", "text_hash", chosen.alias("kept"))
    id_, hash_, nth = private(docs, "_id", "_hash", "_n")
    ids = [F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)]
    drop = written(judged.filter("NOT kept").select(*ids).distinct(), "dropped")
    again = written(judged.filter("kept").groupBy("doc_id", "text_hash").count().filter("count > 1").select(*ids), "repeated")
    text_hash = F.xxhash64("text")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_))
    kept = docs.join(few(drop), same, "left_anti")
    if again.isEmpty():
        return kept
    again = few(again)
    first = F.row_number().over(Window.partitionBy("doc_id", text_hash).orderBy(text_hash))
    one = kept.join(again, same, "left_semi").withColumn(nth, first).filter(F.col(nth) == 1).select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
