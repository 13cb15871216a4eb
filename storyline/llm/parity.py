"""N-gram Jaccard join by parity sketches: classes of documents that pairs at 0.8 or more of word shingles connect.

Every shingle flips one bit of a very wide sketch, so a bit is the parity of the shingles that hash to it, and two
sketches differ in no more bits than the symmetric difference of the two sets has members. At a Jaccard of t that is at
most (a + b) (1 - t) / (1 + t) for sets of a and b members. The sketch is used at two widths:
  * wide, to find pairs. It is cut into segments, and a segment stands for its set bits by the XOR of their hashes (it
    is never stored as bits). A difference touches one segment at most: of a pair with D differences at most D segments
    are not equal (pigeonhole);
  * folded to about two bits per shingle, to check pairs. Its Hamming distance is a lower bound of the difference, so a
    pair beyond the bound is no link; what is left is verified on whole sets.

Size bands: sizes go to windows [l, 2 l] such that any two sizes at a ratio of t share one; a window has one number of
segments. A set of n members in a window differs from a partner there in at most D(n); it gives the keys of its first
D(n) + 1 segments that are not empty, rare ones first. At most D of those are touched in any pair, so a pair has an
equal one among the keys of both. A set with too few segments that are not empty gives all of its keys. Which keys are
frequent is estimated on an eighth of the texts: it changes the order, never the result.

Equal sets are merged before keys are made. A key of two sets is a pair. Of a key of more sets all are paired with its
first and its last one; then components are taken, and only sets of different components that share such a key meet
again: with one of the key, drawn by hash, and after new components all with all. The rows of these joins carry sketches of
1024 bits, so that pairs beyond the bound are no rows of the result; the others' sketches at full width are compared
before their sets are read. Keys that are frequent in the estimate never meet in one task: they are
counted with partial sums, and their joins can be split. What stays quadratic is the comparison of sketches between sets
that share frequent keys and are no links, as in a large group of texts that stay just under the threshold.

Defined results: null and empty texts and texts without words have an empty set, which is linked with nothing, itself
and other empty ones included; fewer words than a shingle are one shingle; a null doc_id takes part in links, and a
component's id is the smallest doc_id that is not null; repeated rows and ids give one row each; an empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import discard, few, lower_bytes, map_rows, table, written
from storyline.operators.graph import connected_components

SHINGLE = 5
NUM, DEN = 4, 5  # the threshold as a fraction: whole numbers keep the bounds exact

#: A key of FREQUENT or more of an eighth of the texts is frequent; at most MOST keys are, by a higher bound.
FREQUENT, MOST = 4, 2_000_000

#: Bits of the sketches that joins compare.
NARROW = 1024

NONE = np.zeros(0, np.int64)


def differing(members: int) -> int:
    """Most members of the symmetric difference of two sets at the threshold that have so many together."""
    return members * (DEN - NUM) // (DEN + NUM)


# ---- windows of sizes -----------------------------------------------------------------------------------------------


def window_bounds(limit: int = 1 << 40) -> list[tuple[int, int]]:
    """Windows of sizes: two sizes of which the smaller is NUM / DEN of the greater or more share one."""
    out, low = [], 1
    while low < limit:
        high = max(2 * low, 8)
        out.append((low, high))
        low = high * NUM // DEN + 1
    return out


WINDOWS = window_bounds()
LOWS = [low for low, _ in WINDOWS]


def windows_of(n: int) -> list[int]:
    """Places of the windows that hold a size."""
    k = bisect_right(LOWS, n) - 1
    return [j for j in (k - 1, k) if j >= 0 and WINDOWS[j][0] <= n <= WINDOWS[j][1]]


def segments(window: int) -> int:
    """Half as many more as can differ, so that enough are left when empty and frequent ones are passed over."""
    return 3 * (differing(2 * WINDOWS[window][1]) + 1) // 2 + 2


def most_differing(n: int, window: int) -> int:
    """D(n): differences of a set of n members from a partner of the window that is as large as can be."""
    return differing(n + min(n * DEN // NUM, WINDOWS[window][1]))


# ---- sketches -------------------------------------------------------------------------------------------------------


def shingles(text: str | None) -> np.ndarray:
    """Different hashes of the text's shingles, sorted; none for a text without words."""
    words = lower_bytes(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g) for g in grams], dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def segment_keys(tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all segments of a window, and which are not empty. tokens are sorted, and so are their segments."""
    count = segments(window)
    at = (tokens >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    digests = np.zeros(count, np.uint64)
    digests[at[starts].astype(np.int64)] = np.bitwise_xor.reduceat(mixed(tokens), starts)
    salt = np.arange(count, dtype=np.uint64) + np.uint64(window << 48)
    keys = mixed(digests + mixed(salt)) & ~np.uint64(63) | np.uint64(window)  # the last six bits name the window
    return keys.view(np.int64), digests != 0


def chosen_keys(tokens: np.ndarray, window: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rare keys and frequent keys that a set gives in a window."""
    most = most_differing(tokens.size, window)
    if not most:  # only equal sets are links
        return NONE, NONE
    keys, full = segment_keys(tokens, window)
    if int(full.sum()) <= most:
        hot = is_in(keys, frequent)
        return keys[~hot], keys[hot]
    keys = keys[full]
    hot = is_in(keys, frequent)
    rare = keys[~hot][: most + 1]
    return rare, keys[hot][: most + 1 - rare.size]


def is_in(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not of.size:
        return np.zeros(values.size, bool)
    return of[np.minimum(np.searchsorted(of, values), of.size - 1)] == values


def folded(tokens: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The sketch at a power of two of bits (two to four a token, NARROW at least) as words of 64."""
    bits = bits or max(NARROW, 1 << (2 * tokens.size - 1).bit_length())
    at = (mixed(tokens) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance of two sketches at the width of the narrower."""
    x, y = (a, b) if a.size <= b.size else (b, a)
    apart = np.bitwise_xor.reduce(y.reshape(-1, x.size), axis=0) ^ x
    return int(np.bitwise_count(apart.view(np.uint64)).sum())  # of signed numbers it would count the absolute value


def uid_of(tokens: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).astype(np.int64)) if tokens.size else None


# ---- on Spark -------------------------------------------------------------------------------------------------------


def frequent_keys(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [np.zeros(0, np.int64)]
                for text in batch.column(0).slice(at, 500).to_pylist():
                    tokens = shingles(text)
                    for window in windows_of(tokens.size):
                        if most_differing(tokens.size, window):
                            keys, full = segment_keys(tokens, window)
                            found.append(keys[full])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["key"])

    part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).select("text").mapInArrow(run, "key long")
    counts = written(part.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT), "key-counts")
    least = max(FREQUENT, (counts.agg(F.sum("n")).first()[0] or 0) // MOST)
    out = np.sort(counts.filter(F.col("n") >= least).select("key").toArrow().column(0).to_numpy())
    discard(counts)
    return out


def described(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, uid (of the set, null if empty), n, sketch and narrow (words of bits; null: as sketch), rare and often (keys)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_keys(docs))
    arrays = ("sketch", "narrow", "rare", "often")

    def rows(cols: dict[str, list]) -> dict:
        out: dict[str, list] = {c: cols[c] for c in ("row", "doc_id", "text_hash")} | {c: [] for c in ("uid", "n", *arrays)}
        for text in cols["text"]:
            tokens = shingles(text)
            chosen = [chosen_keys(tokens, w, frequent.value) for w in windows_of(tokens.size)]
            keys = (np.concatenate([NONE, *(c[k] for c in chosen)]) for k in (0, 1))
            for name, value in zip(("uid", "n", *arrays), (uid_of(tokens), tokens.size, sketch := folded(tokens), folded(tokens, NARROW) if sketch.size * 64 > NARROW else None, *keys)):
                out[name].append(value)
        return out

    longs = [T.StructField(c, T.LongType()) for c in ("row", "doc_id", "text_hash", "uid", "n")]
    schema = T.StructType([*longs, *(T.StructField(c, T.ArrayType(T.LongType())) for c in arrays)])
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return written(map_rows(given, schema, rows, 200), "parity-rows")


def repeated(found: DataFrame) -> DataFrame:
    """row of all but the first row of each set, a written table; only narrow rows are shuffled."""
    sets = found.filter("uid IS NOT NULL").select("uid", "row")
    several = sets.groupBy("uid").agg(F.count("*").alias("rows"), F.min("row").alias("first")).filter("rows > 1")
    return written(sets.join(several, "uid").filter("row <> first").select("row"), "repeated-sets")


def keys_of(found: DataFrame, again: DataFrame, name: str) -> DataFrame:
    """key, uid of one row of each set. The arrays of keys are not written once more."""
    one = found.filter(F.size(name) > 0).select("row", "uid", name).join(again, "row", "left_anti")
    return one.select(F.explode(name).alias("key"), "uid")


def meetings(keyed: DataFrame) -> DataFrame:
    """Of keyed (key, uid), each once: pairs (a, b) of keys of two sets; for keys of more sets the pairs (a, b) of the first
    and of the last one with all others, and rows (key, a) of all its sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key: a key's run may cross batches, so the last run waits for the next batch."""
        keys, uids = NONE, NONE

        def met(keys: np.ndarray, uids: np.ndarray) -> Iterator[pa.RecordBatch]:
            if keys.size:
                starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                sizes = np.diff(np.append(starts, keys.size))
                size = np.repeat(sizes, sizes)
                first, last = (np.repeat(f.reduceat(uids, starts), sizes) for f in (np.minimum, np.maximum))
                up, down, many = (size > 1) & (uids != first), (size > 2) & (uids != last), size > 2
                a, b = np.concatenate((first[up], uids[down])), np.concatenate((uids[up], last[down]))
                pair = np.concatenate((np.ones(a.size, bool), np.zeros(int(many.sum()), bool)))
                columns = (pair, np.concatenate((np.zeros(a.size, np.int64), keys[many])), np.concatenate((a, uids[many])), np.concatenate((b, uids[many])))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pair", "key", "a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            uids = np.concatenate((uids, batch.column(1).to_numpy(zero_copy_only=False)))
            if keys.size:
                last = int(np.searchsorted(keys, keys[-1], "left"))
                yield from met(keys[:last], uids[:last])
                keys, uids = keys[last:], uids[last:]
        yield from met(keys, uids)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "pair boolean, key long, a long, b long")


def token_sets(docs: DataFrame, uids: DataFrame, sets: DataFrame) -> DataFrame:
    """uid and tokens of the given sets, from one text of each; other texts are read, but not moved."""
    one = written(sets.select("uid", "text_hash").join(uids, "uid", "left_semi").select("text_hash").distinct(), "wanted-texts")
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(few(one), "text_hash", "left_semi")

    def rows(cols: dict[str, list]) -> dict:
        tokens = [shingles(t) for t in cols["text"]]
        return {"uid": [uid_of(t) for t in tokens], "tokens": [t.view(np.int64) for t in tokens]}

    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
    out = written(map_rows(texts.select("text"), schema, rows, 200).dropDuplicates(["uid"]), "token-sets")
    discard(one)
    return out


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), each once, that are links: by their sketches first, then by whole sets."""
    pairs = written(pairs.select("a", "b"), "candidates")
    side = sets.select("uid", "n", "sketch")
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    both = both.filter((DEN * F.col("na") >= NUM * F.col("nb")) & (DEN * F.col("nb") >= NUM * F.col("na")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at, m, n in zip(range(batch.num_rows), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = (batch.column(k).slice(at, 1).flatten().to_numpy() for k in (4, 5))
                keep.append(distance(x, y) <= differing(m + n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = written(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a long, b long"), "near")
    uids = left.select(F.col("a").alias("uid")).unionByName(left.select(F.col("b").alias("uid"))).distinct()
    tokens = token_sets(docs, uids, sets)
    whole = left.join(tokens.toDF("a", "x"), "a").join(tokens.toDF("b", "y"), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(batch.num_rows):
                x, y = (batch.column(k).slice(at, 1).flatten().to_numpy() for k in (2, 3))
                shared = np.intersect1d(x, y, assume_unique=True).size
                keep.append((NUM + DEN) * shared >= NUM * (x.size + y.size))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = written(whole.select("a", "b", "x", "y").mapInArrow(linked, "a long, b long"), "links")
    discard(pairs, left, tokens)
    return out


def similar() -> Column:
    """Whether a pair's sizes and narrow sketches allow the threshold."""
    sizes = (DEN * F.col("na") >= NUM * F.col("nb")) & (DEN * F.col("nb") >= NUM * F.col("na"))
    words = (F.bit_count(F.col("xa")[k].bitwiseXOR(F.col("xb")[k])) for k in range(NARROW // 64))
    apart = reduce(add, words)
    return sizes & (apart <= F.floor((F.col("na") + F.col("nb")) * (DEN - NUM) / (DEN + NUM)))


def apart(rest: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """key, uid, label, n, x (narrow sketch) of the keys of rest (key, uid) whose sets are in several components of the links
    found; a written table."""
    joined = connected_components(found).select(F.col("node").alias("uid"), "component")
    labelled = written(rest.join(joined, "uid", "left").select("key", "uid", F.coalesce("component", "uid").alias("label")), "labelled")
    several = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("key")
    out = written(labelled.join(several, "key").join(sets.select("uid", "n", F.col("narrow").alias("x")), "uid"), "apart")
    discard(labelled)
    return out


def side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("key", F.col("uid").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("label", "n", "x")))


def links(docs: DataFrame, sets: DataFrame, rare: DataFrame, often: DataFrame) -> DataFrame:
    """Pairs (a, b) of different sets at the threshold or more that connect all such pairs. rare, often: key, uid."""
    hot = written(often, "frequent-keys")
    met = written(meetings(rare), "meetings")
    ends = hot.groupBy("key").agg(F.min("uid").alias("first"), F.max("uid").alias("last"))
    stars = hot.join(ends, "key").select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("uid").alias("b")), F.struct(F.col("uid").alias("a"), F.col("last").alias("b")))).alias("p"))
    pairs = met.filter("pair").select("a", "b").unionByName(stars.select("p.*").filter("a <> b"))
    found = verified(pairs.distinct(), docs, sets)

    rest = met.filter("NOT pair").select("key", F.col("a").alias("uid")).unionByName(hot)
    rows = apart(rest, sets, found)
    one = rows.groupBy("key").agg(F.min_by(F.struct("uid", "label", "n", "x"), F.xxhash64("uid", "key")).alias("h")).select("key", "h.*")
    drawn = side(one, "a").join(side(rows, "b"), "key").filter((F.col("labela") != F.col("labelb")) & similar())
    found = written(found.unionByName(verified(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, sets)), "links")
    discard(rows)
    rows = apart(rest, sets, found)
    pairs = side(rows, "a").join(side(rows, "b"), "key").filter((F.col("a") < F.col("b")) & (F.col("labela") != F.col("labelb")) & similar())
    out = written(found.unionByName(verified(pairs.select("a", "b").distinct(), docs, sets)), "links")
    discard(hot, met, found, rows)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, uid (null: no shingle), class (of linked sets), component_id."""
    found = described(docs)
    again = repeated(found)
    columns = ("uid", "text_hash", "n", "sketch", F.coalesce("narrow", "sketch").alias("narrow"))
    sets = written(found.filter("uid IS NOT NULL").join(again, "row", "left_anti").select(*columns), "parity-sets")
    classes = written(connected_components(links(docs, sets, keys_of(found, again, "rare"), keys_of(found, again, "often"))), "parity-classes")
    rows = found.select("doc_id", "text_hash", "n", "uid")
    labelled = rows.join(classes, F.col("uid") == F.col("node"), "left").withColumn("class", F.coalesce("component", "uid"))
    ids = written(labelled.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("class", "least"), "component-ids")
    discard(sets)
    return labelled.join(ids, "class", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "uid", "class", F.coalesce("least", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
