"""Benchmark decontamination with training suffix arrays.

Every Arrow block of documents is a shard: its words become one sequence of numbers, whose suffixes are sorted whole (by
prefix doubling), and every suffix of every test item that is long enough for a window is searched in the array by
binary search, one word after the other, for all test suffixes at once. Matches of neighbouring suffixes on one diagonal
are united to the longest verbatim matches with their places in item and document.

Words that no test item has are numbered 0 and end a suffix: no match can reach over them, so the array is exact for
the searches, and positions of such words have no suffix in it. Shards are rebuilt from the documents where a task is
lost; nothing is stored.

The map has no shuffle. The test items go to the tasks in blocks of a checked size (`max_block_words`); with more than
one block the documents are read once for each, and the per-document findings are united by one aggregation on the row
key.

Defined results: a null or empty text has no words and is not contaminated; an item without words never matches;
repeated documents give one row each; of several occurrences all are hit; an empty table gives an empty result; columns
other than doc_id and text are not read (`keep_clean` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import filter_rows, map_rows, table, words_of, written

WINDOW = 13

#: Words of test items that a task holds at once, about.
MAX_BLOCK_WORDS = 1_000_000

MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("item_start", T.IntegerType()),
            T.StructField("doc_start", T.IntegerType()),
            T.StructField("length", T.IntegerType()),
        ]
    )
)
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.IntegerType())),
        T.StructField("matches", MATCH),
    ]
)


def groups(rank: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if rank.size else np.zeros(0, np.int64)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Places of all nonzero numbers, sorted by the suffixes from there to the next zero (equal ones in any order).

    seq ends with a zero. Prefix doubling: suffixes sorted by their first h numbers are sorted by 2 h with the ranks of
    the suffixes h behind; only groups that are still tied and have a suffix of over h numbers are sorted again. Ranks
    and numbers stay under the length of seq or the number of words, so that pairs of them never overflow.
    """
    zeros = np.flatnonzero(seq == 0)
    places = np.flatnonzero(seq)
    length = np.zeros(seq.size, np.int64)
    length[places] = zeros[np.searchsorted(zeros, places)] - places
    array = places[np.argsort(seq[places], kind="stable")]
    rank = np.zeros(seq.size, np.int64)
    starts, h = groups(seq[array]), 1
    sizes = np.diff(np.append(starts, array.size))
    rank[array] = np.repeat(starts + 1, sizes)
    while array.size:
        tied = (sizes > 1) & (np.maximum.reduceat(length[array], starts) > h)
        slots = np.flatnonzero(np.repeat(tied, sizes))
        if not slots.size:
            break
        at = array[slots]
        behind = np.where(length[at] > h, rank[np.minimum(at + h, seq.size - 1)], 0)
        own = rank[at]
        order = np.lexsort((behind, own))
        array[slots], own, behind = at[order], own[order], behind[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])))
        rank[array[slots]] = (slots + 1)[np.maximum.accumulate(np.where(new, np.arange(slots.size), 0))]
        starts, h = groups(rank[array]), 2 * h
        sizes = np.diff(np.append(starts, array.size))
    return array


class TestSuffixes:
    """The test items of one block as one sequence of word numbers, with the suffixes to search."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int):
        self.words: dict[bytes, int] = {}
        self.ids: list[int] = []
        sequences, starts, needs, owners, at = [], [], [], [], 0
        for item, words in items:
            if not words:
                continue
            sequences.append(np.array([self.words.setdefault(w, len(self.words) + 1) for w in words] + [0], dtype=np.int64))
            need = min(window, len(words))  # the words that a suffix must share with a document
            starts.append(np.arange(at, at + len(words) - need + 1))
            needs.append(np.full(starts[-1].size, need))
            owners.append(np.full(starts[-1].size, len(self.ids)))
            self.ids.append(item)
            at += len(words) + 1
        none = [np.zeros(0, np.int64)]
        self.seq, self.starts, self.needs, self.owners = (np.concatenate(none + x) for x in (sequences, starts, needs, owners))
        self.begins = np.cumsum([0] + [s.size for s in sequences])  # of the items in seq

    def search(self, array: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per test suffix the range of the suffix array that shares its needed words."""
        first = seq[array]
        low = np.searchsorted(first, self.seq[self.starts], "left")
        high = np.searchsorted(first, self.seq[self.starts], "right")

        def bound(lo: np.ndarray, hi: np.ndarray, target: np.ndarray, k: int, right: bool) -> np.ndarray:
            while (open_ := lo < hi).any():
                middle = (lo + hi) >> 1
                # ranges that are closed already read any place, and that may lie near the end
                word = seq[np.minimum(array[np.minimum(middle, array.size - 1)] + k, seq.size - 1)]
                beyond = (word > target) if right else (word >= target)
                lo, hi = np.where(open_ & ~beyond, middle + 1, lo), np.where(open_ & beyond, middle, hi)
            return lo

        for k in range(1, int(self.needs.max(initial=1))):
            on = np.flatnonzero((low < high) & (self.needs > k))
            if not on.size:
                break
            target = self.seq[self.starts[on] + k]
            lo, hi = low[on], high[on]
            low[on], high[on] = bound(lo, hi, target, k, False), bound(lo, hi, target, k, True)
        return low, high

    def matches(self, docs: list[list[bytes]]) -> list[tuple[list[int], list[dict]]]:
        """Per document the hit word positions and the longest verbatim matches."""
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))  # a zero parts the documents
        seq = np.zeros(int(begins[-1]) + 1, dtype=np.int64)
        get = self.words.get
        for d, at in zip(docs, begins.tolist()):
            seq[at : at + len(d)] = [get(w, 0) for w in d]
        out: list[tuple[list[int], list[dict]]] = [([], []) for _ in docs]
        if not self.ids or not seq.any():
            return out
        array = suffix_array(seq)
        low, high = self.search(array, seq)
        found = np.flatnonzero(low < high)
        sizes = high[found] - low[found]
        lookup = np.repeat(found, sizes)
        at = array[np.arange(lookup.size) + np.repeat(low[found] - (np.cumsum(sizes) - sizes), sizes)]
        if not at.size:
            return out
        edges = np.bincount(at, minlength=seq.size) - np.bincount(at + self.needs[lookup], minlength=seq.size)[: seq.size]
        places = np.flatnonzero(np.cumsum(edges) > 0)
        owner = np.searchsorted(begins, places, "right") - 1
        for d, place in zip(owner.tolist(), (places - begins[owner]).tolist()):
            out[d][0].append(place)
        # one run per diagonal and neighbouring suffixes: a longest verbatim match
        diagonal = at - self.starts[lookup]
        order = np.lexsort((at, diagonal))
        at, diagonal, lookup = at[order], diagonal[order], lookup[order]
        new = np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], at.size) - 1
        length = at[last] - at[first] + self.needs[lookup[first]]
        doc = np.searchsorted(begins, at[first], "right") - 1
        item = self.owners[lookup[first]]
        in_item = self.starts[lookup[first]] - self.begins[item]
        for d, i, s, p, n in zip(doc.tolist(), item.tolist(), in_item.tolist(), (at[first] - begins[doc]).tolist(), length.tolist()):
            out[d][1].append({"item_id": self.ids[i], "item_start": s, "doc_start": p, "length": n})
        return out


def item_blocks(items: DataFrame, max_block_words: int) -> list[DataFrame]:
    """The items in blocks of at most about max_block_words words, by a running total computed on Spark."""
    words = items.select("item_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (4 * max_block_words)))
    if blocks == 1:
        return [items.select("item_id", "text")]
    return [words.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text") for b in range(blocks)]


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hits (hit word positions) and matches (item_id, item_start, doc_start, length) per document."""
    blocks = item_blocks(items, max_block_words)
    if len(blocks) > 1:  # a key that outlives recomputation: written first
        docs = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_key")), "decontaminate")
    else:
        docs = docs.select("doc_id", "text", F.lit(0).cast("long").alias("row_key"))
    schema = T.StructType([*SCHEMA, T.StructField("row_key", T.LongType())])
    parts = []
    for block in blocks:
        tests = TestSuffixes(((r.item_id, words_of(r.text)) for r in block.toLocalIterator()), window)
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def rows(cols: dict[str, list], shared=shared) -> dict:
            words = [words_of(t) for t in cols["text"]]
            found = shared.value.matches(words)
            return {
                "doc_id": cols["doc_id"],
                "n_words": [len(w) for w in words],
                "hits": [h for h, _ in found],
                "matches": [m for _, m in found],
                "row_key": cols["row_key"],
            }

        parts.append(map_rows(docs, schema, rows))
    if len(parts) == 1:
        return parts[0].drop("row_key")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    ).drop("row_key")


def contaminated(n_hit, n_words):
    """At least a twentieth of the document's words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The operator: find_matches with n_hit and the contaminated verdict."""
    found = find_matches(docs, items, window)
    n_hit = F.size("hits").cast("long")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", contaminated(n_hit, F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    blocks = item_blocks(items, max_block_words)
    if len(blocks) > 1:  # the hits of all blocks count together, so every row needs a key
        keyed = written(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct("*").alias("_row"), "text"), "decontaminate-rows")
        found = find_matches(keyed.select(F.col("_key").alias("doc_id"), "text"), items, window, max_block_words)
        bad = found.filter(contaminated(F.size("hits"), F.col("n_words"))).select(F.col("doc_id").alias("_key"))
        return keyed.join(bad, "_key", "left_anti").select("_row.*")
    tests = TestSuffixes(((r.item_id, words_of(r.text)) for r in blocks[0].toLocalIterator()), window)
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    def keep(texts: list[str | None]) -> list[bool]:
        words = [words_of(t) for t in texts]
        return [not (h and 20 * len(h) >= len(w)) for w, (h, _) in zip(words, shared.value.matches(words))]

    return filter_rows(docs, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_distinct(F.transform("matches", lambda m: m.item_id.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(ids), ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw
), sizes AS (
  SELECT DISTINCT n FROM windows
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, dw.n, i FROM dw JOIN windows ON dw.g = windows.g AND dw.n = windows.n
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
