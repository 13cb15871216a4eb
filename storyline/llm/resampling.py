"""Importance resampling towards a target by hashed word features.

A document's features are its runs of 1 to `most` consecutive words; a feature's bucket is the CRC-32 of its words,
joined by one space, modulo the number of buckets. Buckets of all documents and of all target texts are counted, the
ratio of their smoothed shares is a bucket's gain, a document's weight is its mean gain, and a Gumbel draw on the weights
takes the given share of the documents without replacement.

Aho-Corasick dictionary: the automaton holds distinct words between delimiters (" word "), each with its CRC-32 and its
lengths. One scan of a normalised text emits these payloads; runs of words are composed from adjacent payloads alone
(CRC-32 of a joined text follows from the CRC-32 and the length of its parts), so no run of words is ever built as
text. The dictionary has a bound: the most frequent words of the target and of a 64th of the documents, at most MAX_WORDS.
Words outside of it show as gaps between the payloads' places and get their CRC-32 from their bytes, so that the
dictionary changes the speed, never the result.

Texts are scanned once: the buckets of each document are written (two bytes a feature) and read for counting and for
weighing. One row per bucket reaches the driver. Ranks come from one range partitioning by score: places inside the
sorted parts, and the parts' sizes as offsets; no part holds more than its share, whatever scores are equal.

Defined results: null and empty texts have no features, weight 0 and a score like others; a null doc_id draws by the
empty string and sorts after others of its score; repeated rows are rows of their own and get ranks of their own; an
empty target gives the gains of its smoothing; an empty table gives an empty result; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import WORD_TABLE, discard, lower_bytes, map_rows, table, words_of, written

BUCKETS = 10_000
#: Longest run of words that is a feature.
MOST = 1
SEED = 2024
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 10

#: Bounds of the dictionary: words, and bytes of a word.
MAX_WORDS, MAX_BYTES = 65_536, 48
SAMPLE = 64

#: Characters that are scanned at once, about; cut between words.
CHUNK = 1 << 20


# ---- CRC-32 of joined texts -----------------------------------------------------------------------------------------


def times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The 32 x 32 bit matrix (columns as numbers) times each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def zero_byte() -> np.ndarray:
    """The matrix that carries a CRC-32 register over eight zero bits."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        columns = np.where(columns & np.uint32(1), columns >> np.uint32(1) ^ np.uint32(0xEDB88320), columns >> np.uint32(1))
    return columns


def powers(n: int) -> list[np.ndarray]:
    """Matrices over 1, 2, 4, ... zero bytes."""
    out = [zero_byte()]
    while len(out) < n:
        out.append(times(out[-1], out[-1]))
    return out


POWERS = powers(32)


def joined_crc(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of texts joined from parts with the given CRC-32; right_bytes: lengths of the right parts."""
    moved = left.copy()
    for k in range(int(right_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero(right_bytes >> k & 1)
        moved[on] = times(POWERS[k], moved[on])
    return moved ^ right


SPACE = np.uint32(zlib.crc32(b" "))


def run_crcs(crcs: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """CRC-32 of all runs of 1 to `most` adjacent words, from those and the byte lengths of the words."""
    out, run = [crcs], crcs
    for k in range(1, min(most, crcs.size)):
        spaced = joined_crc(run[:-1], np.full(run.size - 1, SPACE), np.ones(run.size - 1, np.int64))
        run = joined_crc(spaced, crcs[k:], sizes[k:])
        out.append(run)
    return np.concatenate(out)


# ---- the dictionary -------------------------------------------------------------------------------------------------


class Dictionary:
    """Automaton over the words between delimiters, with their payloads."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for k, word in enumerate(words):
            self.automaton.add_word(f" {word} ", k)
        if words:
            self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
        self.bytes = np.array([len(w) for w in raw], np.int64)
        self.chars = np.array([len(w) for w in words], np.int64)

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 and byte lengths of the words of a text in which all delimiters are spaces, the ends included."""
        gap = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        crcs, sizes = np.zeros(starts.size, np.uint32), np.zeros(starts.size, np.int64)
        known = np.zeros(starts.size, bool)
        if self.crc.size:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            ends, word = found[:, 0], found[:, 1]
            at = np.searchsorted(starts, ends - self.chars[word])
            crcs[at], sizes[at], known[at] = self.crc[word], self.bytes[word], True
        if not known.all():
            ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
            for k in np.flatnonzero(~known).tolist():
                raw = text[starts[k] : ends[k]].encode("utf-8", "surrogatepass")
                crcs[k], sizes[k] = zlib.crc32(raw), len(raw)
        return crcs, sizes

    def payloads(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """scan over the words of any text, in chunks."""
        raw = lower_bytes(text).translate(WORD_TABLE)
        out, at = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], 0
        while at < len(raw):
            end = raw.find(b" ", min(at + CHUNK, len(raw)))
            end = len(raw) if end < 0 else end
            out.append(self.scan(f" {raw[at:end].decode('utf-8', 'surrogatepass')} "))
            at = end + 1
        crcs, sizes = zip(*out)
        return np.concatenate(crcs), np.concatenate(sizes)


#: The last dictionary that this process has built, by its words.
BUILT: dict[int, Dictionary] = {}


def built(words: list[str], key: int) -> Dictionary:
    if key not in BUILT:
        BUILT.clear()
        BUILT[key] = Dictionary(words)
    return BUILT[key]


def frequent_words(docs: DataFrame, target: DataFrame, most: int = MAX_WORDS) -> list[str]:
    """The dictionary's words: at most `most`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                seen: Counter = Counter()
                for text in batch.column(0).slice(at, 1000).to_pylist():
                    seen.update(words_of(text))
                pairs = [(w.decode("utf-8", "replace"), n) for w, n in seen.items() if len(w) <= MAX_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], names=["word", "n"])

    part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").unionByName(target.select("text"))
    counts = part.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


# ---- counting, weighing, drawing ------------------------------------------------------------------------------------


def bucketed(docs: DataFrame, words: list[str], most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the features' buckets (little-endian, two or four bytes each), a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    key, kind = hash(tuple(words)), "<u2" if buckets <= 1 << 16 else "<u4"

    def rows(cols: dict[str, list]) -> dict:
        dictionary = built(shared.value, key)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_words": [], "n_features": [], "buckets": []}
        for text in cols["text"]:
            crcs, sizes = dictionary.payloads(text)
            features = run_crcs(crcs, sizes, most) % np.uint32(buckets)
            out["n_words"].append(crcs.size)
            out["n_features"].append(features.size)
            out["buckets"].append(features.astype(kind).tobytes())
        return out

    longs = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features")]
    return written(map_rows(docs.select("doc_id", "text"), T.StructType([*longs, T.StructField("buckets", T.BinaryType())]), rows, 200), "buckets")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: one row per bucket from each task, added up on Spark."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                sums += np.bincount(np.frombuffer(raw.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the logarithm of the ratio of smoothed shares, per bucket."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), source.size
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in pairs], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """A document's draw, from its id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    kind = "<u2" if gain.size <= 1 << 16 else "<u4"
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def rows(cols: dict[str, list]) -> dict:
        weight = []
        for raw in cols["buckets"]:
            of = shared.value[np.frombuffer(raw, kind)]
            weight.append(int(of.sum()) // of.size if of.size else 0)
        same = {c: cols[c] for c in ("doc_id", "n_words", "n_features")}
        return same | {"weight": weight, "score": [w + gumbel(d, seed) for w, d in zip(weight, cols["doc_id"])]}

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])
    return map_rows(found, schema, rows)


def ranked(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs (doc_id, n_words, score, ...) with rank: 1, 2, 3, ... of the drawn share by falling score, then doc_id."""
    eligible = F.col("n_words") >= least_words
    order = [F.when(eligible, F.lit(0)).otherwise(1).alias("_out"), F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(parts.withColumn("_place", F.monotonically_increasing_id()), "by-score")
    part = F.shiftright("_place", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).agg(F.count("*"), F.count(F.when(eligible, 1))).collect()))
    drawn = percent * sum(k for _, _, k in sizes) // 100
    starts, before = [], 0
    for at, n, _ in sizes:
        starts.append((at, before))
        before += n
    offsets = F.broadcast(docs.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _before long"))  # a row per partition
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("_part", part).join(offsets, "_part").withColumn("rank", F.when(eligible & (rank <= drawn), rank))
    return out.drop("_part", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) of every document."""
    words = frequent_words(docs, target, max_words)
    found = bucketed(docs, words, most, buckets)
    wanted = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), words, most, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    out = ranked(scored(found, gain, seed), percent, least_words)
    discard(found, wanted)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 bit by bit over the bytes of each different word.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), f AS (
  SELECT doc_id, unnest(w) AS word FROM d
), vocabulary AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM f UNION SELECT word FROM b)
), bytes AS (
  SELECT word, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))) AS x FROM vocabulary
), crc AS (
  SELECT word, xor(list_reduce(x, lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 10000 AS bucket FROM bytes
), s AS (
  SELECT bucket, count(*) AS s FROM f JOIN crc USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY bucket
), sums AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), sums
), weights AS (
  SELECT doc_id, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || d.doc_id)[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""
