"""Best-two-fit packing of tokenised documents.

One pass tokenises every text and writes one small row per piece (lengths and checksums, no ids). Packing depends on
lengths alone, so it is planned on the histogram of lengths: at most max_tokens numbers, whatever the input. The plan
lists bins (patterns of lengths) with the number of times that each is used. Every piece gets a rank among the pieces
of its length, and a range of ranks of a length belongs to a bin of the plan.

Best-two-fit: a bin is filled greedily (the largest length that still fits); then its smallest piece is replaced by two
unpacked ones if they fill the expanded gap more tightly.

Ranks come from a window over (length, bucket), where bucket is a hash bucket of the row, plus the offsets of the
buckets: a length that a third of all pieces share is spread over buckets whose number grows with its pieces.

Defined results: a null or empty text is the single end id; repeated documents are packed one by one; an empty table
gives no sequences; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import table, written

MAX_TOKENS = 4096
END_ID = 1
TOKENIZER_FILE = "word_bpe_49k.json"
#: Chunks between white space whose ids a Python worker remembers.
CACHE = 500_000
#: Characters that the quick way knows; texts with any other are given whole to the tokenizer. Control characters that
#: count as white space in one library only are left out, and so is END, which marks the end of a run of signs.
END = "\x01"
LATIN = [chr(c) for c in [*range(0x180), *range(0x2010, 0x2028)] if chr(c) not in "\x01\x1c\x1d\x1e\x1f\x85"]

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def ranges(chars: list[str]) -> str:
    """The characters as ranges for a regular expression's class."""
    codes, out = sorted(map(ord, chars)), ""
    for i, c in enumerate(codes):
        if i == 0 or codes[i - 1] != c - 1:
            first = c
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out += f"\\u{first:04x}-\\u{c:04x}"
    return out


def of_category(first: str) -> str:
    return ranges([c for c in LATIN if unicodedata.category(c).startswith(first)])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's own; a cache of chunks by itself.

    The tokenizer lower-cases, drops white space, cuts the rest into runs of letters, single numbers and runs of other
    signs, and encodes each run by itself. For Latin texts the same is done here chunk by chunk, so that each
    different chunk is encoded once and remembered. Runs are encoded by ranks: every vocabulary entry as bytes, with
    END in place of the word-end mark.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, numbers = of_category("L"), of_category("N")
        self.runs = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{letters}{numbers}]+|[{numbers}]").findall
        self.other = re.compile(f"[^{ranges(LATIN)}]").search  # quick for ASCII and for Latin-1
        alphabet, ranks = byte_alphabet(), {}
        special = set(self.tokenizer.get_added_tokens_decoder())
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if i not in special:
                body = token.removesuffix("</w>")
                ranks[bytes(alphabet[c] for c in body) + END.encode() * (body != token)] = i
        self.ids = tiktoken.Encoding("runs", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = array("I", self.ids(chunk + END)).tobytes()
        elif chunk[:-1].isalpha() and chunk[-1] in ".,":
            ids = self[chunk[:-1]] + self[chunk[-1]]
        else:
            ids = array("I", self.ids(END.join([*self.runs(chunk), ""]))).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if END in text or self.other(text):
            return self.whole([text])[0]
        return b"".join(map(self.__getitem__, text.lower().split()))


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most max_tokens ids; the path is looked up in the task, as folders differ by machine."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = Encoder(path or tokenizer_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.encode(text) + end
                    for k, b in enumerate(range(0, len(ids), 4 * max_tokens)):
                        cut = ids[b : b + 4 * max_tokens]
                        out.append((doc_id, k, b // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = zip(*out) if out else [[]] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=PIECE.names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins by best-two-fit: (lengths in the bin, times used), for counts of pieces by length."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    bins = []

    def largest(most: int, used: dict[int, int]) -> int:
        """The largest length up to most of which a piece is left."""
        i = bisect.bisect_right(lengths, most) - 1
        while i >= 0 and left[lengths[i]] <= used.get(lengths[i], 0):
            i -= 1
        return lengths[i] if i >= 0 else 0

    def best_two(gap: int, over: int, used: dict[int, int]) -> tuple[int, int]:
        """Two pieces with the largest sum up to gap and above over, else zeros."""
        best, pair, i, j = over, (0, 0), 0, bisect.bisect_right(lengths, gap) - 1
        while i <= j and best < gap:
            x, y = lengths[i], lengths[j]
            if left[x] - used.get(x, 0) < 1 + (x == y):
                i += 1
            elif left[y] - used.get(y, 0) < 1:
                j -= 1
            elif x + y > gap:
                j -= 1
            else:
                if x + y > best:
                    best, pair = x + y, (x, y)
                i += 1
        return pair

    while lengths:
        content, used, room = [], {}, size
        while room and (n := largest(room, used)):
            times = min(room // n, left[n] - used.get(n, 0))
            content += [n] * times
            used[n] = used.get(n, 0) + times
            room -= n * times
        if room and len(content) > 1:
            smallest = content[-1]
            used[smallest] -= 1
            x, y = best_two(room + smallest, smallest, used)
            if x:
                content[-1:] = [y, x]
                for n in (x, y):
                    used[n] = used.get(n, 0) + 1
            else:
                used[smallest] += 1
        times = min(left[n] // u for n, u in used.items() if u)
        bins.append((content, times))
        for n, u in used.items():
            left[n] -= u * times
        gone = [n for n, u in used.items() if u and not left[n]]
        for n in gone:
            lengths.remove(n)
    return bins


class Places:
    """The plan as sorted ranges of ranks by length, for lookups of whole arrays."""

    def __init__(self, bins: list[tuple[list[int], int]]):
        ranks: dict[int, int] = {}
        rows, sequence = [], 0
        for content, times in bins:
            place = 0
            for n in dict.fromkeys(content):
                copies = content.count(n)
                rows.append((n << 40 | ranks.get(n, 0), copies, sequence, place))
                ranks[n] = ranks.get(n, 0) + copies * times
                place += copies * n
            sequence += times
        rows.sort()
        self.first, self.copies, self.sequence, self.place = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 40 | rank
        at = np.searchsorted(self.first, key, "right") - 1
        turn, within = np.divmod(key - self.first[at], self.copies[at])
        return self.sequence[at] + turn, self.place[at] + within * length


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS, least_buckets: int = 32, bucket_rows: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to the pieces (columns of PIECE).

    A length has least_buckets buckets, and more where it has over least_buckets * bucket_rows pieces. The driver sees
    a row per (length, bucket): max_tokens * least_buckets at most, and one per bucket_rows pieces of frequent lengths.
    """
    spark = cut.sparkSession
    cut = written(cut, "pieces")
    often = cut.groupBy("length").count().filter(F.col("count") > least_buckets * bucket_rows).collect()  # max_tokens rows at most
    buckets = F.lit(least_buckets)
    if often:
        more = F.create_map(*(F.lit(x) for r in often for x in (r["length"], -(-r["count"] // bucket_rows))))
        buckets = F.coalesce(F.try_element_at(more, F.col("length")).cast("int"), buckets)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets).cast("int"))
    counts = cut.groupBy("length", "bucket").count().collect()
    totals: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["bucket"])):
        before[r["length"], r["bucket"]] = totals.get(r["length"], 0)
        totals[r["length"]] = totals.get(r["length"], 0) + r["count"]
    places = spark.sparkContext.broadcast((Places(plan(totals, max_tokens)), before))

    def run(batches):
        where, start = places.value
        for batch in batches:
            length, bucket, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            rank = rank - 1 + np.array([start[k] for k in zip(length.tolist(), bucket.tolist())], dtype=np.int64)
            sequence, offset = where.find(length, rank)
            columns = [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*PIECE.names, "sequence_id", "offset"])

    ranked = cut.selectExpr("*", "row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece, ids_crc32) AS rank")
    schema = T.StructType([*PIECE, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
