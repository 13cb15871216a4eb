"""Quality rules by tokeniser fertility, beside plain text counts.

Two public vocabularies measure every text, word by word (words between ASCII white space, each encoded by itself and
remembered, so that a worker encodes a frequent word once):
  * characters per token and token entropy by the byte-level vocabulary for many languages;
  * byte-fallback share by the piece vocabulary: the share of tokens that are bytes of signs it doesn't have.

A text is kept if its measures lie in the band of its language, or of its script where the language has no band.
Entropy is compared with what a text of its length can reach (log2 of the number of tokens, at most 12 bits).

A map without a shuffle. Defined results: null and empty texts have no words and fail the base rule; a null or unknown
language takes the band of the script; repeated rows give a row each; columns other than doc_id, text and lang are not
read.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import map_rows, table

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
REPEAT_WINDOW = 3
CACHE = 300_000

#: Fixed values. Bands: least and most characters per token, most byte-fallback share, least share of the reachable
#: entropy. The lower ends lie a twentieth or more under the least that texts labelled good have in each language;
#: the vocabulary cuts French and Spanish finer than English and German.
LANGUAGE_BANDS = {
    "en": (1.85, 8.0, 0.02, 0.52),
    "de": (1.95, 8.0, 0.02, 0.52),
    "fr": (1.72, 8.0, 0.02, 0.52),
    "es": (1.78, 8.0, 0.02, 0.52),
}
SCRIPT_BANDS = {
    "latin": (1.3, 9.0, 0.05, 0.40),
    "cyrillic": (1.0, 9.0, 0.05, 0.40),
    "han": (0.4, 5.0, 0.40, 0.40),
    "other": (0.3, 9.0, 0.70, 0.35),
}
SCRIPTS = {
    "latin": re.compile("[A-Za-zÀ-ɏ]"),
    "cyrillic": re.compile("[Ѐ-ӿ]"),
    "han": re.compile("[぀-ヿ一-鿿]"),
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_pieces", "n_byte_pieces"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in COUNTS),
        T.StructField("token_entropy", T.DoubleType()),
        T.StructField("script", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)


class Fertility(dict):
    """word -> (ids by the byte-level vocabulary, number of pieces, number of byte pieces); a bounded cache."""

    def __init__(self, byte_level: str, piece_model: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_level, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.pieces = pieces.encode
        self.is_byte = [pieces.is_byte(i) for i in range(pieces.vocab_size())]

    def __missing__(self, word: str) -> tuple[bytes, int, int]:
        pieces = self.pieces(word)
        found = array("I", self.ids(" " + word)).tobytes(), len(pieces), sum(self.is_byte[i] for i in pieces)
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found

    def measure(self, words: list[str]) -> tuple[int, int, int, float]:
        """Tokens, pieces, byte pieces and the entropy of the tokens in bits."""
        found = list(map(self.__getitem__, words))
        ids = np.frombuffer(b"".join([f[0] for f in found]), dtype="<u4")
        if not ids.size:
            return 0, 0, 0, 0.0
        share = np.unique(ids, return_counts=True)[1] / ids.size
        return ids.size, sum([f[1] for f in found]), sum([f[2] for f in found]), float(-(share * np.log2(share)).sum())


def repeated_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    seq = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    key = seq[:n]
    for k in range(1, window):  # renumbered each time: no overflow for any text
        key = np.unique(key * len(numbers) + seq[k : k + n], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    hit = np.zeros(len(words), dtype=bool)
    for k in range(window):
        hit[k : k + n] |= again
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    return sum(n - 1 for line, n in Counter(text.split("\n")).items() if n > 1 and line.strip(SPACES))


def script_of(text: str) -> str:
    counts = {name: len(letters.findall(text)) for name, letters in SCRIPTS.items()} if not text.isascii() else {"latin": 1}
    name = max(counts, key=counts.get)
    return name if counts[name] else "other"


def measure(docs: DataFrame, byte_level: str | None = None, piece_model: str | None = None) -> DataFrame:
    """Counts and fertility measures of every text; vocabulary files by path, or the installed ones."""
    open_: list[Fertility] = []

    def rows(cols: dict[str, list]) -> dict:
        if not open_:
            import public_tokenizers as P

            open_.append(Fertility(byte_level or P.path("byte_bpe_multi_50k.tiktoken"), piece_model or P.path("piece_bpe_32k.model")))
        out: dict[str, list] = {f.name: [] for f in SCHEMA}
        for text in cols["text"]:
            text = text or ""
            # bytes.split parts at ASCII white space only
            words = text.split() if text.isascii() and not re.search("[\x1c-\x1f]", text) else [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
            tokens, pieces, byte_pieces, entropy = open_[0].measure(words)
            for name, value in (
                ("n_words", len(words)),
                ("word_chars", len(text) - sum(map(text.count, SPACES))),
                ("n_symbols", sum(map(text.count, SYMBOLS))),
                ("n_dup_lines", duplicate_lines(text)),
                ("n_repeat_words", repeated_words(words)),
                ("n_tokens", tokens),
                ("n_pieces", pieces),
                ("n_byte_pieces", byte_pieces),
                ("token_entropy", entropy),
                ("script", script_of(text)),
            ):
                out[name].append(value)
        return out | {"doc_id": cols["doc_id"], "lang": cols["lang"]}

    return map_rows(docs.select("doc_id", "text", "lang"), SCHEMA, rows)


def band(bands: dict[str, tuple], i: int) -> F.Column:
    return F.create_map(*(F.lit(x) for name, values in bands.items() for x in (name, float(values[i]))))


def judge(measured: DataFrame) -> DataFrame:
    """Adds chars_per_token, byte_share, entropy_share, base_failed and kept."""
    limits = [F.coalesce(F.try_element_at(band(LANGUAGE_BANDS, i), F.coalesce("lang", F.lit(""))), F.try_element_at(band(SCRIPT_BANDS, i), F.col("script"))) for i in range(4)]
    out = measured.withColumns(
        {
            "chars_per_token": F.try_divide(F.col("word_chars").cast("double"), F.col("n_tokens")),
            "byte_share": F.try_divide(F.col("n_byte_pieces").cast("double"), F.col("n_pieces")),
            "entropy_share": F.try_divide(F.col("token_entropy"), F.least(F.log2(F.greatest("n_tokens", F.lit(2)).cast("double")), F.lit(12.0))),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    good = F.col("chars_per_token").between(limits[0], limits[1]) & (F.col("byte_share") <= limits[2]) & (F.col("entropy_share") >= limits[3])
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(measure(table(spark, sf_dir, "documents")))
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept", "chars_per_token", "byte_share", "token_entropy")
