"""Language, stems and skeletons of whole texts in one Arrow map: the functions of `text` worked out once for each different word.

Texts of characters for which Python's and Java's classes and lower case agree (SAFE: Latin, Cyrillic, usual punctuation) are cut
into words in Python; any other text goes through the expressions of `text`. Both give the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.functions import text

#: Characters, first and last, and exceptions: numbers that are no digits, connectors, combining signs, dotted I.
RANGES = ((0x00, 0x24F), (0x400, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2116, 0x2116), (0x2122, 0x2122), (0x2212, 0x2212), (0x275D, 0x275E), (0xFEFF, 0xFEFF))
EXCEPT = {0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE, 0x130, 0x203F, 0x2040, 0x2054, *range(0x483, 0x48A)}
SAFE = [c for low, high in RANGES for c in range(low, high + 1) if c not in EXCEPT]

#: Different words whose results a task keeps; texts that are worked on at once.
MOST_WORDS, AT_ONCE = 200_000, 4000

PLAIN = {**dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)), **dict.fromkeys((*range(0x2010, 0x2016), 0x2212), "-")}
MARKS = re.compile("[" + "".join(map(chr, PLAIN)) + "]")
LATIN = str.maketrans(dict(zip(*text.TRANSLIT_ONE)) | text.TRANSLIT_MORE)
FOUND = re.compile(text.WORD.removeprefix("(?U)"))
CYRILLIC, OTHER, DOUBLE = re.compile("[Ѐ-ӿ]"), re.compile("[^a-z]|[aeiouyh]"), re.compile(r"(.)\1+")
NO_CONSONANT = bytes(c for c in range(128) if OTHER.match(chr(c)) or chr(c) == "\n")
STOPS = {*text.STOP_RU, *text.STOP_KK, *text.STOP_EN}
RUSSIAN, ENGLISH = (sorted(x, key=len, reverse=True) for x in (text.ENDINGS_RU, text.ENDINGS_EN))
LAST_ENGLISH = {end[-1] for end in ENGLISH}

#: Bits of a character: safe, letter, Cyrillic letter, ASCII letter, Kazakh letter (of either case).
CLASS = np.zeros(0x110000, np.uint8)
for _c in SAFE:
    CLASS[_c] = 1 | chr(_c).isalpha() * (2 | (0x400 <= _c <= 0x4FF) * 4 | (_c < 0x80) * 8 | (chr(_c).lower() in text.KAZAKH) * 16)


def stem(word: str, kazakh: bool) -> str:
    if len(word) <= 4 or word.isdecimal():
        return word
    cyrillic = not word.isascii() and CYRILLIC.search(word) is not None
    if cyrillic and kazakh:
        return word[:5]
    if cyrillic or word[-1] in LAST_ENGLISH:
        for end in RUSSIAN if cyrillic else ENGLISH:
            if word.endswith(end) and len(word) - len(end) >= 4:
                return word[: len(word) - len(end)][:6]
    return word[:6]


def skeleton(word: str) -> str:
    s = word.encode().translate(None, NO_CONSONANT).decode() if word.isascii() else OTHER.sub("", word.translate(LATIN))
    s = DOUBLE.sub(r"\1", s)
    return s[:-1] if len(s) > 3 and s.endswith("s") else s


class Words(dict):
    """Numbers of words, and what follows from each: whether it counts, its stems and its skeleton."""

    def __init__(self):
        super().__init__()
        self.counts: list[bool] = []
        self.made: tuple[list[str], ...] = ([], [], [])

    def __missing__(self, word: str) -> int:
        self.counts.append(word not in STOPS and (len(word) >= 2 or word.isdecimal()))
        plain, kazakh, bare = self.made
        plain.append(one := stem(word, False))
        kazakh.append(one if word.isascii() else stem(word, True))
        bare.append(skeleton(word))
        self[word] = out = len(self)
        return out


def language(n: int, cyrillic: int, ascii_: int, kazakh: int) -> str:
    if n < 8:
        return "unknown"
    if cyrillic / n > 0.5:
        return "kk" if kazakh >= 2 and kazakh / max(cyrillic, 1) > 0.015 else "ru"
    return "en" if ascii_ / n > 0.6 else "unknown"


def lists(rows: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)), values)


def analysed(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and lang, stems, skeletons: detect_language, tokenize and the skeletons of word_tokens."""
    own = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    schema = f"{kinds}, lang string, stems array<string>, skeletons array<string>, rest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for whole in batches:
            for low in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(low, AT_ONCE)
                if len(known) > MOST_WORDS:
                    known = Words()
                given, n = batch.column(batch.schema.get_field_index("text")), batch.num_rows
                langs, rest, found, size = [], [], [], np.zeros(n, np.int64)
                for k, raw in enumerate(given.cast(pa.binary()).to_pylist()):
                    t = (raw or b"").decode("utf-8", "replace")
                    plain = t.isascii()
                    bits = CLASS[np.frombuffer(raw or b"", np.uint8) if plain else np.frombuffer(t.encode("utf-32-le"), np.uint32)]
                    safe = bool((bits & 1).all())
                    rest.append(None if safe else raw)
                    if safe:
                        langs.append(language(*(int(np.count_nonzero(bits & b)) for b in (2, 4, 8, 16))))
                        t = (t.translate(PLAIN) if not plain and MARKS.search(t) else t).lower().replace("ё", "е")
                        words = [known[w] for w in FOUND.findall(t)]
                        size[k] = len(words)
                        found.extend(words)
                    else:
                        langs.append(None)
                row, at = np.repeat(np.arange(n), size), np.array(found, np.int64)
                plain, kazakh, bare = (pa.array(x, pa.string()) for x in known.made)
                keep = np.array(known.counts, bool)[at]
                kk = np.array([x == "kk" for x in langs], bool)[row]
                stems = pc.if_else(pa.array(kk[keep]), kazakh.take(pa.array(at[keep])), plain.take(pa.array(at[keep])))
                rest = pa.array(rest, pa.binary()).view(pa.string())  # as it is, valid or not
                columns = [batch.column(batch.schema.get_field_index(c)) for c in own]
                columns += [pa.array(langs, pa.string()), lists(row[keep], stems, n), lists(row, bare.take(pa.array(at)), n), rest]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, "lang", "stems", "skeletons", "rest"])

    made = docs.mapInArrow(run, schema)
    t, done = F.col("rest"), F.col("rest").isNull()
    return made.select(
        *own,
        F.when(done, F.col("lang")).otherwise(text.detect_language(t)).alias("lang"),
        F.when(done, F.col("stems")).otherwise(text.tokenize(t)).alias("stems"),
        F.when(done, F.col("skeletons")).otherwise(F.transform(text.word_tokens(t), text.skeleton)).alias("skeletons"),
    )
