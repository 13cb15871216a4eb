"""What the operators share: written intermediate tables, ASCII lower-casing, Arrow maps and filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storyline.sources.scratch import clear, discard, exists, few, folder_of, shared_dir, written  # noqa: F401  (shared by the operators from here)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z to a-z, all other ASCII but digits and a-z to a space. Splitting on spaces then gives
#: the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased (bytes.lower leaves all else as it is)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the ASCII-lower-cased text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def filter_rows(df: DataFrame, keep: Callable[[list[str | None]], list[bool]], block: int = 2000) -> DataFrame:
    """Rows, with all their columns, whose texts `keep` wants; an Arrow map."""
    at_text = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                yield part.filter(pa.array(keep(part.column(at_text).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_rows(df: DataFrame, schema: StructType, rows: Callable[[dict[str, list]], dict[str, Iterable]], block: int = 2000) -> DataFrame:
    """Arrow map: `rows` gets the columns of up to `block` rows as lists and returns columns of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                out = rows({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
