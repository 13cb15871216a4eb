"""From documents to packed sequences: reject toxic texts, keep one of each near-duplicate group, remove benchmark
contamination, mask personal data, pack.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder and read again. All stages
but the last return the columns of documents. Null and empty texts pass the filters as the operators define; of equal
documents one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import decontaminate, jaccard, packing, pii, simhash, toxicity
from storyline.llm.common import table, written
from storyline.sources.scratch import TABLES, clear_since


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the score is a column of the map, so nothing is joined."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id.

    Links are those of op5 (fingerprints at three or fewer differing bits, by Golay keys) and, as an exact check of what
    fingerprints miss, all at a five-word Jaccard of 0.8 or more. A class is what both kinds connect.
    """
    mark = len(TABLES)
    close = simhash.near_duplicates(docs).select("text_hash", "class").distinct()
    close = written(close, "fingerprint-classes")
    clear_since(spark, mark, close)
    return simhash.keep_of_classes(docs, simhash.united(jaccard.near_duplicates(docs), close))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.masked(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 4096 ids with their sequences and offsets."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs


#: No SQL: fingerprints, tokenizers and learned scores are not expressible there; tests hold it against plain Python.
ORACLE_SQL = None
