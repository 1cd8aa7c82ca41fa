"""A corpus pipeline over ``documents``: from raw rows to token ids of a mixed, deduplicated corpus.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import bpe, minhash, mixing, substring_dedup, toxicity
from heliograph.session import shipped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a classifier fitted on their own labels."""
    docs = docs.select(*COLUMNS)
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return minhash.keep_one(docs.select(*COLUMNS), 5, 80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of 50 words that begin in a document of smaller doc_id too."""
    return substring_dedup.dedup(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: one row for each document and pass with the words that the pass takes."""
    return mixing.mix(docs.select(*COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text."""
    return bpe.encoded_rows(docs.select(*COLUMNS), *bpe.vocabulary())


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("minhash_near_dedup", shipped(drop_near_duplicates)),
    ("substring_dedup", shipped(drop_repeats)),
    ("source_mixing", shipped(mix_sources)),
    ("bpe_encode_decode", shipped(tokenise)),
]

#: A trained classifier stands at the start, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's input."""
    from heliograph.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
