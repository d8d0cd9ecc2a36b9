"""From raw documents to token ids: toxicity, exact and near duplicates, benchmark passages, encoding.

Each stage works on all rows that the one before has kept, and is written as Parquet before the next one reads it.
Stages but the last return the columns of `documents`. The steps compare texts by digests, bits and trees that SQL does
not have, so there is no SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadgrid.llm import decontaminate, exact, sentencepiece_bpe, simhash, toxicity
from leadgrid.llm.queries import PIECE_MODEL, TOKENIZERS, table
from leadgrid.sources.storage import stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels of `docs`, scores below a half."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by their SimHash fingerprints (three-word shingles, two bits at most) the document with the smallest id."""
    return simhash.keep_one(docs, shingle=simhash.SHINGLE, bits=simhash.BITS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of test items; documents that are little else go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to."""
    return sentencepiece_bpe.encode_decode(docs, f"{TOKENIZERS}/{PIECE_MODEL}")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
