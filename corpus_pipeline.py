"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, tokenization.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. Every stage works on
all that the one before it kept. All but the last return the columns of `documents`; the last returns one row per
document with doc_id, lang, source, ids (array<int>), n_ids and lossless.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact, langid, mixing, pieces, simhash
from factloom.llm.common import checkpoint_folder, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those too far from every centroid."""
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for white space), one row stays: the longest, then the one with the smallest id."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources, languages and topics have their target weights in tokens; all columns stay."""
    return mixing.keep_mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document, with merge dropout, and tell whether decoding gives its text back. A null text has no ids."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return pieces.encode(rows, outputs=("ids", "n_ids", "lossless"), keep_text=False)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokenize", tokenize),
]

#: Language ID and SimHash aren't SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is written to the shared checkpoint folder.

    A stage's table is removed when the next one's is written; the last one stays, as the result reads it.
    """
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
