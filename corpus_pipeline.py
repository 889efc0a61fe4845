"""Corpus pipeline: quality, line dedup, near-dedup, mixing, packing; each stage is written and read again.

Every stage takes null, empty and very long texts, null ids, repeated rows,
empty tables and further columns of any name; all but the last return the
columns they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import linededup, minhash, mixing, packing, quality
from terrane.llm.common import table
from terrane.llm.queries import vocabulary
from terrane.session import checkpoint_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts (score 0.5 or more: only those likelier bad than good go).

    Null and empty texts are judged like any other; repeated rows share their fate.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines an earlier one holds.

    A document that loses all its lines stays, with an empty text; null texts
    are one empty line; rows that share an id are one document.
    """
    return linededup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, that of the smallest id.

    Documents without words, those the line stage emptied among them, and
    null ids are near nothing and stay; rows that repeat an id are one.
    """
    return minhash.keep_one(docs, width=5, least=80, of=100)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, one row for each time it takes them.

    Texts without words have size 0; null sources are a source of their own.
    """
    return mixing.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; null and empty texts are the end id alone."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("mixing", mix_stage), ("packing", pack_stage),
]
#: Trained scores, signatures and tokens are beyond SQL; tests/llm holds brute-force versions of the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = f"{checkpoint_folder(spark)}/llm/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
