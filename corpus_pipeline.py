"""From raw documents to sampled token pieces, in five stages.

Each stage works on all rows that the stage before kept, written as Parquet and read again.
All but the last return the columns of `documents`, extra ones of any other name among them.
Null and empty texts pass the first stage if the classifier takes them for good, are never anyone's
near copies, and end with no pieces. Of repeated rows one stays; equal scores are treated alike,
and of near copies with one id the smallest text digest names the class. A table without rows
gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litrewise.llm import forest, mixing, pieces, quality, repeats
from litrewise.llm.common import table
from litrewise.placement import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = quality.training_labels(table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, quality.learn(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingle links of 0.8 or more connect."""
    return forest.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that an earlier place has as well."""
    return repeats.dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, piece_ids, n_pieces and lossless of every row of the mix."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "source", "lang", "text")
    return pieces.encode_documents(rows, check=True).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
