"""One query per training-data operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litrewise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(run: Query) -> Query:
    _registry[run.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_registry)


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.mixing import mix_sizes

    return mix_sizes(table(spark, sf_dir, "documents"))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.sketches import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 16)


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.language import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.quality import classify_documents

    return classify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.token_counts import count_documents

    return count_documents(table(spark, sf_dir, "documents"))


@query
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.pieces import encode_and_check

    return encode_and_check(table(spark, sf_dir, "documents"))


@query
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.repeats import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"))


@query
def op4_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.forest import join_documents

    return join_documents(table(spark, sf_dir, "documents"))


@query
def op8_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.permutation import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.runs import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litrewise.llm.conversations import repair_digests

    return repair_digests(table(spark, sf_dir, "conversations"))
