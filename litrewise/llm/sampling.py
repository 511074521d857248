"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litrewise.llm.common import SCALE, hex_number
from litrewise.placement import fits_broadcast


def row_name() -> list[Column]:
    """What tells labelled texts apart: id (empty where there is none) and digest, so that rows of
    one id are several and equal rows are one."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row_id"), F.md5(text).alias("digest")]


def lowest_per_class(rows: DataFrame, label: str, per_class: int, seed: str) -> DataFrame:
    """`per_class` rows of each label, those with the lowest hashes.

    `rows` has the different row_id, digest and label only. Of each label only hashes below a
    bound are ranked, chosen from its count so that about twice as many rows as wanted are left,
    however common the label is.
    """
    drawn = rows.withColumn("_draw", hex_number(F.concat_ws("/", "row_id", "digest", F.lit(seed))))
    totals = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    if fits_broadcast(totals):
        bound = F.lit(SCALE * (2 * per_class + 200)) / F.col("_rows")
        drawn = drawn.join(F.broadcast(totals), label).filter(F.col("_draw") < bound).drop("_rows")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_draw", "row_id", "digest"))
    ranked = drawn.withColumn("_rank", rank).filter(F.col("_rank") <= per_class)
    return ranked.select("row_id", "digest", label, "_draw")
