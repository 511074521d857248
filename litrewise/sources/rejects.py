"""Raw price files whose malformed lines are kept apart."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litrewise.placement import settle
from litrewise.sources.prices import RAW_SCHEMA
from litrewise.sources.stages import read_stage, write_stage

LINE = "_line"
TOO_FEW, TOO_MANY, BAD_VALUE = "too_few_fields", "too_many_fields", "bad_value"


class Sorted(NamedTuple):
    """`accepted`: rows of RAW_SCHEMA; `rejected`: file, line, n_fields and reason."""

    accepted: DataFrame
    rejected: DataFrame


def reject_reason(line: Column, n_fields: Column) -> Column:
    """Why a line does not fit: its number of fields, or else a value of another type."""
    wanted = len(RAW_SCHEMA)
    return F.when(n_fields < wanted, TOO_FEW).when(n_fields > wanted, TOO_MANY).otherwise(BAD_VALUE)


def read_price_files_checked(spark: SparkSession, paths: str | Sequence[str], quarantine: str) -> Sorted:
    """Read price files; lines that do not fit go to a Parquet stage at `quarantine`.

    The files are parsed once (a gzip file cannot be split, nor read in part): all lines are
    settled with the text of those that do not fit, so that accepted and rejected lines add up to
    all. A line is rejected for too few or too many fields and for a value that is not of its
    column's type; a price may be any text. Fields are told as the parser tells them, so that a
    quoted separator is no separator. Empty lines are no lines.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(LINE, T.StringType())])
    reader = spark.read.option("sep", ";").option("header", False).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", LINE).schema(schema).csv(paths)
    rows = settle(rows.withColumn("file", F.col("_metadata.file_path")))
    bad = rows.filter(F.col(LINE).isNotNull()).select("file", F.col(LINE).alias("line"))
    # Quoted stretches count as one character of a field.
    plain = F.regexp_replace("line", r'"[^"]*"', "q")
    bad = bad.withColumn("n_fields", F.length(plain) - F.length(F.translate(plain, ";", "")) + 1)
    write_stage(bad.withColumn("reason", reject_reason(F.col("line"), F.col("n_fields"))), quarantine)
    accepted = rows.filter(F.col(LINE).isNull()).select(*RAW_SCHEMA.names)
    return Sorted(accepted, read_stage(spark, quarantine))


def line_counts(found: Sorted) -> DataFrame:
    """Lines by what became of them: `accepted`, or the reason of their rejection."""
    kept = found.accepted.select(F.lit("accepted").alias("outcome"))
    lost = found.rejected.select(F.col("reason").alias("outcome"))
    return kept.unionByName(lost).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_lines"))
