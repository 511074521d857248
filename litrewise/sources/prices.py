"""Raw price observations: header-less, semicolon-separated, usually gzipped text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column names and their order in the raw files. Text is kept for the
# columns whose bad values must become nulls, and for codes with leading zeros.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("cp", T.StringType()),
        T.StructField("pop", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("long", T.DoubleType()),
        T.StructField("date", T.StringType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("prix", T.StringType()),
    ]
)


def read_price_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    partitions: int | None = None,
    infer_schema: bool = False,
) -> DataFrame:
    """Union of all price files matching `paths` (globs allowed).

    A declared schema spares the extra pass over the data that inference costs.
    A gzip file cannot be split, so one file is one scan task. `partitions` deals the rows
    out to that many tasks: use it when a few files hold a large share of all rows, so that
    only their decompression, and no later step, stays in a few tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("sep", ";").option("header", False)
    if infer_schema:
        rows = reader.option("inferSchema", True).csv(paths).toDF(*RAW_SCHEMA.names)
    else:
        rows = reader.schema(RAW_SCHEMA).csv(paths)
    return rows if partitions is None else rows.repartition(partitions)
