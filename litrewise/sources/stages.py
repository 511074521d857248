"""Stages kept as Parquet between steps of a pipeline."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from litrewise.operators.sketches import day_sketches

# Hidden from scans, like all names that begin with an underscore.
SCHEMA_FOLDER = "_stage_schema"


def write_stage(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """Replace the stage at `path`.

    Partitioning by `name` lets fuel filters skip whole folders. Each task writes one
    file per fuel it holds, so nothing is shuffled and a dominant fuel stays spread.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # Folder values have no type of their own; readers take them from here.
    described = df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string")
    described.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{SCHEMA_FOLDER}")


def stage_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema a stage was written with, if it tells."""
    try:
        described = spark.read.text(f"{path.rstrip('/')}/{SCHEMA_FOLDER}").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return T.StructType.fromJson(json.loads(described["value"])) if described else None


def read_stage(
    spark: SparkSession, path: str, *, schema: T.StructType | None = None
) -> DataFrame:
    """Read a stage with `schema`, or with the one it was written with, so that folder values
    such as "98" do not become numbers."""
    schema = schema or stage_schema(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished job left its success marker at `path`."""
    try:
        spark.read.text(f"{path.rstrip('/')}/_SUCCESS")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    *,
    refresh: bool = False,
    partition_by: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read the stage at `path`, building it first when absent, unfinished or refreshed.

    Errors of `build` and of the read are passed on, never taken for a missing stage.
    """
    if not refresh and is_complete(spark, path):
        return read_stage(spark, path, schema=schema)
    df = build()
    write_stage(df, path, partition_by=partition_by)
    return read_stage(spark, path, schema=schema)


SKETCH_FOLDER = "_day_sketches"


def write_sketched_stage(df: DataFrame, path: str, *, by: Sequence[str] = ("name",), partition_by: Sequence[str] = ()) -> DataFrame:
    """`write_stage`, and beside it a sketch of the days of each group of `by`, made from two
    columns of what was written. Returns the stage."""
    write_stage(df, path, partition_by=partition_by)
    stage = read_stage(df.sparkSession, path, schema=df.schema)
    day_sketches(stage, by).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{SKETCH_FOLDER}")
    return stage


def stage_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The sketches beside a stage: a row for each group, however many rows the stage has."""
    return spark.read.parquet(f"{path.rstrip('/')}/{SKETCH_FOLDER}")


def register_view(df: DataFrame, name: str = "gas_prices") -> DataFrame:
    df.createOrReplaceTempView(name)
    return df
