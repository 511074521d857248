"""Partitioned stages that are refreshed only where their input files have changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litrewise.placement import settle
from litrewise.sources.prices import RAW_SCHEMA
from litrewise.sources.stages import is_complete, read_stage, write_stage

# Hidden from scans, like all names that begin with an underscore.
MANIFEST = "_manifest"
NEXT_MANIFEST = "_manifest_next"
FILE = "input_file"

Build = Callable[[DataFrame], DataFrame]


class Refreshed(NamedTuple):
    """The stage, the partition values that were written or removed, and the files that were read
    for it."""

    stage: DataFrame
    values: list
    read: list[str]


def input_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Name (as scans give it), path (as it is opened), size and time of change of the files that
    match, without reading them."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("path").alias("opened"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("changed"),
    )


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """File, size, change time and partition value of everything that the stage was built from.
    A refresh that ended while it replaced the manifest left the next one, which then holds."""
    for name in (MANIFEST, NEXT_MANIFEST):
        if is_complete(spark, f"{path}/{name}"):
            return spark.read.parquet(f"{path}/{name}")
    return None


def _write_manifest(spark: SparkSession, path: str, rows: DataFrame) -> None:
    _delete(spark, f"{path}/{NEXT_MANIFEST}")
    rows.coalesce(1).write.parquet(f"{path}/{NEXT_MANIFEST}")
    _delete(spark, f"{path}/{MANIFEST}")
    place, files = _place(spark, f"{path}/{NEXT_MANIFEST}")
    files.rename(place, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}"))


def _read(spark: SparkSession, files: Sequence[str], build: Build) -> DataFrame:
    raw = spark.read.option("sep", ";").option("header", False).schema(RAW_SCHEMA).csv(list(files))
    return build(raw.withColumn(FILE, F.col("_metadata.file_path")))


def refresh_stage(
    spark: SparkSession, paths: str | Sequence[str], path: str, build: Build, *, partition: str = "year"
) -> Refreshed:
    """Bring the Parquet stage at `path`, partitioned by `partition`, up to date with the price
    files that match `paths`.

    `build` makes the stage's rows from raw rows, row by row, and must keep the column
    `input_file`. The stage's manifest has the size and time of each file and the partition
    values of its rows. New, changed and vanished files name the values that are affected, by
    what they held and what they hold now; only rows of those values are read (from changed files
    and from unchanged ones that share a value) and only those folders are replaced, by a dynamic
    partition overwrite. A value without rows left loses its folder. The manifest is replaced
    last, so that a refresh which failed is done again. File names and partition values pass
    through the driver, as they do in any scan; rows do not.
    """
    paths, path = [paths] if isinstance(paths, str) else list(paths), path.rstrip("/")
    now = settle(input_files(spark, paths))
    old = read_manifest(spark, path)
    told = [FILE, "opened", "size", "changed"]
    if old is None:
        everything = settle(_read(spark, _names(now), build))
        write_stage(everything.drop(FILE), path, partition_by=[partition])
        values = _values(everything, partition)
        _write_manifest(spark, path, _manifest(now, everything, partition))
        return Refreshed(read_stage(spark, path), values, _names(now))
    old = settle(old)
    changed = settle(now.join(old.select(*told).distinct(), told, "left_anti"))
    gone = old.join(now, told, "left_anti")
    fresh = _names(changed)
    rows = settle(_read(spark, fresh, build)) if fresh else None
    affected = {r[0] for r in gone.select(partition).distinct().collect()} - {None}
    if rows is not None:
        affected |= set(_values(rows, partition))
    kept = old.join(now, told, "left_semi")
    if not affected and not fresh:
        if not gone.isEmpty():
            _write_manifest(spark, path, kept)
        return Refreshed(read_stage(spark, path), [], [])
    touched = F.col(partition).isin(list(affected))
    shared = _names(kept.filter(touched).select("opened").distinct())
    parts = [rows] if rows is not None else []
    if shared:
        parts.append(_read(spark, shared, build).filter(touched))
    schema = read_stage(spark, path).schema
    if parts:
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        writer = whole.select(*schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(partition).parquet(path)
    held = set(_values(rows, partition)) if rows is not None else set()
    held |= {r[0] for r in kept.filter(touched).select(partition).distinct().collect()}
    for value in affected - held:
        _delete(spark, f"{path}/{partition}={value}")
    manifest = kept if rows is None else kept.unionByName(_manifest(changed, rows, partition))
    _write_manifest(spark, path, settle(manifest))
    spark.catalog.refreshByPath(path)
    return Refreshed(read_stage(spark, path), sorted(affected), sorted([*fresh, *shared]))


def _names(files: DataFrame) -> list[str]:
    return sorted(r[0] for r in files.select("opened").collect())


def _values(rows: DataFrame, partition: str) -> list:
    return sorted(r[0] for r in rows.select(partition).distinct().collect() if r[0] is not None)


def _manifest(files: DataFrame, rows: DataFrame, partition: str) -> DataFrame:
    """A row for each file and value in it; a file without rows has one without a value."""
    return files.join(rows.select(FILE, partition).distinct(), FILE, "left")
