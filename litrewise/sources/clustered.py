"""Stages laid out for reading a few stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from litrewise.sources.stages import SCHEMA_FOLDER

ROW_GROUP_BYTES = 16 * 1024 * 1024
EXPECTED_KEYS = 100_000


def write_clustered_stage(
    df: DataFrame,
    path: str,
    *,
    key: str = "id",
    order: Sequence[str] = ("day_date",),
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    expected_keys: int = EXPECTED_KEYS,
) -> None:
    """Replace the stage at `path` by one that is range-clustered on `key` and `order`.

    Each file and row group then spans few keys, so that the statistics of nearly all exclude a
    wanted key, and a Parquet bloom filter on `key` excludes those whose range contains it by
    chance. A key with very many rows is cut by `order` and spreads over several files.
    """
    columns = [key, *order]
    ranged = df.repartitionByRange(*columns) if files is None else df.repartitionByRange(files, *columns)
    writer = ranged.sortWithinPartitions(*columns).write.mode("overwrite")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(row_group_bytes))
    writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(expected_keys)).parquet(path)
    described = df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string")
    described.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{SCHEMA_FOLDER}")
