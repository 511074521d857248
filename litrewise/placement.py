"""Where intermediate results live, who removes them, and when a join side may be broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 64 * 1024 * 1024

# Paths handed out and not yet removed, and folders named for sessions without one, by application.
_paths: dict[str, list[str]] = {}
_named: dict[str, str] = {}


def name_folder(spark: SparkSession, path: str) -> None:
    """The folder to settle data in, for a session that names none in `spark.checkpoint.dir`."""
    _named[spark.sparkContext.applicationId] = path


def folder_root(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or _named.get(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder that `spark.checkpoint.dir` names, or else `name_folder`.

    The path belongs to the session's application until `release` removes it.
    """
    root = folder_root(spark)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, *, since: int = 0) -> None:
    """Remove what was settled after the first `since` paths; frames that read it are void."""
    own = _paths.get(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for path in own[since:]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
    del own[since:]


@contextmanager
def settled_within(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving, also by an error, whatever was settled inside the block."""
    before = len(_paths.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since=before)


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once and return a frame that reads it back.

    The lineage ends there: a lost executor costs a re-read, never a recomputation,
    and values that depend on the layout (partition numbers, random salts) are frozen.
    The files stay until `release` or the end of a `settled_within` block.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_memory(df: DataFrame) -> int:
    """Upper estimate of the bytes `df` takes as a broadcast table (one small job)."""
    row_bytes = F.lit(16 * len(df.columns) + 64)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            row_bytes = row_bytes + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
    return df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return size_in_memory(df) <= max_bytes
