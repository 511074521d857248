"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 13
SCALE = float(16**DIGITS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_number(text: Column) -> Column:
    """The first 52 bits of the MD5 of `text` as a whole number held in a double.

    MD5 and not a Spark hash, so that SQL engines can follow the draws.
    """
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double")


def uniform(text: Column) -> Column:
    """A reproducible draw strictly between 0 and 1 for each `text`."""
    return (hex_number(text) + F.lit(0.5)) / F.lit(SCALE)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to `most` or less (one item at least)."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column`, so that what a task
    computes beside a batch is bounded, however long the texts of a partition are."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        for start, end in slices(np.asarray(sizes), most):
            yield batch.slice(start, end - start)


def sorted_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Whole groups of rows with equal `keys`, from batches sorted by them."""
    waiting: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        changed = np.zeros(n, dtype=bool)
        for key in keys:
            values = np.asarray(batch.column(key).to_numpy(zero_copy_only=False))
            changed[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(changed).tolist()]
        for start, end in zip(starts, [*starts[1:], n]):
            key_now = tuple(batch.column(k)[start].as_py() for k in keys)
            if last is not None and key_now != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(start, end - start))
            last = key_now
    if waiting:
        yield pa.Table.from_batches(waiting)
