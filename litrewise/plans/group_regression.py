"""Linear regressions for all fuels at once, from one grouped aggregation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrewise.placement import fits_broadcast, settle

MODEL = "n_rows long, intercept double, coefficients array<double>"


def moments(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str]) -> DataFrame:
    """Per group: rows, means, and covariances of label and features (upper triangle, label last).

    One pass; means and covariances are merged stably from partial ones before the shuffle, so
    that a group is never one task's rows. Rows with a null feature or label are left out.
    """
    names = [*features, label]
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=names)
    pairs = combinations_with_replacement(names, 2)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(*[F.avg(c) for c in names]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covariances"),
    )


def solve(means: np.ndarray, covariances: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of least squares. Features are scaled to variance 1 first; one
    that does not vary, or only as others do, gets the smallest coefficient that fits."""
    n = len(means)
    full = np.zeros((n, n))
    full[np.triu_indices(n)] = covariances
    full = full + np.triu(full, 1).T
    scale = np.sqrt(np.diag(full))[:-1]
    varies = scale > 0
    slopes = np.zeros(n - 1)
    if varies.any():
        used = np.flatnonzero(varies)
        matrix = full[np.ix_(used, used)] / np.outer(scale[used], scale[used])
        slopes[used] = np.linalg.lstsq(matrix, full[used, -1] / scale[used], rcond=1e-12)[0] / scale[used]
    return float(means[-1] - slopes @ means[:-1]), slopes


def fit_by_group(df: DataFrame, features: Sequence[str], *, label: str = "prix", by: Sequence[str] = ("name",)) -> DataFrame:
    """One row per group: its columns, n_rows, intercept and coefficients in order of `features`.

    The observations are read once and nothing is iterated; what is solved is one small matrix a
    group, in tasks. The result is settled: predictions do not fit again.
    """
    sums = moments(df, features, label, by)

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("means").to_pylist(), batch.column("covariances").to_pylist())
            fits = [solve(np.array(m), np.array(c)) for m, c in rows]
            columns = [batch.column(c) for c in [*by, "n_rows"]]
            columns += [pa.array([f[0] for f in fits], pa.float64()), pa.array([f[1].tolist() for f in fits], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "n_rows", "intercept", "coefficients"])

    groups = ", ".join(f"`{c}` {t}" for c, t in sums.select(*by).dtypes)
    return settle(sums.mapInArrow(solved, f"{groups}, {MODEL}"))


def predict_by_group(df: DataFrame, models: DataFrame, features: Sequence[str], *, by: Sequence[str] = ("name",)) -> DataFrame:
    """`df` with the prediction of its group's model, null for groups without one. The models are
    broadcast if their measured size allows it."""
    renamed = models.select(*[F.col(c).alias(f"_model_{c}") for c in by], "intercept", "coefficients")
    side = F.broadcast(renamed) if fits_broadcast(models) else renamed
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_model_{c}"))
    prediction = F.col("intercept")
    for i, c in enumerate(features):
        prediction = prediction + F.get("coefficients", F.lit(i)) * F.col(c)
    rows = df.join(side, same, "left").withColumn("prediction", prediction)
    return rows.drop("intercept", "coefficients", *[f"_model_{c}" for c in by])
