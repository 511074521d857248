"""Layout-independent sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_BUCKETS = 16**8


def key_hash_sample(keys: Sequence[str], fraction: float, seed: int) -> Column:
    """True for a fixed `fraction` of all key values, whatever the partitioning.

    Two frames with the same keys are sampled alike, because only the key decides.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie between 0 and 1")
    if fraction == 1.0:
        return F.lit(True)
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k) for k in keys]))
    return digest < F.lit(f"{int(fraction * _BUCKETS):08x}")
