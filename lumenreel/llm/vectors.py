"""What the two vector operators share: which vectors take part, and exact copies of one another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def fingerprint(column: str) -> Column:
    """A 128-bit name of a vector's values; -0.0 counts as 0.0."""
    v = F.transform(F.col(column), lambda x: x + F.lit(0.0).cast("float"))
    return F.concat_ws(":", F.hex(F.xxhash64(v)), F.hex(F.xxhash64(v, F.lit(1))), F.size(column))


def matrix(values) -> np.ndarray:
    """An Arrow list column as rows of doubles; every list has the same length."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(np.float64)
