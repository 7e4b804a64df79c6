"""Vectors as exact integers: what whitening and code compression share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def integer_vectors(table: DataFrame, column: str, scale: int, **carried: str) -> tuple[DataFrame, int, int]:
    """Rows (carried..., x) with x = floor(scale * entry) as longs; the vectors' length; and the largest absolute entry of any x.

    carried: new name = column. Rows are left out whose vector is null, empty or shorter than the longest, or holds a null, NaN or
    infinite entry. Entries beyond a long are held at its ends. Without rows the length is 0.
    """
    entries = F.col("vector")
    whole = F.forall(entries, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    given = table.select(*[F.col(f"`{c}`").alias(name) for name, c in carried.items()], F.col(f"`{column}`").cast("array<double>").alias("vector"))
    rows = given.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(whole, F.lit(False)))
    rows = rows.select(*carried, F.transform(entries, lambda e: F.floor(F.lit(float(scale)) * e)).alias("x"))
    size, low, high = rows.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if size is None:
        return rows, 0, 0
    return rows.where(F.size("x") == size), size, max(abs(low), abs(high))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A batch's x as one matrix of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
