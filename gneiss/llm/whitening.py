"""Embedding whitening from an exact integer scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gneiss.llm.session import written
from gneiss.llm.vectors import integer_vectors, matrix

#: Bits of the limbs that cross-products are taken of, and the most rows at once: 2 * 16 + 20 bits are exact in a double.
LIMB, ROWS = 16, 1 << 20
#: Bits of the limbs that sums travel in: 2**31 tasks can add theirs up in a long.
DIGIT = 32


def exact_cross(y: np.ndarray) -> np.ndarray:
    """yᵀy in Python's integers, of int64 or Python integers: cross-products of limbs are exact in doubles, and are put together shifted."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), ROWS):
        rest, limbs = y[k : k + ROWS], []
        while np.abs(rest).max() >= 1 << LIMB:
            limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        limbs.append(rest.astype(np.float64))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def wide(x: np.ndarray, most: int) -> np.ndarray:
    """x, as Python integers where a figure of so much absolute size doesn't fit in 62 bits."""
    return x if most < 1 << 62 else x.astype(object)


@dataclass(frozen=True)
class Scatter:
    """n vectors, their per-dimension sums, and n·XᵀX − SSᵀ, all exact."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray


def exact_scatter(vectors: DataFrame, length: int, most: int, shift: list[int]) -> Scatter:
    """The scatter of all rows' x. Each task adds up its rows, less the shift, in integers of any size; limbs of its sums are then added by cell.

    The driver gets a row for each cell of the upper triangle and limb, however many rows there are. The shift keeps products short and changes no result.
    """
    upper = np.triu_indices(length)
    away = np.array(shift, object)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(length, object), np.zeros((length, length), object)
        for batch in found:
            x = matrix(batch.column(0), length)
            if len(x):
                y = wide(x, 2 * most) - (away if 2 * most >= 1 << 62 else away.astype(np.int64))
                n += len(y)
                sums = sums + y.astype(object).sum(axis=0)
                cross = cross + exact_cross(y)
        out = []
        for cell, value in enumerate([n, *sums, *cross[upper]] if n else ()):
            left, limb, sign = abs(value), 0, -1 if value < 0 else 1
            while left:
                out.append((cell, limb, sign * (left & ((1 << DIGIT) - 1))))
                left, limb = left >> DIGIT, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["cell", "limb", "part"])

    cells = np.zeros(1 + length + len(upper[0]), object)
    for cell, limb, part in vectors.select("x").mapInArrow(batches, "cell int, limb int, part long").groupBy("cell", "limb").agg(F.sum("part")).toLocalIterator():
        cells[cell] += part << (DIGIT * limb)
    n, sums = int(cells[0]), cells[1 : 1 + length]
    cross = np.zeros((length, length), object)
    cross[upper] = cells[1 + length :]
    cross = np.triu(cross) + np.triu(cross, 1).T
    return Scatter(n, sums + n * away, n * cross - np.outer(sums, sums))


def principal(found: Scatter, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling; unit eigenvectors in columns, each one's largest entry positive; and each value's share of the trace.

    The covariance's entries are the exact ones, rounded once. A value that rounding alone can make is returned as 0.
    """
    square = found.n * found.n
    values, vectors = np.linalg.eigh(np.array([[v / square for v in row] for row in found.scatter.tolist()], np.float64))
    order = np.argsort(-values, kind="stable")[:components]
    top = vectors[:, order]
    top = top * np.where(np.take_along_axis(top, np.abs(top).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    trace = int(sum(found.scatter.diagonal())) / square
    own = np.where(values[order] > len(values) * np.finfo(float).eps * max(values.max(), 0.0), values[order], 0.0)
    return own, top, own / trace if trace else np.zeros(len(order))


def projected(vectors: DataFrame, found: Scatter, values: np.ndarray, top: np.ndarray, length: int, most: int) -> DataFrame:
    """vectors' key (if any), their exact deviation as decimal(38, 0), and whitened, an array by component."""
    carried = [c for c in vectors.columns if c == "key"]
    n, sums, with_variance = found.n, found.sums, values > 0
    axes = np.where(with_variance, top / np.sqrt(np.where(with_variance, values, 1.0)), np.nan)
    reach = n * most + max(abs(s) for s in sums)

    def batches(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            x = wide(matrix(batch.column(len(carried)), length), reach)
            away = x * n - (sums if x.dtype == object else sums.astype(np.int64))
            if reach * reach * length < 1 << 63:
                deviation = pa.array((away * away).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0), safe=False)
            else:
                whole = [sum(int(a) * int(a) for a in row) for row in away]
                deviation = pa.array([w if w < 10**38 else None for w in whole], pa.decimal128(38, 0))
            white = (away / n).astype(np.float64) @ axes
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # NaN, of a component without variance, is null
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(values), dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], deviation, lists], [*carried, "deviation", "whitened"])

    schema = vectors.select(*carried).schema.add("deviation", "decimal(38,0)").add("whitened", ArrayType(DoubleType()))
    return vectors.select(*carried, "x").mapInArrow(batches, schema)


def identity_error(white: DataFrame, values: np.ndarray) -> float:
    """The largest absolute entry of whitened's covariance (divisor n, centred first) less the identity, over components with variance; 0 without any."""
    own = [k for k, v in enumerate(values) if v > 0]
    pairs = [(i, j) for i in own for j in own if i <= j]
    if not pairs:
        return 0.0
    got = white.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs, strict=True))


def whiten(table: DataFrame, components: int = 4, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and component, numbered from 1.

    Entries become x = floor(scale * entry); the fit list is each distinct x once. Its scatter n·XᵀX − SSᵀ is formed in integers, only then divided, rounded
    and decomposed. deviation is decimal(38, 0), the exact sum of (n·x − S)²; null beyond 38 digits. A component that the fit list doesn't vary along
    (as with one distinct vector, or fewer than components) has whitened null and explained 0.

    Rows whose vector is null, empty, shorter than the longest, or holds null, NaN or infinite entries are left out. Null and repeated keys are kept: rows out for each row in.
    A table without a usable row gives no rows. There are at most as many components as dimensions. Other columns are left out.
    """
    rows, length, most = integer_vectors(table, column, scale, key=key)
    if not length:
        empty = rows.select(F.col("key").alias(key), F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"))
        return empty.select("*", *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).where("false")
    fit = written(rows.select("x").distinct(), "fit-list")
    found = exact_scatter(fit, length, most, list(fit.first()["x"]))
    values, top, explained = principal(found, min(components, length))
    error = identity_error(projected(fit, found, values, top, length, most), values)
    shares = F.array(*[F.lit(float(e)) for e in explained])
    out = projected(rows, found, values, top, length, most).select("key", "deviation", F.posexplode("whitened").alias("place", "white"))
    return out.select(
        F.col("key").alias(key), (F.col("place") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
        F.col("white").alias("whitened"), F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
