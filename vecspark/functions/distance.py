"""Distances between vector columns: Column expressions that Catalyst sees, and NumPy kernels for Arrow batches.

L2 is squared. Cosine is one minus the dot product of vectors that are already normalised (255 ** 2 and 127 ** 2 minus
it for vectors of unsigned and signed bytes). MIPS is squared L2 between augmented vectors (vecspark.functions.prep)."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(str, Enum):
    L2 = "l2"
    COSINE = "cosine"
    MIPS = "mips"


#: One at full scale, squared, of the element types.
SCALE = {"float": 1, "uint8": 255, "int8": 127}


def metric(name: str | Metric) -> Metric:
    try:
        return Metric(name)
    except ValueError:
        raise ValueError(f"unknown metric {name!r}; one of {[m.value for m in Metric]}") from None


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column, element: str = "float") -> Column:
    return F.lit(float(SCALE[element] ** 2)) - dot(a, b)


def inner_product(a: Column, b: Column) -> Column:
    """Negated, so that less is nearer."""
    return -dot(a, b)


def norm_sq(a: Column) -> Column:
    return _sum(F.transform(doubles(a), lambda x: x * x))


def distance(name: str | Metric, element: str = "float"):
    """The Column builder of a metric."""
    m = metric(name)
    if m is Metric.MIPS and element != "float":
        raise ValueError("mips is for float vectors")
    return (lambda a, b: cosine(a, b, element)) if m is Metric.COSINE else l2sq


# --- kernels -------------------------------------------------------------------------------------------------------


def pairwise(name: str | Metric, a: np.ndarray, b: np.ndarray, element: str = "float") -> np.ndarray:
    """Distances of rows of a to rows of b by one matrix product, in double precision."""
    p = a @ b.T
    if metric(name) is Metric.COSINE:
        return SCALE[element] ** 2 - p
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * p, 0)


def to_rows(name: str | Metric, q: np.ndarray, rows: np.ndarray, element: str = "float") -> np.ndarray:
    """Distances of q to rows (or of each row of q to the row it stands beside), term by term: free of cancellation."""
    if metric(name) is Metric.COSINE:
        return SCALE[element] ** 2 - (rows * q).sum(-1)
    d = rows - q
    return (d * d).sum(-1)


def matrix(column, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), dtype)
