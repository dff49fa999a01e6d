"""Preparing vectors: normalisation, augmentation for inner products, queries, residuals, hashes and small rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.distance import Metric, doubles, metric, norm_sq

#: Squared norms below this count as zero: the machine epsilon of 32-bit floats.
TINY = 2.0**-23
#: Knuth's multiplicative hash: the same arithmetic in every engine, where xxhash64 is not.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def portable_hash(i: Column, salt: int = 0) -> Column:
    """(i + salt) * MULTIPLIER modulo MODULUS, for any integer: in two halves, so that no product leaves 64 bits."""
    a = F.pmod(i.cast("long") + F.lit(salt).cast("long"), F.lit(MODULUS))
    high, low = divmod(MULTIPLIER, 1 << 16)
    return F.pmod(F.pmod(a * F.lit(high), F.lit(1 << 16)) * F.lit(1 << 16) + a * F.lit(low), F.lit(MODULUS))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def normalize(v: Column, element: str = "float") -> Column:
    """Unit norm; for bytes 255 or 127 times that, rounded half away from zero. (Nearly) zero vectors become zeros."""
    scale = {"float": 1.0, "uint8": 255.0, "int8": 127.0}[element]

    def scaled(n: Column) -> Column:
        one = lambda x: F.when(n < TINY, F.lit(0.0)).otherwise(x / F.sqrt(n) * F.lit(scale))
        out = F.transform(doubles(v), one if element == "float" else lambda x: F.round(one(x)))
        return out if element == "float" else out.cast("array<smallint>")

    return _let(norm_sq(v), scaled)


def normalize_rows(df: DataFrame, column: str) -> DataFrame:
    """A whole table by unit norms, the squared norm starting at TINY: zero rows stay zeros."""
    return df.withColumn(column, _let(norm_sq(F.col(column)) + TINY, lambda n: F.transform(doubles(F.col(column)), lambda x: x / F.sqrt(n))))


def max_norm(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sqrt(F.max(norm_sq(F.col(column)))).alias("max_norm"))


def augment(df: DataFrame, column: str) -> tuple[DataFrame, float]:
    """Base vectors for inner products: divided by the largest norm, with a coordinate that makes them unit vectors. One scalar comes to the driver."""
    m = max_norm(df, column).first()[0] or 1.0
    scaled = F.transform(doubles(F.col(column)), lambda x: x / F.lit(m))
    last = F.sqrt(F.greatest(F.lit(0.0), 1 - norm_sq(F.col(column)) / F.lit(m * m)))
    return df.withColumn(column, F.concat(scaled, F.array(last))), m


def prepare_query(v: Column, name: str | Metric, element: str = "float") -> Column:
    """Queries as the index wants them: mips gets unit norm and a zero at the end, cosine the index's own scaling."""
    m = metric(name)
    if m is Metric.MIPS:
        return F.concat(normalize(v), F.array(F.lit(0.0)))
    return normalize(v, element) if m is Metric.COSINE else v


def convert(v: Column, element: str) -> Column:
    return v.cast({"float": "array<float>", "uint8": "array<smallint>", "int8": "array<tinyint>"}[element])


def residual(v: Column, center: Column, add: bool = False) -> Column:
    return F.zip_with(doubles(v), doubles(center), (lambda x, c: x + c) if add else (lambda x, c: x - c))


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix: dim by dim, so it travels with the plan."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotate(df: DataFrame, column: str, r: np.ndarray, transpose: bool = False) -> DataFrame:
    """column times r, batch by batch."""
    import pyarrow as pa

    from vecspark.functions.distance import matrix

    m = r.T if transpose else r
    at = df.columns.index(column)
    schema = df.withColumn(column, doubles(F.col(column))).schema

    def turn(batches):
        for b in batches:
            x = matrix(b.column(at)) @ m if b.num_rows else np.zeros((0, len(m)))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * m.shape[1]
            yield b.set_column(at, column, pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel())))

    return df.mapInArrow(turn, schema)


def occlusion(d_ik: Column, d_jk: Column, name: str | Metric = "l2") -> Column:
    """How much closer k is to j than to i: d_ik / d_jk, without bound where d_jk is zero. For inner products (negated, so signs matter) the ratio of the larger to the smaller counts only where both are negative."""
    if metric(name) is Metric.MIPS:
        return F.when((d_ik < 0) & (d_jk < 0), d_jk / d_ik).otherwise(F.lit(0.0))
    return F.when(d_jk == 0, F.lit(float("inf"))).otherwise(d_ik / d_jk)


def pack_id(query: Column, node: Column) -> Column:
    """query * 2 ** 32 + node as DECIMAL(20, 0): all 64 bits are used."""
    return (query.cast("decimal(20,0)") * F.lit(MODULUS).cast("decimal(20,0)") + node.cast("decimal(20,0)")).cast("decimal(20,0)")


def unpack_id(message: Column) -> tuple[Column, Column]:
    """(query, node)"""
    m = message.cast("decimal(20,0)")
    base = F.lit(MODULUS).cast("decimal(20,0)")
    node = F.pmod(m, base)
    return ((m - node) / base).cast("long"), node.cast("long")


def tagged(df: DataFrame, tags: DataFrame, local: str = "id") -> DataFrame:
    """Local ids become global ones where tags (local_id, global_id) has them, and stay as they are elsewhere."""
    t = tags.select(F.col("local_id").alias("_l"), F.col("global_id").alias("_g"))
    return df.join(t, F.col(local) == F.col("_l"), "left").withColumn(local, F.coalesce("_g", local)).drop("_l", "_g")


def pq_chunks(budget_bytes: int, n: int, dim: int) -> int:
    return max(1, min(budget_bytes // max(1, n), dim, 128))


def ram_estimate(n: int, dim: int, degree: int, element_bytes: int = 4) -> float:
    """Bytes of an index in memory: links with 30 % slack and vectors, 10 % on top."""
    return 1.1 * (n * degree * 4 * 1.3 + n * dim * element_bytes)


def medoid_sample_size(base: int, n: int) -> int:
    """Grows with the logarithm of the whole multiple of base that n is."""
    return base if n < base else base + int(100 * math.log2(n // base))
