"""Product quantisation: training, encoding, lookup tables and distances by codes.

A codebook is a table (chunk, code, pivot); vectors are centred on the data's mean first. A chunk is a run of
dimensions: of d dimensions in c chunks the first d mod c chunks have one more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.distance import matrix, pairwise
from vecspark.operators import cluster, knn

PIVOTS = 256
#: Rows to train on: a tenth of all, and no more than this.
TRAIN_SHARE, TRAIN_ROWS = 0.1, 256_000


def chunk_offsets(dim: int, chunks: int) -> list[int]:
    """Where the chunks begin, and the end."""
    small, more = divmod(dim, chunks)
    out = [0]
    for c in range(chunks):
        out.append(out[-1] + small + (c < more))
    return out


@dataclass
class Codebook:
    """pivots[c] is (codes, dimensions of the chunk); at most 256 by the dimension in all, so it may go to every task."""

    centroid: np.ndarray
    offsets: list[int]
    pivots: list[np.ndarray]

    @property
    def chunks(self) -> int:
        return len(self.pivots)

    def part(self, x: np.ndarray, c: int) -> np.ndarray:
        return (x - self.centroid)[:, self.offsets[c] : self.offsets[c + 1]]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivot of each chunk, the first of equals: distances term by term, so that ties are ties."""
        out = np.zeros((len(x), self.chunks), np.int16)
        for c, p in enumerate(self.pivots):
            y = self.part(x, c)
            d = np.zeros((len(y), len(p)))
            for j in range(p.shape[1]):
                d += (y[:, j, None] - p[None, :, j]) ** 2
            out[:, c] = d.argmin(axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([p[codes[:, c]] for c, p in enumerate(self.pivots)], axis=1) + self.centroid

    def table(self, q: np.ndarray) -> np.ndarray:
        """(queries, chunks, codes): squared distance of each query's part to each pivot; unused codes are infinite."""
        out = np.full((len(q), self.chunks, max(map(len, self.pivots))), np.inf)
        for c, p in enumerate(self.pivots):
            out[:, c, : len(p)] = pairwise("l2", self.part(q, c), p)
        return out

    def inner_table(self, q: np.ndarray) -> np.ndarray:
        """The same with negated inner products; the centroid's share is left out, being the same for all codes."""
        out = np.full((len(q), self.chunks, max(map(len, self.pivots))), np.inf)
        for c, p in enumerate(self.pivots):
            out[:, c, : len(p)] = -q[:, self.offsets[c] : self.offsets[c + 1]] @ p.T
        return out

    def between(self) -> np.ndarray:
        """(chunks, codes, codes): squared distances between pivots, for distances of codes to codes."""
        n = max(map(len, self.pivots))
        out = np.full((self.chunks, n, n), np.inf)
        for c, p in enumerate(self.pivots):
            out[c, : len(p), : len(p)] = pairwise("l2", p, p)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, k, [float(y) for y in v]) for c, p in enumerate(self.pivots) for k, v in enumerate(p)], "chunk int, code int, pivot array<double>")

    @classmethod
    def of(cls, centroid, frame: DataFrame) -> Codebook:
        rows = sorted((r.chunk, r.code, r.pivot) for r in frame.collect())
        pivots = [np.array([p for c, _, p in rows if c == k]) for k in range(rows[-1][0] + 1)]
        return cls(np.asarray(centroid, float), np.cumsum([0, *(p.shape[1] for p in pivots)]).tolist(), pivots)


def adc(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of codes (n, chunks) by one query's table (chunks, codes)."""
    return table.ravel().take(codes + np.arange(0, table.size, table.shape[1])).sum(axis=1)


def _lloyd(x: np.ndarray, k: int, seed: int, iterations: int = 12) -> np.ndarray:
    """k-means of one chunk: k-means++ pivots, then Lloyd until the residual hardly changes; empty clusters take the farthest rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    c = x[[rng.integers(len(x))]]
    d = pairwise("l2", x, c)[:, 0]
    while len(c) < k:
        at = min(int(np.searchsorted(np.cumsum(d), rng.random() * d.sum())), len(x) - 1)
        c = np.concatenate([c, x[[at]]])
        d = np.minimum(d, pairwise("l2", x, x[[at]])[:, 0])
        d[at] = 0
    last = None
    for _ in range(iterations):
        all_d = pairwise("l2", x, c)
        near = all_d.argmin(axis=1)
        rest = all_d[np.arange(len(x)), near]
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-rest)[: len(empty)]]
        if last is not None and abs(last - rest.sum()) <= 1e-5 * last:
            break
        last = rest.sum()
    return c


def train(df: DataFrame, chunks: int, pivots: int = PIVOTS, share: float = TRAIN_SHARE, rows: int = TRAIN_ROWS, seed: int = 0) -> Codebook:
    """A codebook from a hash sample of bounded size; chunks are trained in parallel, one group each."""
    mean = cluster.centroid(df).first()
    if mean is None:
        raise ValueError("no rows to train on")
    mean = np.array(mean.vec)
    offsets = chunk_offsets(len(mean), chunks)
    n = df.count()
    some = df if n <= 4 * pivots else cluster.sample(df, min(1.0, max(4 * pivots, min(share * n, rows)) / n), seed)
    parts = F.array(*(F.struct(F.lit(c).alias("chunk"), F.slice("vec", a + 1, b - a).alias("part")) for c, (a, b) in enumerate(zip(offsets, offsets[1:]))))
    long = some.select("id", F.col("vec").cast("array<double>").alias("vec")).select("id", F.explode(parts).alias("p")).select("id", "p.chunk", "p.part")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        c = table["chunk"][0].as_py()
        got = _lloyd(matrix(table["part"]) - mean[offsets[c] : offsets[c + 1]], pivots, seed + c)
        return pa.table({"chunk": pa.array([c] * len(got), pa.int32()), "code": pa.array(range(len(got)), pa.int32()), "pivot": pa.array(list(got), pa.list_(pa.float64()))})

    return Codebook.of(mean, long.groupBy("chunk").applyInArrow(fit, "chunk int, code int, pivot array<double>"))


def fixed(df: DataFrame, chunks: int, pivots: int = PIVOTS) -> Codebook:
    """A codebook whose pivots are the first rows' own parts: no training, the same in any engine."""
    mean = np.array(cluster.centroid(df).first().vec)
    offsets = chunk_offsets(len(mean), chunks)
    x = np.array([r.vec for r in df.orderBy("id").limit(pivots).select(F.col("vec").cast("array<double>")).collect()]) - mean
    return Codebook(mean, offsets, [x[:, a:b] for a, b in zip(offsets, offsets[1:])])


def encode(df: DataFrame, book: Codebook) -> DataFrame:
    """id and codes, batch by batch."""
    sent = df.sparkSession.sparkContext.broadcast(book)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                c = sent.value.encode(matrix(part.column(1)))
                yield pa.record_batch([part.column(0), pa.array(list(c), pa.list_(pa.int16()))], names=["id", "codes"])

    return df.select("id", F.col("vec").cast("array<double>")).mapInArrow(codes, "id long, codes array<smallint>")


def lookup(queries: DataFrame, book: Codebook, inner: bool = False) -> DataFrame:
    """qid, chunk, code and dist: the queries' tables in long form, of squared distances or of negated inner products."""
    sent = queries.sparkSession.sparkContext.broadcast(book)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                q = matrix(part.column(1))
                t = sent.value.inner_table(q) if inner else sent.value.table(q)
                q, c, k = np.nonzero(np.isfinite(t))
                yield pa.record_batch([pa.array(part.column(0).to_numpy()[q]), pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(t[q, c, k])], names=["qid", "chunk", "code", "dist"])

    return queries.select("qid", F.col("vec").cast("array<double>")).mapInArrow(tables, "qid long, chunk int, code int, dist double")


def nearest_by_codes(queries: DataFrame, codes: DataFrame, book: Codebook, k: int, block_bytes: int = knn.QUERY_BLOCK_BYTES, symmetric: bool = False) -> DataFrame:
    """The k nearest rows by asymmetric distance (exact query, coded rows), or by symmetric distance (the query coded too): qid, id, dist, rank. codes isn't shuffled."""
    spark, out = queries.sparkSession, None
    for ids, vectors in knn._blocks(queries, block_bytes // 32):
        vectors = book.decode(book.encode(vectors)) if symmetric else vectors
        sent = spark.sparkContext.broadcast((ids, book.table(vectors)))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, tables = sent.value
            top_d, top_id = np.full((len(qid), 0), np.inf), np.full((len(qid), 0), -1, np.int64)
            for b in batches:
                for at in range(0, b.num_rows, 16384):
                    part = b.slice(at, 16384)
                    c, ids = matrix(part.column(1), np.int64), part.column(0).to_numpy()
                    d = np.zeros((len(qid), len(ids)))
                    for j in range(c.shape[1]):
                        d += tables[:, j, :][:, c[:, j]]
                    all_d, all_id = np.concatenate([top_d, d], axis=1), np.concatenate([top_id, np.broadcast_to(ids, d.shape)], axis=1)
                    order = np.lexsort((all_id, all_d), axis=1)[:, :k]
                    top_d, top_id = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_id, order, 1)
            if top_id.shape[1]:
                yield pa.record_batch([pa.array(np.repeat(qid, top_id.shape[1])), pa.array(top_id.ravel()), pa.array(top_d.ravel())], names=["qid", "id", "dist"])

        one = codes.select("id", "codes").mapInArrow(best, "qid long, id long, dist double")
        out = one if out is None else out.unionByName(one)
    return knn.ranked(out, k)


def rerank(queries: DataFrame, base: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Candidates (qid, id) by their exact squared distance."""
    from vecspark.functions.distance import l2sq

    pairs = found.select("qid", "id").join(base.select("id", "vec"), "id").join(queries.select("qid", F.col("vec").alias("qvec")), "qid")
    return knn.ranked(pairs.select("qid", "id", l2sq(F.col("qvec"), F.col("vec")).alias("dist")), k)
