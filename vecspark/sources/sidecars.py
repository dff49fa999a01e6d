"""Files that stand beside an index: ids, codebooks, norms, partitions' ids and clusters.

Columns of numbers are matrix files (vecspark.sources.binary) of one column, read in ranges. What is small by its nature
(a codebook, a norm, the sizes of clusters) is read by the driver. A file that doesn't fit its header is an error."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators.pq import Codebook
from vecspark.sources.binary import _open, _ranges, _read, metadata, read_matrix, size

# Where a codebook's first block begins, and how many codes it has.
FIRST_BLOCK, CODES = 4096, 256


def read_ids(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """row and value of a column of ids (tags, places of partitions' rows, maps from shards' rows to global ids). rows: how many there have to be."""
    n, columns = metadata(path)
    if columns != 1 or size(path) != 8 + 4 * n or (rows is not None and n != rows):
        raise ValueError(f"{path}: {n} rows of {columns} in {size(path)} bytes; one column of {rows if rows is not None else n} is wanted")
    return read_matrix(spark, path, "uint32").select(F.col("id").alias("row"), F.col("vec")[0].alias("value"))


def read_max_norm(path: str) -> float:
    """The norm by which vectors were divided: a matrix file of one float."""
    if metadata(path) != (1, 1):
        raise ValueError(f"{path} holds no single number")
    return float(np.frombuffer(_read(path, 8, 4), "<f4")[0])


def write_max_norm(norm: float, path: str) -> None:
    place, plain = _open(path)
    with place.open_output_stream(plain) as f:
        f.write(struct.pack("<iif", 1, 1, norm))


def _block(path: str, at: int, kind: str) -> np.ndarray:
    n, d = metadata(path, at)
    return np.frombuffer(_read(path, at + 8, n * d * np.dtype(kind).itemsize), kind).reshape(n, d)


def read_codebook(path: str) -> Codebook:
    """Pivots of all chunks side by side, the centroid and the chunks' offsets, at places that the first block names. An older form has a block more (an order of dimensions, which is read over)."""
    places = _block(path, 0, "<u8").ravel().tolist()
    if len(places) not in (4, 5):
        raise ValueError(f"{path} names {len(places)} places")
    pivots, centroid, offsets = (_block(path, places[i], k) for i, k in ((0, "<f4"), (1, "<f4"), (len(places) - 2, "<u4")))
    dim = pivots.shape[1]
    o = offsets.ravel().astype(int).tolist()
    if len(pivots) != CODES or centroid.shape != (dim, 1) or o[0] != 0 or o[-1] != dim or sorted(o) != o:
        raise ValueError(f"{path} is no codebook of {CODES} codes")
    return Codebook(centroid.ravel().astype(float), o, [pivots[:, a:b].astype(float) for a, b in zip(o, o[1:])])


def write_codebook(book: Codebook, path: str, older: bool = False) -> None:
    """The same; chunks with fewer codes repeat their last."""
    filled = [np.concatenate([p, np.repeat(p[-1:], CODES - len(p), axis=0)]) for p in book.pivots]
    dim = book.offsets[-1]
    blocks = [np.concatenate(filled, axis=1).astype("<f4"), book.centroid.reshape(-1, 1).astype("<f4")]
    if older:
        blocks.append(np.arange(dim, dtype="<u4").reshape(-1, 1))
    blocks.append(np.array(book.offsets, "<u4").reshape(-1, 1))
    places = np.cumsum([FIRST_BLOCK, *(8 + b.nbytes for b in blocks)]).astype("<u8").reshape(-1, 1)
    place, plain = _open(path)
    with place.open_output_stream(plain) as f:
        head = struct.pack("<ii", *places.shape) + places.tobytes()
        f.write(head + bytes(FIRST_BLOCK - len(head)))
        for b in blocks:
            f.write(struct.pack("<ii", *b.shape) + b.tobytes())


# --- partitions and clusters ---------------------------------------------------------------------------------------


def write_partition_ids(parts: DataFrame, prefix: str) -> DataFrame:
    """A matrix file of ascending ids for each partition, {prefix}_partition{n}_ids_uint32.bin: partition_id, n. Tasks stream through their partitions; a file is renamed when it is complete."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, now, n, f = TaskContext.get().taskAttemptId(), None, 0, None
        place, plain = _open(prefix)

        def close() -> Iterator[pa.RecordBatch]:
            if f is None:
                return
            f.close()
            name = f"{plain}_partition{now}_ids_uint32.bin"
            with place.open_output_stream(f"{name}.{attempt}") as out, place.open_input_stream(f"{name}.{attempt}.rows") as rows:
                out.write(struct.pack("<ii", n, 1))
                while part := rows.read(1 << 20):
                    out.write(part)
            place.delete_file(f"{name}.{attempt}.rows")
            place.move(f"{name}.{attempt}", name)
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([n])], names=["partition_id", "n"])

        for b in it:
            home, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(home)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if int(home[x]) != now:
                    yield from close()
                    now, n = int(home[x]), 0
                    f = place.open_output_stream(f"{plain}_partition{now}_ids_uint32.bin.{attempt}.rows")
                f.write(ids[x:y].astype("<u4").tobytes())
                n += y - x
        yield from close()

    ordered = parts.select(F.col("partition_id").cast("int"), F.col("id").cast("long")).repartition("partition_id").sortWithinPartitions("partition_id", "id")
    return ordered.mapInArrow(write, "partition_id int, n long")


def read_partition_ids(spark: SparkSession, prefix: str, partitions: int) -> DataFrame:
    """id and partition_id from these files."""
    out = None
    for p in range(partitions):
        one = read_ids(spark, f"{prefix}_partition{p}_ids_uint32.bin").select(F.col("value").alias("id"), F.lit(p).alias("partition_id"))
        out = one if out is None else out.unionByName(one)
    return out


def _longs(spark: SparkSession, path: str, at: int, n: int, kind: str) -> DataFrame:
    """(place, value) of n numbers from a byte of a file on, by ranges."""
    width = np.dtype(kind).itemsize

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m > 0:
                    yield pa.record_batch([pa.array(np.arange(first, first + m)), pa.array(np.frombuffer(_read(path, at + width * first, width * m), kind).astype(np.int64))], names=["place", "value"])

    return _ranges(spark, n, 1 << 20).mapInArrow(read, "place long, value long")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """id and partition_id from a cluster file: the number of clusters, their sizes, then their nodes one after the other."""
    k = struct.unpack("<I", _read(path, 0, 4))[0]
    sizes = np.frombuffer(_read(path, 4, 4 * k), "<u4").astype(np.int64)
    if size(path) != 4 + 4 * k + 4 * int(sizes.sum()):
        raise ValueError(f"{path} doesn't fit the sizes of its {k} clusters")
    ends = np.cumsum(sizes)
    homes = spark.createDataFrame([(i, int(e - s), int(e)) for i, (s, e) in enumerate(zip(sizes, ends))], "partition_id int, a long, b long")
    rows = _longs(spark, path, 4 + 4 * k, int(sizes.sum()), "<u4")
    return rows.join(F.broadcast(homes), (F.col("place") >= F.col("a")) & (F.col("place") < F.col("b"))).select(F.col("value").alias("id"), "partition_id")


def read_cluster_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of one cluster: their number, then they."""
    n = struct.unpack("<I", _read(path, 0, 4))[0]
    if size(path) != 4 + 4 * n:
        raise ValueError(f"{path} doesn't hold {n} nodes")
    return _longs(spark, path, 4, n, "<u4").select(F.col("value").alias("id"))


def read_cluster_assignment(spark: SparkSession, path: str) -> DataFrame:
    """id and partition_id from one byte a node behind the number of nodes and (a byte) of clusters."""
    n, k = struct.unpack("<IB", _read(path, 0, 5))
    if size(path) != 5 + n:
        raise ValueError(f"{path} doesn't hold {n} nodes")
    rows = _longs(spark, path, 5, n, "u1")
    ok = F.assert_true(F.col("value") < k, F.lit(f"{path}: a cluster beyond {k}"))
    return rows.where(ok.isNull()).select(F.col("place").alias("id"), F.col("value").cast("int").alias("partition_id"))


def write_clusters(parts: DataFrame, clusters: str, assignment: str | None = None) -> None:
    """A cluster file, and an assignment file of ids 0 to n - 1 (up to 255 clusters). Rows come to the driver a partition of the table at a time; for large sets use write_partition_ids."""
    counts = {r[0]: r[1] for r in parts.groupBy("partition_id").count().collect()}
    k = max(counts, default=-1) + 1
    place, plain = _open(clusters)
    with place.open_output_stream(plain) as f:
        f.write(struct.pack(f"<I{k}I", k, *(counts.get(i, 0) for i in range(k))))
        for r in parts.select("id", "partition_id").orderBy("partition_id", "id").toLocalIterator():
            f.write(struct.pack("<I", r.id))
    if assignment is not None:
        if k > 255:
            raise ValueError(f"{k} clusters don't fit a byte")
        place, plain = _open(assignment)
        with place.open_output_stream(plain) as f:
            f.write(struct.pack("<IB", sum(counts.values()), k))
            for r in parts.select("id", "partition_id").orderBy("id").toLocalIterator():
                f.write(struct.pack("<B", r.partition_id))
