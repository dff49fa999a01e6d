"""Binary files of vectors, truth sets and graphs.

A matrix file is two 32-bit integers (rows, columns) and the rows one after the other; a row's number is its id. Rows have
one width, so a file is read by ranges of rows in parallel, without a task seeing all of it. Unsigned bytes become
shorts, unsigned 32-bit integers longs, for Spark has neither. Files are reached through Arrow's file systems: local and
shared folders, hdfs and s3."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: element: (type in the file, Spark's type of a coordinate)
ELEMENTS = {"float": ("<f4", "float"), "uint8": ("u1", "smallint"), "int8": ("i1", "tinyint"), "uint32": ("<u4", "bigint"), "int32": ("<i4", "int")}
ROWS_BYTES = 32 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _read(path: str, offset: int, n: int) -> bytes:
    place, plain = _open(path)
    with place.open_input_file(plain) as f:
        got = f.read_at(n, offset)
    if len(got) != n:
        raise ValueError(f"{path} ends early: {len(got)} of {n} bytes at {offset}")
    return got


def size(path: str) -> int:
    place, plain = _open(path)
    return place.get_file_info(plain).size


def metadata(path: str, offset: int = 0) -> tuple[int, int]:
    """(rows, columns)"""
    return struct.unpack("<ii", _read(path, offset, 8))


class _Range(InputPartition):
    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.offset = options["path"], int(options.get("offset", 0))
        self.dtype = np.dtype(ELEMENTS[options.get("element", "float")][0])
        self.rows_bytes = int(options.get("rowsbytes", ROWS_BYTES))

    def partitions(self) -> list[_Range]:
        n, d = metadata(self.path, self.offset)
        if size(self.path) < self.offset + 8 + n * d * self.dtype.itemsize:
            raise ValueError(f"{self.path} is shorter than its header says")
        step = max(1, self.rows_bytes // max(1, d * self.dtype.itemsize))
        return [_Range(i, min(step, n - i)) for i in range(0, n, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        _, d = metadata(self.path, self.offset)
        for first in range(partition.first, partition.first + partition.rows, 8192):
            n = min(8192, partition.first + partition.rows - first)
            raw = _read(self.path, self.offset + 8 + first * d * self.dtype.itemsize, n * d * self.dtype.itemsize)
            yield pa.record_batch([pa.array(np.arange(first, first + n)), _lists(np.frombuffer(raw, self.dtype).reshape(n, d))], names=["id", "vec"])


def _lists(x: np.ndarray) -> pa.Array:
    wide = {"u1": np.int16, "<u4": np.int64}.get(x.dtype.str.lstrip("|"), x.dtype)
    flat = np.ascontiguousarray(x, dtype=wide).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(flat))


class BinMatrix(DataSource):
    """spark.read.format("binmatrix").option("element", "uint8").load(path): id, vec. Options: element, offset, rowsBytes."""

    @classmethod
    def name(cls) -> str:
        return "binmatrix"

    def schema(self) -> str:
        return f"id bigint, vec array<{ELEMENTS[self.options.get('element', 'float')][1]}>"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_matrix(spark: SparkSession, path: str, element: str = "float", offset: int = 0, pad_to: int = 1) -> DataFrame:
    """id and vec; pad_to fills vectors with zeros to a multiple of it, which changes neither L2 nor dot products."""
    if element not in ELEMENTS:
        raise ValueError(f"unknown element {element!r}; one of {list(ELEMENTS)}")
    spark.dataSource.register(BinMatrix)
    df = spark.read.format("binmatrix").option("element", element).option("offset", str(offset)).load(path)
    if pad_to > 1:
        _, d = metadata(path, offset)
        more = -d % pad_to
        if more:
            zero = F.array_repeat(F.lit(0).cast(ELEMENTS[element][1]), more)
            df = df.withColumn("vec", F.concat("vec", zero))
    return df


def write_matrix(df: DataFrame, path: str, element: str = "float") -> int:
    """Rows (id, vec) in the order of their ids, which must be 0 to n - 1. Tasks write their rows in place, which takes a folder that all executors can write to at any offset (a shared file system); the number of rows."""
    place, plain = _open(path)
    if not isinstance(place, fs.LocalFileSystem):
        raise ValueError("rows are written in place: give a path of a shared file system")
    dtype = np.dtype(ELEMENTS[element][0])
    n, low, high, d, d2 = df.agg(F.count("*"), F.min("id"), F.max("id"), F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if n and (low != 0 or high != n - 1 or d != d2):
        raise ValueError("ids have to be 0 to n - 1 and vectors of one length")
    with open(plain, "wb") as f:
        f.write(struct.pack("<ii", n, d or 0))
        f.truncate(8 + n * (d or 0) * dtype.itemsize)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(plain, "r+b") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(dtype)
                for k in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids) != 1) + 1):  # runs of ids that follow each other
                    f.seek(8 + int(ids[k[0]]) * d * dtype.itemsize)
                    f.write(x[k].tobytes())
                done += len(ids)
        yield pa.record_batch([pa.array([done])], names=["rows"])

    return df.select("id", "vec").sortWithinPartitions("id").mapInArrow(put, "rows long").agg(F.sum("rows")).first()[0] or 0


# --- truth sets ----------------------------------------------------------------------------------------------------


def _ranges(spark: SparkSession, n: int, step: int) -> DataFrame:
    parts = max(1, -(-n // step))
    return spark.range(0, parts, 1, parts).select((F.col("id") * step).alias("first"), F.least(F.lit(step), F.lit(n) - F.col("id") * step).alias("n"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """qid, rank (from 1), id, and dist and tag where the file has them; which it is follows from its size."""
    n, k = metadata(path)
    kinds = {8 + n * k * 4 * m: m for m in (1, 2, 3)}
    blocks = kinds.get(size(path))
    if blocks is None:
        raise ValueError(f"{path}: {size(path)} bytes fit no truth set of {n} by {k}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m <= 0:
                    continue
                part = [np.frombuffer(_read(path, 8 + (i * n + first) * k * 4, m * k * 4), t) for i, t in zip(range(blocks), ("<u4", "<f4", "<u4"))]
                cols = [pa.array(np.repeat(np.arange(first, first + m), k)), pa.array(np.tile(np.arange(1, k + 1), m)), pa.array(part[0].astype(np.int64))]
                cols.append(pa.array(part[1].astype(np.float64)) if blocks > 1 else pa.nulls(m * k, pa.float64()))
                cols.append(pa.array(part[2].astype(np.int64)) if blocks > 2 else pa.nulls(m * k, pa.int64()))
                yield pa.record_batch(cols, names=["qid", "rank", "id", "dist", "tag"])

    return _ranges(spark, n, max(1, (8 << 20) // max(1, 4 * k))).mapInArrow(read, "qid long, rank long, id long, dist double, tag long")


def write_truth(truth: DataFrame, path: str) -> None:
    """A truth set (qid 0 to n - 1, rank 1 to k, id, dist) with distances. Truth of a query set is small; it is written by the driver, query by query."""
    k = truth.agg(F.max("rank")).first()[0]
    lists = truth.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "dist"))).alias("t")).orderBy("qid")
    n = lists.count()
    place, plain = _open(path)
    for at, kind in (("id", "<u4"), ("dist", "<f4")):
        with (place.open_output_stream(plain) if at == "id" else place.open_append_stream(plain)) as f:
            if at == "id":
                f.write(struct.pack("<ii", n, k))
            for r in lists.select(F.transform("t", lambda x: x[at]).alias("v")).toLocalIterator():
                f.write(np.array(r.v, kind).tobytes())


# --- graphs --------------------------------------------------------------------------------------------------------


def read_graph(spark: SparkSession, path: str, dialect: str = "degrees") -> DataFrame:
    """id and nbrs. "degrees": points, largest degree, all degrees, all links (read by ranges of points). "lists": a header of 24 bytes (length, largest degree, points or entry, frozen points), then for each point its degree and links; such a file has no index and is scanned by one task."""
    if dialect == "degrees":
        n, _ = metadata(path)
        step = 1 << 20
        starts, total = [], 0
        for first in range(0, n, step):  # what lies before each range: sums of degrees, a range at a time
            m = min(step, n - first)
            starts.append((first, m, total))
            total += int(np.frombuffer(_read(path, 8 + 4 * first, 4 * m), "<u4").sum(dtype=np.int64))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, m, before in zip(*(c.to_pylist() for c in b.columns)):
                    deg = np.frombuffer(_read(path, 8 + 4 * first, 4 * m), "<u4").astype(np.int64)
                    links = np.frombuffer(_read(path, 8 + 4 * n + 4 * before, 4 * int(deg.sum())), "<u4").astype(np.int64)
                    yield pa.record_batch([pa.array(np.arange(first, first + m)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(deg)]).astype(np.int32)), pa.array(links))], names=["id", "nbrs"])

        ranges = spark.createDataFrame(starts, "first long, n long, before long").repartition(max(1, len(starts)))
        return ranges.mapInArrow(read, "id long, nbrs array<long>")
    if dialect != "lists":
        raise ValueError("dialect is degrees or lists")
    total = size(path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, node, rest, ids, lists = 24, 0, np.zeros(0, "<u4"), [], []
            while at < total or len(rest):
                part = np.frombuffer(_read(path, at, min(8 << 20, total - at)), "<u4")
                at += 4 * len(part)
                rest, i = np.concatenate([rest, part]), 0
                while i < len(rest) and i + 1 + rest[i] <= len(rest):
                    lists.append(rest[i + 1 : i + 1 + int(rest[i])].astype(np.int64))
                    ids.append(node)
                    node, i = node + 1, i + 1 + int(rest[i])
                rest = rest[i:]
                if ids:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "nbrs"])
                    ids, lists = [], []
                if at >= total and len(rest):
                    raise ValueError(f"{path} ends within a list")

    return spark.range(0, 1, 1, 1).mapInArrow(scan, "id long, nbrs array<long>")


def write_graph(graph: DataFrame, path: str, dialect: str = "degrees", entry: int = 0) -> None:
    """A graph of ids 0 to n - 1. Rows come to the driver one partition at a time; for large graphs use parquet."""
    n, most = graph.agg(F.count("*"), F.max(F.size("nbrs"))).first()
    ordered = graph.select("id", "nbrs").orderBy("id")
    place, plain = _open(path)
    if dialect == "lists":
        total = 24 + 4 * (n + (graph.agg(F.sum(F.size("nbrs"))).first()[0] or 0))
        with place.open_output_stream(plain) as f:
            f.write(struct.pack("<QIIQ", total, most or 0, entry, 0))
            for r in ordered.toLocalIterator():
                f.write(np.array([len(r.nbrs), *r.nbrs], "<u4").tobytes())
        return
    with place.open_output_stream(plain) as f:
        f.write(struct.pack("<II", n, most or 0))
        for r in ordered.select(F.size("nbrs").alias("d")).toLocalIterator():
            f.write(struct.pack("<I", r.d))
        for r in ordered.select("nbrs").toLocalIterator():
            f.write(np.array(r.nbrs, "<u4").tobytes())


# --- text ----------------------------------------------------------------------------------------------------------


def read_partition_lists(spark: SparkSession, path: str) -> DataFrame:
    """id and partition_id from a text file with a line of ids for each partition, parted by spaces or commas. The line's place is the partition: one file is read as one split."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("partition_id", "line")).where(F.trim("line") != "")
    return lines.select("partition_id", F.explode(F.split(F.trim("line"), "[ ,]+")).alias("id")).select(F.col("id").cast("long"), "partition_id")


def write_partition_lists(parts: DataFrame, path: str) -> None:
    """One line for each partition, ids parted by spaces, in the order of the partitions."""
    lists = parts.groupBy("partition_id").agg(F.array_join(F.sort_array(F.collect_list("id")), " ").alias("value"))
    lists.repartition(1).sortWithinPartitions("partition_id").select("value").write.text(path)


def read_bytes_assignment(spark: SparkSession, path: str) -> DataFrame:
    """id and partition_id from a matrix file of one unsigned byte a point."""
    return read_matrix(spark, path, "uint8").select("id", F.col("vec")[0].cast("int").alias("partition_id"))
