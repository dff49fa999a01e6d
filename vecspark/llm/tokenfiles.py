"""Token ids as Arrow files: fixed-size-list batches with random access, no copy.

Layout of a folder: for each shard ``ids-NNNNNN.arrow`` (Arrow IPC file; columns ``ids`` fixed_size_list<uint32>[length]
(uint16 where the vocabulary fits) and ``mask`` fixed_size_list<bool>[length]; every batch but the last has ``BATCH`` sequences, so sequence i is row
i % BATCH of batch i // BATCH) and ``docs-NNNNNN.arrow`` (doc_id, start in the shard, n_tokens). The ids of a shard's
documents follow each other without gaps; only a shard's last sequence is padded, under mask false. ``manifest.arrow``
has, for each shard in order, the ids and sequences before it.

Where the file system is a local or mounted one, files are mapped and sequences are views of them; from other stores a
batch is read at a time. Documents are range-partitioned by doc_id, so shards ascend; there are more of them where there
are more bytes. A task writes under a name of its own and renames the
finished files: an attempt that is repeated on another executor replaces the same files by the same content. The folder
has to be one that driver and executors share. Null texts are empty documents, null doc_ids come first, rows with one
doc_id are ordered by their text, other columns are ignored, an empty table gives a manifest without shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import lean, texts
from vecspark.llm.tokens import coder, public_path

LENGTH, BATCH = 2048, 256
#: Bytes of text for each shard, where the input is larger than the session's shuffle partitions times that.
SHARD_BYTES = 256 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard long, n_docs long, n_tokens long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


def _sequences(ids: np.ndarray, length: int, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the ids; the last sequence is padded with zeros that the mask marks."""
    n = len(ids)
    room = -(-n // length) * length
    flat = pa.array(np.concatenate([ids, np.zeros(room - n, ids.dtype)]) if room > n else ids)
    mask = pa.Array.from_buffers(pa.bool_(), room, [None, pa.py_buffer(np.packbits(np.arange(room) < n, bitorder="little").tobytes())])
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(flat, length), pa.FixedSizeListArray.from_arrays(mask, length)], schema=schema)


class ShardWriter:
    """One shard's two files; close() gives them their names."""

    def __init__(self, folder: str, shard: int, attempt: int, length: int = LENGTH, small: bool = False):
        self.fs, self.folder = _place(folder)
        self.kind = np.uint16 if small else np.uint32
        self.shard, self.length, self.schema = shard, length, _schema(length, pa.from_numpy_dtype(self.kind))
        self.parts = {k: (f"{self.folder}/_{k}-{shard:06d}.{attempt}", f"{self.folder}/{k}-{shard:06d}.arrow") for k in ("ids", "docs")}
        self.out = {k: self.fs.open_output_stream(a) for k, (a, _) in self.parts.items()}
        self.ids = pa.ipc.new_file(self.out["ids"], self.schema)
        self.docs = pa.ipc.new_file(self.out["docs"], INDEX)
        self.held, self.index, self.n_tokens, self.n_docs = bytearray(), [], 0, 0

    def add(self, doc_id, ids: bytes) -> None:
        self.index.append((doc_id, self.n_tokens, len(ids) // 4))
        self.n_tokens += len(ids) // 4
        self.n_docs += 1
        self.held += ids
        full = 4 * self.length * BATCH
        while len(self.held) >= full:
            self._write(self.held[:full])
            del self.held[:full]
        if len(self.index) >= 10_000:
            self._write_index()

    def _write(self, ids: bytes) -> None:
        self.ids.write_batch(_sequences(np.frombuffer(ids, "<u4").astype(self.kind), self.length, self.schema))

    def _write_index(self) -> None:
        if self.index:
            self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.index)], schema=INDEX))
            self.index = []

    def close(self) -> None:
        if self.held:
            self._write(self.held)
        self._write_index()
        for w in (self.ids, self.docs, *self.out.values()):
            w.close()
        for a, b in self.parts.values():
            self.fs.move(a, b)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 2, length: int = LENGTH) -> DataFrame:
    """Encode docs and write the files; the manifest as a DataFrame (one row a shard, with what lies before it)."""
    spark = docs.sparkSession
    path = path or public_path()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    place, plain = _place(folder)
    place.create_dir(plain, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, code = TaskContext.get(), None, coder(path)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                writer = writer or ShardWriter(folder, task.partitionId(), task.taskAttemptId(), length, max(code.size, end_id or 0) < 1 << 16)
                writer.add(doc_id, code.ids(text) + end)
        code.rest()
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([x], pa.int64()) for x in (writer.shard, writer.n_docs, writer.n_tokens)], names=["shard", "n_docs", "n_tokens"])

    ordered = texts(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = sorted(tuple(r) for r in ordered.mapInArrow(lean(shard), MANIFEST).collect())  # a row for each file
    rows, start, sequence = [], 0, 0
    for k, n_docs, n_tokens in shards:
        rows.append((k, n_docs, n_tokens, start, sequence))
        start += n_tokens
        sequence += -(-n_tokens // length)
    names = ["shard", "n_docs", "n_tokens", "start", "sequence"]
    table = pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)
    with place.open_output_stream(f"{plain}/manifest.arrow") as out, pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    return manifest(spark, folder)


def _open(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    place, plain = _place(folder)
    file = pa.memory_map(f"{plain}/{name}") if isinstance(place, fs.LocalFileSystem) else place.open_input_file(f"{plain}/{name}")
    return pa.ipc.open_file(file)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _open(folder, "manifest.arrow").read_all().to_pylist()
    return spark.createDataFrame([tuple(r.values()) for r in rows], "shard long, n_docs long, n_tokens long, start long, sequence long")


class Shard:
    """Random access to one shard's sequences: views of the mapped file."""

    def __init__(self, folder: str, shard: int):
        self.file = _open(folder, f"ids-{shard:06d}.arrow")
        self.length = self.file.schema.field("ids").type.list_size
        self._last = (-1, None)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self._last[0] != k:
            self._last = (k, self.file.get_batch(k))
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence; neither is copied (the mask has a bit for each id)."""
        b = self._batch(i // BATCH)
        at = (i % BATCH) * self.length
        ids = b.column(0).values.to_numpy(zero_copy_only=True)[at : at + self.length]
        return ids, b.column(1).values.slice(at, self.length)

    def ids(self, start: int, n: int) -> bytes:
        """The ids from start on, across sequences and batches."""
        size, out = self.length * BATCH, []
        while n > 0:
            flat = self._batch(start // size).column(0).values.to_numpy(zero_copy_only=True)
            part = flat[start % size : start % size + n]
            out.append(part.astype("<u4").tobytes())
            start, n = start + len(part), n - len(part)
        return b"".join(out)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (4 little-endian bytes each), read from the files."""
    shards = manifest(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, docs = Shard(folder, shard), _open(folder, f"docs-{shard:06d}.arrow")
                for k in range(docs.num_record_batches):
                    index = docs.get_batch(k)
                    start, size = index.column(1).to_numpy(), index.column(2).to_numpy()
                    at = 0
                    while at < len(size):  # some 8 MB at a time
                        end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), 2_000_000, side="right")))
                        yield pa.record_batch(
                            [index.column(0).slice(at, end - at), pa.array(start[at:end] + before), pa.array(size[at:end]), pa.array([ids.ids(int(s), int(n)) for s, n in zip(start[at:end], size[at:end])], pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        at = end

    n = max(1, shards.count())
    return shards.select("shard", "start").repartition(n, "shard").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids binary")
