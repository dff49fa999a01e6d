"""Packing by multiway differencing (Karmarkar and Karp).

Documents become ids and an end id. Whole windows are cut off a document's front; what remains of ``group`` documents is
packed together. Every remainder starts as a partition of its own; the two partitions with the largest difference
between their fullest and emptiest window are merged again and again, full windows against empty ones, so that
imbalances cancel. The result is ``windows`` near-equal windows, as many as the capacity calls for at least.

Where a window still exceeds the capacity: without cutting, the window count rises until none does; with cutting, the
excess is cut off and moved into windows with room, so that all windows but one are full. That last window, which a
group always has unless its ids divide evenly, is cut along the powers of two, which need no padding.

Tasks pack their own rows: no shuffle, and no more than ``group`` remainders in memory besides one batch of rows.
Repeated attempts of a task see the same rows and give the same sequences. Null texts are empty documents (their end id
alone), null doc_ids stay null, rows that repeat are packed each for itself, other columns are ignored, an empty table
gives no pieces."""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vecspark.llm.common import lean, texts
from vecspark.llm.tokens import coder, public_path

CAPACITY, GROUP = 2048, 1024
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """The items of each window. A partition is its windows that aren't empty, fullest first, as (-sum, items)."""
    if not sizes:
        return [[] for _ in range(windows)]

    def spread(p: list) -> int:
        return -p[0][0] + (p[-1][0] if len(p) == windows else 0)

    heap = [(-s, i, [(-s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        free = windows - len(a)
        alone, met = b[:free], b[free:]  # b's fullest windows meet empty ones, its emptiest the fullest of a that are reached
        if len(b) == 1 and free:
            insort(a, b[0])
        else:
            # the windows of b that are left over meet those of a from its emptiest on
            rest = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(met, reversed(a))]
            a = sorted(alone + a[: len(a) - len(met)] + rest)
        heapq.heappush(heap, (-spread(a), n, a))
        n += 1
    out = [list(items) for _, items in heap[0][2]]
    return out + [[] for _ in range(windows - len(out))]


def windows_of(sizes: Sequence[int], capacity: int = CAPACITY, cut: bool = True, powers: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length). Sizes are at most the capacity."""
    total = sum(sizes)
    k = -(-total // capacity)
    bins = differencing(sizes, k) if k else []
    if not cut:
        while any(sum(sizes[i] for i in b) > capacity for b in bins):
            k += 1
            bins = differencing(sizes, k)
        return [[(i, 0, sizes[i]) for i in b] for b in bins]
    bins = sorted(bins, key=lambda b: -sum(sizes[i] for i in b))
    rest = total - (k - 1) * capacity
    room = [capacity] * (k - 1) + [rest] * (k > 0)
    out, over = [], []
    for b, most in zip(bins, room):
        w = [(i, 0, sizes[i]) for i in b]
        much = sum(sizes[i] for i in b) - most
        while much > 0:
            i, at, n = w.pop()
            off = min(n, much)
            much -= off
            over.append((i, at + n - off, off))
            if n > off:
                w.append((i, at, n - off))
        out.append(w)
    for w, most in zip(out, room):
        much = most - sum(n for _, _, n in w)
        while much:
            i, at, n = over.pop()
            w.append((i, at, min(n, much)))
            if n > much:
                over.append((i, at + much, n - much))
            much -= min(n, much)
    if powers and rest and rest < capacity:
        out += _by_powers(out.pop(), rest)
    return out


def _by_powers(window: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    out, left = [], list(reversed(window))
    for bit in reversed(range(total.bit_length())):
        if much := total & (1 << bit):
            w = []
            while much:
                i, at, n = left.pop()
                w.append((i, at, min(n, much)))
                if n > much:
                    left.append((i, at + much, n - much))
                much -= min(n, much)
            out.append(w)
    return out


class Packer:
    """Collects documents' ids and gives rows of pieces, group by group."""

    def __init__(self, first_sequence: int, capacity: int, group: int, cut: bool):
        self.sequence, self.capacity, self.group, self.cut = first_sequence, capacity, group, cut
        self.held: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.capacity
        for at in range(0, whole, self.capacity):
            self.rows.append((doc_id, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], n, self.sequence, 0))
            self.sequence += 1
        if n > whole:
            self.held.append((doc_id, whole, n, ids[4 * whole :]))
            if len(self.held) == self.group:
                self.pack()

    def pack(self) -> None:
        for window in windows_of([n - at for _, at, n, _ in self.held], self.capacity, self.cut):
            offset = 0
            for i, at, length in window:
                doc_id, start, n, ids = self.held[i]
                self.rows.append((doc_id, start + at, length, ids[4 * at : 4 * (at + length)], n, self.sequence, offset))
                offset += length
            self.sequence += 1
        self.held = []

    def taken(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        for i in range(0, len(rows), 2000):
            c = list(zip(*rows[i : i + 2000]))
            yield pa.record_batch([pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(c)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, end_id: int | None = 1, capacity: int = CAPACITY, group: int = GROUP, cut: bool = True) -> DataFrame:
    """A row for each piece: its document, place there, ids (4 little-endian bytes each), the document's ids in all, its sequence and place there."""
    path = path or public_path()
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = coder(path), Packer(TaskContext.get().partitionId() << 40, capacity, group, cut)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(doc_id, code.ids(text) + end)
                if len(packer.rows) >= 2000:
                    yield from packer.taken()
        packer.pack()
        yield from packer.taken()
        code.rest()

    return texts(docs).mapInArrow(lean(packed), PIECES)
