"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints follow from the hashes of all word shingles of a whole text. Two fingerprints link at ``RADIUS`` or fewer
differing bits; documents linked through any chain form one component.

Candidates: of four 16-bit blocks, linked fingerprints share two at least, so each distinct fingerprint goes to six
buckets, one for each pair of blocks, and no link is lost. A bucket of more than ``BLOCK`` fingerprints is split again in
the same way by the four bytes that it leaves open: its parts have 16 open bits, so 65536 fingerprints at most, whatever
the corpus; parts above ``BLOCK`` are dealt out as pairs of sub-blocks to several tasks. Within a bucket the 64 bit planes
of all fingerprints are stored vertically, 64 lanes a word; carry-save counters update the distances of all lanes plane by
plane, and a block of lanes is abandoned once every lane is past the radius. A bucket gives a star for each of its
components, not pairs.

Components come from alternating large and small stars over links between distinct fingerprints, each round written to
the shared folder. Exact copies never meet: they share a fingerprint and are joined to it at the end.

Texts without words have fingerprint zero and link like any other; null texts count as such. Null doc_ids get the id of
their component; a component of null doc_ids alone has a null id. Rows that repeat are rows of one component; other
columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import lean, texts
from vecspark.runtime import forget, stored

RADIUS, WORDS, SEED, BLOCK, SMALL = 2, 3, 42, 4096, 64
PAIRS = tuple(combinations(range(4), 2))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


#: Bytes of a text that are cut into words at once, and shingles whose bits are laid out at once.
PIECE, LAID = 1 << 20, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_runs(raw: bytes | memoryview, words: int = WORDS) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, a piece of the text at a time."""
    from xxhash import xxh64_intdigest

    hashes = lambda s: np.fromiter((xxh64_intdigest(x, SEED) for x in s), np.uint64)
    at, held, found = 0, [], False
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw):
            cut = _SPACE.search(raw, end)
            end = cut.start() if cut else len(raw)
        w = held + bytes(raw[at:end]).lower().split()
        at = end
        if len(w) >= words:
            found = True
            yield hashes(map(b" ".join, zip(*(w[i:] for i in range(words)))))
            held = w[len(w) - words + 1 :]
        else:
            held = w
    if held and not found:
        yield hashes([b" ".join(held)])


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *shingle_runs(text.encode(), words)])


def long_fingerprint(runs: Iterator[np.ndarray]) -> np.ndarray:
    """One text's fingerprint, its bits counted a run at a time."""
    set_, n = np.zeros(64, np.int64), 0
    for h in runs:
        n += len(h)
        for at in range(0, len(h), LAID):
            set_ += np.unpackbits(h[at : at + LAID].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_ > n, bitorder="little").view(np.uint64) if n else np.zeros(1, np.uint64)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The majority of each bit over each document's hashes."""
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    if full := [h for h in hashes if len(h)]:
        n = sizes[sizes > 0]
        bits = np.unpackbits(np.concatenate(full).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.int32)
        out[sizes > 0] = np.packbits(2 * set_ > n[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a long)."""

    def batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps, held, n = [], [], 0
            for text in b.column(1):
                raw = memoryview(text.as_buffer())
                if len(raw) > PIECE:
                    fps += [fingerprints_of(held), long_fingerprint(shingle_runs(raw, words))] if held else [long_fingerprint(shingle_runs(raw, words))]
                    held, n = [], 0
                    continue
                held.append(np.concatenate([np.zeros(0, np.uint64), *shingle_runs(raw, words)]))
                n += len(held[-1])
                if n > 100_000:
                    fps.append(fingerprints_of(held))
                    held, n = [], 0
            if held:
                fps.append(fingerprints_of(held))
            if fps:
                yield pa.record_batch([b.column(0), pa.array(np.concatenate(fps).view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(lean(batch), "doc_id long, fp long")


# --- bit-sliced comparison ---------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word j of plane b is bit b of fingerprint 64 * j + i."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def sliced_within(difference, shape, radius: int, alive: np.ndarray) -> np.ndarray:
    """Lanes of alive whose distance is within the radius. difference(b) gives plane b of the differing bits, for all lanes at once."""
    digits = max(1, radius.bit_length())
    counts = [np.zeros(shape, np.uint64) for _ in range(digits)]
    past = ~alive

    def beyond() -> np.ndarray:
        """Lanes whose counter is above the radius: compared from the highest digit on."""
        more, same = past.copy(), np.full(shape, ALL)
        for k in reversed(range(digits)):
            if radius >> k & 1:
                same &= counts[k]
            else:
                more |= same & counts[k]
                same &= ~counts[k]
        return more

    for b in range(64):
        carry = difference(b)
        for k in range(digits):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        past = past | carry
        if b % 8 == 7 and not (~beyond()).any():
            break
    return ~beyond()


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")


def _shifted(p: np.ndarray, d: int) -> np.ndarray:
    """Lane i of the result is lane i + d of p."""
    w, r = divmod(d, 64)
    q = np.zeros_like(p)
    q[..., : p.shape[-1] - w or None] = p[..., w:]
    if r:
        up = np.zeros_like(q)
        up[..., :-1] = q[..., 1:]
        q = (q >> np.uint64(r)) | (up << np.uint64(64 - r))
    return q


def _small_links(fps: np.ndarray, left: np.ndarray, most: int, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within many small buckets that lie one after the other; left: how many lanes of its bucket follow each lane."""
    out = []
    for at in range(0, len(fps), 1 << 16):  # a block of lanes and what may follow it
        f, rest = fps[at : at + (1 << 16) + most], left[at : at + (1 << 16)]
        p = planes(f)
        for d in range(1, most):
            valid = np.zeros(p.shape[1] * 64, np.uint8)
            valid[: len(rest)] = rest >= d
            if not valid.any():
                break
            q = _shifted(p, d)
            hit = sliced_within(lambda b, q=q: p[b] ^ q[b], p.shape[1:], radius, np.packbits(valid, bitorder="little").view(np.uint64))
            i = np.flatnonzero(_lanes(hit))
            if len(i):
                out.append((at + i, at + i + d))
    return out


def _large_links(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within one bucket: 64 fingerprints at a time against all lanes from theirs on."""
    out, p = [], planes(fps)
    for at in range(0, len(fps), 64):
        q = fps[at : at + 64]
        lanes = p[:, at // 64 :]
        own = np.where((q[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ALL, np.uint64(0))  # (queries, 64)
        valid = np.zeros(lanes.shape[1] * 64, np.uint8)
        valid[: len(fps) - at] = 1
        alive = np.broadcast_to(np.packbits(valid, bitorder="little").view(np.uint64), (len(q), lanes.shape[1]))
        hit = sliced_within(lambda b: own[:, b, None] ^ lanes[b], alive.shape, radius, alive)
        i, j = np.nonzero(_lanes(np.ascontiguousarray(hit)))
        keep = j > i
        out.append((at + i[keep], at + j[keep]))
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least lane of each lane's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def star_links(key: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fingerprint, least of its component in the bucket) of buckets that lie one after the other; key names them, fingerprints ascend within."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    row_size, row_end = np.repeat(size, size), np.repeat(start + size, size)
    left = row_end - np.arange(len(key)) - 1
    pairs, low = [], 1
    while low < SMALL:  # by size, so that few lanes take part in the longest shifts
        pick = np.flatnonzero((row_size > low) & (row_size <= 2 * low))
        if len(pick):
            pairs += [(pick[i], pick[j]) for i, j in _small_links(fps[pick], left[pick], 2 * low, radius)]
        low *= 2
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        pairs += [(s + i, s + j) for i, j in _large_links(fps[s : s + n], radius)]
    if not pairs:
        return fps[:0], fps[:0]
    root = _roots(len(fps), np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join what is within the radius."""
    if radius > 2:
        raise ValueError("two shared blocks of four are certain only up to a radius of 2")
    part = lambda x, i, bits: F.shiftrightunsigned(x, bits * i).bitwiseAND((1 << bits) - 1)
    both = lambda x, i, j, bits: F.shiftleft(part(x, i, bits), bits) + part(x, j, bits)

    def keys(x: Column, name: Column, bits: int) -> Column:
        """For each pair of four blocks: a key of the pair, and the bits of the other two."""
        others = [tuple(sorted({0, 1, 2, 3} - set(pair))) for pair in PAIRS]
        return F.explode(F.array(*(F.struct(F.xxhash64(name, F.lit(n), both(x, *pair, bits)).alias("key"), both(x, *rest, bits).alias("open")) for n, (pair, rest) in enumerate(zip(PAIRS, others)))))

    keyed = distinct.select("fp", keys(F.col("fp"), F.lit(0), 16).alias("k")).select("fp", "k.*")
    count = stored(keyed.groupBy("key").count().where("count > 1"), "bucket-sizes")
    inner = keyed.join(count.where(F.col("count") > block), "key", "left_semi").select("fp", keys(F.col("open"), F.col("key"), 8).alias("k")).select("fp", "k.key")
    sizes = inner.groupBy("key").count().where("count > 1")
    keyed = keyed.select("fp", "key").join(count.where(F.col("count") <= block), "key").unionByName(inner.join(sizes, "key"))
    parts = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # a row for each pair of sub-blocks that this fingerprint's own belongs to: one where the bucket isn't split
    placed = keyed.select("key", "fp", own.alias("s"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("t"))
    bucket = F.struct("key", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"))
    sorted_ = placed.select(F.xxhash64(bucket).alias("bucket"), "key", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = sorted_.repartition(n, "bucket").sortWithinPartitions("bucket", "key", "x", "y", "fp")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for last, part in _whole_buckets(it):
            held.append(part)
            if last or sum(len(p) for p in held) > 200_000:
                rows = np.concatenate(held)
                held = []
                a, b = star_links(rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(np.uint64), radius)
                if len(a):
                    yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return sorted_.select(F.xxhash64("bucket", "key", "x", "y").alias("g"), "fp").mapInArrow(lean(compare), "a long, b long").distinct()


def _whole_buckets(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray]]:
    """Rows (bucket, fingerprint) in pieces that don't cut a bucket; whether it is the last one."""
    rest = np.zeros((0, 2), np.int64)
    for b in it:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
        rows = np.concatenate([rest, rows])
        cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if (rows[:, 0] != rows[-1, 0]).any() else 0
        rest = rows[cut:]
        if cut:
            yield False, rows[:cut]
    if len(rest):
        yield True, rest


# --- components --------------------------------------------------------------------------------------------------


def components(edges: DataFrame, what: str = "stars") -> DataFrame:
    """(a, b): b is the least node of a's component; least nodes themselves don't appear. Large and small stars by turns until nothing changes."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, what)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, e = e, stored(small, what)
        forget(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e
        state = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of the component)."""
    fp = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius, block))
    named = distinct.join(roots, distinct["fp"] == roots["a"], "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    linked = named.join(roots.select(F.col("b").alias("root")).distinct(), "root", "left_semi")
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(first, "root", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return fp.join(of, "fp").select("doc_id", "fp", "component_id")
