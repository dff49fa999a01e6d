"""Scoring by a probabilistic suffix tree over word symbols.

Tokens are a text's lower-cased (A-Z) words and one end. A word that training texts hold ``frequent`` times or more is a
symbol of its own, any other has its shape's (last letter or accent, closing punctuation, length). The tree's candidates
are contexts of up to ``depth`` symbols that training texts hold ``contexts`` times or more. Both bounds are counts, so
symbols and states grow with the corpus.

Divergence test: a candidate is retained if its next-symbol distribution, each occurrence judged by all the others,
predicts training texts better than its parent's (the context without its oldest symbol) by ``GAIN`` bits a symbol. A
retained state's distribution is smoothed by its parent's, by absolute discounting (n symbols that occur at all leave
n * ``DISCOUNT`` of their counts to the parent); the root's by one count a symbol. Both rules are the same for every
context, whatever its count. A text's log10 probability is the sum over tokens of the symbol's, in the longest retained
suffix of what came before, and the word's among its shape's words, (c + 1) / (N + V + 1) with the shape's own N and V.

No worker holds the tree. Documents are read once into blocks of some 16 MB, each with a vocabulary of its own and the
texts as places in it. Level by level a block asks for its distinct contexts with what follows them and how often; the
questions are dealt to buckets by context (and what follows, where the context has ``HOT`` tokens or more, so that no
context fills a bucket), a bucket sums the counts of all blocks, tests the contexts and answers with the counts. The
pieces of a hot context are added up first: how many kinds of symbols follow it, then the test's bits; a row for each
piece comes to the driver, a row for each hot context goes to the blocks. What a context
one symbol longer occurs is known from its parent's answer, so only contexts that reach the bound are ever asked for.
Blocks' states are files in the shared folder, renamed when complete, the same in every attempt; a level's are deleted
when the next is stored. Words are known by 64-bit hashes (symbols by 31 bits of them). In messages a symbol is its rank
by count in its word's bucket, a context of three symbols or more its place among its bucket's pairs: small numbers that
ascend, of which the differences are sent, so a question takes few bytes however many buckets there are. What a parent
says is sent from the third level on. On the first it follows from the symbols' counts; contexts of two symbols go to
the bucket of their last one, which has kept what it learnt of that (a symbol that is hot is kept in pieces, which each
of its buckets reads). Blocks don't keep it either, but the counts that it follows from.

Null texts have only their end. A null doc_id counts as the empty text in ``held_out``. Rows that repeat count each for
itself, other columns are ignored, an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import lean, texts
from vecspark.runtime import forget, shared_dir, stored

FREQUENT, CONTEXTS, DEPTH, GAIN, DISCOUNT = 20, 10, 5, 0.05, 0.7
HOT, HOT_PRIOR = 1 << 20, 1000.0
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 50_000
#: Bytes of text for each partition that blocks are dealt to, and training tokens for each bucket of questions.
PARTITION_BYTES, BUCKET_TOKENS = 256 << 20, 1 << 21
#: Shapes: three closings, two lengths, 27 plain last letters (or none) and 17 accents.
SHAPES = 3 * 2 * 44
END = SHAPES  #: the end's symbol; those of frequent words follow, END + 1 and 31 bits of the word's hash
MASK = np.uint64(0x7FFFFFFF)
_R = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, fold: int = 2, folds: int = 7) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def shapes(words: pa.Array) -> np.ndarray:
    """The shape of each word, from its bytes: not empty, without nulls."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    first, last = offsets[:-1], offsets[1:] - 1
    closing = np.where(data[last] == ord("."), 1, 2 * ((data[last] < 128) & ~((data[last] >= 97) & (data[last] <= 122)) & ~((data[last] >= 48) & (data[last] <= 57))))
    letter = data[np.where((closing > 0) & (last > first), last - 1, last)]
    plain = np.where((letter >= 97) & (letter <= 122), letter - 96, 0)
    # the last byte beyond ASCII in each word, if any
    place = np.maximum.accumulate(np.where(data >= 128, np.arange(len(data)), -1))[last]
    accent = np.where(place >= first, 27 + (data[np.maximum(place, 0)] & 15), 0)
    return (closing * 2 + (last - first >= 5)) * 44 + np.where(accent > 0, accent, plain)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(31))


# --- files and messages --------------------------------------------------------------------------------------------


def _save(folder: str, block: int | str, arrays: dict[str, np.ndarray]) -> None:
    place, plain = fs.FileSystem.from_uri(folder)
    part = f"{plain}/_{block}.{TaskContext.get().taskAttemptId()}"
    table = pa.table({k: pa.array([_planes(v)], pa.large_binary()) for k, v in arrays.items()})
    schema = table.schema.with_metadata({k: v.dtype.str for k, v in arrays.items()})
    with place.open_output_stream(part) as f, pa.ipc.new_file(f, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_table(table.cast(schema))
    place.move(part, f"{plain}/{block}.arrow")


def _load(folder: str, block: int | str) -> dict[str, np.ndarray]:
    place, plain = fs.FileSystem.from_uri(folder)
    with place.open_input_file(f"{plain}/{block}.arrow") as f:
        t = pa.ipc.open_file(f).read_all()
    kinds = {k.decode(): v.decode() for k, v in t.schema.metadata.items()}
    return {k: _numbers(t[k][0].as_buffer(), kinds[k]) for k in t.column_names}


def _found(folder: str, block: int | str) -> dict[str, np.ndarray] | None:
    place, plain = fs.FileSystem.from_uri(folder)
    return _load(folder, block) if place.get_file_info(f"{plain}/{block}.arrow").type == fs.FileType.File else None


def _made(folder: str) -> str:
    place, plain = fs.FileSystem.from_uri(folder)
    place.create_dir(plain, recursive=True)
    return folder


def _gone(folder: str) -> None:
    place, plain = fs.FileSystem.from_uri(folder)
    place.delete_dir(plain)


def _planes(a: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: high bytes are often the same."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _numbers(data: pa.Buffer | memoryview, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(map(_planes, arrays)))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<u4", len(kinds)), 4 * len(kinds), []
    for k, n in zip(kinds, sizes.tolist()):
        width = n * np.dtype(k).itemsize
        out.append(_numbers(memoryview(raw)[at : at + width], k))
        at += width
    return out


def _steps(v: np.ndarray) -> np.ndarray:
    """Differences of numbers (modulo their width); np.cumsum undoes it."""
    return np.diff(v, prepend=v.dtype.type(0))


def _after(v: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences that begin anew where new says so; _followed undoes it."""
    d = _steps(v)
    d[new] = v[new]
    return d


def _followed(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    v, begin = np.cumsum(d, dtype=d.dtype), np.flatnonzero(new)
    return v - np.repeat((v - d)[begin], np.diff(np.append(begin, len(d))))


def _coded(n: np.ndarray) -> np.ndarray:
    """Numbers as their differences, small either way where neighbours are alike."""
    d = _steps(n.astype("<i8"))
    return ((d << 1) ^ (d >> 63)).view("<u8")


def _decoded(z: np.ndarray) -> np.ndarray:
    return np.cumsum((z >> np.uint64(1)).view("<i8") ^ -(z & np.uint64(1)).view("<i8"), dtype="<i8")


def _each(symbols: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Symbols' numbers, once for each (they fall with the rank); _all undoes it."""
    return _coded(n[np.unique(symbols, return_index=True)[1]])


def _all(each: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return _decoded(each)[np.unique(symbols, return_inverse=True)[1]]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, ascending; for each a place that has it; the key's number at each place). Takes less time than np.unique, which looks for the first place."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.empty(len(order), np.uint32)
    at[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return key[new], order[new], at


MESSAGE = "bucket long, block long, data binary"
#: Answers, and with no block: sums over a bucket's words by symbol.
ANSWER = f"{MESSAGE}, symbol long, n long, v long"


def _messages(bucket: list[int], block: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "data"])


def _answers(bucket: list[int], block: list[int], data: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(len(bucket), pa.int64())
    return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(data, pa.binary()), none, none, none], names=["bucket", "block", "data", "symbol", "n", "v"])


def _grouped(it: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of messages that lie one after the other, by one of their first two columns."""
    held: list[tuple] = []
    for b in it:
        for row in zip(*(b.column(i).to_pylist() for i in range(3))):
            if held and row[key] != held[0][key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def _dealt(block: int, bucket: np.ndarray, send: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """Messages of the runs of equal buckets (ascending); send gives that of a range. A block without questions asks an empty one, so that it is answered too."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(1, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    names = bucket[cuts].tolist() if len(bucket) else [0]
    for i in range(0, len(cuts), 256):
        part = [send(int(x), int(y)) for x, y in zip(cuts[i : i + 256], ends[i : i + 256])]
        yield _messages(names[i : i + 256], [block] * len(part), part)


# --- words ---------------------------------------------------------------------------------------------------------


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(docs: DataFrame, folder: str, words: str, buckets: int) -> DataFrame:
    """Write the blocks and, apart, their words' buckets and shapes, which the first level alone reads; ask for the counts of the words. Word 0 of each is the end."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        task = TaskContext.get()
        names, ids, held, tokens, size, n = _Names({b"": 0}), [], [], [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            block = (task.partitionId() << 24) + n
            lengths = np.array([len(t) for t in tokens])
            flat = np.concatenate(tokens)
            out = np.array(held)
            counts = np.bincount(flat[~np.repeat(out, lengths)], minlength=len(names)).astype("<u4")
            hashes = np.fromiter(map(xxh64_intdigest, names), np.uint64, len(names))
            shape = np.concatenate([[END], shapes(pa.array(list(names)[1:], pa.binary()).cast(pa.string()))]).astype("<u2")
            # the words by how often they occur, after the end: small numbers for frequent words, so they take few bytes
            most = np.append(0, 1 + np.argsort(-np.bincount(flat, minlength=len(names))[1:], kind="stable"))
            place = np.empty(len(most), np.uint32)
            place[most] = np.arange(len(most), dtype=np.uint32)
            hashes, counts, shape = hashes[most], counts[most], shape[most]
            bucket = _word_buckets(hashes & MASK, buckets)
            _save(folder, block, {"doc": np.array([i or 0 for i in ids], np.int64), "null": np.array([i is None for i in ids]), "held": out, "size": lengths, "word": place[flat]})
            _save(words, block, {"shape": shape, "bucket": bucket.astype("<u4")})
            order = np.argsort(bucket, kind="stable")
            hashes, counts, shape, bucket = hashes[order], counts[order], shape[order], bucket[order]
            yield from _dealt(block, bucket, lambda x, y: _pack(hashes[x:y], counts[x:y], shape[x:y]))

        for b in it:
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = t.as_py().encode().lower()
                w = raw.split()
                w.append(b"")
                ids.append(i)
                held.append(h)
                tokens.append(np.fromiter(map(names.__getitem__, w), np.uint32, len(w)))
                size += len(raw)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield from close()
                    names, ids, held, tokens, size, n = _Names({b"": 0}), [], [], [], 0, n + 1
        if ids:
            yield from close()

    return texts(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(lean(write), MESSAGE)


def _word_buckets(names: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word, by the hash that its symbol has; words are asked for by bucket, else as they come."""
    return (_mix(names.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _word_counts(frequent: int) -> Callable:
    """Answer with each word's training count, what its symbol has besides it where that isn't a shape, and that symbol's rank in the bucket (from 1, most tokens first; 0: a shape); sums by symbol go without a block."""

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(it, 0):
            parts = [_unpack(r[2], "<u8", "<u4", "<u2") for r in rows]
            hashes, n, shape = (np.concatenate([p[i] for p in parts]) for i in range(3))
            _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
            c = np.bincount(at, n, len(first)).astype(np.int64)
            symbol = _symbols(c, shape[first], hashes[first] & MASK, frequent)
            names, of = np.unique(symbol, return_inverse=True)
            own, kinds = np.bincount(of, c, len(names)).astype(np.int64), np.bincount(of, c > 0, len(names)).astype(np.int64)
            sums = [np.where(names <= END, names, END + 1), own, kinds]
            yield pa.record_batch([*(pa.nulls(len(names), t) for t in (pa.int64(), pa.int64(), pa.binary())), *map(pa.array, sums)], names=["bucket", "block", "data", "symbol", "n", "v"])
            rank, most = np.zeros(len(names), "<u4"), np.lexsort((names, -own))
            most = most[names[most] > END]
            rank[most] = np.arange(1, len(most) + 1)
            c, own, rank, ends = c[at], own[of][at], rank[of][at], np.cumsum([len(p[0]) for p in parts])
            own = np.where(rank > 0, own - c, 0)
            for r, x, y in zip(rows, [0, *ends.tolist()], ends.tolist()):
                yield _answers([bucket], [r[1]], [_pack(c[x:y], own[x:y], rank[x:y])])

    return answer


def _symbols(c: np.ndarray, shape: np.ndarray, name: np.ndarray, frequent: int) -> np.ndarray:
    return np.where((c >= frequent) & (shape != END), END + 1 + name.astype(np.int64), shape.astype(np.int64))


# --- levels --------------------------------------------------------------------------------------------------------


@dataclass
class Pairs:
    """Contexts with what follows them, each pair once, in the order in which they are asked for; a run of pairs has one context (or piece of a hot one)."""

    at: np.ndarray  # the pair at each place
    new: np.ndarray  # whether a pair begins a run
    q: np.ndarray  # log10 of what the parent says
    total: np.ndarray  # for each run: the context's training count
    hot: np.ndarray  # the names of the contexts of hot runs

    @property
    def run(self) -> np.ndarray:
        return np.cumsum(self.new) - 1


def _pairs(x: np.ndarray, named: np.ndarray | None, pos: np.ndarray, ctx: np.ndarray, total: np.ndarray, p: np.ndarray, buckets: int, hot: int, homes: np.ndarray | None = None) -> tuple[Pairs, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs; for each one of its places in pos, bucket and context's name). At each place, ctx: a number for the context within the block, of which named has the name that all blocks know (None: the number itself, a symbol) and homes what its bucket goes by (None: the name's hash); total: its training count, p: log10 of what its parent says of the symbol."""
    key = ctx.astype(np.uint64)
    key <<= np.uint64(32)
    key |= x[pos]
    first, at = _distinct(key)[1:]
    del key
    names = ctx[first].astype(np.uint64) if named is None else named[ctx[first]]
    total = total[first].astype(np.int64)
    split = x[pos[first]].astype(np.uint64) % (np.uint64(1) + (total // hot).astype(np.uint64))
    bucket = (_mix((_mix(names) if homes is None else homes[ctx[first]]) + split * _R) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((names, bucket))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    first, bucket, names = first[order], bucket[order], names[order]
    new = np.ones(len(first), bool)
    new[1:] = (names[1:] != names[:-1]) | (bucket[1:] != bucket[:-1])
    total = total[order][new]
    return Pairs(place[at], new, p[first].astype("<f4"), total, names[new][total >= hot]), first, bucket, names


def _two(x: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of two symbols before places: (names, ascending: the last symbol, then the one before it; for each one of its places in pos; the context at each place)."""
    return _distinct(x[pos - 1].astype(np.uint64) << np.uint64(32) | x[pos - 2])


def _second(x: np.ndarray, pos: np.ndarray, two: tuple[np.ndarray, np.ndarray, np.ndarray], total: np.ndarray, own: np.ndarray, p: np.ndarray, buckets: int, hot: int) -> tuple[Pairs, np.ndarray, np.ndarray, np.ndarray]:
    """_pairs of the second level. A context's bucket is that of its last symbol, or where that is hot, any of that symbol's by the one before. two: _two's; at each place, own: the last symbol's training count."""
    names, first, ctx = two
    split = (names & np.uint64(0xFFFFFFFF)) % (np.uint64(1) + (own[first] // hot).astype(np.uint64))
    return _pairs(x, names, pos, ctx, total, p, buckets, hot, _mix(names >> np.uint64(32)) + split * _R)


def _ask(block: int, texts: dict[str, np.ndarray], x: np.ndarray, pos: np.ndarray, asked: tuple[Pairs, np.ndarray, np.ndarray, np.ndarray], hot: int, level: int, often: np.ndarray | None = None, lone: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The questions of a level. What the parent says goes with them from the third level on, where the test may need it from here (not for pairs of held-out texts alone, or that follow the parent once at most: lone, at each place); on the first the training counts of the symbols that follow (often, at each place) tell it, on the second the bucket knows it."""
    pairs, first, bucket, names = asked
    train = ~np.repeat(texts["held"], texts["size"])[pos]
    n, follows = np.bincount(pairs.at, train, len(first)).astype("<u4"), x[pos[first]]
    runs = np.append(np.flatnonzero(pairs.new), len(first))

    # symbols ascend within a run; a context's count is the sum of its pairs', so it is sent for pieces of hot ones alone
    after = _after(follows, pairs.new)
    whole = np.where(pairs.total >= hot, pairs.total, 0)
    if often is not None:
        often = often[first]
    says = pairs.q if lone is None else np.where((n > 0) & ~lone[first], pairs.q, np.float32(0))

    def send(a: int, b: int) -> bytes:
        r, s = np.searchsorted(runs, (a, b))
        name = names[runs[r:s]]
        high, low = (name >> np.uint64(32)).astype("<u4"), name.astype("<u4")
        each = np.zeros(0, "<u8") if often is None else _each(follows[a:b], often[a:b])
        q = says[a:b] if level > 2 else np.zeros(0, "<f4")
        high = _steps(high)
        return _pack(high, _after(low, high > 0), whole[r:s], np.diff(runs[r : s + 1]).astype("<u4"), after[a:b], n[a:b], each, q)

    yield from _dealt(block, bucket, send)


def _asked(data: bytes, symbols: int) -> tuple[np.ndarray, ...]:
    """What _ask packed: contexts' names, counts (0: the sum of the pairs'), numbers of pairs; for each pair the symbol, how often it is there and q (0 if it isn't sent), and the symbol's training count (0: q needs none). symbols: what the root divides by."""
    high, low, total, run, after, n, each, q = _unpack(data, "<u4", "<u4", "<i8", "<u4", "<u4", "<u4", "<u8", "<f4")
    new = high > 0
    new[:1] = True
    names = np.cumsum(high, dtype="<u4").astype(np.uint64) << np.uint64(32) | _followed(low, new)
    new = np.zeros(len(after), bool)
    new[np.cumsum(run, dtype=np.int64) - run] = True
    follows, often = _followed(after, new), np.zeros(len(after), np.int64)
    if len(each):
        often = _all(each, follows)
        q = _root(often, symbols).astype("<f4")
    return names, total, run, follows, n, q if len(q) else np.zeros(len(after), "<f4"), often


def smoothed(c: np.ndarray, q: np.ndarray, total: np.ndarray, kinds: np.ndarray, retained: np.ndarray, discount: float = DISCOUNT, alone: float = HOT) -> np.ndarray:
    """What contexts say of symbols that follow them c times, by their training counts, how many kinds of symbols follow them, and what their parents say (q).

    From alone tokens on the kinds aren't needed: HOT_PRIOR counts go to the parent. The tree knows them always and has no such bound."""
    hot = (c + HOT_PRIOR * q) / (total + HOT_PRIOR)
    rest = (np.maximum(c - discount, 0) + discount * kinds * q) / np.maximum(total, 1)
    return np.where(retained, np.where(total >= alone, hot, rest), q)


def gained_bits(total: np.ndarray, own: np.ndarray, c: np.ndarray, q: np.ndarray, kinds: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """What contexts gain over their parents, in bits, by the pairs that are given; kinds: of the whole contexts."""
    # each occurrence by all others: its own count and, if it is the only one, its kind are taken away
    others = (np.maximum(c - 1 - discount, 0) + discount * (kinds[own] - (c == 1)) * q) / np.maximum(total[own] - 1, 1)
    return np.bincount(own, np.where(c > 0, c * np.log2(np.maximum(others / q, 1e-3)), 0.0), len(total))


def contexts_tested(total: np.ndarray, own: np.ndarray, c: np.ndarray, q: np.ndarray, gain: float, discount: float = DISCOUNT, alone: float = HOT) -> tuple[np.ndarray, np.ndarray]:
    """For each context (kinds of symbols that follow, retained). own: the context of each pair of a context and what follows (c times), q: what the parent says. From alone tokens on contexts are retained untested; the tree has no such bound."""
    kinds = np.bincount(own, c > 0, len(total)).astype(np.int64)
    return kinds, (total >= alone) | (gained_bits(total, own, c, q, kinds, discount) >= gain * np.maximum(total, 1))


def _learnt(model: str, bucket: int, names: np.ndarray, total: np.ndarray, kinds: np.ndarray, retained: np.ndarray, own: np.ndarray, follows: np.ndarray, c: np.ndarray, often: np.ndarray, hot: int) -> None:
    """Write what a bucket's contexts of the first level say of symbols that follow them twice or more, pieces of hot ones in files of their own."""
    often_enough, mine = c > 1, total < hot
    for i in np.flatnonzero(~mine).tolist():
        x, y = np.searchsorted(own, (i, i + 1))
        some = often_enough[x:y]
        _save(model, f"{names[i]}-{bucket}", {"symbol": _steps(follows[x:y][some]), "c": c[x:y][some], "often": _each(follows[x:y][some], often[x:y][some])})
    some = often_enough & mine[own]
    run = np.bincount(own[some], minlength=len(names))[mine]
    new = np.zeros(run.sum(), bool)
    new[(np.cumsum(run) - run)[run > 0]] = True
    _save(model, bucket, {"name": names[mine], "total": total[mine], "kinds": kinds[mine], "retained": retained[mine], "run": run, "symbol": _after(follows[some], new), "c": c[some], "often": _each(follows[some], often[some])})


def _told(model: str, bucket: int, last: np.ndarray, buckets: int, hot: int, symbols: int, judged: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols and what follows them, ascending; log10 of what the first level says of it), for the bucket's own contexts and the hot ones among last."""
    keys, logs = [np.zeros(0, np.uint64)], [np.zeros(0, "<f4")]

    def add(name, s, follows, total, kinds, retained):
        keys.append(name << np.uint64(32) | follows.astype(np.uint64))
        logs.append(_said(s["c"], _all(s["often"], follows), total, kinds, retained, symbols))

    names, kinds, kept, total = judged or (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    hot_ones = np.isin(last, names)
    if not hot_ones.all():
        s = _load(model, bucket)
        run = s["run"]
        new = np.zeros(len(s["c"]), bool)
        new[(np.cumsum(run) - run)[run > 0]] = True
        add(np.repeat(s["name"], run), s, _followed(s["symbol"], new), *(np.repeat(s[k], run) for k in ("total", "kinds", "retained")))
    for b in last[hot_ones]:  # the pieces of a hot one lie in all its buckets
        i = int(np.searchsorted(names, b))
        split = np.arange(1 + total[i] // hot).astype(np.uint64)
        for k in np.unique(_mix(_mix(last[last == b]) + split * _R) % np.uint64(buckets)).tolist():
            if (s := _found(model, f"{b}-{k}")) is not None:
                add(b, s, np.cumsum(s["symbol"], dtype="<u4"), total[i], kinds[i], kept[i])
    keys, logs = np.concatenate(keys), np.concatenate(logs)
    if hot_ones.any():
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
    return keys, logs


def _pair_counts(gain: float, hot: int, contexts: float, level: int, symbols: int, buckets: int, model: str | None, judged: tuple | None) -> Callable:
    """Answer with each pair's training count in other blocks, and for each run its context's kinds and whether it is retained; and from the second level on for pairs that are often enough their places among the bucket's. Pieces of hot contexts go without a block: the context's name, the piece's kinds, the context's count, and the piece's counts with what the parent says. The first level's buckets write what they learnt, the second's read it (judged: its hot contexts)."""

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(it, 0):
            parts = [_asked(r[2], symbols) for r in rows]
            names, total, run, follows, n, q, freq = (np.concatenate([p[i] for p in parts]) for i in range(7))
            names, first, of = np.unique(names, return_index=True, return_inverse=True)
            pairs, where, at = _distinct(np.repeat(of, run).astype(np.uint64) << np.uint64(32) | follows.astype(np.uint64))
            c, own, total = np.bincount(at, n, len(pairs)).astype(np.int64), (pairs >> np.uint64(32)).astype(np.int64), total[first]
            sent, q = q, np.zeros(len(pairs), "<f4")
            q[at[sent != 0]] = sent[sent != 0]  # all that send it send the same
            total = np.where(total > 0, total, np.bincount(own, c, len(total)).astype(np.int64))
            if level == 2 and len(names):
                last = names >> np.uint64(32)
                keys, logs = _told(model, bucket, np.unique(last), buckets, hot, symbols, judged)
                often = np.flatnonzero(c > 1)  # where a symbol follows once, the parent's share falls out of the test
                found = np.searchsorted(keys, last[own[often]] << np.uint64(32) | follows[where[often]].astype(np.uint64))
                q[often] = logs[found]
            kinds, retained = contexts_tested(total, own, c, 10.0 ** q.astype(np.float64), gain, alone=np.inf)
            if level == 1 and model:
                _learnt(model, bucket, names, total, kinds, retained, own, follows[where], c, freq[where], hot)
            for i in np.flatnonzero(total >= hot).tolist():
                x, y = np.searchsorted(own, (i, i + 1))
                piece = [bucket], [None], [_pack(c[x:y].astype("<i8"), q[x:y])], [int(names[i].view(np.int64))], [int(kinds[i])], [int(total[i])]
                yield pa.record_batch([pa.array(v, pa.binary() if k == 2 else pa.int64()) for k, v in enumerate(piece)], names=["bucket", "block", "data", "symbol", "n", "v"])
            often = (c >= contexts) & (level > 1)
            place, often = (np.cumsum(often) - 1).astype("<u4")[at], often[at]
            # where a context isn't retained, a count matters only if the pair is a context of the next level
            needed = retained[own] | (c >= contexts) | (total >= hot)[own]
            c, kinds, retained = np.where(needed[at], np.minimum(c, 0xFFFFFFFF)[at] - n, 0).astype("<u4"), kinds.astype("<u4")[of], retained.astype("u1")[of]
            ends, runs = (np.cumsum([0, *(len(x[i]) for x in parts)]) for i in (3, 0))
            for i, r in enumerate(rows):
                mine, some = slice(runs[i], runs[i + 1]), slice(ends[i], ends[i + 1])
                yield _answers([bucket], [r[1]], [_pack(c[some], kinds[mine], retained[mine], _steps(place[some][often[some]]))])

    return answer


def _hot_contexts(told: DataFrame, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hot contexts of a level's answers: (names, ascending; kinds; retained; training counts). At most a row for each piece comes to the driver."""

    def judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bits = []
            for data, v, kinds in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                c, q = _unpack(data, "<i8", "<f4")
                bits.append(float(gained_bits(np.array([v]), np.zeros(len(c), np.int64), c, 10.0 ** q.astype(np.float64), np.array([kinds]))[0]))
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(bits, pa.float64())], names=["symbol", "bucket", "v", "kinds", "bits"])

    pieces = told.where("block is null")
    kinds = pieces.groupBy("symbol").agg(F.sum("n").alias("kinds"))
    met = pieces.join(kinds, "symbol").select("symbol", "bucket", "data", "v", "kinds")
    rows = sorted(met.mapInArrow(lean(judged), "symbol long, bucket long, v long, kinds long, bits double").collect())
    names, first, of = np.unique(np.array([r.symbol for r in rows], np.int64).view(np.uint64), return_index=True, return_inverse=True)
    total, kinds = (np.array([r[i] for r in rows], np.int64)[first] for i in (2, 3))
    return names, kinds, np.bincount(of, [r.bits for r in rows], len(names)) >= gain * total, total


def _add(sums: np.ndarray, size: np.ndarray, pos: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """sums with the logarithms at pos added for each text."""
    doc = np.repeat(np.arange(len(size)), size)[pos]
    return sums + np.bincount(doc, logs, len(sums))


def _first(blocks: str, words: str, folder: str, sums: tuple, model: tuple[int, int, int, int, int], buckets: int, hot: int) -> Callable:
    """From the words' counts to symbols; the first level's questions."""
    frequent, contexts, total, distinct, symbols = model
    of_n, of_v = sums

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(it, 1):
            s, known = _load(blocks, block), _load(words, block)
            parts, bucket = [_unpack(r[2], "<i8", "<i8", "<u4") for r in rows], known["bucket"].astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            c, n, rank = np.empty((3, len(order)), np.int64)
            c[order], n[order], rank[order] = (np.concatenate([x[i] for x in parts]) for i in range(3))
            symbol = np.where(rank > 0, END + 1 + (rank - 1) * buckets + bucket, known["shape"])
            shape = np.minimum(symbol, END)
            n, v = np.where(symbol <= END, of_n[shape], c + n), of_v[shape]
            base = np.log10((c + 1) / (total + distinct + 1))
            within = np.where(symbol < END, np.log10((c + 1) / (n + v + 1)), np.log10(np.maximum(c, 1) / np.maximum(n, 1)))
            root = _root(n, total + symbols)
            size, w = s["size"], s["word"]
            begin = np.cumsum(size) - size
            pos, x, total_at = _starts(s, symbol, n, contexts)
            rest = np.ones(len(w), bool)
            rest[pos] = False
            score = _add(np.add.reduceat(within[w], begin), size, np.flatnonzero(rest), root[w[rest]])
            _save(folder, block, {"score": score, "known": np.add.reduceat((c > 0)[w].astype(np.int64), begin), "base": np.add.reduceat(base[w], begin), "symbol": symbol.astype(np.uint32), "often": _coded(n[np.argsort(symbol, kind="stable")]), "root": np.array([total + symbols])})
            yield from _ask(block, s, x, pos, _pairs(x, None, pos, x[pos - 1], total_at, root[w[pos]], buckets, hot), hot, 1, n[w[pos]])

    return run


def _root(n: np.ndarray, total: int) -> np.ndarray:
    """log10 of what the root says of symbols, by their training counts."""
    return np.log10((n + 1) / total)


def _said(c: np.ndarray, often: np.ndarray, total: np.ndarray, kinds: np.ndarray, retained: np.ndarray, symbols: int) -> np.ndarray:
    """log10 of what contexts of one symbol say, as the second level has it; often: the training counts of the symbols that follow."""
    q = 10.0 ** _root(often, symbols).astype("<f4").astype(np.float64)
    return np.log10(smoothed(c.astype(np.float64), q, total, kinds, retained, alone=np.inf)).astype("<f4")


def _starts(s: dict[str, np.ndarray], symbol: np.ndarray, n: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places whose symbol before is often enough, all symbols, how often it is for each place)."""
    w = s["word"]
    before = np.concatenate([w[:1], w[:-1]])
    ok = n[before] >= contexts
    ok[np.cumsum(s["size"]) - s["size"]] = False
    pos = np.flatnonzero(ok)
    return pos, symbol[w].astype(np.uint32), n[before[pos]]


def _answered(rows: list[tuple], blocks: str, base: str, folder: str, block: int, level: int, contexts: int, buckets: int, hot: int, judged: tuple | None) -> tuple:
    """Where a block's search stands, with the answers of a level: (texts, the first level's file with each word's symbol's count, score, symbols, places, pairs, log10 of each pair's probability, each pair's count (where its context is retained or it is often enough itself), each run's kinds and whether it is retained, for each bucket the places that it answered with)."""
    texts, one = _load(blocks, block), _load(base, block)
    order, often, symbols = np.argsort(one["symbol"], kind="stable"), _decoded(one["often"]), one["root"][0]
    one["often"] = np.empty_like(often)
    one["often"][order] = often
    word, often = texts["word"], one["often"]
    if level == 1:  # the pairs follow from the words once more, and needn't be kept
        pos, x, total = _starts(texts, one["symbol"], often, contexts)
        pairs, score = _pairs(x, None, pos, x[pos - 1], total, _root(often, symbols)[word[pos]], buckets, hot)[0], one["score"]
    else:
        s = _load(folder, block)
        pos, score, x = np.cumsum(s["pos"], dtype=np.int64), s["score"], one["symbol"][word]
        if level == 2:  # from the words and the first level's counts
            two = _two(x, pos)
            pairs, first, _, _ = _second(x, pos, two, s["total"][two[2]], often[word[pos - 1]], np.zeros(len(pos), "<f4"), buckets, hot)
            first = pos[first]
            last = np.unique(x[first - 1], return_inverse=True)[1]
            pairs.q = _said(s["c"], often[word[first]], often[word[first - 1]], s["kinds"][last], s["retained"][last] > 0, symbols)
        else:
            pairs = Pairs(s["at"], s["new"], s["q"], s["total"], s["hot"])
    parts = [_unpack(r[2], "<u4", "<u4", "u1", "<u4") for r in rows]
    c, kinds, retained = (np.concatenate([a[i] for a in parts]) for i in range(3))
    c += np.bincount(pairs.at, ~np.repeat(texts["held"], texts["size"])[pos], len(c)).astype("<u4")
    if len(pairs.hot):
        names, whole, kept, _ = judged
        at, own = np.searchsorted(names, pairs.hot), pairs.total >= hot
        kinds, retained = kinds.astype(np.int64), retained.copy()
        kinds[own], retained[own] = whole[at], kept[at]
    run, q = pairs.run, 10.0 ** pairs.q.astype(np.float64)
    p = np.log10(smoothed(c.astype(np.float64), q, pairs.total[run], kinds[run], retained[run] > 0, alone=np.inf))
    return texts, one, score, x, pos, pairs, p, c, (kinds, retained), [(r[0], a[3]) for r, a in zip(rows, parts)]


def _next(blocks: str, base: str, old: str, new: str, level: int, contexts: int, buckets: int, hot: int, judged: tuple | None) -> Callable:
    """Answers of a level to the questions of the next."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(it, 1):
            texts, one, score, x, pos, before, p, c, (kinds, retained), places = _answered(rows, blocks, base, old, block, level, contexts, buckets, hot, judged)
            at = before.at
            # a pair that is often enough is the next place's context; that place is asked about already, by the shorter one
            grown = np.flatnonzero((c >= contexts)[at] & (x[pos] != END))
            stop = np.ones(len(pos), bool)
            stop[grown + 1] = False
            score = _add(score, texts["size"], pos[stop], p[at[stop]])
            there, total, parent, lone = pos[grown + 1], c[at[grown]], at[grown + 1], None
            if level == 1:
                two, often = _two(x, there), one["often"][texts["word"]]
                asked = _second(x, there, two, total, often[there - 1], p[parent], buckets, hot)
                # of the first level's answers what its logarithms follow from: by pair, and by the context's last symbol
                first = asked[1]
                of = before.run[parent[first[np.unique(x[there[first] - 1], return_index=True)[1]]]]
                keep = {"total": total[two[1]], "c": c[parent[first]], "kinds": kinds[of], "retained": retained[of]}
            else:
                named = np.zeros(len(c), np.uint64)
                named[c >= contexts] = np.concatenate([np.cumsum(v, dtype=np.uint64) * np.uint64(buckets) + np.uint64(b) for b, v in places])
                asked = _pairs(x, named, there, at[grown], total, p[parent], buckets, hot)
                lone = ((c <= 1) & (retained[before.run] > 0))[parent]
                keep = {"at": asked[0].at, "new": asked[0].new, "q": asked[0].q, "total": asked[0].total, "hot": asked[0].hot}
            _save(new, block, {"score": score, "pos": np.diff(there, prepend=0).astype(np.uint32), **keep})
            yield from _ask(block, texts, x, there, asked, hot, level + 1, lone=lone)

    return run


def _last(blocks: str, base: str, old: str, level: int, contexts: int, buckets: int, total: int, hot: int, judged: tuple | None) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(it, 1):
            texts, one, score, _, pos, pairs, p, _, _, _ = _answered(rows, blocks, base, old, block, level, contexts, buckets, hot, judged)
            score = _add(score, texts["size"], pos, p[pairs.at])
            columns = [pa.array(texts["doc"], mask=texts["null"]), pa.array(texts["held"]), pa.array(texts["size"]), pa.array(one["known"]), pa.array(np.full(len(score), total)), pa.array(one["base"]), pa.array(score)]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, depth: int = DEPTH, frequent: int = FREQUENT, contexts: int = CONTEXTS, gain: float = GAIN, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words by themselves) and score (the tree). hot: contexts of so many tokens are dealt to several buckets; the results don't depend on it."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    buckets = max(n, size // (4 * BUCKET_TOKENS))
    to_buckets = lambda asked: asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    to_blocks = lambda told: told.where("block is not null").select("bucket", "block", "data").repartition(n, "block").sortWithinPartitions("block", "bucket")

    blocks, words, base = (_made(shared_dir(spark, x)) for x in ("blocks", "words", "level-1"))
    told = stored(to_buckets(_blocks(docs, blocks, words, buckets)).mapInArrow(lean(_word_counts(frequent)), ANSWER), "word-answers")
    total, distinct, symbols, most = 0, 0, END + 1, 0
    of_n, of_v = np.zeros(END + 1, np.int64), np.zeros(END + 1, np.int64)
    # a row for each shape, and one for all frequent words
    for r in told.where("block is null").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.count("*").alias("k"), F.max("n").alias("most")).collect():
        total, distinct, most = total + r.n, distinct + r.v, max(most, r.n if r.symbol <= END else r.most)
        if r.symbol <= END:
            of_n[r.symbol], of_v[r.symbol] = r.n, r.v
        else:
            symbols += r.k
    model = (frequent, contexts, total, distinct, symbols)
    learnt, judged = _made(shared_dir(spark, "learnt")) if depth > 1 else None, None
    step, old, new = _first(blocks, words, base, (of_n, of_v), model, buckets, hot), None, base
    for level in range(1, depth + 1):
        # what blocks ask isn't stored: it is larger than the answers
        more = stored(to_buckets(to_blocks(told).mapInArrow(lean(step), MESSAGE)).mapInArrow(lean(_pair_counts(gain, hot, contexts if level < depth else np.inf, level, total + symbols, buckets, learnt, judged)), ANSWER), "answers")
        forget(told)
        if level == 2:
            _gone(learnt)
        if old != base:
            _gone(old or words)
        told, old = more, new
        judged = _hot_contexts(told, gain) if most >= hot else None  # a context's last symbol occurs as often at least
        if level < depth:
            new = _made(shared_dir(spark, f"level-{level + 1}"))
            step = _next(blocks, base, old, new, level, contexts, buckets, hot, judged)
    return to_blocks(told).mapInArrow(lean(_last(blocks, base, old, depth, contexts, buckets, total, hot, judged)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
