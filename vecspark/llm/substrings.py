"""Substring dedup: windows of words that occur anywhere else are removed, found by an FM-index per shard.

Which shard? Every window of ``window`` words has an anchor: the run of ``GRAM`` words with the least hash in it, the
leftmost of equals. Equal windows have equal anchors, so it is enough to compare windows of one anchor. Consecutive
windows with one anchor form a segment; each window lies in one segment. Anchors that occur once can hold no repeat;
only segments of the others go on (counts first, as pairs of numbers, then the words of those segments alone).

Shards are made of whole anchors, ``SHARD`` words each. A shard's distinct segments (equal ones at most twice: that
proves a repeat) become an FM-index, its own segments stream over it, and matching statistics by backward search give the
stretches of ``window`` words or more that occur twice. Words are compared as words, hashes only route; what a batch cuts
has numbers of its own, by which it gets its stretches back.

Hot anchors (whose segments hold more than ``HOT`` words) are split: each of their windows is a segment and its own
anchor, so only equal ones meet; no other anchor brings a task more words than that, whatever the corpus. Copies of a segment are merged by the
tasks that cut them, so a group of copies sends a row a batch.

Null texts have no words. Documents are known by doc_id and the text's hash, so null and repeated doc_ids work: rows that
repeat are copies of each other. Other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import lean, texts
from vecspark.llm.fmindex import FMIndex, repeated_stretches
from vecspark.runtime import forget, stored

WINDOW, GRAM, SHARD, HOT = 35, 8, 500_000, 100_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base))])


class Words:
    """The words of some texts as places in their bytes, and hashes of runs of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        space = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a text's end ends a word
        before = np.concatenate([[True], space[:-1]]) | edge[:-1] if len(data) else space
        after = np.concatenate([space[1:], [True]]) | edge[1:] if len(data) else space
        self.start, self.end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets)  # of each text; the last is the number of words
        p = _powers(_R, len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(data * p[:-1])])
        q = _powers(_INVERSE, len(data))
        self.hash = _mix((sums[self.end] - sums[self.start]) * q[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on, where there are so many."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _R + self.hash[j : j + n]
        return _mix(out)

    def anchors(self, window: int, gram: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(anchor, first window, windows) of the segments, windows named by their first word. wanted: the windows that count (all, if None)."""
        n = len(self.hash) - window + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none
        g = self.grams(gram)
        at, value, span, width = np.arange(len(g)), g, window - gram + 1, 1
        while 2 * width <= span:  # the least of windows of doubled width, the left one of equals
            left = value[:-width] <= value[width:]
            at, value, width = np.where(left, at[:-width], at[width:]), np.where(left, value[:-width], value[width:]), 2 * width
        rest = span - width
        m = len(value) - rest
        at = np.where(value[:m] <= value[rest:], at[:m], at[rest:])[:n]
        ok = self.doc[:n] == self.doc[window - 1 :][:n]
        if wanted is not None:
            ok = ok & wanted[:n]
        w = np.flatnonzero(ok)
        new = np.ones(len(w), bool)
        new[1:] = (at[w[1:]] != at[w[:-1]]) | (w[1:] != w[:-1] + 1)
        s = np.flatnonzero(new)
        return g[at[w]][s].view(np.int64), w[s], np.diff(np.concatenate([s, [len(w)]]))


def _column(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(c.type) else np.int32
    offsets = np.frombuffer(c.buffers()[1], kind)[c.offset : c.offset + len(c) + 1]
    data = c.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def _chunks(c: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, Words]]:
    """Runs of texts of some bytes: (from, to, their words)."""
    data, offsets = _column(c)
    at = 0
    while at < len(c):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, Words(data, offsets[at : end + 1])
        at = end


def _known(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")


def anchor_table(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row for each segment: anchor, document, its first window and how many."""

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, _, w in _chunks(b.column(2)):
                key, first, n = w.anchors(window, gram)
                doc = w.doc[first]
                rows = pa.array(at + doc)
                yield pa.record_batch([pa.array(key), b.column(0).take(rows), b.column(1).take(rows), pa.array((first - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "doc_id", "th", "s", "n"])

    return _known(docs).mapInArrow(lean(find), "anchor long, doc_id long, th long, s int, n int")


CUT = "anchor long, row long, seg string, cnt int, at array<struct<doc_id:long,th:long,s:int>>"
_AT = pa.list_(pa.struct([("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32())]))


def _cut(hit: DataFrame, window: int) -> DataFrame:
    """The words of the segments; hot anchors replaced. hit: doc_id, th, text, segs (anchor, s, n, hot). A row for each distinct segment of a batch, with its places."""
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in it:
            for at, end, w in _chunks(b.column(2)):
                segs = b.column(3).slice(at, end - at)
                owner = np.repeat(np.arange(end - at), np.diff(segs.offsets.to_numpy()))
                flat = segs.flatten()
                key, s, n, is_hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                first = w.first[owner] + s
                if is_hot.any():
                    mark = np.zeros(len(w.hash) + 1, np.int64)  # windows of hot segments
                    np.add.at(mark, first[is_hot], 1)
                    np.add.at(mark, first[is_hot] + n[is_hot], -1)
                    key2, first2, n2 = w.anchors(window, window, np.cumsum(mark)[:-1] > 0)
                    key, first, n = np.concatenate([key[~is_hot], key2]), np.concatenate([first[~is_hot], first2]), np.concatenate([n[~is_hot], n2])
                doc = w.doc[first] if len(first) else first
                raw = [t.encode().split() for t in b.column(2).slice(at, end - at).to_pylist()]
                ids, hashes = b.column(0).slice(at, end - at).to_pylist(), b.column(1).slice(at, end - at).to_pylist()
                found: dict[tuple[int, bytes], list] = {}
                for k, d, a, m in zip(key.tolist(), doc.tolist(), (first - w.first[doc]).tolist(), n.tolist()):
                    found.setdefault((k, b" ".join(raw[d][a : a + m + window - 1])), []).append((ids[d], hashes[d], a))
                items = list(found.items())
                for i in range(0, len(items), 5000):
                    part = items[i : i + 5000]
                    yield pa.record_batch(
                        [
                            pa.array([k for (k, _), _ in part], pa.int64()),
                            pa.array(np.arange(row, row + len(part))),
                            pa.array([x.decode() for (_, x), _ in part], pa.string()),
                            pa.array([len(p) for _, p in part], pa.int32()),
                            pa.array([[{"doc_id": x, "th": y, "s": z} for x, y, z in p] for _, p in part], _AT),
                        ],
                        names=["anchor", "row", "seg", "cnt", "at"],
                    )
                    row += len(part)

    return hit.select("doc_id", "th", "text", "segs").mapInArrow(lean(cut), CUT)


def search_shard(segments: list[str], counts: list[int], window: int) -> list[list[int]]:
    """For each distinct segment the stretches, as from, to, from, to, ..., that occur twice or more among all (counts: how often each is there)."""
    names: dict[str, int] = {}
    symbols, start, length = [], [], []
    at = 0
    for s, c in zip(segments, counts):
        ids = [names.setdefault(x, len(names) + 1) for x in s.split(" ")]
        start.append(at)
        length.append(len(ids))
        for _ in range(min(2, c)):
            symbols += ids
            symbols.append(0)
            at += len(ids) + 1
    text, length = np.array(symbols, np.int64), np.array(length)
    index = FMIndex(text, len(names) + 1, int(length.max()) + 1)
    out: list[list[int]] = [[] for _ in segments]
    for k, a, b in zip(*(x.tolist() for x in repeated_stretches(index, text, np.array(start), length, window))):
        out[k] += [a, b]
    return out


def _search(cuts: DataFrame, window: int, shard: int) -> DataFrame:
    """row and spans of the segments that have repeated stretches."""
    n = int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cuts.select("anchor", "row", "seg", "cnt").repartition(n, "anchor").sortWithinPartitions("anchor")

    def answer(held: dict) -> Iterator[pa.RecordBatch]:
        counts = [c for c, _ in held.values()]
        if counts == [1]:
            return
        spans = search_shard([s for _, s in held], counts, window)
        hit = [(row, x) for (_, theirs), x in zip(held.values(), spans) if x for row in theirs]
        if hit:
            yield pa.record_batch([pa.array([h[0] for h in hit], pa.int64()), pa.array([h[1] for h in hit], pa.list_(pa.int32()))], names=["row", "spans"])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], tuple[int, list[int]]] = {}  # how often a segment is there, and in which rows
        size, last = 0, None
        for b in it:
            for a, row, s, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                if a != last and size >= shard:
                    yield from answer(held)
                    held, size = {}, 0
                last = a
                if (a, s) not in held:
                    size += s.count(" ") + 2
                before, theirs = held.get((a, s), (0, []))
                theirs.append(row)
                held[a, s] = (before + c, theirs)
        if held:
            yield from answer(held)

    return rows.mapInArrow(lean(search), "row long, spans array<int>")


def _of(small: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """docs joined to small by document, by a shuffle at every size."""
    on = docs["doc_id"].eqNullSafe(small["s_doc"]) & (docs["th"] == small["s_th"])
    return docs.join(small, on, how).drop("s_doc", "s_th")


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """s_doc, s_th (the document) and spans: its words' stretches of repeated windows, as from, to, from, to, ..."""
    table = stored(anchor_table(docs, window, gram), "anchors")
    counts = table.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.col("n") + (window - 1)).alias("words"))
    # stored, so that the join below is one of two shuffles, whose hot parts Spark can split
    many = stored(counts.where("k > 1").select("anchor", (F.col("words") > hot).alias("hot")), "repeated-anchors")
    theirs = table.join(many, "anchor").groupBy(F.col("doc_id").alias("s_doc"), F.col("th").alias("s_th")).agg(F.collect_set(F.struct("anchor", "s", "n", "hot")).alias("segs"))
    theirs = stored(theirs, "repeated-segments")
    forget(table, many)
    cuts = stored(_cut(_of(theirs, _known(docs), "inner"), window), "segments")
    forget(theirs)
    found = stored(_search(cuts, window, shard), "stretches")
    placed = cuts.select("row", "at").join(found, "row").select(F.explode("at").alias("p"), "spans")
    moved = placed.select(F.col("p.doc_id").alias("s_doc"), F.col("p.th").alias("s_th"), F.transform("spans", lambda x: x + F.col("p.s")).alias("spans"))
    spans = stored(moved.groupBy("s_doc", "s_th").agg(F.flatten(F.collect_set("spans")).alias("spans")), "repeated-words")
    forget(cuts, found)
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces)."""
    joined = _of(repeated(docs, window, gram, shard, hot), _known(docs), "left").select("doc_id", "text", "spans")

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n_words, n_removed, kept = [], [], []
            for t, x in zip(b.column(1), b.column(2)):
                w = t.as_py().encode().split()
                gone = 0
                if x.is_valid:
                    stays = np.ones(len(w), bool)
                    s = x.values.to_numpy()
                    for p, q in zip(s[::2], s[1::2]):
                        stays[p:q] = False
                    gone = len(w) - int(stays.sum())
                    kept.append(b" ".join([w[i] for i in np.flatnonzero(stays)]))
                else:
                    kept.append(b" ".join(w))
                n_words.append(len(w))
                n_removed.append(gone)
            yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(lean(keep), "doc_id long, n_words long, n_removed long, kept string")


def sql(window: int = WINDOW) -> str:
    """The same for DuckDB: every window of every document, compared as text."""
    return f"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, p, array_to_string(w[p:p + {window - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {window - 2})) as p from d where len(w) >= {window})),
rep as (select doc_id, p from (select doc_id, p, count(*) over (partition by g) as c from win) where c > 1),
gone as (select doc_id, list(distinct x) as x from (select doc_id, unnest(range(p, p + {window})) as x from rep) group by doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
cov as (select distinct doc_id, unnest(x) as p from gone),
kept as (select doc_id, string_agg(word, ' ' order by p) as k, count(*) as n from words anti join cov using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (doc_id)"""
