"""Near copies: SimHash first, then every other pair that reaches a Jaccard similarity of word shingles.

A text's shingles are its distinct runs of five words, lower-cased and cut at ASCII white space (a text of fewer words is
one shingle of all of them), as 64-bit hashes. Two texts link at a Jaccard similarity of ``percent`` or more; documents
linked through any chain form one component.

SimHash (``simhash.links``: bit-sliced comparison, radius 2) names the pairs of nearly equal texts. At a similarity of 0.8
fingerprints of 64 bits differ in some ten, beyond any radius that buckets can promise, so an exact search adds the rest.
Prefix filter: with the shingles of all texts in one order, texts of a and b shingles that link share one of the first
a - ceil(t a) + 1 and b - ceil(t b) + 1, and the first that they share leaves enough behind it in both. So texts that
share none of these never meet, and no link is lost. The order puts shingles that are common in a sample of the texts
last; the sample decides what is compared, not what links.

What shares a shingle is compared in steps: with two members of its bucket first; then with the member of another component
whose parities (below) differ least, a few times over, so that a large group of near copies becomes a few components without
its pairs; then with all members that are in other components yet, unless the two met at one of the shingles just before. Every link is
verified over the whole sets; pairs whose parities prove them apart are left out before. Texts with equal shingles never
meet: they are one node, joined at the end.

Texts without words have the same (empty) shingles; null texts count as such. Null doc_ids get the id of their component;
rows that repeat are rows of one component; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm import simhash
from vecspark.llm.common import NEAR, SHINGLE, lean, texts
from vecspark.llm import simhash
from vecspark.llm.simhash import components, fingerprints_of, shingle_hashes
from vecspark.runtime import forget, stored

#: Texts whose shingles are counted for the order, how many of them make a shingle common, and the most that are kept.
SAMPLE, COMMON, MOST = 20_000, 3, 200_000
#: Turns of nearest members at most before all members meet, and how many of its shingles before this one a node brings to a bucket.
TURNS, EARLIER = 3, 4


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def _digest(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes())).view(np.int64))


def prefix(s: np.ndarray, common: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which texts that link share one. common ascends; a common shingle comes after the others, by its count."""
    n = len(s)
    if not n:
        return s
    at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
    seen = np.where(common[at] == s, count[at], 0) if len(common) else np.zeros(n, np.int64)
    return s[np.lexsort((s, seen))[: n + (-n * percent // 100) + 1]]


def parities(s: np.ndarray) -> np.ndarray:
    """512 bits as longs: bit k is the parity of the shingles that fall on it, so two sets differ in as many shingles as bits at least."""
    odd = (np.bincount((s >> np.uint64(20)).astype(np.int64) & 511, minlength=512) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _hashed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")


def _common(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many texts of a sample have, ascending, and their counts."""

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t in b.column(0):
                yield pa.record_batch([pa.array(shingle_set(t.as_py()).view(np.int64))], names=["s"])

    every = max(1, hashed.count() // SAMPLE)
    some = hashed.where(F.pmod("th", F.lit(every)) == 0).dropDuplicates(["th"]).select("text")
    rows = some.mapInArrow(lean(sets), "s long").groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST).collect()
    s, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def _prefixes(hashed: DataFrame, percent: int) -> DataFrame:
    """doc_id, th, node (the shingles' digest), n (how many), fp (their SimHash), prefix and bits (parities)."""
    sent = hashed.sparkSession.sparkContext.broadcast(_common(hashed))

    def batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = sent.value
        for b in it:
            node, n, fp, first, bits = [], [], [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py())
                node.append(_digest(s))
                n.append(len(s))
                fp.append(fingerprints_of([s])[0])
                first.append(prefix(s, common, count, percent).view(np.int64))
                bits.append(parities(s))
            if node:
                yield pa.record_batch([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "th", "node", "n", "fp", "prefix", "bits"])

    return hashed.mapInArrow(lean(batch), "doc_id long, th long, node long, n int, fp long, prefix array<long>, bits array<long>")


def _enough(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can link if the first shared one is at places i and j of their orders."""
    return F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent


def _apart(bits: Column, other: Column, n: Column, m: Column, percent: int) -> Column:
    differ = F.aggregate(F.zip_with(bits, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return differ * (100 + percent) > (n + m) * (100 - percent)


def _once(rows: DataFrame, key: str) -> DataFrame:
    """One row for each value of key: only rows whose value repeats are dealt anew."""
    again = stored(rows.groupBy(key).count().where("count > 1").select(key), "repeated")
    return rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates([key]))


def _verified(pairs: DataFrame, nodes: DataFrame, hashed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the similarity. Texts travel, not their shingles: they are smaller."""

    def batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = shingle_set(x.as_py()), shingle_set(y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both * 100 >= (len(s) + len(t) - both) * percent)
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = stored(nodes.select("node", "th").join(needed, "node"), "needed")
    some = _once(hashed.join(needed.select("th"), "th", "left_semi").select("th", "text"), "th").join(needed, "th").select("node", "text")
    met = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return stored(met.select("a", "b", "ta", "tb").mapInArrow(lean(batch), "a long, b long"), "similar")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or in one star of simhash.links: each with the least node of its fingerprint or the two least nodes."""
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("c")), "least-of-fingerprint")
    same = nodes.select("fp", "node").join(least, "fp").where("node <> c").select("node", "c")
    near = simhash.links(least.select("fp"))
    one, two = least.select(F.col("fp").alias("a"), F.col("c").alias("node")), least.select(F.col("fp").alias("b"), "c")
    pairs = same.unionByName(near.join(one, "a").join(two, "b").select("node", "c"))
    return pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _not_apart(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """pairs without those that the parities prove apart."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    return met.where(~_apart(F.col("bitsa"), F.col("bitsb"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def links(hashed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the nodes (node, n, fp, prefix, bits, th) that reach the similarity through any chain."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = stored(_not_apart(_simhash_pairs(nodes), nodes, percent), "simhash-pairs")
    copies = _verified(first, nodes, hashed, percent)
    before = components(copies)
    keyed = nodes.select("node", "n", F.posexplode("prefix").alias("i", "key")).select("key", "node", "n", "i").repartition(n, "key").sortWithinPartitions("key")

    def shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(it):
            same = rows[1:, 0] == rows[:-1, 0]
            rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            if len(rows):
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["key", "node", "n", "i"])

    every = stored(keyed.mapInArrow(lean(shared), "key long, node long, n long, i long"), "shared-shingles")
    met = _labelled(every, before)
    forget(every)
    theirs = nodes.select("node", *(F.col("bits")[k].alias(f"b{k}") for k in range(8)), "prefix")
    earlier = [F.coalesce(F.get("prefix", F.col("i") - 1 - k), F.lit(0)).alias(f"p{k}") for k in range(EARLIER)]

    def members(nearest: bool) -> DataFrame:
        """Pairs (a, b) of each bucket's nodes in different components, not tested yet: all, or for each node the one whose parities differ least."""
        labelled = met.join(theirs, "node").select("key", "node", "n", "i", "root", *(f"b{k}" for k in range(8)), *earlier)
        pairs = labelled.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(_across(percent, nearest)), "a long, b long").distinct()
        return stored(pairs.join(tested, ["a", "b"], "left_anti"), "other-pairs")

    found, tested = copies, first
    for turn in range(TURNS + 1):
        pairs = members(True) if turn else stored(_not_apart(_stars(met, percent), nodes, percent).join(tested, ["a", "b"], "left_anti"), "star-pairs")
        similar = _verified(pairs, nodes, hashed, percent)
        found, tested = stored(found.unionByName(similar), "found-links"), tested.unionByName(pairs)
        before = met
        met = _open(_labelled(before.drop("root"), components(found)))
        forget(before)
        if turn and 4 * similar.count() <= pairs.count():
            break
    rest = members(False)
    forget(met)
    return found.unionByName(_verified(rest, nodes, hashed, percent))


def _across(percent: int, nearest: bool):
    """Pairs of nodes of a bucket that may link and are in different components."""

    def across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(it):
            start = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            for x, y in zip(start, [*start[1:], len(rows)]):
                node, size, place, root, bits = rows[x:y, 1], rows[x:y, 2], rows[x:y, 3], rows[x:y, 4], np.ascontiguousarray(rows[x:y, 5:13]).view(np.uint64)
                earlier, real = rows[x:y, 13:], place[:, None] > np.arange(EARLIER)
                left = size - place
                best, least = np.full(y - x, -1), np.full(y - x, 1 << 30)
                for i in range(len(node) - 1):
                    rest = np.minimum(left[i], left[i + 1 :])
                    at = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (rest * (100 + percent) >= (size[i + 1 :] + size[i]) * percent))
                    differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    near = differ * (100 + percent) <= (size[at] + size[i]) * (100 - percent)
                    at, differ = at[near], differ[near]
                    if nearest:
                        if len(at):
                            less = differ < least[at]
                            best[at[less]], least[at[less]] = i, differ[less]
                            k = differ.argmin()
                            if differ[k] < least[i]:
                                best[i], least[i] = at[k], differ[k]
                        continue
                    met_before = (earlier[at][:, :, None] == earlier[i][real[i]]) & real[at][:, :, None]
                    other = node[at[~met_before.any(axis=(1, 2))]]
                    if len(other):
                        yield pa.record_batch([pa.array(np.minimum(node[i], other)), pa.array(np.maximum(node[i], other))], names=["a", "b"])
                own = np.flatnonzero(best >= 0)
                if len(own):
                    other = node[best[own]]
                    yield pa.record_batch([pa.array(np.minimum(node[own], other)), pa.array(np.maximum(node[own], other))], names=["a", "b"])

    return across


def _stars(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each bucket's nodes with two of its members, least in two orders of all nodes, that are in another component."""
    member = F.struct(F.col("node").alias("c"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("r"))
    least = met.groupBy("key").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), member.alias("x"))).alias(f"c{k}") for k in (0, 1)))
    stars = met.join(least, "key").select("node", "n", "i", "root", F.explode(F.array("c0.x", "c1.x")).alias("x")).select("node", "n", "i", "root", "x.*")
    stars = stars.where((F.col("root") != F.col("r")) & _enough(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent))
    return stars.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _open(labels: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes are in several components yet, stored; labels go."""
    keys = labels.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    out = stored(labels.join(keys, "key", "left_semi"), "open-buckets")
    forget(labels)
    return out


def _labelled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """met with the root of each node's component."""
    named = met.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    return stored(named.select("key", "node", "n", "i", F.coalesce("root", "node").alias("root")), "labelled")


def _buckets(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of longs in pieces that don't cut a run of equal first columns."""
    rest = None
    for b in it:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        rows = rows if rest is None else np.concatenate([rest, rows])
        cut = np.flatnonzero(rows[:, 0] != rows[-1, 0])
        cut = int(cut[-1]) + 1 if len(cut) else 0
        rest = rows[cut:]
        if cut:
            yield rows[:cut]
    if rest is not None:
        yield rest


def _rooted(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, th, node), (nodes that link: a, and the root they reach: b), (least: node and the least doc_id, th of its rows; null ids come last)."""
    percent = round(threshold * 100)
    hashed = _hashed(docs)
    rows = stored(_prefixes(hashed, percent), "shingle-prefixes")
    nodes = stored(_once(rows.select("node", "n", "fp", "prefix", "bits", "th"), "node"), "nodes")
    roots = components(links(hashed, nodes, percent))
    least = rows.groupBy("node").agg(F.min(_order()).alias("least"))
    named = least.join(roots, least["node"] == roots["a"], "left").select("node", "least", F.coalesce("b", "node").alias("root"))
    return rows.select("doc_id", "th", "node"), roots, stored(named, "named-nodes")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))


def near_duplicates(docs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """doc_id and component_id (the least doc_id of the component)."""
    rows, roots, named = _rooted(docs, threshold)
    linked = named.join(roots.select(F.col("b").alias("root")).distinct(), "root", "left_semi")
    first = linked.groupBy("root").agg(F.min("least").alias("first"))
    of = named.join(first, "root", "left").select("node", F.coalesce("first", "least")["doc_id"].alias("component_id"))
    return rows.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")


def verdicts(docs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """A row for each distinct row of a component: doc_id, th (xxhash64 of the text, null as empty), copies (how many rows are the same) and stays. One of each component stays, the one whose (doc_id, th) is least, null ids last."""
    rows, _, named = _rooted(docs, threshold)
    first = named.groupBy("root").agg(F.min("least").alias("f")).select("f.doc_id", "f.th", F.lit(True).alias("stays"))
    each = rows.groupBy("doc_id", "th").agg(F.count("*").alias("copies"))
    on = each["doc_id"].eqNullSafe(first["doc_id"]) & (each["th"] == first["th"])
    return each.join(first, on, "left").select(each["doc_id"], each["th"], "copies", F.coalesce("stays", F.lit(False)).alias("stays"))
