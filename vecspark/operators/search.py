"""Approximate search over partitioned proximity graphs.

Candidates are ranked by code distances (vecspark.operators.pq), answers by exact ones. Order is by (distance, id)
everywhere. A search holds a pool of the ``size`` best candidates; each step expands the ``beam`` best that aren't yet,
and it ends when all of the pool are. With size at least the number of nodes everything reachable is expanded. Such a pool
drops nothing, so it is kept as marks in the order of all code distances instead of being sorted at every step
(expanded_all): the same nodes are expanded in the same steps.

The node table carries, next to each node's links, the codes and homes of the nodes they lead to, so a partition can
rank foreign candidates without a copy of all codes. For searches that move between partitions it is laid out once as
files, a partition's columns side by side, ascending by id: workers map them and read the nodes that a search touches, so
between rounds only states move."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.functions.distance import matrix, to_rows
from vecspark.operators import knn
from vecspark.operators.graph import greedy_many
from vecspark.operators.pq import Codebook, adc
from vecspark.runtime import settings, shared_dir, stored

NODES = "partition_id int, id long, vec array<double>, codes array<smallint>, nbrs array<long>, nbr_codes array<smallint>, nbr_homes array<int>"
RESULT = "qid long, id long, dist double, hops long, ios long, cmps long, inter_hops long, history array<int>"


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    size: int = 64
    beam: int = 4
    seeds: int = 10
    #: Where ids are stored that answers leave out; for pools that have room for all nodes.
    gone: str | None = None


def node_table(vectors: DataFrame, graph: DataFrame, codes: DataFrame, homes: DataFrame) -> DataFrame:
    """The nodes of an index: vectors (id, vec), graph (id, nbrs), codes (id, codes) and homes (id, partition_id) joined, with codes and homes of the neighbours beside the links."""
    h = homes.select("id", F.col("partition_id").cast("int").alias("partition_id"))
    known = codes.select("id", "codes").join(h, "id")
    edges = graph.select("id", F.posexplode("nbrs").alias("p", "n"))
    far = known.select(F.col("id").alias("n"), F.col("codes").alias("c"), F.col("partition_id").alias("h"))
    lists = edges.join(far, "n").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("p", "n", "c", "h"))).alias("e"))
    nodes = known.join(vectors.select("id", F.col("vec").cast("array<double>").alias("vec")), "id").join(lists, "id", "left")
    e = F.coalesce("e", F.array().cast("array<struct<p:int,n:bigint,c:array<smallint>,h:int>>"))
    return nodes.select("partition_id", "id", "vec", "codes", F.transform(e, lambda s: s["n"]).alias("nbrs"), F.flatten(F.transform(e, lambda s: s["c"])).alias("nbr_codes"), F.transform(e, lambda s: s["h"]).alias("nbr_homes"))


# --- the kernel ----------------------------------------------------------------------------------------------------


@dataclass
class State:
    """One query's search: the pool (ascending by distance and id), exact answers and what it cost."""

    q: np.ndarray
    ids: np.ndarray
    dist: np.ndarray
    done: np.ndarray
    homes: np.ndarray
    exact_id: list[int] = field(default_factory=list)
    exact_d: list[float] = field(default_factory=list)
    hops: int = 0
    ios: int = 0
    cmps: int = 0
    history: list[int] = field(default_factory=list)

    @classmethod
    def start(cls, q: np.ndarray, ids: np.ndarray, dist: np.ndarray, homes: np.ndarray, size: int) -> State:
        ids, at = np.unique(ids, return_index=True)
        s = cls(q, ids, dist[at], np.zeros(len(ids), bool), homes[at])
        s._sort(size)
        return s

    def _sort(self, size: int) -> None:
        o = np.lexsort((self.ids, self.dist))[:size]
        self.ids, self.dist, self.done, self.homes = self.ids[o], self.dist[o], self.done[o], self.homes[o]

    def frontier(self, beam: int, home: int | None) -> tuple[np.ndarray, int | None]:
        """Places of the next candidates to expand here, and the home of the first that lies elsewhere if there are none."""
        ahead = np.flatnonzero(~self.done)[:beam]
        if home is None:
            return ahead, None
        here = ahead[self.homes[ahead] == home]
        return here, int(self.homes[ahead[0]]) if len(ahead) and not len(here) else None

    def add(self, ids: np.ndarray, dist: np.ndarray, homes: np.ndarray, size: int) -> None:
        """Merge candidates that aren't in the pool; those no better than the last of a full pool are dropped."""
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        held = np.sort(self.ids)
        new = held[np.minimum(np.searchsorted(held, ids), len(held) - 1)] != ids
        new[1:] &= ids[1:] != ids[:-1]
        ids, order = ids[new], order[new]
        dist, homes = dist[order], homes[order]
        self.cmps += len(ids)
        if len(self.ids) >= size:
            near = dist < self.dist[-1]
            ids, dist, homes = ids[near], dist[near], homes[near]
        if len(ids):
            self.ids, self.dist = np.concatenate([self.ids, ids]), np.concatenate([self.dist, dist])
            self.done, self.homes = np.concatenate([self.done, np.zeros(len(ids), bool)]), np.concatenate([self.homes, homes])
            self._sort(size)

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, at = np.unique(np.array(self.exact_id, np.int64), return_index=True)
        d = np.array(self.exact_d)[at] if len(ids) else np.zeros(0)
        o = np.lexsort((ids, d))[:k]
        return ids[o], d[o]


@dataclass
class Seeds:
    """Where searches start: some nodes with their codes and homes. With vectors and links (a head, places among them) each query starts at the nodes nearest to it, else at all of them."""

    ids: np.ndarray
    codes: np.ndarray
    homes: np.ndarray
    x: np.ndarray | None = None
    links: np.ndarray | None = None
    entry: int = 0

    def of(self, q: np.ndarray, n: int) -> np.ndarray:
        """(queries, seeds): places."""
        if self.x is None or not len(q):
            return np.broadcast_to(np.arange(len(self.ids)), (len(q), len(self.ids)))
        n = min(n, len(self.ids))
        found, d = greedy_many(self.x, self.links, q, self.entry, max(2 * n, 16))
        order = np.lexsort((found, d), axis=1)[:, :n]
        best = np.take_along_axis(found, order, 1)
        return np.where(best >= 0, best, best[:, :1])  # a head that is hardly connected may show fewer


def code_distances(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """adc in steps that stay in the cache."""
    return np.concatenate([adc(table, codes[at : at + 4096]) for at in range(0, len(codes), 4096)]) if len(codes) else np.zeros(0)


def expanded_all(dist: np.ndarray, links: np.ndarray, seeds: np.ndarray, beam: int, homes: np.ndarray | None = None, home: int | None = None) -> tuple[np.ndarray, int, int, list[int]]:
    """A search whose pool has room for all nodes, from seeds (places; they ascend by id): (whether each node is expanded, hops, comparisons, homes one after the other). dist: code distances; links: places, -1 where there are fewer. With homes a step expands those of the beam that are at home, and the search moves on to the first's home if none is."""
    n, seeds = len(dist), np.unique(seeds)
    order = np.argsort(dist, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    seen, ahead_of = np.zeros(n + 1, bool), np.zeros(n, bool)  # seen: the last is for links that aren't there; ahead_of: by rank
    seen[-1], seen[seeds], ahead_of[rank[seeds]] = True, True, True
    low, hops, wide, history = int(rank[seeds].min()), 0, 4 * beam, [] if home is None else [home]
    while True:
        at = np.flatnonzero(ahead_of[low : low + wide])[:beam]
        while len(at) < beam and low + wide < n:
            wide *= 2
            at = np.flatnonzero(ahead_of[low : low + wide])[:beam]
        if not len(at):
            return seen[:-1], hops, int(seen[:-1].sum()) - len(seeds), history
        if len(at) == beam and at[-1] * 4 < wide:
            wide = max(4 * beam, wide // 2)
        at += low
        low, node = int(at[0]), order[at]
        if homes is not None:
            here = homes[node] == home
            if not here.any():
                home = int(homes[node[0]])
                history.append(home)
                continue
            at, node = at[here], node[here]
        hops += 1
        ahead_of[at] = False
        far = links[node].ravel()
        far = far[~seen[far]]
        if len(far):
            seen[far] = True
            far = rank[far]
            ahead_of[far] = True
            low = min(low, int(far.min()))


def best_of(q: np.ndarray, rows: list[tuple[np.ndarray | slice, np.ndarray]], held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact distances) of the k nearest of the held places. rows: places and their vectors, in parts."""
    d = np.empty(len(held))
    for places, x in rows:
        d[places] = np.concatenate([to_rows("l2", q, x[at : at + 4096]) for at in range(0, len(x), 4096)]) if len(x) else 0
    some = np.flatnonzero(held)
    if len(some) > k:
        last = np.partition(d[some], k - 1)[k - 1]
        some = some[d[some] <= last]
    some = some[np.lexsort((some, d[some]))[:k]]
    return some, d[some]


def reached(links: np.ndarray, seed: int) -> np.ndarray:
    """Whether links lead to each node from seed."""
    seen, front = np.zeros(len(links) + 1, bool), np.array([seed])
    seen[-1], seen[seed] = True, True
    while len(front):
        far = links[front].ravel()
        front = np.unique(far[~seen[far]])
        seen[front] = True
    return seen[:-1]


#: Ids that answers leave out, by the table that they are read from.
_GONE: dict[str, np.ndarray] = {}


def gone_ids(stored_at: str | None) -> np.ndarray:
    """The ids (column id) of a stored table, ascending. A search that holds all nodes has room for them."""
    import pyarrow.parquet as pq

    if stored_at is None:
        return np.zeros(0, np.int64)
    if stored_at not in _GONE:
        _GONE.clear()
        place, plain = fs.FileSystem.from_uri(stored_at)
        _GONE[stored_at] = np.sort(pq.read_table(plain, columns=["id"], filesystem=place)["id"].to_numpy())
    return _GONE[stored_at]


def _left(ids: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Whether each of ids isn't gone."""
    return gone[np.minimum(np.searchsorted(gone, ids), len(gone) - 1)] != ids if len(gone) else np.ones(len(ids), bool)


class Part:
    """The nodes that a worker has, ascending by id: a partition, or all."""

    def __init__(self, home: int | None, ids, x, codes, offsets, nbrs, nbr_codes, nbr_homes):
        self.home, self.ids, self.x, self.codes = home, ids, x, codes
        self.offsets, self.nbrs, self.nbr_codes, self.nbr_homes = offsets, nbrs, nbr_codes, nbr_homes

    @classmethod
    def of(cls, t: pa.Table, home: int | None = None) -> Part:
        t = t.sort_by("id").combine_chunks()
        codes, links = matrix(t["codes"], np.int16), t["nbrs"].combine_chunks()
        values = lambda k, kind: t[k].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        sizes = links.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(home, t["id"].to_numpy(), matrix(t["vec"]), codes, np.concatenate([[0], np.cumsum(sizes)]), values("nbrs", np.int64), values("nbr_codes", np.int16).reshape(-1, codes.shape[1] or 1), values("nbr_homes", np.int32))

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def run(self, s: State, table: np.ndarray, p: SearchParams) -> int | None:
        """Search on until nothing is left to expand (None) or everything ahead lies elsewhere (where)."""
        if self.home is not None:
            s.history.append(self.home)
        while True:
            here, away = s.frontier(p.beam, self.home)
            if not len(here):
                return away
            s.hops += 1
            s.done[here] = True
            rows = self.rows(s.ids[here])
            s.ios += len(rows)
            s.exact_id += self.ids[rows].tolist()
            s.exact_d += to_rows("l2", s.q, self.x[rows]).tolist()
            span = slice(self.offsets[rows[0]], self.offsets[rows[0] + 1]) if len(rows) == 1 else np.concatenate([np.arange(self.offsets[r], self.offsets[r + 1]) for r in rows])
            if len(self.nbrs[span]):
                s.add(self.nbrs[span], adc(table, self.nbr_codes[span]), self.nbr_homes[span], p.size)


    def links(self) -> np.ndarray:
        """(nodes, largest degree): the places of each node's neighbours here, -1 where there are fewer."""
        if not hasattr(self, "_links"):
            at = np.minimum(self.rows(self.nbrs), max(0, len(self.ids) - 1))
            place = np.where(self.ids[at] == self.nbrs, at, -1) if len(self.nbrs) else self.nbrs
            degree = np.diff(self.offsets)
            self._links = np.full((len(self.ids), max(1, int(degree.max(initial=0)))), -1)
            row = np.repeat(np.arange(len(degree)), degree)
            self._links[row, np.arange(len(row)) - (self.offsets[:-1] - self.offsets[0])[row]] = place[: len(row)]
        return self._links

    def run_many(self, q: np.ndarray, tables: np.ndarray, seeds: np.ndarray, p: SearchParams) -> list[tuple]:
        """Search for several queries at once, all in step, each from its own seeds (queries, places); links that lead elsewhere aren't followed. For each query ids, distances, hops, I/Os and comparisons."""
        n, many, links, chunk = len(self.ids), len(q), self.links(), np.arange(tables.shape[1])
        place, dist, done = np.zeros((many, p.size), np.int64), np.full((many, p.size), np.inf), np.ones((many, p.size), bool)
        seen = np.zeros((many, n), bool)
        hops, ios, cmps = (np.zeros(many, np.int64) for _ in range(3))
        exact: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merge(rows: np.ndarray, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
            """Candidates c of rows r (ascending) into the pools of these rows."""
            count = np.bincount(r, minlength=many)
            begin = np.concatenate([[0], np.cumsum(count)[:-1]])
            width = int(count.max())
            back = np.zeros(many, np.int64)
            back[rows] = np.arange(len(rows))
            more_c, more_d = np.zeros((len(rows), width), np.int64), np.full((len(rows), width), np.inf)
            at = np.arange(len(r)) - begin[r]
            more_c[back[r], at], more_d[back[r], at] = c, d
            all_c, all_d = np.concatenate([place[rows], more_c], axis=1), np.concatenate([dist[rows], more_d], axis=1)
            all_done = np.concatenate([done[rows], np.isinf(more_d)], axis=1)
            order = np.lexsort((self.ids[all_c], all_d), axis=1)[:, : p.size]
            place[rows], dist[rows], done[rows] = (np.take_along_axis(x, order, 1) for x in (all_c, all_d, all_done))

        rows = np.arange(many)
        r, c = np.divmod(np.unique(np.repeat(rows, seeds.shape[1]) * n + seeds.ravel()), n)
        seen[r, c] = True
        merge(rows, r, c, tables[r[:, None], chunk, self.codes[c]].sum(axis=1))
        while len(rows):
            ahead = ~done[rows]
            ahead &= np.cumsum(ahead, axis=1) <= p.beam
            rows, ahead = rows[ahead.any(axis=1)], ahead[ahead.any(axis=1)]
            if not len(rows):
                break
            r, k = np.nonzero(ahead)
            r = rows[r]
            node = place[r, k]
            done[r, k] = True
            hops[rows] += 1
            ios += np.bincount(r, minlength=many)
            exact.append((r, node, to_rows("l2", q[r], self.x[node])))
            far = links[node]
            ok = far >= 0
            r, c = np.repeat(r, far.shape[1])[ok.ravel()], far[ok]
            new = ~seen[r, c]
            r, c = np.divmod(np.unique(r[new] * n + c[new]), n)
            if not len(r):
                continue
            seen[r, c] = True
            cmps += np.bincount(r, minlength=many)
            d = tables[r[:, None], chunk, self.codes[c]].sum(axis=1)
            near = d < dist[r, -1]
            if near.any():
                merge(np.unique(r[near]), r[near], c[near], d[near])
        r, node, d = (np.concatenate(x) for x in zip(*exact)) if exact else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((self.ids[node], d, r))
        r, node, d = r[order], node[order], d[order]
        cut = np.searchsorted(r, np.arange(many + 1))
        return [(self.ids[node[a : min(b, a + p.k)]], d[a : min(b, a + p.k)], int(hops[i]), int(ios[i]), int(cmps[i])) for i, (a, b) in enumerate(zip(cut, cut[1:]))]


#: Queries that search in step; with the bytes of their marks bounded.
STEP_QUERIES, STEP_BYTES = 256, 256 << 20


def _many(part: Part, qids: list, q: np.ndarray, book: Codebook, seeds: np.ndarray, p: SearchParams, history: list[int]) -> list[tuple]:
    step, rows = max(1, min(STEP_QUERIES, STEP_BYTES // max(1, len(part.ids)))), []
    if p.size >= len(part.ids):
        left = _left(part.ids, gone_ids(p.gone))
        for i, qid in enumerate(qids):
            table = book.table(q[i : i + 1])[0]
            seen, hops, cmps, _ = expanded_all(code_distances(table, part.codes), part.links(), seeds[i], p.beam)
            best, d = best_of(q[i], [(slice(None), part.x)], seen & left, p.k)
            rows += [(qid, int(j), float(x), hops, int(seen.sum()), cmps, 0, history) for j, x in zip(part.ids[best], d)]
        return rows
    for at in range(0, len(qids), step):
        some = q[at : at + step]
        for qid, (ids, d, hops, ios, cmps) in zip(qids[at : at + step], part.run_many(some, book.table(some), seeds[at : at + step], p)):
            rows += [(qid, int(i), float(x), hops, ios, cmps, 0, history) for i, x in zip(ids, d)]
    return rows


def _exactly(part: Part, qids: list, q: np.ndarray, seeds: np.ndarray, p: SearchParams) -> list[tuple]:
    """The same with exact distances throughout; every node that is seen is a comparison."""
    step, rows = max(1, min(STEP_QUERIES, STEP_BYTES // max(1, len(part.ids)))), []
    if p.size >= len(part.ids):
        left, links = _left(part.ids, gone_ids(p.gone)), part.links()
        for at in range(0, len(qids), step):
            seen = reached(links, int(seeds[at, 0]))
            some, n, top = np.flatnonzero(seen & left), int(seen.sum()), knn.Nearest(q[at : at + step], p.k)
            for x in range(0, len(some), knn.STEP_ROWS):
                top.add(part.ids[some[x : x + knn.STEP_ROWS]], part.x[some[x : x + knn.STEP_ROWS]])
            for qid, ids, d in zip(qids[at : at + step], top.ids, top.dist):
                rows += [(qid, int(i), float(x), n, n, n, 0, []) for i, x in zip(ids, d) if np.isfinite(x)]
        return rows
    for at in range(0, len(qids), step):
        found, d = greedy_many(part.x, part.links(), q[at : at + step], int(seeds[at, 0]), p.size)
        order = np.lexsort((part.ids[np.maximum(found, 0)], d), axis=1)[:, : p.k]
        n = (found >= 0).sum(axis=1)
        for i, o in enumerate(order):
            rows += [(qids[at + i], int(part.ids[found[i, j]]), float(d[i, j]), int(n[i]), int(n[i]), int(n[i]), 0, []) for j in o if found[i, j] >= 0]
    return rows


def _answer(rows: list[tuple], schema_names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema_names)


_NAMES = [x.split()[0] for x in RESULT.split(", ")]


# --- modes ---------------------------------------------------------------------------------------------------------


#: Whole indexes that a worker has made of what was sent, by broadcast.
_WHOLE: dict[int, tuple[Part, np.ndarray]] = {}


def whole(nodes: DataFrame, book: Codebook, seeds: Seeds, most_bytes: int = 512 << 20):
    """What every task of single() needs, sent after a look at its size; an index sends it once."""
    spark = nodes.sparkSession
    n, dim, degree = nodes.agg(F.count("*"), F.max(F.size("vec")), F.avg(F.size("nbrs"))).first()
    if n * (8 * (dim or 0) + (degree or 0) * (12 + 2 * book.chunks)) > most_bytes:
        raise ValueError("the index doesn't fit one worker: use another mode")
    return spark.sparkContext.broadcast((nodes.orderBy("id").toArrow(), book, seeds))


def single(queries: DataFrame, sent, p: SearchParams, exact: bool = False) -> DataFrame:
    """One place has the whole graph (sent: of whole()); queries are shared out. exact: distances of vectors instead of codes (from one seed)."""
    spark, number = queries.sparkSession, sent._jbroadcast.id() if hasattr(sent, "_jbroadcast") else id(sent)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, book, seeds = sent.value
        if number not in _WHOLE:
            _WHOLE.clear()
            part = Part.of(t)
            _WHOLE[number] = part, part.rows(seeds.ids)
        part, at = _WHOLE[number]
        for b in batches:
            if not b.num_rows:
                continue
            qids, q = b.column(0).to_pylist(), matrix(b.column(1))
            start = at[seeds.of(q, p.seeds)]
            rows = _exactly(part, qids, q, start, p) if exact else _many(part, qids, q, book, start, p, [])
            if rows:
                yield _answer(rows, _NAMES)

    shared = queries.select("qid", F.col("vec").cast("array<double>")).repartition(spark.sparkContext.defaultParallelism, "qid")  # a small file of queries would be one task
    return shared.mapInArrow(search, RESULT)


#: Nodes of a partition that are searched by several queries in step; larger ones are read node by node.
STEP_NODES = 100_000


def scatter(queries: DataFrame, files: Files, entries: DataFrame, book: Codebook, p: SearchParams, routed: DataFrame | None = None) -> DataFrame:
    """Each partition has an index of its own (files of a node table whose links stay inside); its queries (all, or those routed to it: qid, partition_id) search it from its entry (partition_id, id), and the parts are merged. What is shuffled is queries."""
    spark = queries.sparkSession
    first = {r.partition_id: r.id for r in entries.select(F.col("partition_id").cast("int"), "id").collect()}  # one for each partition
    sent = spark.sparkContext.broadcast((book, first))
    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec"))
    if routed is None:
        homes = spark.createDataFrame([(h,) for h in sorted(first)], "partition_id int")
        placed = asked.join(F.broadcast(homes))
    else:
        placed = asked.join(routed.select("qid", F.col("partition_id").cast("int")), "qid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, first = sent.value
        for b in batches:
            homes, qids, x = b.column(2).to_numpy(), np.array(b.column(0).to_pylist()), matrix(b.column(1))
            for home in np.unique(homes).tolist():
                own = np.flatnonzero(homes == home)
                part, q, some = opened(files, home), x[own], qids[own].tolist()
                start = part.rows(np.array([first[home]]))
                if len(part.ids) <= max(STEP_NODES, p.size):
                    rows = _many(part, some, q, book, np.broadcast_to(start, (len(q), 1)), p, [home])
                else:
                    rows = []
                    for qid, y, table in zip(some, q, book.table(q)):
                        s = State.start(y, part.ids[start], adc(table, part.codes[start]), np.array([home]), p.size)
                        part.run(s, table, p)
                        rows += [(qid, int(i), float(d), s.hops, s.ios, s.cmps, 0, s.history) for i, d in zip(*s.best(p.k))]
                if rows:
                    yield _answer(rows, _NAMES)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = -(-n // max(1, len(first)))
    found = placed.select("qid", "vec", "partition_id").repartition(n, "partition_id", F.pmod("qid", F.lit(spread))).mapInArrow(search, RESULT)
    return gathered(found, p.k)


def gathered(found: DataFrame, k: int) -> DataFrame:
    """Partial results as one list for each query: ids once, costs summed over partitions, histories joined."""
    part = found.groupBy("qid", F.col("history").alias("h")).agg(F.max("hops").alias("hops"), F.max("ios").alias("ios"), F.max("cmps").alias("cmps"), F.max("inter_hops").alias("inter_hops"))
    cost = part.groupBy("qid").agg(*(F.sum(c).alias(c) for c in ("hops", "ios", "cmps", "inter_hops")), F.flatten(F.sort_array(F.collect_list("h"))).alias("history"))
    return knn.merge(found.select("qid", "id", "dist"), k).join(cost, "qid").select(*_NAMES)


# --- states that move -----------------------------------------------------------------------------------------------

#: A column of a partition's files and its numbers.
COLUMNS = {"ids": np.int64, "x": np.float64, "codes": np.int16, "offsets": np.int64, "nbrs": np.int64, "nbr_codes": np.int16, "nbr_homes": np.int32}


@dataclass(frozen=True)
class Files:
    """A node table as files: {folder}/{partition}.{column}. of: each partition's (nodes, dimensions, chunks)."""

    folder: str
    of: dict[int, tuple[int, int, int]]


def mapped(files: Files) -> bool:
    """Whether every worker can map the files."""
    return isinstance(fs.FileSystem.from_uri(files.folder)[0], fs.LocalFileSystem)


def laid_out(nodes: DataFrame) -> Files:
    """Write the files, each partition by one task that streams through its rows. Finished files are renamed, so a repeated attempt replaces them by the same."""
    folder = shared_dir(nodes.sparkSession, "partitions")
    place, plain = fs.FileSystem.from_uri(folder)
    place.create_dir(plain, recursive=True)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, home, out, n, dim, chunks, links = TaskContext.get().taskAttemptId(), None, {}, 0, 0, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            if home is not None:
                for k, f in out.items():
                    f.close()
                    place.move(f"{plain}/_{home}.{k}.{attempt}", f"{plain}/{home}.{k}")
                yield pa.record_batch([pa.array([v], pa.int64()) for v in (home, n, dim, chunks)], names=["home", "n", "dim", "chunks"])

        for b in it:
            homes = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(homes[1:] != homes[:-1]) + 1).tolist(), len(homes)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                t = pa.Table.from_batches([b.slice(x, y - x)])
                if int(homes[x]) != home:
                    yield from close()
                    home, n, links = int(homes[x]), 0, 0
                    out = {k: place.open_output_stream(f"{plain}/_{home}.{k}.{attempt}") for k in COLUMNS}
                    out["offsets"].write(np.zeros(1, np.int64).tobytes())
                part = Part.of(t)
                dim, chunks = part.x.shape[1], part.codes.shape[1]
                for k, kind in COLUMNS.items():
                    values = part.offsets[1:] + links if k == "offsets" else getattr(part, k)
                    out[k].write(np.ascontiguousarray(values, kind).tobytes())
                n, links = n + len(part.ids), links + len(part.nbrs)
        yield from close()

    ordered = nodes.select(*(x.split()[0] for x in NODES.split(", "))).repartition("partition_id").sortWithinPartitions("partition_id", "id")
    rows = ordered.mapInArrow(write, "home long, n long, dim long, chunks long").collect()  # one for each partition
    return Files(folder, {r.home: (r.n, r.dim, r.chunks) for r in rows})


#: A worker's open partitions. Mapped ones cost nothing; those that had to be read whole count against READ_BYTES.
_OPEN: OrderedDict[tuple[str, int], Part] = OrderedDict()
READ_BYTES, OPEN_PARTS = 512 << 20, 4096


def opened(files: Files, home: int) -> Part:
    key = (files.folder, home)
    if key in _OPEN:
        _OPEN.move_to_end(key)
        return _OPEN[key]
    place, plain = fs.FileSystem.from_uri(files.folder)
    _, dim, chunks = files.of[home]
    held, read = {}, not isinstance(place, fs.LocalFileSystem)
    for k, kind in COLUMNS.items():
        path = f"{plain}/{home}.{k}"
        if read:
            with place.open_input_file(path) as f:
                held[k] = np.frombuffer(f.read(), kind)
        else:
            held[k] = np.memmap(path, kind, "r") if place.get_file_info(path).size else np.zeros(0, kind)
    part = Part(home, held["ids"], held["x"].reshape(-1, dim), held["codes"].reshape(-1, chunks), held["offsets"], held["nbrs"], held["nbr_codes"].reshape(-1, chunks), held["nbr_homes"])
    _OPEN[key] = part
    while len(_OPEN) > OPEN_PARTS or (read and len(_OPEN) > 1 and sum(x.x.nbytes + x.nbr_codes.nbytes + x.nbrs.nbytes for x in _OPEN.values()) > READ_BYTES):
        _OPEN.popitem(last=False)
    return part


class Everything:
    """All partitions' mapped files as one graph, for searches whose pools have room for all nodes: codes and links by place, the vectors where they are."""

    def __init__(self, files: Files):
        parts = [opened(files, home) for home in sorted(files.of)]
        ids = np.concatenate([x.ids for x in parts])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ends = np.cumsum([0, *(len(x.ids) for x in parts)])
        self.ids, self.homes = ids[order], np.concatenate([np.full(len(x.ids), x.home, np.int64) for x in parts])[order]
        self.codes = np.concatenate([x.codes for x in parts])[order]
        self.rows = [(place[a:b], x.x) for a, b, x in zip(ends, ends[1:], parts)]
        degree = np.concatenate([np.diff(x.offsets) for x in parts])
        self.links, self.degree = np.full((len(ids), max(1, int(degree.max(initial=0)))), -1, np.int32), degree[order]
        for (own, _), x in zip(self.rows, parts):
            size = np.diff(x.offsets)
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(self.ids, x.nbrs), len(ids) - 1)
            self.links[own[row], np.arange(len(row)) - x.offsets[:-1][row]] = np.where(self.ids[at] == x.nbrs, at, -1)
        self._left: tuple[str | None, np.ndarray] = None, np.ones(len(ids), bool)

    def left(self, gone: str | None) -> np.ndarray:
        if self._left[0] != gone:
            self._left = gone, _left(self.ids, gone_ids(gone))
        return self._left[1]

    def search(self, q: np.ndarray, table: np.ndarray, seeds: np.ndarray, home: int, p: SearchParams) -> tuple[np.ndarray, np.ndarray, int, int, int, list[int]]:
        """From seeds (ids): (ids, distances, hops, I/Os, comparisons, history), as a state finds them that moves from home to home."""
        seen, hops, cmps, history = expanded_all(code_distances(table, self.codes), self.links, np.searchsorted(self.ids, seeds), p.beam, self.homes, home)
        best, d = best_of(q, self.rows, seen & self.left(p.gone), p.k)
        return self.ids[best], d, hops, int(seen.sum()), cmps, history

    def rounds(self, q: np.ndarray, table: np.ndarray, seeds: np.ndarray, p: SearchParams) -> tuple[np.ndarray, np.ndarray, int, int, int]:
        """From seeds (ids): (ids, distances, rounds, I/Os, comparisons) of a coordinator, who takes the beam wherever it lies and has all links of it scored."""
        seen, hops, _, _ = expanded_all(code_distances(table, self.codes), self.links, np.searchsorted(self.ids, seeds), p.beam)
        best, d = best_of(q, self.rows, seen & self.left(p.gone), p.k)
        return self.ids[best], d, hops, int(seen.sum()), int(self.degree[seen].sum())


#: The last one that a worker has made.
_EVERYTHING: dict[str, Everything] = {}


def holds_all(files: Files, size: int) -> bool:
    """Whether a pool of that size has room for all nodes and the files can be mapped."""
    return size >= sum(n for n, _, _ in files.of.values()) and mapped(files)


def everything(files: Files, size: int) -> Everything | None:
    """All partitions as one graph if the pool holds_all."""
    if not holds_all(files, size):
        return None
    if files.folder not in _EVERYTHING:
        _EVERYTHING.clear()
        _EVERYTHING[files.folder] = Everything(files)
    return _EVERYTHING[files.folder]


_STATE = "qid long, home int, live boolean, part int, data binary"
_LAYOUT = (("q", np.float64), ("ids", np.int64), ("dist", np.float64), ("done", np.uint8), ("homes", np.int32), ("exact_id", np.int64), ("exact_d", np.float64), ("history", np.int32))


def _pack(s: State, keep: int) -> bytes:
    """A state as bytes. Exact answers are cut to the best `keep`; they are what the result can need."""
    ids, d = s.best(keep)
    values = (s.q, s.ids, s.dist, s.done, s.homes, ids, d, s.history)
    arrays = [np.ascontiguousarray(v, kind) for v, (_, kind) in zip(values, _LAYOUT)]
    return np.array([s.hops, s.ios, s.cmps, *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes) -> State:
    head = np.frombuffer(data, np.int64, 3 + len(_LAYOUT))
    at, v = head.nbytes, {}
    for (k, kind), n in zip(_LAYOUT, head[3:].tolist()):
        v[k] = np.frombuffer(data, kind, n, at)
        at += v[k].nbytes
    return State(v["q"], v["ids"], v["dist"], v["done"].astype(bool), v["homes"].astype(np.int64), v["exact_id"].tolist(), v["exact_d"].tolist(), *head[:3].tolist(), v["history"].tolist())


def _states(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=[x.split()[0] for x in _STATE.split(", ")])


#: Rounds of one job; after each job the states are stored and counted.
ROUNDS = 8


def state_send(queries: DataFrame, nodes: DataFrame, book: Codebook, seeds: Seeds, p: SearchParams, gather: bool = False, files: Files | None = None, round_robin: bool = False, moves: bool | None = None) -> DataFrame:
    """One graph over all partitions; a query's whole state goes on to the home of its next candidate whenever nothing ahead is local.

    Where the partitions' files can be mapped by every worker (a mounted file system), a task takes its states from one
    partition to the next itself: a move would read the same pages in another task. Elsewhere (moves; by default as the
    store is) states are sent. A round is one shuffle of states, and of nothing else: a task opens the partitions of the states that it gets and runs
    these until they end or have to leave. Several rounds are a job; its states are stored, so a lost executor costs these
    rounds at most, and jobs follow until no state is live. With gather the exact answers found in a partition are put
    aside at every move and merged in the end, instead of travelling with the state. With round_robin a query begins in
    the partition of its turn (by qid), not in that of its best seed; it moves on from there if nothing is local."""
    spark = nodes.sparkSession
    files = files or laid_out(nodes)
    sent = spark.sparkContext.broadcast((book, seeds))
    homes = sorted(files.of)

    if moves is None:
        moves = not mapped(files)

    def started(qids: list, q: np.ndarray) -> Iterator[tuple[int, int, State, np.ndarray]]:
        book, seeds = sent.value
        for qid, x, table, at in zip(qids, q, book.table(q), seeds.of(q, p.seeds)):
            s = State.start(x, seeds.ids[at], adc(table, seeds.codes[at]), seeds.homes[at], p.size)
            yield qid, homes[qid % len(homes)] if round_robin else int(s.homes[0]), s, table

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = everything(files, p.size)
        for b in batches:
            qids, q = b.column(0).to_pylist(), matrix(b.column(1))
            if whole:
                for at in range(0, len(qids), STEP_QUERIES):
                    rows = []
                    for qid, home, s, table in started(qids[at : at + STEP_QUERIES], q[at : at + STEP_QUERIES]):
                        ids, d, *cost, history = whole.search(s.q, table, s.ids, home, p)
                        rows += [(qid, int(i), float(x), *cost, len(history) - 1, history) for i, x in zip(ids, d)]
                    if rows:
                        yield _answer(rows, _NAMES)
                continue
            for at in range(0, len(qids), STEP_QUERIES):
                live, rows = list(started(qids[at : at + STEP_QUERIES], q[at : at + STEP_QUERIES])), []
                while live:
                    live.sort(key=lambda s: (s[1], s[0]))  # partition by partition
                    on = [(qid, opened(files, home).run(s, table, p), s, table) for qid, home, s, table in live]
                    for qid, away, s, _ in on:
                        if away is None:
                            rows += [(qid, int(i), float(d), s.hops, s.ios, s.cmps, max(0, len(s.history) - 1), s.history) for i, d in zip(*s.best(p.k))]
                    live = [s for s in on if s[1] is not None]
                if rows:
                    yield _answer(rows, _NAMES)

    if not moves:
        return queries.select("qid", F.col("vec").cast("array<double>")).repartition(spark.sparkContext.defaultParallelism, "qid").mapInArrow(follow, RESULT)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _states([(qid, home, True, None, _pack(s, p.k)) for qid, home, s, _ in started(b.column(0).to_pylist(), matrix(b.column(1)))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, _ = sent.value
        for b in batches:
            rows, moved = [], []
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                (moved if row[2] else rows).append(row)
            moved.sort(key=lambda r: (r[1], r[0]))
            for at in range(0, len(moved), STEP_QUERIES):
                some = [(*r[:2], _unpack(r[4])) for r in moved[at : at + STEP_QUERIES]]
                for (qid, home, s), table in zip(some, book.table(np.stack([s.q for _, _, s in some]))):
                    away = opened(files, home).run(s, table, p)
                    if gather:
                        ids, d = s.best(p.k)
                        rows.append((qid, home, False, len(s.history), _pack(State(s.q[:0], s.ids[:0], s.dist[:0], s.done[:0], s.homes[:0], ids.tolist(), d.tolist()), p.k)))
                        s.exact_id, s.exact_d = [], []
                    if away is None:  # what is left of it is the answer
                        s = State(s.q[:0], s.ids[:0], s.dist[:0], s.done[:0], s.homes[:0], s.exact_id, s.exact_d, s.hops, s.ios, s.cmps, s.history)
                    rows.append((qid, home if away is None else away, away is not None, None, _pack(s, p.k)))
            if rows:
                yield _states(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = -(-n // len(homes))  # the states of one partition are shared out too
    states = queries.select("qid", F.col("vec").cast("array<double>")).mapInArrow(begin, _STATE)
    ended, live = None, None
    # the stages of a job are known beforehand: nothing to plan anew between them
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        while live is None or live.limit(1).count():
            states = states if live is None else live
            for _ in range(ROUNDS):
                states = states.repartition(n, "home", F.pmod("qid", F.lit(spread))).mapInArrow(step, _STATE)
            after = stored(states, "states")
            done, live = after.where("not live"), after.where("live")
            ended = done if ended is None else ended.unionByName(done)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for qid, _, _, part, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                s = _unpack(data)
                # a part has answers alone; a state without answers of its own has a row for its costs
                costs = (None,) * 5 if part is not None else (s.hops, s.ios, s.cmps, max(0, len(s.history) - 1), s.history)
                found = list(zip(s.exact_id, s.exact_d)) or ([] if part is not None else [(None, None)])
                rows += [(qid, i, d, *costs) for i, d in found]
            if rows:
                yield _answer(rows, _NAMES)

    found = ended.mapInArrow(answers, RESULT)
    if not gather:
        return found.where("id is not null")
    cost = found.where("hops is not null").select("qid", "hops", "ios", "cmps", "inter_hops", "history")
    return knn.merge(found.where("id is not null").select("qid", "id", "dist"), p.k).join(cost, "qid").select(*_NAMES)


def coordinator(queries: DataFrame, nodes: DataFrame, book: Codebook, seeds: Seeds, p: SearchParams, files: Files | None = None) -> DataFrame:
    """The pool is a table; each round joins its frontier to the nodes and scores their links: relational operators alone.

    Only candidates below the query's cut-off (the last of a full pool) come back from the join. Pools are stored after
    each round. Every round is a job, so this is for comparison and for few rounds, not for speed.

    With files that can be mapped and a pool that has room for all nodes there is a round for every beam of the nodes. Then
    a query's coordinator is a task: it keeps the pool as marks (expanded_all) and reads its rounds' nodes in the
    partitions' files. Answers, rounds, I/Os and comparisons are the same."""
    spark = nodes.sparkSession
    if files is not None and holds_all(files, p.size):
        given = spark.sparkContext.broadcast((book, seeds))

        def coordinated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (book, seeds), whole = given.value, everything(files, p.size)
            for b in batches:
                qids, q = b.column(0).to_pylist(), matrix(b.column(1))
                for at in range(0, len(qids), STEP_QUERIES):
                    some, rows = q[at : at + STEP_QUERIES], []
                    for qid, x, table, first in zip(qids[at : at + STEP_QUERIES], some, book.table(some), seeds.of(some, p.seeds)):
                        ids, d, *cost = whole.rounds(x, table, seeds.ids[first], p)
                        rows += [(qid, int(i), float(y), *cost, 0, []) for i, y in zip(ids, d)]
                    if rows:
                        yield _answer(rows, _NAMES)

        return queries.select("qid", F.col("vec").cast("array<double>")).repartition(spark.sparkContext.defaultParallelism, "qid").mapInArrow(coordinated, RESULT)

    frame = book.frame(spark)
    o = book.offsets
    mean = F.array(*(F.lit(float(x)) for x in book.centroid))
    centred = queries.select("qid", F.col("vec").cast("array<double>").alias("qvec")).withColumn("y", F.zip_with("qvec", mean, lambda x, m: x - m))
    span = F.create_map(*(F.lit(v) for c in range(book.chunks) for v in (c, o[c] + 1)))
    part = F.slice(F.col("y"), F.element_at(span, F.col("chunk")), F.size("pivot"))
    one = F.aggregate(F.zip_with(part, F.col("pivot"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    rows = centred.join(F.broadcast(frame)).select("qid", "chunk", "code", one.alias("d"))
    table = rows.groupBy("qid", "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "d"))), lambda s: s["d"]).alias("row"))
    table = table.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "row"))), lambda s: s["row"]).alias("lut"))
    q = stored(centred.select("qid", "qvec").join(table, "qid"), "query-tables")
    chunks = book.chunks

    def by_codes(lut, codes, at=None):
        get = lambda c, i: F.element_at(c, F.element_at(codes, i + 1 if at is None else at * chunks + i + 1) + 1)
        return F.aggregate(F.transform(lut, get), F.lit(0.0), lambda a, x: a + x)

    sent = spark.sparkContext.broadcast(seeds)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sent.value
        for b in batches:
            if b.num_rows:
                at = seeds.of(matrix(b.column(1)), p.seeds)
                yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), at.shape[1])), pa.array(seeds.ids[at.ravel()]), pa.array(list(seeds.codes[at.ravel()]), pa.list_(pa.int16()))], names=["qid", "id", "codes"])

    start = q.select("qid", "qvec").mapInArrow(starts, "qid long, id long, codes array<smallint>").dropDuplicates(["qid", "id"])
    pool = knn.ranked(q.join(start, "qid").select("qid", "id", by_codes(F.col("lut"), F.col("codes")).alias("dist"), F.lit(False).alias("expanded")), p.size)
    pool = stored(pool.drop("rank"), "pool")
    exact, rounds = None, 0
    while True:
        w = Window.partitionBy("qid").orderBy("dist", "id")
        ahead = pool.where("not expanded").withColumn("r", F.row_number().over(w)).where(F.col("r") <= p.beam).select("qid", "id")
        ahead = stored(ahead, "frontier")
        if not ahead.limit(1).count():
            break
        rounds += 1
        met = nodes.join(ahead, "id").join(q, "qid")
        diff = F.aggregate(F.zip_with("qvec", "vec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        read = stored(met.select("qid", "id", diff.alias("dist"), F.lit(rounds).alias("round"), "nbrs", F.transform("nbrs", lambda n, i: by_codes(F.col("lut"), F.col("nbr_codes"), i)).alias("nd")), "scored")
        cut = pool.groupBy("qid").agg(F.when(F.count("*") >= p.size, F.max("dist")).alias("cut"))
        links = read.select("qid", F.explode(F.arrays_zip(F.col("nbrs").alias("id"), F.col("nd").alias("dist"))).alias("e")).select("qid", "e.id", "e.dist")
        fresh = links.join(pool.select("qid", "id"), ["qid", "id"], "left_anti").join(cut, "qid").where(F.col("cut").isNull() | (F.col("dist") < F.col("cut")))
        fresh = fresh.groupBy("qid", "id").agg(F.min("dist").alias("dist")).withColumn("expanded", F.lit(False))
        now = pool.join(ahead.withColumn("now", F.lit(True)), ["qid", "id"], "left").select("qid", "id", "dist", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"))
        exact_now = read.select("qid", "id", "dist", "round", F.size("nbrs").alias("links"))
        exact = exact_now if exact is None else exact.unionByName(exact_now)
        pool = stored(knn.ranked(now.unionByName(fresh), p.size).drop("rank"), "pool")
    cost = exact.groupBy("qid").agg(F.countDistinct("round").alias("hops"), F.count("*").alias("ios"), F.sum("links").cast("long").alias("cmps"))
    return knn.merge(exact.select("qid", "id", "dist"), p.k).join(cost, "qid").select("qid", "id", "dist", "hops", "ios", "cmps", F.lit(0).cast("long").alias("inter_hops"), F.array().cast("array<int>").alias("history"))
