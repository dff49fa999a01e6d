"""Proximity graphs: building by pruned greedy search, sharded builds, merging and maintenance.

A graph is a table (id, nbrs); together with vectors, homes and codes it makes the node table of an index. Building is
sequential within a shard (one group of rows, bounded by the shards' size) and parallel over shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.functions.distance import matrix, pairwise, to_rows
from vecspark.functions.prep import portable_hash
from vecspark.operators import cluster, knn
from vecspark.runtime import stored

#: Room that reverse links may take beyond the degree before a node is pruned again.
SLACK = 1.3


@dataclass(frozen=True)
class BuildParams:
    degree: int = 32
    search: int = 64
    pool: int = 160
    alpha: float = 1.2
    saturate: bool = False


# --- kernels -------------------------------------------------------------------------------------------------------


def _spread(dist: np.ndarray, between: np.ndarray, p: BuildParams, degree: int) -> np.ndarray:
    """Which candidates of each row are chosen. dist (rows, candidates) ascends, infinite where there is none; between (rows, candidates, candidates).

    cover[b, i, j] is how much nearer candidate j of row b is to the earlier candidate i than to the node; what is chosen
    covers the later ones, and a slack admits candidates that nothing chosen covers by more than it."""
    rows, n = dist.shape
    with np.errstate(divide="ignore", invalid="ignore"):
        cover = np.where(between > 0, dist[:, None, :] / between, np.inf)
    cover[:, np.tri(n, dtype=bool)] = 0.0
    chosen, most = np.zeros((rows, n), bool), np.where(np.isfinite(dist), 0.0, np.inf)
    slack = 1.0
    while slack <= p.alpha:
        while True:
            free = (most <= slack) & ~chosen & (chosen.sum(axis=1) < degree)[:, None]
            at = np.flatnonzero(free.any(axis=1))
            if not len(at):
                break
            first = free[at].argmax(axis=1)
            chosen[at, first] = True
            most[at] = np.maximum(most[at], cover[at, first])
        slack *= 1.2
    if p.saturate and p.alpha > 1:
        rest = np.isfinite(dist) & ~chosen
        chosen |= rest & (np.cumsum(rest, axis=1) <= (degree - chosen.sum(axis=1))[:, None])
    return chosen


#: Bytes of distances between candidates that are taken at once.
PRUNE_BYTES = 64 << 20


def prune_many(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, p: BuildParams, degree: int | None = None) -> np.ndarray:
    """Neighbours of several nodes from their pools (nodes, candidates), places in x: nearest first, leaving out what a chosen one covers. -1 and infinite where there is none; so is the result, with degree columns."""
    degree = degree or p.degree
    out = np.full((len(nodes), degree), -1)
    order = np.lexsort((ids, dist), axis=1)
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    again = np.zeros(ids.shape, bool)  # copies of an id have one distance, so they lie side by side
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    dist = np.where(again | (ids < 0) | (ids == nodes[:, None]), np.inf, dist)
    order = np.argsort(dist, axis=1, kind="stable")[:, : p.pool]
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    width = max(1, int(np.isfinite(dist).sum(axis=1).max(initial=0)))
    ids, dist = ids[:, :width], dist[:, :width]
    step = max(1, PRUNE_BYTES // (8 * width * width))
    for at in range(0, len(nodes), step):
        y = x[np.maximum(ids[at : at + step], 0)]
        norm = (y * y).sum(axis=2)
        between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * y @ y.transpose(0, 2, 1), 0)
        between[between < 1e-12 * (norm[:, :, None] + norm[:, None, :])] = 0  # copies, but for rounding
        chosen = _spread(dist[at : at + step], between, p, degree)
        r, c = np.nonzero(chosen)
        out[at + r, (np.cumsum(chosen, axis=1) - 1)[r, c]] = ids[at + r, c]
    return out


def prune(ids: np.ndarray, dist: np.ndarray, vectors: np.ndarray, p: BuildParams, degree: int | None = None) -> np.ndarray:
    """Neighbours of one node from a pool with vectors of its own; ids are any names."""
    if not len(ids):
        return ids
    names, at = np.unique(ids, return_index=True)
    kept = prune_many(vectors[at], np.array([-2]), np.arange(len(names))[None], dist[at][None], p, degree)[0]
    return names[kept[kept >= 0]]


def evict(node: np.ndarray, ids: np.ndarray, vectors: np.ndarray, p: BuildParams) -> np.ndarray:
    """A full list and a newcomer (the last): all but one stay, nearest first.

    Of the newcomer and another neighbour the one farther from the node may go, if it is nearer to the other by more than
    a slack; slacks fall from alpha to 1 by fifths, and the farthest such neighbour decides. If no slack finds one, the
    first neighbour (by the nearest that covers it) goes that a nearer one covers by more than alpha; else the farthest."""
    d, new = to_rows("l2", node, vectors), len(ids) - 1
    order = np.lexsort((ids, d))
    ids, d, x, at = ids[order], d[order], vectors[order], int(np.flatnonzero(order == new)[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = to_rows("l2", x[at], x)
        ratio = np.where(apart > 0, np.maximum(d, d[at]) / apart, np.inf)
        ratio[at] = -np.inf
        slack = p.alpha
        while slack >= 1 - 1e-5:
            if len(hit := np.flatnonzero(ratio > slack)):
                return np.delete(ids, hit[-1] if d[hit[-1]] > d[at] else at)
            slack /= 1.2
        between = pairwise("l2", x, x)
        cover = np.triu(np.where(between > 0, d[None, :] / between, np.inf), 1) > p.alpha
    cover[at] = False
    gone = np.flatnonzero(cover.any(axis=1))
    return np.delete(ids, int(cover[gone[0]].argmax()) if len(gone) else len(ids) - 1)


def greedy_many(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first searches with exact distances, all in step: the expanded nodes of each query and their distances (-1 and infinite where there are fewer). links (nodes, degree): places, -1 where there are fewer."""
    many = len(q)
    seen = np.zeros((many, len(x)), bool)
    seen[:, entry] = True
    pool, dist, done = np.full((many, size), -1), np.full((many, size), np.inf), np.ones((many, size), bool)
    pool[:, 0], dist[:, 0], done[:, 0] = entry, to_rows("l2", q, x[entry]), False
    out_r, out_id, out_d = [], [], []
    while True:
        rows = np.flatnonzero(~done.all(axis=1))
        if not len(rows):
            break
        at = done[rows].argmin(axis=1)
        node = pool[rows, at]
        done[rows, at] = True
        out_r.append(rows)
        out_id.append(node)
        out_d.append(dist[rows, at])
        far = links[node]
        new = (far >= 0) & ~seen[rows[:, None], far]
        r, c = np.nonzero(new)
        if not len(r):
            continue
        seen[rows[r], far[r, c]] = True
        d = np.full(far.shape, np.inf)
        d[r, c] = to_rows("l2", q[rows[r]], x[far[r, c]])
        all_id, all_d = np.concatenate([pool[rows], far], axis=1), np.concatenate([dist[rows], d], axis=1)
        all_done = np.concatenate([done[rows], ~new], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :size]
        pool[rows], dist[rows], done[rows] = (np.take_along_axis(v, order, 1) for v in (all_id, all_d, all_done))
    r, i, d = (np.concatenate(v) for v in (out_r, out_id, out_d))
    order = np.argsort(r, kind="stable")
    count = np.bincount(r, minlength=many)
    place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
    ids, best = np.full((many, int(count.max())), -1), np.full((many, int(count.max())), np.inf)
    ids[r[order], place], best[r[order], place] = i[order], d[order]
    return ids, best


def greedy(x: np.ndarray, nbrs: list[np.ndarray], q: np.ndarray, entry: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search with exact distances; the expanded nodes and their distances, in the order of expansion."""
    pool_id = np.array([entry])
    pool_d = to_rows("l2", q, x[pool_id])
    done = np.zeros(1, bool)
    seen = np.zeros(len(x), bool)
    seen[entry] = True
    out_id, out_d = [], []
    while True:
        open_ = np.flatnonzero(~done)
        if not len(open_):
            return np.array(out_id, np.int64), np.array(out_d)
        i = open_[0]
        done[i] = True
        node = pool_id[i]
        out_id.append(node)
        out_d.append(pool_d[i])
        new = nbrs[node]
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        pool_id = np.concatenate([pool_id, new])
        pool_d = np.concatenate([pool_d, to_rows("l2", q, x[new])])
        done = np.concatenate([done, np.zeros(len(new), bool)])
        order = np.lexsort((pool_id, pool_d))[:size]
        pool_id, pool_d, done = pool_id[order], pool_d[order], done[order]


def center(x: np.ndarray) -> int:
    return int(to_rows("l2", x.mean(axis=0), x).argmin())


def link(x: np.ndarray, nbrs: list[np.ndarray], node: int, entry: int, p: BuildParams) -> None:
    """Give a node its neighbours and them a link back; nodes whose links overflow the slack are pruned again."""
    ids, d = greedy(x, nbrs, x[node], entry, p.search)
    own = ids != node
    ids, d = ids[own], d[own]
    old = nbrs[node]
    old = old[(old != node) & ~np.isin(old, ids)]
    ids, d = np.concatenate([ids, old]), np.concatenate([d, to_rows("l2", x[node], x[old])])
    if not len(ids):
        return
    nbrs[node] = prune(ids, d, x[ids], p)
    for other in nbrs[node]:
        back(x, nbrs, int(other), node, p)


def back(x: np.ndarray, nbrs: list[np.ndarray], node: int, other: int, p: BuildParams) -> None:
    if other in nbrs[node]:
        return
    both = np.append(nbrs[node], other)
    if len(both) > p.degree + 1:
        both = prune(both, to_rows("l2", x[node], x[both]), x[both], p)
    nbrs[node] = evict(x[node], both, x[both], p) if len(both) > p.degree else both


#: Nodes that are linked at once, and the bytes of marks of their searches.
BATCH, MARK_BYTES = 256, 64 << 20


def _back(x: np.ndarray, links: np.ndarray, to: np.ndarray, who: np.ndarray, p: BuildParams) -> None:
    """Links from to back to who; nodes whose links overflow their room are pruned again."""
    order = np.lexsort((who, to))
    to, who = to[order], who[order]
    nodes, start, count = np.unique(to, return_index=True, return_counts=True)
    more = np.full((len(nodes), int(count.max(initial=0))), -1)
    row = np.repeat(np.arange(len(nodes)), count)
    more[row, np.arange(len(to)) - start[row]] = who
    both = np.concatenate([links[nodes], more], axis=1)
    both[:, links.shape[1] :][(both[:, links.shape[1] :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
    held = (both >= 0).sum(axis=1)
    fits = held <= links.shape[1]
    packed = np.take_along_axis(both[fits], np.argsort(both[fits] < 0, axis=1, kind="stable")[:, : links.shape[1]], 1)
    links[nodes[fits]] = packed
    if not fits.all():
        full = nodes[~fits]
        pool = both[~fits]
        d = np.where(pool >= 0, to_rows("l2", x[full][:, None, :], x[np.maximum(pool, 0)]), np.inf)
        links[full] = -1
        links[full, : p.degree] = prune_many(x, full, pool, d, p)


def build(x: np.ndarray, p: BuildParams = BuildParams(), entry: int | None = None) -> tuple[list[np.ndarray], int]:
    """A graph over the rows of x, and its entry point. Nodes are linked in order, in batches that double as the graph grows: a batch searches the graph as it is, all in step, prunes what it has seen and is linked back. Then every node comes down to the degree, and what nothing leads to gets a link from its nearest neighbour."""
    entry = center(x) if entry is None else entry
    links = np.full((len(x), max(p.degree + 1, int(SLACK * p.degree))), -1)
    todo = np.delete(np.arange(len(x)), entry)
    most, at, size = max(1, min(BATCH, MARK_BYTES // len(x))), 0, 1
    while at < len(todo):
        some = todo[at : at + size]
        ids, d = greedy_many(x, links, x[some], entry, p.search)
        kept = prune_many(x, some, ids, d, p)
        links[some, : p.degree] = kept
        r, c = np.nonzero(kept >= 0)
        _back(x, links, kept[r, c], some[r], p)
        at, size = at + len(some), min(most, 2 * size)
    full = np.flatnonzero((links >= 0).sum(axis=1) > p.degree)
    if len(full):
        pool = links[full]
        d = np.where(pool >= 0, to_rows("l2", x[full][:, None, :], x[np.maximum(pool, 0)]), np.inf)
        links[full] = -1
        links[full, : p.degree] = prune_many(x, full, pool, d, p)
    nbrs = [np.sort(a[a >= 0]) for a in links]
    connect(x, nbrs, entry, p.degree)
    return nbrs, entry


def padded(nbrs: list[np.ndarray]) -> np.ndarray:
    """Lists of places as a matrix, -1 where there are fewer."""
    out = np.full((len(nbrs), max([1, *map(len, nbrs)])), -1)
    for i, a in enumerate(nbrs):
        out[i, : len(a)] = a
    return out


def reachable(nbrs: list[np.ndarray], entry: int) -> np.ndarray:
    seen = np.zeros(len(nbrs), bool)
    seen[entry] = True
    front = np.array([entry])
    while len(front):
        new = np.unique(np.concatenate([nbrs[i] for i in front])) if len(front) else front
        front = new[~seen[new]]
        seen[front] = True
    return seen


def connect(x: np.ndarray, nbrs: list[np.ndarray], entry: int, degree: int) -> None:
    """Link what can't be reached from the nearest node that can, into the place of its farthest link where there is no room and the link isn't needed for reaching."""
    seen = reachable(nbrs, entry)
    while not seen.all():
        node = int(np.flatnonzero(~seen)[0])
        there = np.flatnonzero(seen)
        order = there[np.lexsort((there, to_rows("l2", x[node], x[there])))]
        home = next((int(h) for h in order if len(nbrs[h]) < degree), None)
        if home is None:
            home = int(order[0])
            far = int(to_rows("l2", x[home], x[nbrs[home]]).argmax())
            trial = np.delete(nbrs[home], far)
            nbrs[home], old = trial, nbrs[home]
            if reachable(nbrs, entry).sum() < seen.sum():
                nbrs[home] = old  # the link is needed: one above the degree rather than a node that is lost
        nbrs[home] = np.append(nbrs[home], node)
        seen = reachable(nbrs, entry)


# --- tables --------------------------------------------------------------------------------------------------------


def build_shards(df: DataFrame, by: str, p: BuildParams = BuildParams()) -> DataFrame:
    """An independent graph for each value of by: by, id, vec, nbrs, entry. One task builds one shard, so the caller keeps shards small (vecspark.operators.cluster.shards_within)."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, x = t["id"].to_numpy(), matrix(t["vec"])
        nbrs, entry = build(x, p)
        return pa.table({by: t[by], "id": t["id"], "vec": t["vec"], "nbrs": pa.array([ids[n] for n in nbrs], pa.list_(pa.int64())), "entry": pa.array(np.arange(len(ids)) == entry)})

    kind = dict(df.dtypes)[by]
    return df.select(by, "id", F.col("vec").cast("array<double>").alias("vec")).groupBy(by).applyInArrow(one, f"{by} {kind}, id long, vec array<double>, nbrs array<long>, entry boolean")


def merge_shards(graphs: DataFrame, degree: int, salt: int = 0) -> DataFrame:
    """Graphs over overlapping shards as one: the union of a node's neighbours, in hash order up to the degree."""
    edges = graphs.select("id", F.explode("nbrs").alias("n")).where("id <> n").distinct()
    w = Window.partitionBy("id").orderBy(portable_hash(F.col("n"), salt), "n")
    kept = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree)
    lists = kept.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "n"))), lambda s: s["n"]).alias("nbrs"))
    return graphs.select("id").distinct().join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))


def merged_build(df: DataFrame, shards: int, p: BuildParams = BuildParams(), replicas: int = 2) -> DataFrame:
    """Overlapping k-means shards, a graph of two thirds of the degree in each, merged: id, vec, nbrs."""
    centers, _ = cluster.kmeans(df, cluster.random_rows(df, shards), 10)
    homes = cluster.assign(df, centers, replicas).select("id", F.col("partition_id").alias("shard"))
    small = BuildParams(max(2, 2 * p.degree // 3), p.search, p.pool, p.alpha, p.saturate)
    graphs = stored(build_shards(homes.join(df.select("id", "vec"), "id"), "shard", small), "shard-graphs")
    return merge_shards(graphs, p.degree).join(df.select("id", F.col("vec").cast("array<double>").alias("vec")), "id").select("id", "vec", "nbrs")


def connected(graph: DataFrame, vectors: DataFrame, entry: int, degree: int) -> DataFrame:
    """The graph (id, nbrs) with a link to whatever the entry doesn't lead to, from the nearest node (by vectors: id, vec) that is reached and has room: id, nbrs. Where no list is longer than the degree, none gets longer than one more.

    A round links all that is lost and offers each node as many newcomers as it has room for, the nearest first; what was
    turned down is left to the next round. Every newcomer brings room of its own, so each round links some."""
    spark = graph.sparkSession
    seen = _reached(stored(graph.select("id", F.explode("nbrs").alias("n")), "edges"), spark.createDataFrame([(entry,)], "id long"))
    while True:
        lost = stored(graph.join(seen, "id", "left_anti").select("id", "nbrs"), "lost")
        if lost.isEmpty():
            return graph
        room = graph.join(seen, "id", "left_semi").select("id", (F.lit(degree + 1) - F.size("nbrs")).alias("room")).where("room > 0")
        near = knn.nearest(lost.join(vectors, "id").select(F.col("id").alias("qid"), "vec"), vectors.join(room, "id").select("id", "vec"), 1)
        w = Window.partitionBy("id").orderBy("dist", "qid")
        taken = near.join(room, "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("room")).select("id", F.col("qid").alias("n"))
        taken = stored(taken, "new-links")
        more = taken.groupBy("id").agg(F.sort_array(F.collect_list("n")).alias("more"))
        graph = stored(graph.join(more, "id", "left").select("id", F.when(F.col("more").isNull(), F.col("nbrs")).otherwise(F.concat("nbrs", "more")).alias("nbrs")), "connected")
        edges = stored(lost.select("id", F.explode("nbrs").alias("n")), "edges")
        seen = seen.unionByName(_reached(edges.join(seen.select(F.col("id").alias("n")), "n", "left_anti"), taken.select(F.col("n").alias("id"))))


def rooted(graph: DataFrame, vectors: DataFrame, entry: int, starts: DataFrame) -> DataFrame:
    """The graph (id, nbrs) with links by which each of starts (id) leads to the entry, so that searches from there see all that the entry leads to: id, nbrs. No list gets more than one link more.

    A round links the starts nearest to the entry (by vectors: id, vec), each to the nearest that leads there, and four
    times as many as the round before: one link brings most others along, unless they have nothing to do with each other."""
    spark = graph.sparkSession
    edges = stored(graph.select(F.explode("nbrs").alias("id"), F.col("id").alias("n")), "edges")  # turned round
    first = spark.createDataFrame([(entry,)], "id long")
    seen, some = _reached(edges, first), 1
    while True:
        lost = stored(starts.join(seen, "id", "left_anti").select("id"), "lost")
        if lost.isEmpty():
            return graph
        one = vectors.join(first, "id").select(F.col("id").alias("qid"), "vec")
        next_ = stored(knn.nearest(one, vectors.join(lost, "id").select("id", "vec"), some).select("id"), "next")
        near = knn.nearest(vectors.join(next_, "id").select(F.col("id").alias("qid"), "vec"), vectors.join(seen, "id").select("id", "vec"), 1)
        taken = stored(near.select(F.col("qid").alias("id"), F.col("id").alias("n")), "new-links")
        graph = stored(graph.join(taken, "id", "left").select("id", F.when(F.col("n").isNull(), F.col("nbrs")).otherwise(F.concat("nbrs", F.array("n"))).alias("nbrs")), "rooted")
        seen = seen.unionByName(_reached(edges.join(seen.select(F.col("id").alias("n")), "n", "left_anti"), taken.select("id")))
        some *= 4


def _reached(edges: DataFrame, front: DataFrame) -> DataFrame:
    """The ids that edges (id, n) lead to from front (id), front included."""
    seen = front = stored(front.distinct(), "level")
    while not front.isEmpty():
        new = edges.join(front, "id").select(F.col("n").alias("id")).distinct().join(seen, "id", "left_anti")
        front = stored(new, "level")
        seen = seen.unionByName(front)
    return stored(seen, "reached")


def knn_graph(df: DataFrame, k: int) -> DataFrame:
    """Every row's k nearest others, exactly: id, n, dist, rank. All rows are queries, so all pairs are compared, a block of rows with a task's queries at a time."""
    found = knn.nearest_of_many(df.select(F.col("id").alias("qid"), "vec"), df, k + 1).where("qid <> id")
    return knn.ranked(found.drop("rank"), k).select(F.col("qid").alias("id"), F.col("id").alias("n"), "dist", "rank")


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges (id, n) as lists; each once, ascending."""
    return edges.groupBy("id").agg(F.sort_array(F.collect_set("n")).alias("nbrs"))


def reverse_edges(graph: DataFrame) -> DataFrame:
    """(id, nbrs) with every edge turned round."""
    return adjacency(graph.select(F.explode("nbrs").alias("id"), F.col("id").alias("n")))


def with_reverse(graph: DataFrame) -> DataFrame:
    e = graph.select("id", F.explode("nbrs").alias("n"))
    return adjacency(e.unionByName(e.select(F.col("n").alias("id"), F.col("id").alias("n"))))


def bfs_levels(graph: DataFrame, entry: DataFrame) -> DataFrame:
    """id and level of all that can be reached from entry (id). A level is one join; it is stored by itself and the earlier ones aren't written again."""
    edges = stored(graph.select("id", F.explode("nbrs").alias("n")), "edges")
    front = stored(entry.select("id", F.lit(0).alias("level")).distinct(), "level")
    seen, level = front, 0
    while not front.isEmpty():
        level += 1
        new = edges.join(front.select("id"), "id").select(F.col("n").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = stored(new.select("id", F.lit(level).alias("level")), "level")
        seen = seen.unionByName(front)
        if level % 32 == 0:  # many levels make many files: one table of them now and then
            seen = stored(seen.coalesce(16), "levels")
    return seen


def head_nodes(graph: DataFrame, entry: DataFrame, share: float) -> DataFrame:
    """Whole levels around the entry up to the share of all nodes."""
    levels = bfs_levels(graph, entry)
    n = graph.count()
    counts, total, last = sorted((r[0], r[1]) for r in levels.groupBy("level").count().collect()), 0, 0
    for level, c in counts:
        if total + c > share * n and level > 0:
            break
        total, last = total + c, level
    return levels.where(F.col("level") <= last).select("id")


def partition_graph(graph: DataFrame, parts: DataFrame, partition: int) -> DataFrame:
    """The nodes of one partition; their edges out of it stay."""
    return graph.join(parts.where(F.col("partition_id") == partition).select("id"), "id", "left_semi")


def layout(vectors: DataFrame, graph: DataFrame, parts: DataFrame, degree: int) -> DataFrame:
    """The node table: partition_id, id, vec, nbrs (at most the degree). A node without a vector, a home or a link out is an error."""
    joined = graph.join(vectors.select("id", "vec"), "id", "left").join(parts.select("id", "partition_id"), "id", "left")
    ok = F.col("vec").isNotNull() & F.col("partition_id").isNotNull() & (F.size("nbrs") > 0)
    checked = joined.where(F.assert_true(ok, F.concat(F.lit("node without vector, home or link: "), F.col("id").cast("string"))).isNull())
    return checked.select("partition_id", "id", "vec", F.slice("nbrs", 1, degree).alias("nbrs"))


# --- maintenance ---------------------------------------------------------------------------------------------------


def delete(deleted: DataFrame, ids: DataFrame, graph: DataFrame) -> DataFrame:
    """Lazy: the ids join the table of deleted ones; unknown ids are left out."""
    return deleted.select("id").unionByName(ids.select("id").join(graph.select("id"), "id", "left_semi")).distinct()


def repaired(graph: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges of the nodes that stay: a deleted neighbour is replaced by its own neighbours that stay. (id, nbrs)"""
    gone = deleted.select(F.col("id").alias("g")).distinct()
    edges = graph.select("id", F.explode("nbrs").alias("n"))
    live = edges.join(gone, F.col("id") == F.col("g"), "left_anti")
    direct = live.join(gone, F.col("n") == F.col("g"), "left_anti")
    lost = live.join(gone, F.col("n") == F.col("g"), "left_semi")
    theirs = edges.join(gone, F.col("id") == F.col("g"), "left_semi").join(gone, F.col("n") == F.col("g"), "left_anti").select(F.col("id").alias("via"), F.col("n").alias("m"))
    hop = lost.join(theirs, F.col("n") == F.col("via")).where("id <> m").select("id", F.col("m").alias("n"))
    lists = adjacency(direct.unionByName(hop))
    return graph.select("id").join(gone, F.col("id") == F.col("g"), "left_anti").join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))


def consolidate(nodes: DataFrame, deleted: DataFrame, p: BuildParams = BuildParams()) -> DataFrame:
    """The node table (id, vec, nbrs) without deleted nodes: repaired, nodes with more links than the degree pruned."""
    graph = repaired(nodes.select("id", "nbrs"), deleted)
    vec = nodes.select("id", "vec")
    few = graph.where(F.size("nbrs") <= p.degree)
    many = graph.where(F.size("nbrs") > p.degree).select("id", F.explode("nbrs").alias("n"))
    pool = many.join(vec.select(F.col("id").alias("n"), F.col("vec").alias("nv")), "n").join(vec, "id")

    def one(t: pa.Table) -> pa.Table:
        ids, x = t["n"].to_numpy(), matrix(t["nv"])
        node = matrix(t["vec"].slice(0, 1))[0]
        kept = prune(ids, to_rows("l2", node, x), x, p)
        return pa.table({"id": t["id"].slice(0, 1), "nbrs": pa.array([kept], pa.list_(pa.int64()))})

    pruned = pool.groupBy("id").applyInArrow(one, "id long, nbrs array<long>")
    return few.unionByName(pruned).join(vec, "id").select("id", "vec", "nbrs")


def reconnected(nodes: DataFrame, entries: DataFrame, degree: int, by: str = "partition_id") -> DataFrame:
    """Local graphs (by, id, vec, nbrs) in which the entry (by, id) leads to every node of its partition again: id, nbrs. A partition is one task, as when it was built."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, x = t["id"].to_numpy(), matrix(t["vec"])
        nbrs = [np.searchsorted(ids, n) for n in t["nbrs"].to_pylist()]
        at = np.flatnonzero(t["entry"].to_numpy(zero_copy_only=False))
        connect(x, nbrs, int(at[0]) if len(at) else center(x), degree)
        return pa.table({"id": t["id"], "nbrs": pa.array([ids[n] for n in nbrs], pa.list_(pa.int64()))})

    first = entries.select("id", F.lit(True).alias("entry"))
    rows = nodes.select(by, "id", "vec", "nbrs").join(first, "id", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return rows.groupBy(by).applyInArrow(one, "id long, nbrs array<long>")


def insert(nodes: DataFrame, new: DataFrame, p: BuildParams = BuildParams(), by: str = "partition_id") -> DataFrame:
    """Add rows (by, id, vec) to the node table of partitions (by, id, vec, nbrs); a row whose id is there already replaces it. Each partition links its own new rows in one task."""
    kind = dict(nodes.dtypes)[by]
    fresh = new.select(by, "id", F.col("vec").cast("array<double>").alias("vec"))
    old = nodes.select(by, "id", F.col("vec").cast("array<double>").alias("vec"), "nbrs")

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kept = ~np.isin(left["id"].to_numpy(), right["id"].to_numpy()) if left.num_rows else np.zeros(0, bool)
        gone = set(left["id"].to_numpy()[~kept].tolist())
        left = left.filter(pa.array(kept)) if left.num_rows else left
        right = right.sort_by("id")
        ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
        parts = [matrix(t["vec"]) for t in (left, right) if t.num_rows]
        x = np.concatenate(parts)
        at = {i: k for k, i in enumerate(ids.tolist())}
        outside: dict[int, list[int]] = {}
        nbrs = []
        for k, links in enumerate(left["nbrs"].to_pylist()):
            nbrs.append(np.array([at[i] for i in links if i in at and i not in gone], np.int64))
            outside[k] = [i for i in links if i not in at and i not in gone]
        nbrs += [np.zeros(0, np.int64) for _ in range(right.num_rows)]
        entry = center(x[: max(1, left.num_rows)])
        for k in range(left.num_rows, len(ids)):
            link(x, nbrs, k, entry, p)
        lists = []
        for k, links in enumerate(nbrs):
            if len(links) > p.degree:
                links = prune(links, to_rows("l2", x[k], x[links]), x[links], p)
            lists.append([*ids[links].tolist(), *outside.get(k, [])])
        return pa.table({by: pa.array([key[0].as_py()] * len(ids), left.schema.field(by).type), "id": pa.array(ids), "vec": pa.array(list(x), pa.list_(pa.float64())), "nbrs": pa.array(lists, pa.list_(pa.int64()))})

    return old.groupBy(by).cogroup(fresh.groupBy(by)).applyInArrow(one, f"{by} {kind}, id long, vec array<double>, nbrs array<long>")
