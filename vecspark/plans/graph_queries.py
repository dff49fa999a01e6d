"""Queries on graphs, and searches over an index.

The exhaustive searches really run: with a pool that holds every node all that is reachable gets expanded and ranked by
exact distances, so the answer must be the exact one that SQL gives. They are checks, not results of approximate search;
those are ann_beam_stats and ann_recall_curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.operators import cluster, graph, knn, metrics
from vecspark.operators.graph import BuildParams
from vecspark.plans.index import Index
from vecspark.plans.registry import SQL_VECTORS, base_of, queries_of, query, rounded, sql_l2, vectors
from vecspark.runtime import stored

_PAIRS = f"with {SQL_VECTORS}, d as (select x.id, y.id as n, {sql_l2('x.vec', 'y.vec')} as dist from b x, b y where x.id <> y.id), k as (select * from (select *, row_number() over (partition by id order by dist, n) as rank from d) where rank <= 8)"
_BOTH = _PAIRS + ", e as (select id, n from k union select n, id from k)"


def _knn(spark, sf):
    return graph.knn_graph(base_of(vectors(spark, sf)), 8)


def _graph(spark, sf):
    return graph.with_reverse(graph.adjacency(_knn(spark, sf)))


def _edges(g):
    return g.select("id", F.explode("nbrs").alias("n"))


@query(_PAIRS + " select id, n, round(dist, 6) as dist, rank from k")
def knn_graph(spark, sf):
    return rounded(_knn(spark, sf), "dist")


@query(_PAIRS + " select distinct n as id, id as n from k")
def reverse_edges(spark, sf):
    return _edges(graph.reverse_edges(graph.adjacency(_knn(spark, sf))))


@query(_BOTH + ", g as (select id, count(*) as d from e group by id) select max(d) as max_degree, round(avg(d), 6) as avg_degree, min(d) as min_degree, sum((d < 2)::bigint)::bigint as few from g")
def degree_stats(spark, sf):
    return rounded(metrics.degree_stats(_graph(spark, sf)), "avg_degree")


_LEVELS = _BOTH.replace("with ", "with recursive ", 1) + ", l(id, level) as (select 0::bigint, 0 union select e.n, l.level + 1 from l join e using (id) where l.level < 12) select id, min(level)::int as level from l group by id"


@query(_LEVELS)
def graph_bfs_levels(spark, sf):
    return graph.bfs_levels(_graph(spark, sf), spark.createDataFrame([(0,)], "id long"))


@query(_BOTH + " select e.id, n from e join b using (id) where label = 3")
def partition_subgraph(spark, sf):
    v = base_of(vectors(spark, sf)).select("id", F.col("label").alias("partition_id"))
    return _edges(graph.partition_graph(_graph(spark, sf), v, 3))


@query(_BOTH + ", r as (select *, row_number() over (partition by id order by (n * 2654435761) % 4294967296, n) as r from (select distinct id, n from e)) select id, n from r where r <= 6")
def shard_merge_edges(spark, sf):
    a = graph.adjacency(_knn(spark, sf))
    return _edges(graph.merge_shards(a.unionByName(graph.reverse_edges(a)), 6))


@query(_BOTH + ", x as (select * from e where id % 7 <> 0), stay as (select id, n from x where n % 7 <> 0), t as (select x.id, e.n from x join e on e.id = x.n where x.n % 7 = 0 and e.n % 7 <> 0 and e.n <> x.id) select distinct id, n from (select * from stay union all select * from t)")
def delete_repair_2hop(spark, sf):
    g = stored(_graph(spark, sf), "graph")
    return _edges(graph.repaired(g, g.where("id % 7 = 0").select("id")))


@query(f"with {SQL_VECTORS} select id from b where id % 7 = 0 or id % 11 = 0")
def lazy_delete(spark, sf):
    v = base_of(vectors(spark, sf))
    g, old = v.select("id"), v.where("id % 7 = 0").select("id")
    more = v.where("id % 11 = 0").select("id").unionByName(spark.createDataFrame([(-5,)], "id long"))
    return graph.delete(old, more, g)


@query(_BOTH + ", r as (select e.id, n, row_number() over (partition by e.id order by n) as p from e) select label::int as partition_id, r.id, n, p from r join b using (id) where p <= 10")
def disk_layout(spark, sf):
    v = base_of(vectors(spark, sf))
    nodes = graph.layout(v, _graph(spark, sf), v.select("id", F.col("label").cast("int").alias("partition_id")), 10)
    return nodes.select("partition_id", "id", F.posexplode("nbrs").alias("p", "n")).select("partition_id", "id", "n", (F.col("p") + 1).cast("long").alias("p"))


_INDEXES: dict = {}


def index(spark, sf) -> Index:
    """The index of a folder's vectors, built once in an application: labels are homes."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        v = base_of(vectors(spark, sf))
        homes = v.select("id", F.pmod("label", F.lit(4)).alias("partition_id"))
        _INDEXES[key] = Index.build(v, homes, "l2", 32, BuildParams(32, 64, 160))
    return _INDEXES[key]


_EXACT = f"with {SQL_VECTORS}, d as (select qid, id, {sql_l2('q.vec', 'b.vec')} as dist from q, b) select qid, id, round(dist, 6) as dist from (select *, row_number() over (partition by qid order by dist, id) as rank from d) where rank <= 10"


def _exhaustive(mode):
    def run(spark, sf):
        v = vectors(spark, sf)
        n = base_of(v).count()
        found = index(spark, sf).search(queries_of(v), 10, n, 64, mode)
        return rounded(found.select("qid", "id", "dist"), "dist")

    run.__doc__ = f"Mode {mode} with a pool of all nodes."
    return run


for _mode in ("single", "full_precision", "scatter", "state_send", "client_gather", "coordinator"):
    query(_EXACT, f"ann_exhaustive_{_mode}")(_exhaustive(_mode))


@query("select true as fewer_cut, true as balanced, count(*)::bigint as n from embeddings")
def partition_by_links(spark, sf):
    """Partitions of the neighbour graph from random ones: at least a third fewer links are cut, sizes stay bounded, no row is lost."""
    v, g = base_of(vectors(spark, sf)), stored(_graph(spark, sf), "graph")
    random_ = cluster.random_tags(v, 4, 1)
    parts = cluster.by_links(g, random_, 4, 0.1)
    before, after = (cluster.cut_share(g, p).first()[0] for p in (random_, parts))
    sizes = parts.groupBy("partition_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.lit(after < before * 2 / 3).alias("fewer_cut"), (F.max("n") <= F.lit(v.count() / 4 * 1.3)).alias("balanced"), F.sum("n").alias("n"))


_ROUTED = f"with {SQL_VECTORS}, h as (select *, label % 4 as p from b), s as (select x.p, x.id, sum({sql_l2('x.vec', 'y.vec')}) as cost from h x join h y on x.p = y.p group by all), m as (select p, vec from (select *, row_number() over (partition by p order by round(cost, 9), id) as r from s) join b using (id) where r = 1), r as (select qid, p from (select qid, p, row_number() over (partition by qid order by {sql_l2('q.vec', 'm.vec')}, p) as r from q, m) where r <= 2), d as (select qid, id, {sql_l2('q.vec', 'h.vec')} as dist from r join q using (qid) join h using (p))"


@query(_ROUTED + " select qid, id, round(dist, 6) as dist from (select *, row_number() over (partition by qid order by dist, id) as rank from d) where rank <= 10")
def ann_exhaustive_scatter_top_n(spark, sf):
    """Routed to the two partitions of four whose medoids are nearest: what lies in the others isn't found."""
    v = vectors(spark, sf)
    found = index(spark, sf).search(queries_of(v), 10, base_of(v).count(), 64, "scatter_top_n", top_n=2)
    return rounded(found.select("qid", "id", "dist"), "dist")


@query(_EXACT.replace("from q, b)", "from q, b where b.id % 3 <> 0)"))
def ann_deleted(spark, sf):
    """A third of the ids deleted: paths lead through them, answers leave them out."""
    v = vectors(spark, sf)
    ix = index(spark, sf).delete(base_of(v).where("id % 3 = 0").select("id"))
    return rounded(ix.search(queries_of(v), 10, base_of(v).count(), 64, "state_send").select("qid", "id", "dist"), "dist")


@query(f"with {SQL_VECTORS}, k as (select *, row_number() over (order by id) - 1 as new from b where id % 3 <> 0), d as (select qid, new, k.id as tag, {sql_l2('q.vec', 'k.vec')} as dist from q, k) select qid, new as id, tag, round(dist, 6) as dist from (select *, row_number() over (partition by qid order by dist, new) as rank from d) where rank <= 10")
def ann_consolidated(spark, sf):
    """The same consolidated: links repaired, ids renumbered, tags the old ones."""
    v = vectors(spark, sf)
    ix = index(spark, sf).delete(base_of(v).where("id % 3 = 0").select("id")).consolidated(BuildParams(32, 64, 160), compact=True)
    ix.check()
    return rounded(ix.search(queries_of(v), 10, base_of(v).count(), 64, "single").select("qid", "id", "tag", "dist"), "dist")


@query()
def ann_beam_stats(spark, sf):
    """Mean costs and recall of each mode with a pool of 80."""
    v = vectors(spark, sf)
    q, out = queries_of(v), None
    truth = stored(knn.nearest(q, base_of(v), 10), "truth")
    for mode in ("single", "full_precision", "scatter", "scatter_top_n", "state_send", "client_gather", "coordinator"):
        found = stored(index(spark, sf).search(q, 10, 80, 4, mode), "found")
        cost = found.select("qid", "hops", "ios", "cmps", "inter_hops").distinct().agg(*(F.round(F.avg(c), 3).alias(f"mean_{c}") for c in ("hops", "ios", "cmps", "inter_hops")))
        one = cost.withColumn("recall", F.lit(knn.recall(found, truth, 10).first()[0])).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def ann_recall_curve(spark, sf):
    """Recall at 10 by the size of the pool, in one place and by moving states, one candidate a hop."""
    v = vectors(spark, sf)
    q, out = queries_of(v), None
    truth = stored(knn.nearest(q, base_of(v), 10), "truth")
    for mode in ("single", "state_send"):
        for size in (10, 20, 40, 80):
            found = index(spark, sf).search(q, 10, size, 1, mode)
            one = knn.recall(found, truth, 10).select(F.lit(mode).alias("mode"), F.lit(size).alias("size"), "recall")
            out = one if out is None else out.unionByName(one)
    return out


@query("select m.mode, s.size, true as enough from (select unnest(['single', 'state_send']) as mode) m, (select unnest([10, 20, 40, 80]) as size) s")
def ann_recall_bounds(spark, sf):
    """Whether pools of these sizes find 58.8, 76.6, 88.2 and 94.7 of 100 neighbours at least."""
    least = F.create_map(*(F.lit(x) for kv in ((10, 58.8), (20, 76.6), (40, 88.2), (80, 94.7)) for x in kv))
    return ann_recall_curve(spark, sf).select("mode", "size", (F.col("recall") >= F.element_at(least, F.col("size"))).alias("enough"))


@query("select count(*) as n, count(*) as reached, 0::bigint as self_links, 0::bigint as repeated, 0::bigint as nowhere, true as bounded from embeddings")
def index_graph_rules(spark, sf):
    """The index's graph: every node is reached from the entry, no node links to itself, twice to one or to none that is there, degrees are bounded (by one more where a node would be lost)."""
    ix = index(spark, sf)
    g = ix.nodes.select("id", "nbrs")
    e = _edges(g)
    reached = graph.bfs_levels(g, spark.createDataFrame([(ix.entry,)], "id long")).count()
    nowhere = e.join(g.select(F.col("id").alias("n")), "n", "left_anti").count()
    one = g.agg(F.count("*").alias("n"), F.sum(F.array_contains("nbrs", F.col("id")).cast("long")).alias("self_links"), F.sum(F.size("nbrs") - F.size(F.array_distinct("nbrs"))).cast("long").alias("repeated"), (F.max(F.size("nbrs")) <= 33).alias("bounded"))
    return one.select("n", F.lit(reached).cast("long").alias("reached"), "self_links", "repeated", F.lit(nowhere).cast("long").alias("nowhere"), "bounded")


@query()
def graph_maintenance(spark, sf):
    """Recall of local graphs after a seventh of their nodes is deleted and consolidated and a fifth of all rows is inserted, a partition by itself each."""
    from vecspark.operators import pq, search
    from vecspark.operators.search import SearchParams

    v = base_of(vectors(spark, sf)).select("id", "vec", F.pmod("label", F.lit(4)).cast("int").alias("partition_id"))
    old, new = v.where("id % 5 <> 3"), v.where("id % 5 = 3")
    p = BuildParams(24, 64, 120)
    nodes = stored(graph.build_shards(old, "partition_id", p).select("id", "vec", "nbrs"), "nodes")
    gone = old.where("id % 7 = 1").select("id")
    left = graph.consolidate(nodes, gone, p).join(v.select("id", "partition_id"), "id")
    grown = stored(graph.insert(left.select("partition_id", "id", "vec", "nbrs"), new.select("partition_id", "id", "vec"), p), "grown")
    base = grown.select("id", "vec")
    book = pq.train(base, 32)
    table = search.node_table(base, grown.select("id", "nbrs"), pq.encode(base, book), grown.select("id", "partition_id"))
    q = queries_of(vectors(spark, sf))
    entries = cluster.medoids(grown.select("id", "vec", "partition_id"), "partition_id").select("partition_id", "id")
    found = search.scatter(q, search.laid_out(table), entries, book, SearchParams(10, 80, 4))
    return knn.recall(found, knn.nearest(q, base, 10), 10)
