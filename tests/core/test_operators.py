import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import prep, sqlfuncs
from vecspark.operators import cluster, graph, knn, metrics, pq, search
from vecspark.operators.graph import BuildParams
from vecspark.plans.index import Index
from vecspark.streaming import queries as S


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1.0, (80, 6)) for c in (0, 6, 12)])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)


def vec(df, key="qid"):
    return df.select(F.col("id").alias(key), "vec")


def exact(points, ids, k):
    rows = {r.id: np.array(r.vec) for r in points.collect()}
    return {q: [i for _, i in sorted((((rows[q] - v) ** 2).sum(), i) for i, v in rows.items())[:k]] for q in ids}


def test_nearest_in_blocks_and_edges(spark, points):
    q = vec(points.where("id % 40 = 0"))
    want = exact(points, [r.qid for r in q.collect()], 5)
    for block in (1 << 20, 48):
        got = {}
        for r in knn.nearest(q, points, 5, block_bytes=block).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == want
    assert knn.nearest(q, points, 500).count() == 6 * 240  # more than there are
    assert knn.nearest(q.limit(0), points, 5).count() == 0
    assert knn.nearest(q, points.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(q, points, 5, "none")


def test_recall_of_ties_duplicates_and_missing(spark):
    truth = spark.createDataFrame([(0, 1, 1, 0.1), (0, 2, 2, 0.5), (0, 3, 3, 0.5), (1, 1, 7, 0.0), (1, 2, 8, 0.2), (1, 3, 9, 0.3)], "qid long, rank long, id long, dist double")
    found = spark.createDataFrame([(0, 3, 0.5), (0, 1, 0.1), (0, 1, 0.1), (1, 7, 0.0)], "qid long, id long, dist double")
    # id 1 is there twice and fills the second place; query 1 has one of two
    assert knn.recall(found, truth, 2).first()[0] == 50.0
    assert knn.recall(found.limit(0), truth, 2).first()[0] == 0.0


def test_merges(spark):
    parts = spark.createDataFrame([(0, 5, 1.0), (0, 5, 1.0), (0, 6, 0.5), (0, 4, 1.0)], "qid long, id long, dist double")
    assert [(r.id, r["rank"]) for r in knn.merge(parts, 3).orderBy("rank").collect()] == [(6, 1), (4, 2), (5, 3)]


def test_normalisation_of_zeros_and_rotation(spark):
    d = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, vec array<double>")
    n = {r.id: r.v for r in d.select("id", prep.normalize(F.col("vec")).alias("v")).collect()}
    assert n == {0: [0.0, 0.0], 1: [0.6, 0.8]}
    r = prep.rotation(2, 1)
    back = prep.rotate(prep.rotate(d, "vec", r), "vec", r, transpose=True)
    assert all(np.allclose(a.vec, b.vec) for a, b in zip(back.orderBy("id").collect(), d.orderBy("id").collect()))


def test_clusters(spark, points):
    centers, residual = cluster.kmeans(points, cluster.plus_plus(points, 3, 1), 15)
    sizes = sorted(r["count"] for r in cluster.assign(points, centers).groupBy("partition_id").count().collect())
    assert sizes == [80, 80, 80] and residual < 240 * 12
    parts = cluster.balanced(points, 4, 0.05)
    n = [r["count"] for r in parts.groupBy("partition_id").count().collect()]
    assert sum(n) == 240 and len(n) == 4 and max(n) <= 63
    assert parts.select("id").distinct().count() == 240
    rnd = cluster.random_partitions(points, 7)
    assert sorted(r["count"] for r in rnd.groupBy("partition_id").count().collect()) == [34] * 6 + [36]
    assert cluster.sample(points, 0.0).count() == 0 and cluster.sample(points, 1.0).count() == 240
    fit = cluster.shards_within(points, prep.ram_estimate(70, 6, 8), 8, 1, first=2)
    assert fit.count() >= 4
    assert {len(r.homes) for r in cluster.overlapping(points, centers, 0.0).collect()} == {1}


def test_lloyd_leaves_empty_clusters_at_zero(spark):
    d = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 3.0])], "id long, vec array<double>")
    c = spark.createDataFrame([(0, [1.0, 1.0]), (1, [99.0, 99.0])], "id long, vec array<double>")
    new, res = cluster.lloyd_step(d, c)
    assert {r.id: r.vec for r in new.collect()} == {0: [1.0, 2.0], 1: [0.0, 0.0]} and res.first()[0] == 4.0


def test_merged_build_and_maintenance(spark, points):
    p = BuildParams(8, 24, 48)
    g = graph.merged_build(points, 3, p)
    assert g.count() == 240 and g.agg(F.max(F.size("nbrs"))).first()[0] <= 8
    gone = points.where("id % 9 = 0").select("id")
    left = graph.consolidate(g, gone, p)
    assert left.count() == 240 - gone.count()
    assert left.select(F.explode("nbrs").alias("n")).join(gone, F.col("n") == F.col("id"), "left_semi").count() == 0
    twice = graph.insert(left.withColumn("partition_id", F.lit(0)), points.where("id < 20").withColumn("partition_id", F.lit(0)), p)
    assert twice.count() == twice.select("id").distinct().count() == left.select("id").union(points.where("id < 20").select("id")).distinct().count()
    head = graph.head_nodes(g, spark.createDataFrame([(0,)], "id long"), 0.5).count()
    assert 1 <= head <= 120


def test_layout_refuses_lone_nodes(spark, points):
    g = spark.createDataFrame([(0, [1]), (1, [])], "id long, nbrs array<long>")
    parts = points.select("id", F.lit(0).alias("partition_id"))
    with pytest.raises(Exception, match="node without"):
        graph.layout(points, g, parts, 4).collect()


@pytest.fixture(scope="module")
def built(points):
    homes = points.select("id", F.pmod("id", F.lit(3)).cast("int").alias("partition_id"))
    return Index.build(points, homes, "l2", 3, BuildParams(10, 30, 60), head_share=0.2)


def test_index_round_trip_and_modes(spark, points, built, tmp_path):
    built.check()
    built.save(f"{tmp_path}/index")
    again = Index.open(spark, f"{tmp_path}/index")
    again.check()
    q = vec(points.where("id % 30 = 7"))
    want = exact(points, [r.qid for r in q.collect()], 4)
    for ix, mode in ((built, "single"), (again, "state_send"), (again, "client_gather"), (again, "scatter"), (again, "coordinator")):
        got = {}
        for r in ix.search(q, 4, 240, 8, mode).orderBy("qid", "dist", "id").collect():
            got.setdefault(r.qid, []).append(r.id)
            assert r.ios >= 4 and (mode != "single" or r.inter_hops == 0)
        assert got == want, mode
    some = again.search(q, 4, 20, 4, "scatter_top_n", top_n=2)
    assert some.groupBy("qid").count().agg(F.min("count")).first()[0] == 4
    # states that are sent find what states that are followed do, at the same cost
    for mode in ("state_send", "client_gather"):
        for robin in (False, True):
            sent, kept = ({(r.qid, r.id): (r.hops, r.ios, r.cmps, r.inter_hops, tuple(r.history)) for r in again.search(q, 4, 12, 2, mode, round_robin=robin, moves=m).collect()} for m in (True, False))
            assert sent == kept and max(v[3] for v in sent.values()) > 8  # more moves than a job has rounds
    with pytest.raises(ValueError):
        built.search(q, mode="none")


def test_other_metrics(spark, points):
    few = points.where("id % 3 = 0").select("id", F.transform("vec", lambda x: x + 0.5).alias("vec"))
    q = vec(points.where("id in (5, 100, 200)"))
    rows = {r.id: np.array(r.vec) for r in few.collect()}
    homes = few.select("id", F.lit(0).alias("partition_id"))
    for m in ("cosine", "mips"):
        got = Index.build(few, homes, m, 2, BuildParams(8, 24, 48)).search(q, 3, 80, 8, "single")
        for r in q.collect():
            u = np.array(r.vec) / np.linalg.norm(r.vec)
            s = {i: float(u @ v) / (np.linalg.norm(v) if m == "cosine" else 1) for i, v in rows.items()}
            best = sorted(s.values(), reverse=True)[:3]
            mine = got.where(F.col("qid") == r.qid).collect()
            assert np.allclose(sorted((s[x.id] for x in mine), reverse=True), best)
            if m == "mips":
                assert np.allclose(sorted((x.inner for x in mine), reverse=True), best)


def test_sql_functions_and_table_function(spark, points, built):
    sqlfuncs.register(spark)
    r = spark.sql("select l2sq(array(1D,2D), array(3D,2D)) a, cosine_dist(array(1D,0D), array(1D,0D)) b, neg_ip(array(2D), array(3D)) c, vec_norm_sq(array(3D,4D)) d, vec_normalize(array(3D,4D)) e, adc(array(array(1D,2D), array(3D,4D)), array(1S,0S)) f").first()
    assert tuple(r) == (4.0, 0.0, -6.0, 25.0, [0.6, 0.8], 5.0)
    sqlfuncs.register_search(spark, "vector_search", built)
    points.where("id = 7").createOrReplaceTempView("one")
    got = spark.sql("select o.id as q, s.* from one o, lateral vector_search(o.vec, 3, 240) s").collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == exact(points, [7], 3)[7]


def test_interpolation_edges(spark):
    d = spark.createDataFrame([("a", 0.5, 10.0), ("a", 0.9, 20.0), ("b", 0.7, 1.0), ("c", 0.1, 5.0), ("c", 0.2, 6.0)], "run string, recall double, qps double")
    got = {r.run: r.qps for r in metrics.interpolate_at(d, "recall", "qps", 0.7, ["run"]).collect()}
    assert got == {"a": 15.0, "b": 1.0, "c": None}
    near = {r.run: r.qps for r in metrics.closest_at(d, "recall", "qps", 0.72, ["run"]).collect()}
    assert near == {"a": None, "b": 1.0, "c": None}


def test_run_table(spark):
    rows = [(10, i, i * 100.0, i * 100.0 + 50 + i, 3.0, 1.0, 4.0, 50.0, 90.0) for i in range(20)]
    d = spark.createDataFrame(rows, "L int, qid long, send_us double, receive_us double, n_hops double, n_inter_partition_hops double, n_ios double, n_cmps double, recall double")
    r = metrics.run_table(d, ["L"]).first()
    assert r.p50 == 60.0 and r.p999 == 69.0 and r.mean_hops == 3.0 and abs(r.qps - 20 * 1e6 / (1900 + 69)) < 1e-6


def test_streamed_queries(spark, points, built, tmp_path):
    now = dt.datetime(2024, 1, 1)
    q = vec(points.where("id % 60 = 1")).withColumn("sent", F.lit(now))
    q.repartition(2).write.parquet(f"{tmp_path}/in")
    s = S.search_stream(S.query_files(spark, f"{tmp_path}/in"), lambda d: built.search(d.select("qid", "vec"), 3, 240, 8, "single"), f"{tmp_path}/out", f"{tmp_path}/cp")
    s.awaitTermination(120)
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("qid", "dist", "id").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == exact(points, [r.qid for r in q.collect()], 3)


def test_gathered_parts(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    rows = [(1, 0, 2, [5, 6], [0.5, 0.9], now), (1, 1, 2, [7, 5], [0.1, 0.5], now), (1, 1, 2, [8], [0.0], now), (2, 0, 2, [1], [1.0], now)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], S.PARTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(S.PARTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.gather_batches(stream, 2, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out/done").select("qid", "rank", "id", "dist").orderBy("rank").collect()
    assert [tuple(r) for r in got] in ([(1, 1, 7, 0.1), (1, 2, 5, 0.5)], [(1, 1, 8, 0.0), (1, 2, 5, 0.5)])


def test_windows_and_late_parts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t0, "q", 1), (t0 + dt.timedelta(seconds=30), "q", 2), (t0 + dt.timedelta(hours=1), "q", 5)], "ts timestamp, counter string, value int").coalesce(1).write.parquet(f"{tmp_path}/c")
    w = S.counter_windows(spark.readStream.schema("ts timestamp, counter string, value int").parquet(f"{tmp_path}/c"))
    w.writeStream.format("memory").queryName("cw").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.n, r.total) for r in spark.sql("select * from cw order by window").collect()][0] == (2, 3)
    parts = spark.createDataFrame([(1, 0, 1, [1], [0.1], t0), (1, 0, 1, [1], [0.1], t0)], S.PARTS)
    parts.coalesce(1).write.parquet(f"{tmp_path}/p")
    s = S.without_late(spark.readStream.schema(S.PARTS).parquet(f"{tmp_path}/p"))
    s.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.sql("select * from once").count() == 1


def test_trained_codes_find_neighbours(spark, points):
    book = pq.train(points, 3)
    q = vec(points.where("id % 24 = 0"))
    found = pq.nearest_by_codes(q, pq.encode(points, book), book, 20)
    assert knn.recall(pq.rerank(q, points, found, 5), knn.nearest(q, points, 5), 5).first()[0] >= 95


def test_stateful_gather(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    rows = [(1, 0, 2, [5, 6], [0.5, 0.9], now), (1, 1, 2, [7, 5], [0.1, 0.5], now), (2, 0, 2, [1], [1.0], now)]
    spark.createDataFrame(rows, S.PARTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = S.gather_stream(spark.readStream.schema(S.PARTS).parquet(f"{tmp_path}/in"), 2)
        s.writeStream.format("memory").queryName("gathered").outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert [(r.qid, r["rank"], r.id, r.dist) for r in spark.sql("select * from gathered order by rank").collect()] == [(1, 1, 7, 0.1), (1, 2, 5, 0.5)]


def test_counters_and_waiting(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t0), (2, t0)], "qid long, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/q")
    spark.createDataFrame([(1, [1.0], t0 + dt.timedelta(minutes=1)), (2, [2.0], t0 + dt.timedelta(hours=5))], S.VECTORS).coalesce(1).write.parquet(f"{tmp_path}/v")
    counters = S.Counters()
    spark.streams.addListener(counters)
    try:
        q = spark.readStream.schema("qid long, at timestamp").parquet(f"{tmp_path}/q")
        v = spark.readStream.schema(S.VECTORS).parquet(f"{tmp_path}/v")
        S.waiting(q, v).writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(counters)
    assert [(r.qid, r.vec) for r in spark.sql("select * from met").collect()] == [(1, [1.0])]
    assert counters.frame(spark).agg(F.sum("rows")).first()[0] >= 4


def test_floor_percentiles_by_brackets(spark):
    rng = np.random.default_rng(5)
    groups = {"many": rng.normal(size=3000), "tied": np.concatenate([np.full(900, 7.0), rng.normal(size=300)]), "one": np.array([3.0]), "few": np.array([2.0, 1.0])}
    d = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("few", None)], "g string, v double").repartition(4)
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.999}
    got = {r.g: r for r in metrics.floor_percentile(d, "v", shares, ["g"]).collect()}
    for g, x in groups.items():
        assert all(got[g][k] == sorted(x)[min(int(p * len(x)), len(x) - 1)] for k, p in shares.items()), g
    whole = sorted(v for x in groups.values() for v in x)
    assert metrics.floor_percentile(d, "v", {"m": 0.5}).first().m == whole[len(whole) // 2]


def test_prefix_sums_over_a_whole_table(spark):
    d = spark.createDataFrame([(i * 3 - 50, i % 5) for i in range(500)], "id long, w long").repartition(4)
    for exclusive in (False, True):
        got = [r.prefix for r in metrics.prefix_weights(d, "w", exclusive=exclusive, buckets=16).orderBy("id").collect()]
        want = np.cumsum([i % 5 for i in range(500)])
        assert got == list(want - [i % 5 for i in range(500)] if exclusive else want)
    assert metrics.prefix_weights(d.limit(0), "w").count() == 0


def test_portable_hash_of_any_integer(spark):
    rng = np.random.default_rng(1)
    ids = [0, 1, 2**31, 2**32 - 1, 2**33 + 7, 3_400_000_001, 2**62, -5, *rng.integers(0, 2**62, 50).tolist()]
    for salt in (0, 3, 2**40):
        got = {r.id: r.h for r in spark.createDataFrame([(int(i),) for i in ids], "id long").select("id", prep.portable_hash(F.col("id"), salt).alias("h")).collect()}
        assert all(h == (i + salt) * 2654435761 % 2**32 for i, h in got.items())


def test_levels_have_no_cap_and_bounds_are_met_or_refused(spark, points):
    chain = spark.createDataFrame([(i, [i + 1]) for i in range(40)] + [(40, [])], "id long, nbrs array<long>")
    got = {r.id: r.level for r in graph.bfs_levels(chain, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {i: i for i in range(41)}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id long, vec array<double>")
    with pytest.raises(ValueError, match="centres leave"):
        cluster.shards_within(same, prep.ram_estimate(2, 2, 4), 4, 1)


def naive_search(x, nbrs, codes, table, q, entry, size, beam, k):
    """The rule, word by word: the pool's best that aren't expanded are, until none is left."""
    d = lambda i: float(table[np.arange(len(table)), codes[i]].sum())
    pool, done, seen, hops = {entry: d(entry)}, {}, {entry}, 0
    while ahead := [i for i in sorted(pool, key=lambda i: (pool[i], i)) if i not in done][:beam]:
        hops += 1
        fresh = []
        for i in ahead:
            done[i] = float(((x[i] - q) ** 2).sum())
            fresh += [n for n in nbrs[i] if n not in seen]
            seen.update(nbrs[i])
        pool |= {n: d(n) for n in fresh}
        pool = {i: pool[i] for i in sorted(pool, key=lambda i: (pool[i], i))[:size]}
    return sorted(done, key=lambda i: (done[i], i))[:k], hops, len(done)


def test_small_pools_follow_the_rule(spark, points):
    """Every global mode with a pool that cuts most nodes off, against the rule."""
    ix = Index.build(points, 3, "l2", 3, BuildParams(6, 30, 60), head_share=0.0)
    rows = sorted(ix.nodes.collect(), key=lambda r: r.id)
    x, codes, nbrs = np.array([r.vec for r in rows]), np.array([r.codes for r in rows]), [r.nbrs for r in rows]
    q = vec(points.where("id % 50 = 3"))
    for size, beam in ((5, 1), (12, 3)):
        want = {r.qid: naive_search(x, nbrs, codes, ix.book.table(np.array([r.vec]))[0], np.array(r.vec), ix.entry, size, beam, 4) for r in q.collect()}
        got = {}
        for r in ix.search(q, 4, size, beam, "single").orderBy("qid", "dist", "id").collect():
            got.setdefault(r.qid, ([], r.hops, r.ios))[0].append(r.id)
        assert {k: tuple(v) for k, v in got.items()} == want
        for mode in ("state_send", "client_gather"):
            found = ix.search(q, 4, size, 1, mode)  # one candidate a hop: the order doesn't depend on homes
            one = {r.qid: naive_search(x, nbrs, codes, ix.book.table(np.array([r.vec]))[0], np.array(r.vec), ix.entry, size, 1, 4) for r in q.collect()}
            mine = {}
            for r in found.orderBy("qid", "dist", "id").collect():
                mine.setdefault(r.qid, ([], r.hops, r.ios))[0].append(r.id)
            assert {k: tuple(v) for k, v in mine.items()} == one, mode


def test_deletes_tags_and_compaction(spark, points, built, tmp_path):
    gone = points.where("id % 4 = 1").select("id")
    ix = built.delete(gone)
    q = vec(points.where("id % 30 = 7"))
    rows = {r.id: np.array(r.vec) for r in points.collect() if r.id % 4 != 1}
    want = {r.qid: [i for _, i in sorted((((rows_v - np.array(r.vec)) ** 2).sum(), i) for i, rows_v in rows.items())[:4]] for r in q.collect()}
    ix.save(f"{tmp_path}/d")
    ix = Index.open(spark, f"{tmp_path}/d")
    assert ix.head is not None and ix.deleted.count() == 60
    left = ix.consolidated(BuildParams(10, 30, 60), compact=True)
    left.check()
    assert sorted(r.id for r in left.nodes.select("id").collect()) == list(range(180))
    for i, mode in ((ix, "single"), (ix, "state_send"), (left, "single"), (left, "state_send"), (left, "scatter")):
        got = {}
        for r in i.search(q, 4, 240, 8, mode).orderBy("qid", "dist", "id").collect():
            got.setdefault(r.qid, []).append(r.id if i is ix else r.tag)
        assert got == want, mode


def test_consolidated_graphs_lead_to_every_node(spark, points, built):
    """Links are a chain, so two deleted neighbours break it and its later nodes lead to no earlier one: a pool of all nodes must still find all that stay, from wherever in the head a search begins."""
    old = built.nodes
    chain = old.select("id", F.when(F.col("id") < 239, F.array(F.col("id") + 1)).otherwise(F.array().cast("array<long>")).alias("nbrs"))
    nodes = search.node_table(old.select("id", "vec"), chain, old.select("id", "codes"), old.select("id", "partition_id"))
    gone = points.where("id % 10 < 2").select("id")
    q = vec(points.where("id % 30 = 7"))
    left = {r.id: np.array(r.vec) for r in points.where("id % 10 > 1").collect()}
    want = {r.qid: [i for _, i in sorted((((v - np.array(r.vec)) ** 2).sum(), i) for i, v in left.items())[:20]] for r in q.collect()}
    ix = replace(built, nodes=nodes, _files=None, _whole=None, _seeds=None).delete(gone).consolidated(BuildParams(4, 30, 60), compact=True)
    ix.check()
    assert ix.nodes.agg(F.max(F.size("nbrs"))).first()[0] <= 5
    for mode in ("single", "state_send"):
        got = {}
        for r in ix.search(q, 20, 240, 8, mode).orderBy("qid", "dist", "id").collect():
            got.setdefault(r.qid, []).append(r.tag)
        assert got == want, mode


def test_rooted_starts_lead_to_the_entry(spark):
    """A ring whose entry nothing leads to gets one link, nodes without links one each."""
    x = np.array([[0.0, 0.0]] + [[np.cos(a), np.sin(a) + 5] for a in range(6)] + [[50.0, float(i)] for i in range(7)])
    links = [[1]] + [[i % 6 + 1] for i in range(1, 7)] + [[] for _ in range(7)]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    g = spark.createDataFrame(list(enumerate(links)), "id long, nbrs array<long>")
    got = {r.id: r.nbrs for r in graph.rooted(g, v, 0, v.select("id")).collect()}
    more = {i: got[i][len(n) :] for i, n in enumerate(links)}
    assert all(got[i][: len(n)] == n for i, n in enumerate(links)) and [len(more[i]) for i in range(7, 14)] == [1] * 7
    assert more[0] == [] and [m for i in range(1, 7) for m in more[i]] == [0]
    nbrs = [np.array(got[i], np.int64) for i in range(14)]
    assert all(graph.reachable(nbrs, i)[0] for i in range(14))


def test_an_index_has_the_exact_medoids_of_large_partitions(spark):
    x = np.stack([np.random.default_rng(5).permutation(2600) / 2600, np.zeros(2600)], axis=1)  # so dense that any sample has another centre
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    ix = Index.build(d, d.select("id", (F.col("id") % 2).alias("partition_id")), "l2", 1, BuildParams(6, 12, 24), head_share=0)
    got = {r.partition_id: r.vec for r in ix.medoids.collect()}
    for p in (0, 1):
        own = x[p::2]
        assert got[p] == own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()].tolist()


def test_nearest_of_copies_and_bounded_steps(spark, monkeypatch):
    """Of many copies the least ids are found whatever the rows' order, and no more pairs than a step's are compared at once."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(5, 8)), 300, axis=0)
    ids = rng.permutation(len(x))
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vec array<double>").repartition(2)
    of = {int(i): n // 300 for n, i in enumerate(ids)}
    least = [sorted(i for i, c in of.items() if c == k)[:5] for k in range(5)]
    q = d.where("id < 40")
    for found in (knn.nearest(vec(q), d, 4), knn.nearest_of_many(vec(q), d, 4)):
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == {i: least[of[i]][:4] for i in range(40)}
    links = {}
    for r in graph.knn_graph(d, 4).orderBy("id", "rank").collect():
        links.setdefault(r.id, []).append(r.n)
    assert links == {i: [n for n in least[c] if n != i][:4] for i, c in of.items()}
    seen, plain = [], knn.pairwise
    monkeypatch.setattr(knn, "pairwise", lambda name, a, b, e="float": seen.append(len(a) * len(b)) or plain(name, a, b, e))
    top = knn.Nearest(rng.normal(size=(3000, 4)), 3)
    top.add(np.arange(9000), rng.normal(size=(9000, 4)))
    assert max(seen) <= knn.STEP_ROWS * knn.STEP_QUERIES < 3000 * 9000 and sum(seen) == 3000 * 9000


def test_connected_links_what_is_lost(spark):
    """Two islands and a node without links: all are reached, no list is longer than the degree and one, what was there stays."""
    x = np.array([[float(i), 0.0] for i in range(4)] + [[float(i), 9.0] for i in range(4)] + [[50.0, 50.0]])
    links = [[1, 2], [0, 3], [0], [1], [5, 6], [4, 7], [4], [5], []]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    g = spark.createDataFrame(list(enumerate(links)), "id long, nbrs array<long>")
    out = graph.connected(g, v, 0, 2)
    assert graph.bfs_levels(out, spark.createDataFrame([(0,)], "id long")).count() == 9
    got = {r.id: r.nbrs for r in out.collect()}
    assert all(len(got[i]) <= 3 and got[i][: len(n)] == n and len(set(got[i])) == len(got[i]) for i, n in enumerate(links))


def test_merged_index_reaches_every_node(spark):
    x = np.random.default_rng(8).normal(size=(600, 6)) + np.repeat(np.arange(6), 100)[:, None] * 30.0
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    ix = Index.build(d, d.select("id", F.lit(0).alias("partition_id")), "l2", 3, BuildParams(6, 12, 24), shards=6, head_share=0)
    assert graph.bfs_levels(ix.nodes.select("id", "nbrs"), spark.createDataFrame([(ix.entry,)], "id long")).count() == 600
    assert ix.nodes.agg(F.max(F.size("nbrs"))).first()[0] <= 7


def test_coordinators_of_all_nodes_take_no_job_a_round(spark, points, built):
    """A pool with room for all nodes: the same answers and costs as by joins, in a number of jobs that rounds don't raise."""
    q, jobs = vec(points.where("id % 60 = 7")), spark.sparkContext.statusTracker()
    by_joins = search.coordinator(built.prepare(q), built.nodes, built.book, built.seeds(), search.SearchParams(4, 240, 40))
    spark.sparkContext.setJobGroup("coordinator", "all nodes")
    got = built.search(q, 4, 240, 40, "coordinator").collect()
    rows = lambda rs: sorted((r.qid, r.id, round(r.dist, 9), *r[3:]) for r in rs)
    assert rows(got) == rows(by_joins.collect()) and all(r.hops >= 6 and r.ios == 240 for r in got)
    built.search(q, 4, 240, 4, "coordinator").collect()  # ten times the rounds
    assert len(jobs.getJobIdsForGroup("coordinator")) < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    gone = points.where("id % 5 = 0").select("id")
    want = sorted((r.qid, r.id) for r in built.delete(gone).search(q, 4, 240, 8, "single").collect())
    assert sorted((r.qid, r.id) for r in built.delete(gone).search(q, 4, 240, 8, "coordinator").collect()) == want
