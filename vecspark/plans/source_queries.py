"""Queries through files, SQL functions and streams: tables are written in a format, read back and compared."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from vecspark.functions import prep, sqlfuncs
from vecspark.functions.distance import inner_product
from vecspark.operators import cluster, graph, knn, pq
from vecspark.plans.graph_queries import _BOTH, _PAIRS, _graph, index
from vecspark.plans.knn_queries import _L2, _TOP
from vecspark.plans.metric_queries import _HISTORY, _MICROS, _history
from vecspark.plans.pq_queries import FIXED_PIVOTS as _PARTS_SQL
from vecspark.plans.registry import SQL_VECTORS, base_of, queries_of, query, rounded, sql_dot, sql_l2, table, vectors
from vecspark.runtime import settings, shared_root, stored
from vecspark.sources import binary, logs, sidecars
from vecspark.streaming import queries as streams


def _file(spark, name: str) -> str:
    """A new path below the shared folder, as a plain path: some formats are written in place, which takes a mounted file system."""
    root = shared_root(spark).removeprefix("file://")
    if "://" in root:
        raise ValueError(f"{root} isn't mounted: files of these formats are written in place")
    folder = f"{root}/vecspark/files-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}"


_FLAT = "select id, pos, x from (select vec_id as id, unnest(range(64)) as pos, unnest({v}) as x from embeddings)"


@query(_FLAT.format(v="embedding::double[]"))
def bin_matrix_scan(spark, sf):
    path = _file(spark, "m.bin")
    binary.write_matrix(vectors(spark, sf).select("id", "vec"), path)
    return binary.read_matrix(spark, path).select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long"), F.col("x").cast("double"))


@query(_FLAT.format(v="list_transform(embedding::double[], lambda x: round(abs(x) * 255)::smallint)"))
def u8bin_matrix_scan(spark, sf):
    path = _file(spark, "m.u8bin")
    binary.write_matrix(vectors(spark, sf).select("id", F.transform("vec", lambda x: F.round(F.abs(x) * 255)).alias("vec")), path, "uint8")
    return binary.read_matrix(spark, path, "uint8").select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long"), "x")


@query("select count(*)::bigint as n, 64::bigint as d from embeddings")
def bin_metadata(spark, sf):
    path = _file(spark, "m.bin")
    binary.write_matrix(vectors(spark, sf).select("id", "vec"), path)
    return spark.createDataFrame([binary.metadata(path)], "n long, d long")


@query(_L2 + "select qid, rank, id, round(dist::float::double, 4) as dist from (select *, row_number() over (partition by qid order by dist, id) as rank from d) where rank <= 20")
def truth_set_scan(spark, sf):
    v = vectors(spark, sf)
    path = _file(spark, "truth.bin")
    # a truth set knows queries by their places
    binary.write_truth(knn.nearest(queries_of(v), base_of(v), 20).withColumn("qid", (F.col("qid") / 100).cast("long")), path)
    return rounded(binary.read_truth(spark, path).drop("tag").withColumn("qid", F.col("qid") * 100), "dist", digits=4)


def _graph_scan(dialect):
    def run(spark, sf):
        g = stored(_graph(spark, sf), "graph")
        path = _file(spark, "graph.bin")
        binary.write_graph(g, path, dialect)
        return binary.read_graph(spark, path, dialect).select("id", F.explode("nbrs").alias("n"))

    run.__doc__ = f"A graph through a file of the dialect {dialect}."
    return run


for _dialect in ("degrees", "lists"):
    query(_BOTH + " select id, n from e", f"graph_file_{_dialect}")(_graph_scan(_dialect))


@query("select vec_id as id, label::int as partition_id from embeddings")
def partition_text_scan(spark, sf):
    path = _file(spark, "parts")
    binary.write_partition_lists(vectors(spark, sf).select("id", F.col("label").alias("partition_id")), path)
    return binary.read_partition_lists(spark, path)


@query(f"with {SQL_VECTORS} select id, round(vec[1], 6) as first from b where label = 3")
def partition_vectors(spark, sf):
    """The vectors of one partition's id list, read from the text form."""
    path = _file(spark, "parts")
    v = base_of(vectors(spark, sf))
    binary.write_partition_lists(v.select("id", F.col("label").alias("partition_id")), path)
    own = cluster.vectors_of(v.select("id", "vec"), binary.read_partition_lists(spark, path), 3)
    return own.select("id", F.round(F.col("vec")[0], 6).alias("first"))


@query(f"with {_HISTORY} select qid as query_id, qid * 1000.0::double as send_timestamp_ns, (qid % 9)::double as n_hops, unnest(range(len(history)))::bigint as p, unnest(history) as partition_id from h")
def query_csv_scan(spark, sf):
    h = _history(spark, sf).select(F.col("qid").alias("query_id"), (F.col("qid") * 1000).alias("send_timestamp_ns"), (F.col("qid") * 3000).alias("receive_timestamp_ns"), F.lit(1.5).alias("completion_time_us"), F.lit(0.5).alias("io_us"), (F.col("qid") % 9).alias("n_hops"), F.lit(1).alias("n_ios"), F.lit(2).alias("n_cmps"), "partition_history", F.transform("partition_history", lambda x, i: i).alias("partition_history_hop_idx"))
    path = _file(spark, "csv")
    logs.write_query_table(h, path)
    return logs.query_table(spark, path).select("query_id", "send_timestamp_ns", "n_hops", F.posexplode("partition_history").alias("p", "partition_id")).select("query_id", "send_timestamp_ns", "n_hops", F.col("p").cast("long"), "partition_id")


@query("select epoch_us(ts) as ts, user_id as msg_id, event_type as type, case when event_id % 2 = 0 then 'BEGIN_HANDLER' else 'NUM_MSG' end as action, case when event_id % 2 = 1 then event_id end as value from events")
def event_log_scan(spark, sf):
    e = table(spark, sf, "events").select(F.expr(_MICROS).cast("long").alias("us"), "user_id", "event_type", "event_id")
    line = F.format_string("[%d] [%d] [%s]:%s", "us", "user_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.lit("BEGIN_HANDLER")).otherwise(F.concat(F.lit("NUM_MSG "), F.col("event_id").cast("string"))))
    path = _file(spark, "events")
    e.select(line.alias("value")).write.text(path)
    return logs.events(spark, path).drop("file")


@query("select (10000 + event_id % 2)::bigint as tag, round(epoch_us(ts) / 1000.0, 3) as us, (user_id * 3)::bigint as query_id, (event_id % 977)::bigint as node_id from events")
def tagged_log_scan(spark, sf):
    e = table(spark, sf, "events").select(F.expr(_MICROS).cast("long").alias("us"), "user_id", "event_id")
    message = prep.pack_id(F.col("user_id") * 3, F.col("event_id") % 977)
    line = F.concat_ws(" ", (10000 + F.col("event_id") % 2).cast("string"), F.col("us").cast("string"), F.lit("1"), message.cast("string"), F.lit("0"), F.lit("0"))
    path = _file(spark, "tagged")
    e.select(line.alias("value")).write.text(path)
    tags = spark.createDataFrame([(10000, "query_id_and_node_id"), (10001, "query_id_and_node_id")], "tag_value int, msg_id_type string")
    return rounded(logs.with_ids(logs.tagged(spark, path), tags).select("tag", "us", "query_id", "node_id"), "us", digits=3)


@query("with c as (select l_suppkey, l_linenumber, sum(l_quantity) as s from lineitem group by all) select l_linenumber::int as L, l_suppkey::int as beam, round(s, 2) as qps, round(s / 100, 4) as recall_pct from c")
def client_log_scan(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("s"))
    line = F.concat_ws("   ", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.round("s", 2).cast("string"), *(F.lit("1.0"),) * 6, F.round(F.col("s") / 100, 4).cast("string"))
    head = spark.createDataFrame([("L   I/O Width  QPS  AvgLat(us)  P99 Lat  Mean Hops  Mean inter  Mean IOs  Mean cmps  Recall@10",), ("=" * 40,)], "value string")
    path = _file(spark, "client")
    head.unionByName(c.select(line.alias("value"))).write.text(path)
    return logs.client_table(spark, path).select("L", "beam", "qps", "recall_pct")


_FOLDERS = "case when o_custkey % 5 = 0 then null else case o_orderkey % 3 when 0 then 'STATE_SEND' when 1 then 'SCATTER_GATHER' else 'SINGLE_SERVER' end end"


@query(f"select o_orderkey as id, {_FOLDERS} as method, case when o_custkey % 5 <> 0 then (o_orderkey % 11)::int end as servers, case when o_custkey % 5 <> 0 then (o_custkey % 9)::int end as beam from orders")
def run_name_parts(spark, sf):
    o = table(spark, sf, "orders")
    method = F.element_at(F.array(F.lit("STATE_SEND"), F.lit("SCATTER_GATHER"), F.lit("SINGLE_SERVER")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    name = F.when(F.col("o_custkey") % 5 == 0, F.lit("backup")).otherwise(F.format_string("logs_%s_distributed_bigann_10M_%d_500_MS_x_BEAMWIDTH_%d_t", method, F.col("o_orderkey") % 11, F.col("o_custkey") % 9))
    r = logs.run_names(name)
    return o.select(F.col("o_orderkey").alias("id"), r["method"].alias("method"), r["servers"].alias("servers"), r["beam"].alias("beam"))


@query(f"with {SQL_VECTORS}, n as (select qid, id, {sql_l2('q.vec', 'b.vec')} as dist, {sql_dot('q.vec', 'b.vec')} as d, {sql_dot('b.vec', 'b.vec')} as n2, b.vec[1] as x from q, b), r as (select *, row_number() over (partition by qid order by dist, id) as rank from n) select qid, id, round(dist, 6) + 0.0 as l2, round(1 - d, 6) + 0.0 as cosine, round(-d, 6) + 0.0 as ip, round(n2, 6) as n2, round(x / sqrt(n2), 6) as first from r where rank <= 10")
def sql_functions(spark, sf):
    """The nearest of all rows by the SQL functions alone."""
    sqlfuncs.register(spark)
    v = vectors(spark, sf)
    queries_of(v).createOrReplaceTempView("vs_q")
    base_of(v).createOrReplaceTempView("vs_b")
    # the least distances of ten buckets bound the tenth: only what is within it is ranked
    return spark.sql("""
with p as (select /*+ BROADCAST(q) */ qid, pmod(xxhash64(id), 128) as bucket, min(l2sq(q.vec, b.vec)) as l2 from vs_q q join vs_b b on true group by qid, pmod(xxhash64(id), 128)),
o as (select *, row_number() over (partition by qid order by l2) as r, count(*) over (partition by qid) as c from p),
f as (select qid, if(max(c) < 10, double('NaN'), max(if(r = 10, l2, null))) as far from o group by qid),
c as (select p.qid, bucket, far from p join f on p.qid = f.qid and p.l2 <= f.far),
n as (select /*+ BROADCAST(c), BROADCAST(q) */ c.qid, id, far, l2sq(q.vec, b.vec) as l2, cosine_dist(q.vec, b.vec) as cosine, neg_ip(q.vec, b.vec) as ip, vec_norm_sq(b.vec) as n2, vec_normalize(b.vec)[0] as first from vs_b b join c on pmod(xxhash64(b.id), 128) = c.bucket join vs_q q on q.qid = c.qid),
r as (select *, row_number() over (partition by qid order by l2, id) as rank from n where l2 <= far)
select qid, id, round(l2, 6) + 0D as l2, round(cosine, 6) + 0D as cosine, round(ip, 6) + 0D as ip, round(n2, 6) as n2, round(first, 6) as first from r where rank <= 10""")


@query(_L2 + _TOP)
def sql_table_function(spark, sf):
    """The table function over an index, with a pool of all nodes, for every query."""
    v = vectors(spark, sf)
    sqlfuncs.register_search(spark, "vector_search", index(spark, sf))
    queries_of(v).createOrReplaceTempView("vs_t")
    return rounded(spark.sql(f"select qid, s.id, s.dist, s.rank from vs_t t, lateral vector_search(t.vec, 10, {base_of(v).count()}) s"), "dist")


@query("select id, pos, round(x, 6) + 0.0 as x, true as moved from (select vec_id as id, unnest(range(64)) as pos, unnest(embedding::double[]) as x from embeddings)")
def random_rotation(spark, sf):
    """A random rotation moves every vector and is undone by its transpose."""
    v = vectors(spark, sf).select("id", "vec")
    r = prep.rotation(64, 3)
    turned = prep.rotate(v.withColumn("was", F.col("vec")), "vec", r)
    moved = turned.withColumn("moved", F.aggregate(F.zip_with("vec", "was", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) > 0.1)
    back = prep.rotate(moved, "vec", r, transpose=True)
    return back.select("id", "moved", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long"), (F.round("x", 6) + F.lit(0.0)).alias("x"), "moved")


@query(_L2 + "select qid, id, round(dist, 6) as dist from (select *, row_number() over (partition by qid order by dist, id) as rank from d) where rank <= 10")
def stream_search(spark, sf):
    """Queries that arrive as files, searched batch by batch with a pool of all nodes."""
    v = vectors(spark, sf)
    folder = _file(spark, "stream")
    queries_of(v).withColumn("sent", F.current_timestamp()).repartition(2).write.parquet(f"{folder}/in")
    ix, n = index(spark, sf), base_of(v).count()
    done = streams.search_stream(streams.query_files(spark, f"{folder}/in"), lambda d: ix.search(d.select("qid", "vec"), 10, n, 64, "single"), f"{folder}/out", f"{folder}/checkpoint")
    done.awaitTermination(600)
    return rounded(spark.read.parquet(f"{folder}/out").select("qid", "id", "dist"), "dist")


@query(_L2 + _TOP)
def stream_gather(spark, sf):
    """Partial results of four partitions, arriving one file a batch, gathered by the stateful processor; every part comes twice."""
    v = vectors(spark, sf)
    folder, name = _file(spark, "gather"), f"g_{uuid.uuid4().hex}"
    one = knn.nearest_by(queries_of(v), base_of(v).withColumn("part", F.pmod("label", F.lit(4)).cast("int")), "part", 10)
    lists = one.groupBy("qid", "part").agg(F.collect_list("id").alias("ids"), F.collect_list("dist").alias("dists"))
    rows = stored(lists.select("qid", "part", F.lit(4).alias("parts"), "ids", "dists", F.current_timestamp().alias("at")), "parts")
    for p in (2, 0, 3, 1, 0, 3):
        rows.where(F.col("part") == p).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(streams.PARTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        done = streams.gather_stream(stream, 10).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        done.awaitTermination(600)
    return rounded(spark.table(name).select("qid", "id", "dist", "rank"), "dist")


@query(_L2 + _TOP)
def stream_gather_batches(spark, sf):
    """The same for state stores without such state: parts are kept in a folder."""
    v = vectors(spark, sf)
    folder = _file(spark, "gather")
    one = knn.nearest_by(queries_of(v), base_of(v).withColumn("part", F.pmod("label", F.lit(4)).cast("int")), "part", 10)
    lists = one.groupBy("qid", "part").agg(F.collect_list("id").alias("ids"), F.collect_list("dist").alias("dists"))
    lists.select("qid", "part", F.lit(4).alias("parts"), "ids", "dists", F.current_timestamp().alias("at")).repartition(3, "part").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(streams.PARTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.gather_batches(stream, 10, f"{folder}/out", f"{folder}/checkpoint").awaitTermination(600)
    return rounded(spark.read.parquet(f"{folder}/out/done").select("qid", "id", "dist", "rank"), "dist")


@query("select date_trunc('day', ts)::varchar as day, event_type as counter, count(*) as n, round(sum(value), 4) as total from events where ts < (select date_trunc('day', max(ts)) from events) - interval 1 day group by all")
def stream_counter_windows(spark, sf):
    """Daily windows of the event stream; the last days stay open until the watermark passes them, so both sides leave them out."""
    folder = _file(spark, "windows")
    name = f"w_{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select(F.expr(f"timestamp_micros(cast({_MICROS} as long))").alias("ts"), F.col("event_type").alias("counter"), "value")
    e.write.parquet(f"{folder}/in")
    w = streams.counter_windows(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "ts", "1 day", "1 hour")
    w.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(600)
    last = e.agg(F.max("ts")).select(F.expr("unix_micros(`max(ts)`) div 86400000000 * 86400000000 - 86400000000").alias("x")).first()[0]
    us = F.expr("unix_micros(window.start)")
    day = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")).cast("string"), F.lit(" 00:00:00"))  # in no session's zone
    return spark.table(name).where(us < last).select(day.alias("day"), "counter", "n", F.round("total", 4).alias("total"))


@query("select vec_id as id, (label % 4)::int as partition_id, round(embedding[1]::double, 6) as first, true as linked from embeddings")
def index_round_trip(spark, sf):
    """An index saved, opened and checked: every node has its home, vector and links."""
    from vecspark.plans.index import Index

    folder = f"file://{_file(spark, 'index')}"
    index(spark, sf).save(folder)
    again = Index.open(spark, folder)
    again.check()
    return again.nodes.select("id", "partition_id", F.round(F.col("vec")[0], 6).alias("first"), (F.size("nbrs") > 0).alias("linked"))


@query(_PAIRS + " select id, n, round(case when dist = 0 then 'inf'::double else 1 / dist end, 6) as factor from k")
def occlusion_factors(spark, sf):
    """Of each row's eight nearest others, at a distance of 1 from a node."""
    d = graph.knn_graph(base_of(vectors(spark, sf)), 8)
    return d.select("id", "n", F.round(prep.occlusion(F.lit(1.0), F.col("dist")), 6).alias("factor"))


@query(_PAIRS + f", s as (select id, n, -{sql_dot('x.vec', 'y.vec')} as ip, -0.5 as own from k join b x using (id) join b y on y.id = k.n) select id, n, round(case when own < 0 and ip < 0 then ip / own else 0 end, 6) as factor from s")
def occlusion_factors_inner(spark, sf):
    """The same for inner products, where both have to be negative."""
    v = base_of(vectors(spark, sf))
    d = graph.knn_graph(v, 8).select("id", "n").join(v.select("id", F.col("vec").alias("x")), "id").join(v.select(F.col("id").alias("n"), F.col("vec").alias("y")), "n")
    return d.select("id", "n", F.round(prep.occlusion(F.lit(-0.5), inner_product(F.col("x"), F.col("y")), "mips"), 6).alias("factor"))




_DUR = "select user_id, event_type as type, min(epoch_us(ts)) as b, max(epoch_us(ts)) as e from events group by all"


@query(f"with d as ({_DUR}) select type, count(*) as n, round(avg((e - b) / 1000.0), 3) as mean_us, round(median((e - b) / 1000.0), 3) as median_us, round(max((e - b) / 1000.0), 3) as max_us, round(stddev_samp((e - b) / 1000.0), 3) as std_us from d group by type")
def event_duration_stats(spark, sf):
    """Durations from an event log, by type: each user's first and last event of a type as its two ends."""
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("type"), F.expr(_MICROS).cast("long").alias("us")).groupBy("user_id", "type").agg(F.min("us").alias("b"), F.max("us").alias("e"))
    ends = e.select("user_id", "type", F.explode(F.array(F.struct(F.lit("BEGIN_HANDLER").alias("a"), F.col("b").alias("us")), F.struct(F.lit("END_HANDLER").alias("a"), F.col("e").alias("us")))).alias("x"))
    path = _file(spark, "ends")
    ends.select(F.format_string("[%d] [%d] [%s]:%s", "x.us", "user_id", "type", "x.a").alias("value")).write.text(path)
    stats = logs.duration_statistics(logs.event_durations(logs.events(spark, path)))
    return rounded(stats.select("type", "n", "mean_us", "median_us", "max_us", "std_us"), "mean_us", "median_us", "max_us", "std_us", digits=3)


@query("select count(distinct id) as n from (select vec_id as id, label from embeddings union all select vec_id, (label + 1) % 10 from embeddings where vec_id % 3 = 0)")
def distinct_overlap_points(spark, sf):
    """Points over overlapping partitions, each once."""
    v = vectors(spark, sf)
    both = v.select("id", F.when(F.col("id") % 3 == 0, F.array("label", (F.col("label") + 1) % 10)).otherwise(F.array("label")).alias("homes"))
    return cluster.homes(cluster.flatten_homes(both)).agg(F.count("*").alias("n"))


@query(f"with {SQL_VECTORS} select qid, (qid % 4)::int as partition_id from q")
def round_robin_start(spark, sf):
    """Where searches that begin by turns did begin."""
    found = index(spark, sf).search(queries_of(vectors(spark, sf)), 5, 20, 4, "state_send", round_robin=True)
    return found.select("qid", F.col("history")[0].alias("partition_id")).distinct()


@query("select vec_id as row, (vec_id * 3 + 1)::bigint as value from embeddings")
def id_map_scan(spark, sf):
    """Ids of rows through a file of one column, its length checked."""
    v, path = vectors(spark, sf), _file(spark, "ids.bin")
    binary.write_matrix(v.select("id", F.array(F.col("id") * 3 + 1).alias("vec")), path, "uint32")
    return sidecars.read_ids(spark, path, v.count())


@query(_PARTS_SQL + " select chunk, code, unnest(range(8)) as p, round(unnest(pv)::float::double, 5) + 0.0 as x from piv")
def codebook_scan(spark, sf):
    """Fixed pivots through a codebook file."""
    path = _file(spark, "pivots.bin")
    sidecars.write_codebook(pq.fixed(base_of(vectors(spark, sf)), 8, 64), path)
    book = sidecars.read_codebook(path).frame(spark).where("code < 64")
    long = book.select(F.col("chunk").cast("long"), F.col("code").cast("long"), F.posexplode("pivot").alias("p", "x"))
    return long.select("chunk", "code", F.col("p").cast("long"), (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query("select vec_id as id, label::int as partition_id from embeddings")
def partition_ids_scan(spark, sf):
    """Partitions through binary files of their ids."""
    prefix = _file(spark, "parts")
    done = sidecars.write_partition_ids(vectors(spark, sf).select("id", F.col("label").alias("partition_id")), prefix)
    return sidecars.read_partition_ids(spark, prefix, done.agg(F.max("partition_id")).first()[0] + 1)


@query("select vec_id as id, label::int as partition_id, label::int as assigned from embeddings")
def cluster_files_scan(spark, sf):
    """Clusters through both of their files."""
    v, a, b = vectors(spark, sf), _file(spark, "clusters.bin"), _file(spark, "assignment.bin")
    sidecars.write_clusters(v.select("id", F.col("label").alias("partition_id")), a, b)
    return sidecars.read_clusters(spark, a).join(sidecars.read_cluster_assignment(spark, b).withColumnRenamed("partition_id", "assigned"), "id").select("id", "partition_id", "assigned")


@query("select vec_id as id, 96::bigint as dim, round(embedding[64]::double, 6) + 0.0 as last, 0.0::double as beyond from embeddings")
def padded_matrix_scan(spark, sf):
    """A matrix file whose rows are padded to a multiple of 48 dimensions."""
    path = _file(spark, "m.bin")
    binary.write_matrix(vectors(spark, sf).select("id", "vec"), path)
    m = binary.read_matrix(spark, path, pad_to=48)
    rest = F.aggregate(F.slice("vec", 65, 32), F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return m.select("id", F.size("vec").cast("long").alias("dim"), (F.round(F.element_at("vec", 64).cast("double"), 6) + F.lit(0.0)).alias("last"), rest.alias("beyond"))


@query("with e as (select user_id % 3 as f, epoch_us(ts) * 1000 as ns, user_id as queued, event_id % 11 as sent from events), s as (select *, (ns - min(ns) over (partition by f)) / 1e9 as s from e), k as (select s - min(s) over (partition by f) as seconds, queued, sent from s where s >= 86400) select round(seconds, 2) as seconds, 'queued' as counter, queued as value from k union all select round(seconds, 2), 'sent', sent from k")
def counter_csv_scan(spark, sf):
    """Counter files of three servers, each from its own beginning, without the first day."""
    folder = _file(spark, "counters")
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("f"), (F.expr(_MICROS).cast("long") * 1000).alias("timestamp_ns"), F.col("user_id").alias("queued"), (F.col("event_id") % 11).alias("sent"))
    for f in range(3):
        e.where(F.col("f") == f).drop("f").coalesce(1).write.option("header", True).csv(f"{folder}/{f}")
    return rounded(logs.counters(spark, [f"{folder}/{f}" for f in range(3)], 86_400.0).select("seconds", "counter", "value"), "seconds", digits=2)


@query("with n as (select distinct l_partkey % 500 as k from lineitem) select (k * 2)::int as \"start\", (k * 2 + 1)::int as \"end\", case when k % 3 = 0 then 'query_id' else 'batch_id' end as msg_id_type from n where k % 7 <> 0")
def tag_pairs_scan(spark, sf):
    """A tag dictionary through its file, paired by names; every seventh name has no end."""
    k = table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("k")).distinct()
    name = lambda end: F.concat(F.lit("step_"), F.col("k").cast("string"), F.lit(end))
    kind = F.when(F.col("k") % 3 == 0, F.lit("query_id")).otherwise(F.lit("batch_id"))
    (s, e), path = logs.START_END[0], _file(spark, "tags")
    rows = k.select(name(s).alias("tag_name"), (F.col("k") * 2).alias("tag_value"), kind.alias("msg_id_type"))
    ends = k.where("k % 7 <> 0").select(name(e).alias("tag_name"), (F.col("k") * 2 + 1).alias("tag_value"), kind.alias("msg_id_type"))
    rows.unionByName(ends).coalesce(1).write.option("header", True).csv(path)
    return logs.tag_pairs(logs.tag_dictionary(spark, path))


@query("select l_linenumber as f, count(*) as n, sum(l_orderkey)::bigint as ids from lineitem where l_linenumber <= 3 group by 1")
def query_csv_files(spark, sf):
    """Query tables of several runs, read by a list of paths and told apart by it."""
    h, paths = _history(spark, sf), []
    for f in (1, 2, 3):
        own = table(spark, sf, "lineitem").where(F.col("l_linenumber") == f).select(F.col("l_orderkey").alias("qid")).join(h, "qid")
        row = own.select(F.col("qid").alias("query_id"), *(F.lit(f * 1.0).alias(c) for c in logs.QUERY[1:]), "partition_history", F.transform("partition_history", lambda x, i: i).alias("partition_history_hop_idx"))
        paths.append(_file(spark, f"run{f}"))
        logs.write_query_table(row, paths[-1])
    return logs.query_table(spark, paths).groupBy(F.col("n_hops").cast("long").alias("f")).agg(F.count("*").alias("n"), F.sum("query_id").cast("long").alias("ids"))


@query("select distinct event_id as qid, (user_id % 3)::int as part from events")
def stream_parts_once(spark, sf):
    """Parts that come three times over, each kept once."""
    folder = _file(spark, "late")
    e = table(spark, sf, "events").select(F.col("event_id").alias("qid"), (F.col("user_id") % 3).cast("int").alias("part"), F.lit(3).alias("parts"), F.array(F.col("event_id")).alias("ids"), F.array(F.lit(1.0)).alias("dists"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
    for _ in range(3):
        e.write.mode("append").parquet(f"{folder}/in")
    files = len(spark.read.schema(streams.PARTS).parquet(f"{folder}/in").inputFiles())
    s = streams.without_late(spark.readStream.schema(streams.PARTS).option("maxFilesPerTrigger", max(1, files // 3)).parquet(f"{folder}/in"))
    return streams.to_files(s.select("qid", "part"), folder)


@query("select event_id as qid, user_id % 5 as v from events where event_id % 2 = 0")
def stream_waiting(spark, sf):
    """Work that meets its query's vector within ten minutes; that of odd queries comes an hour late."""
    folder, t0 = _file(spark, "waiting"), F.timestamp_seconds(F.lit(1_700_000_000))
    e = table(spark, sf, "events")
    e.select(F.col("event_id").alias("qid"), t0.alias("at")).write.parquet(f"{folder}/q")
    late = F.when(F.col("event_id") % 2 == 1, F.expr("interval 1 hour")).otherwise(F.expr("interval 1 minute"))
    e.select(F.col("event_id").alias("qid"), F.array((F.col("user_id") % 5).cast("double")).alias("vec"), (t0 + late).alias("sent")).write.parquet(f"{folder}/v")
    q = spark.readStream.schema("qid long, at timestamp").parquet(f"{folder}/q")
    v = spark.readStream.schema(streams.VECTORS).parquet(f"{folder}/v")
    return streams.to_files(streams.waiting(q, v).select("qid", F.col("vec")[0].cast("long").alias("v")), folder)
