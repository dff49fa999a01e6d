"""Queries on statistics, interpolation and event logs, over the events and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.operators import metrics as M
from vecspark.plans.registry import query, rounded, table


#: Microseconds since 1970 of a time without a zone, in no session's zone.
_MICROS = "cast(cast(cast(ts as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6)) * 1000000"


def _events(spark, sf):
    """Events as timed messages: nanoseconds, an id, a value."""
    return table(spark, sf, "events").select("event_id", F.expr(_MICROS).cast("long").alias("us"), "user_id", "event_type", "value")


def _floor(p, c):
    return f"list_sort(list({c}))[least(floor({p} * count({c})), count({c}) - 1)::bigint + 1]"


@query(f"select event_type, round(avg(value), 6) as mean, round({_floor(0.5, 'value')}, 6) as p50, round({_floor(0.99, 'value')}, 6) as p99, round({_floor(0.999, 'value')}, 6) as p999 from events where value is not null group by event_type")
def latency_percentiles(spark, sf):
    return rounded(M.latency_summary(_events(spark, sf), "value", ["event_type"]), "mean", "p50", "p99", "p999")


@query("select event_type, round(count(*) * 1e6 / (max(epoch_us(ts)) + 1000 - min(epoch_us(ts))), 9) as qps from events group by event_type")
def qps_by_type(spark, sf):
    e = _events(spark, sf).withColumn("done", F.col("us") + 1000)
    return rounded(M.qps(e, "us", "done", ["event_type"], 1e6), "qps", digits=9)


@query("select user_id as qid, " + ", ".join(f"sum({i + 1} * (event_id % {i + 3})::double) as {s}" for i, s in enumerate(M.STATS)) + " from events group by user_id")
def merge_partition_stats(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("qid"), *(((i + 1) * (F.col("event_id") % (i + 3)).cast("double")).alias(s) for i, s in enumerate(M.STATS)))
    return M.merge_stats(e)


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_samp(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def summary_statistics(spark, sf):
    return rounded(M.summary(_events(spark, sf), "value", ["event_type"]), "mean", "median", "std", "min", "max", "p90", "p95", "p99")


@query("with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by event_type) select event_type, event_id, round(value, 6) as value, round(q1, 6) as q1, round(q3, 6) as q3 from events join q using (event_type) where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)")
def iqr_outliers(spark, sf):
    return rounded(M.iqr_outliers(_events(spark, sf), "value", ["event_type"]).select("event_type", "event_id", "value", "q1", "q3"), "value", "q1", "q3")


#: A made-up recall curve for each user: search-list size, recall and two metrics.
_CURVE = "c as (select l_suppkey as run, l_linenumber as l, avg(l_quantity) / 50 as recall, avg(l_extendedprice) as qps from lineitem group by all)"


def _curve(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("l")).agg((F.avg("l_quantity") / 50).alias("recall"), F.avg("l_extendedprice").alias("qps"))


@query(f"with {_CURVE}, p as (select run, recall, qps, lead(recall) over w as r2, lead(qps) over w as q2 from c window w as (partition by run order by recall, qps)) select run, round(min(case when abs(recall - 0.52) <= 1e-6 then qps when recall < 0.52 and r2 > 0.52 then qps + (0.52 - recall) / (r2 - recall) * (q2 - qps) end), 4) as qps from p group by run")
def interp_at_recall(spark, sf):
    return rounded(M.interpolate_at(_curve(spark, sf), "recall", "qps", 0.52, ["run"]), "qps", digits=4)


@query(f"with {_CURVE}, r as (select run, min(recall) as low, max(recall) as high from c group by run) select run, round(low, 6) as low, round(high, 6) as high, true as said from r where low - 1e-6 > 0.55 or high + 1e-6 < 0.55")
def interp_out_of_range(spark, sf):
    out = M.out_of_range(_curve(spark, sf), "recall", 0.55, ["run"])
    return rounded(out.select("run", "low", "high", F.col("message").startswith("0.5500 is outside").alias("said")), "low", "high")


#: Exact hits of a target, but for rounding: recalls that are multiples of a tenth.
_STEPS = "c as (select l_suppkey as run, l_linenumber * 0.1 + (l_suppkey % 3) * 4e-7 as recall, avg(l_extendedprice) as qps from lineitem group by all)"


@query(f"with {_STEPS}, p as (select run, recall, qps, lead(recall) over w as r2, lead(qps) over w as q2 from c window w as (partition by run order by recall, qps)) select run, round(min(case when abs(recall - 0.3) <= 1e-6 then qps when recall < 0.3 and r2 > 0.3 then qps + (0.3 - recall) / (r2 - recall) * (q2 - qps) end), 3) as qps from p group by run")
def interp_exact_hit(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), (F.col("l_linenumber") * 0.1 + (F.col("l_suppkey") % 3) * 4e-7).alias("recall")).agg(F.avg("l_extendedprice").alias("qps"))
    return rounded(M.interpolate_at(c, "recall", "qps", 0.3, ["run"]), "qps", digits=3)


@query(f"with {_CURVE}, p as (select run, min(struct_pack(o := abs(recall - 0.6), y := qps)) as m from c group by run) select run, case when m.o <= 0.05 then round(m.y, 4) end as qps from p")
def qps_closest(spark, sf):
    return rounded(M.closest_at(_curve(spark, sf), "recall", "qps", 0.6, ["run"]), "qps", digits=4)


@query(f"with {_CURVE} select l, round(avg(recall), 9) as recall, round(avg(qps), 4) as qps from c group by l")
def average_runs(spark, sf):
    return rounded(rounded(M.average_runs(_curve(spark, sf), ["l"], ["recall", "qps"]), "recall", digits=9), "qps", digits=4)


_PAIRS = "e as (select user_id, epoch_us(ts) as us, case event_type when 'click' then 1 when 'purchase' then 2 else 0 end as tag from events where event_type in ('click', 'purchase')), d as (select user_id, us // 86400000000 as day, us, tag from e)"


def _pairs(spark, sf):
    e = _events(spark, sf).where(F.col("event_type").isin("click", "purchase"))
    return e.select("user_id", F.floor(F.col("us") / 86_400_000_000).alias("day"), "us", F.when(F.col("event_type") == "click", 1).otherwise(2).alias("tag"))


@query(f"with {_PAIRS} select user_id, day, max(case when tag = 1 then us end) as start, max(case when tag = 2 then us end) - max(case when tag = 1 then us end) as duration, max(case when tag = 2 then us end) < max(case when tag = 1 then us end) as negative from d group by user_id, day having count(*) = 2 and count(distinct tag) = 2")
def event_durations(spark, sf):
    return M.event_pairs(_pairs(spark, sf), ["user_id", "day"], "tag", "us", 1, 2)


@query(f"with {_PAIRS} select count(*) as malformed from (select 1 from d group by user_id, day having count(*) <> 2 or count(distinct tag) <> 2)")
def event_malformed(spark, sf):
    return M.malformed_pairs(_pairs(spark, sf), ["user_id", "day"], "tag", 1, 2)


@query("with e as (select event_id, user_id, (epoch_us(ts) * 1000) as ns from events), s as (select event_id, user_id, (ns - min(ns) over (partition by user_id)) / 1e9 as seconds from e), k as (select * from s where seconds >= 86400) select event_id, round(seconds - min(seconds) over (partition by user_id), 3) as seconds from k")
def warmup_rebase(spark, sf):
    e = _events(spark, sf).withColumn("ns", F.col("us") * 1000)
    return rounded(M.rebase(e, "ns", ["user_id"], 86_400.0).select("event_id", "seconds"), "seconds", digits=3)


#: Histories: the suppliers of an order's lines, in order.
_HISTORY = "h as (select l_orderkey as qid, list((l_suppkey % 10)::int order by l_linenumber, l_suppkey) as history from lineitem group by l_orderkey)"


def _history(spark, sf):
    s = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(s, lambda x: (x["l_suppkey"] % 10).cast("int")).alias("partition_history"))


@query(f"with {_HISTORY} select unnest(history) as partition_id, count(*) as visits from h group by 1")
def partition_usage(spark, sf):
    return M.partition_usage(_history(spark, sf), "partition_history")


@query(f"with {_HISTORY}, u as (select unnest(history) as partition_id, count(*) as visits from h group by 1) select partition_id, visits from u order by visits desc, partition_id limit 1")
def most_visited_partition(spark, sf):
    return M.most_visited(_history(spark, sf), "partition_history")


@query(f"with {_HISTORY} select qid, round((qid * 3000 + 500000 - qid * 1000) / 1000.0, 6) as e2e_latency_us, round(100.0 / ((qid * 2000 + 500000) / 1000.0) * 100.0, 6) as completion_pct, round((qid % 50) / ((qid * 2000 + 500000) / 1000.0) * 100.0, 6) as io_pct, len(list_distinct(history))::bigint as n_partitions_visited, greatest(0, len(history) - 1)::bigint as inter_partition_hops from h")
def query_history_metrics(spark, sf):
    h = _history(spark, sf).withColumns({"send_timestamp_ns": F.col("qid") * 1000, "receive_timestamp_ns": F.col("qid") * 3000 + 500_000, "completion_time_us": F.lit(100.0), "io_us": (F.col("qid") % 50).cast("double")})
    return rounded(M.history_metrics(h).select("qid", "e2e_latency_us", "completion_pct", "io_pct", "n_partitions_visited", "inter_partition_hops"), "e2e_latency_us", "completion_pct", "io_pct")


@query("with e as (select event_id, user_id, event_type from events), n as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by event_id) as n from e), b as (select *, row_number() over (partition by user_id order by n desc, event_id) as r from n) select user_id, event_type, n as hits from b where r = 1")
def majority_cluster(spark, sf):
    return M.majority(_events(spark, sf), "user_id", "event_type", "event_id")


@query("select event_type as peer, count(*) as depth from events where user_id % 2 = 0 group by event_type")
def peer_queue_depth(spark, sf):
    return M.queue_depths(_events(spark, sf).where("user_id % 2 = 0").withColumnRenamed("event_type", "peer"))


@query("with m as (select event_id as msg_id, case when event_id % 4 = 0 then user_id else 0 end as batch_id from events), x as (select event_id as msg_id, user_id + event_id % 8 as b from events where event_id % 3 = 0) select m.msg_id, case when batch_id = 0 then coalesce(b, 0) else batch_id end as batch_id, batch_id <> 0 and coalesce(b, 0) <> 0 and batch_id <> coalesce(b, 0) as conflict from m left join x using (msg_id)")
def batch_propagation(spark, sf):
    e = _events(spark, sf)
    m = e.select(F.col("event_id").alias("msg_id"), F.when(F.col("event_id") % 4 == 0, F.col("user_id")).otherwise(F.lit(0)).alias("batch_id"))
    return M.propagate_batches(m, e.where("event_id % 3 = 0").select(F.col("event_id").alias("msg_id"), (F.col("user_id") + F.col("event_id") % 8).alias("batch_id")))


@query("with o as (select o_custkey, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as w from orders) select o_custkey, id, w, coalesce(sum(w) over (partition by o_custkey order by id rows between unbounded preceding and 1 preceding), 0)::bigint as prefix from o")
def adjacency_offsets(spark, sf):
    from pyspark.sql.window import Window

    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id")).withColumn("w", F.row_number().over(Window.partitionBy("o_custkey").orderBy("id")).cast("long"))
    return M.prefix_weights(o, "w", ["o_custkey"], exclusive=True)


@query("with p as (select vec_id as id, (vec_id % 17) + 1 as w from embeddings), s as (select *, sum(w) over (order by id) as prefix, sum(w) over () as total from p) select id, w, prefix::bigint as prefix from s where prefix >= total * 0.37 order by id limit 1")
def weight_dart(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 17 + 1).alias("w"))
    return M.dart(v, "w", 0.37)


@query(f"with e as (select value, row_number() over (order by event_id) as r, count(*) over () as n from events), k as (select value from e where r > floor(n * 0.1)) select round({_floor(0.5, 'value')}, 6) as median, round({_floor(0.95, 'value')}, 6) as p95, round(avg(value), 6) as mean from k where value is not null")
def trimmed_latency(spark, sf):
    return rounded(M.trimmed_latency(_events(spark, sf), "value", "event_id"), "median", "p95", "mean")


_RUN = "r as (select l_linenumber::int as l, l_orderkey * 10.0::double as send, l_orderkey * 10.0::double + 100 + l_partkey % 977 as receive, (l_partkey % 13)::double as hops, (l_partkey % 5)::double as inter, (l_partkey % 17)::double as ios, (l_partkey % 301)::double as cmps, (l_suppkey % 101)::double as recall, (100 + l_partkey % 977)::double as lat from lineitem)"


@query(f"with {_RUN} select l as L, round(count(*) * 1e6 / (max(receive) - min(send)), 4) as qps, round(avg(lat), 4) as mean, {_floor(0.5, 'lat')} as p50, {_floor(0.99, 'lat')} as p99, {_floor(0.999, 'lat')} as p999, round(avg(hops), 4) as mean_hops, round(avg(inter), 4) as mean_inter, round(avg(ios), 4) as mean_ios, round(avg(cmps), 4) as mean_cmps, round(avg(recall), 4) as recall from r group by l")
def run_table(spark, sf):
    """The table of a benchmark: a row for each size of the pool."""
    part = lambda n: (F.col("l_partkey") % n).cast("double")
    send = F.col("l_orderkey") * F.lit(10.0)
    r = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("L"), send.alias("send_us"), (send + 100 + F.col("l_partkey") % 977).alias("receive_us"), part(13).alias("n_hops"), part(5).alias("n_inter_partition_hops"), part(17).alias("n_ios"), part(301).alias("n_cmps"), (F.col("l_suppkey") % 101).cast("double").alias("recall"))
    return rounded(M.run_table(r, ["L"]).select("L", "qps", "mean", "p50", "p99", "p999", "mean_hops", "mean_inter", "mean_ios", "mean_cmps", "recall"), "qps", "mean", "mean_hops", "mean_inter", "mean_ios", "mean_cmps", "recall", digits=4)
