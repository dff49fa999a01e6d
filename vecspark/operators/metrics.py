"""Evaluation: statistics of runs, interpolation at a recall, event pairs and the tables behind plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATS = ("total_us", "n_4k", "n_ios", "io_us", "head_us", "cpu_us", "n_cmps", "n_hops", "n_inter_partition_hops")


def mean(column: str) -> Column:
    return F.avg(column)


def floor_percentile(df: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """sorted[floor(share * n)] for each name, without interpolation.

    Exact, and no task sorts a whole group: approximate quantiles cut each group into some hundred brackets, exact counts
    of the brackets say which one holds the wanted place, and only its rows are ranked. A bracket of one value needs no
    ranking, so a value that a third of the rows have is no burden."""
    by = by or []
    d = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    cuts = F.percentile_approx("_v", F.array(*(F.lit(i / 256) for i in range(1, 256))), F.lit(10_000)).alias("_cuts")
    bounds = d.groupBy(*by).agg(cuts, F.count("*").alias("_n"))
    rows = d.join(bounds, by) if by else d.join(F.broadcast(bounds))
    below = lambda cuts: F.size(F.filter(cuts, lambda x: x < F.col("_v")))
    sixteenth = below(F.transform(F.sequence(F.lit(16), F.lit(240), F.lit(16)), lambda i: F.element_at("_cuts", i)))  # of the 255 cuts first every sixteenth
    rows = rows.withColumn("_s", sixteenth).select(*by, "_v", "_n", (F.col("_s") * 16 + below(F.slice("_cuts", F.col("_s") * 16 + 1, F.lit(15)))).alias("_b"))
    count = rows.groupBy(*by, "_b", "_n").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # some hundred rows a group
    before = F.sum("_c").over(w.orderBy("_b")) - F.col("_c")
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in shares.items())))
    place = F.least(F.floor(F.col("_s.p") * F.col("_n")) + 1, F.col("_n")) - F.col("_before")
    at = count.withColumn("_before", before).select(*by, "_b", "_c", "_low", "_high", "_n", "_before", wanted.alias("_s")).withColumn("_k", place).where("_k between 1 and _c")
    plain = at.where("_low = _high").select(*by, F.col("_s.name").alias("_name"), F.col("_low").alias("_v"))
    mixed = at.where("_low < _high").select(*by, "_b", F.col("_s.name").alias("_name"), "_k")
    r = rows.drop("_n").join(mixed, [*by, "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_name").orderBy("_v")))
    found = plain.unionByName(r.where("_r = _k").select(*by, "_name", "_v"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in shares))


def latency_summary(df: DataFrame, column: str = "latency_us", by: list[str] | None = None) -> DataFrame:
    """Mean, p50, p99 and p999, each under its own name."""
    p = floor_percentile(df, column, {"p50": 0.5, "p99": 0.99, "p999": 0.999}, by)
    m = df.groupBy(*(by or [])).agg(F.avg(column).alias("mean"))
    return p.join(m, by) if by else p.join(F.broadcast(m))


def qps(df: DataFrame, send: str, receive: str, by: list[str] | None = None, per_second: float = 1e9) -> DataFrame:
    """Queries a second between the first send and the last receipt."""
    return df.groupBy(*(by or [])).agg((F.count("*") * F.lit(per_second) / (F.max(receive) - F.min(send))).alias("qps"))


def merge_stats(df: DataFrame, stats=STATS) -> DataFrame:
    """The statistics of a query's partitions, summed; inter-partition hops too."""
    return df.groupBy("qid").agg(*(F.sum(s).alias(s) for s in stats))


def summary(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, median, std (sample), min, max and interpolated p90, p95, p99."""
    q = lambda p, name: F.percentile(column, F.lit(p)).alias(name)
    return df.groupBy(*(by or [])).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), q(0.5, "median"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), q(0.9, "p90"), q(0.95, "p95"), q(0.99, "p99"))


def iqr_outliers(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges of the quartiles of their group."""
    q = df.groupBy(*by).agg(F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"))
    c, spread = F.col(column), 1.5 * (F.col("q3") - F.col("q1"))
    return df.join(q, by).where((c < F.col("q1") - spread) | (c > F.col("q3") + spread))


#: How far a point may lie from a target and still be at it.
AT = 1e-6


def interpolate_at(df: DataFrame, x: str, y: str, target: float, by: list[str]) -> DataFrame:
    """y where x reaches the target, linear between neighbouring points; null outside their range (out_of_range says why). A point at the target (to AT) counts as it is."""
    s = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    w = Window.partitionBy(*by).orderBy("x", "y")
    p = s.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    at = F.when(F.abs(F.col("x") - target) <= AT, F.col("y")).when((F.col("x") < target) & (F.col("x2") > target), F.col("y") + (target - F.col("x")) / (F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y")))
    return p.groupBy(*by).agg(F.min(at).alias(y))


def out_of_range(df: DataFrame, x: str, target: float, by: list[str]) -> DataFrame:
    """Groups that don't reach the target, or begin above it: low, high and a message."""
    r = df.groupBy(*by).agg(F.min(x).cast("double").alias("low"), F.max(x).cast("double").alias("high"))
    out = r.where((F.col("low") - AT > target) | (F.col("high") + AT < target))
    return out.withColumn("message", F.format_string("%.4f is outside %.4f to %.4f", F.lit(float(target)), "low", "high"))


def closest_at(df: DataFrame, x: str, y: str, target: float, by: list[str], within: float = 0.05) -> DataFrame:
    """y of the point whose x is closest to the target, null if that is further than `within`."""
    off = F.abs(F.col(x) - target)
    near = df.groupBy(*by).agg(F.min(F.struct(off.alias("off"), F.col(y).alias("y"))).alias("m"))
    return near.select(*by, F.when(F.col("m.off") <= within, F.col("m.y")).alias(y))


def average_runs(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Repeated runs of one setting, averaged."""
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))


def rebase(df: DataFrame, ts: str, by: list[str], warmup_s: float = 30.0) -> DataFrame:
    """seconds since the first sample, without the warm-up, from zero again. ts is in nanoseconds."""
    w = Window.partitionBy(*by)
    t = df.withColumn("seconds", (F.col(ts) - F.min(ts).over(w)) / 1e9).where(F.col("seconds") >= warmup_s)
    return t.withColumn("seconds", F.col("seconds") - F.min("seconds").over(w))


def prefix_weights(df: DataFrame, weight: str, by: list[str] | None = None, order: str = "id", exclusive: bool = False, buckets: int = 1024) -> DataFrame:
    """Running sums in the order of an integer column: adjacency offsets (exclusive) or the scale for a dart (inclusive).

    Over a whole table the order is cut into ranges, whose sums (one row each) come first: no task sums all rows."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        return df.withColumn("prefix", F.coalesce(F.sum(weight).over(w), F.lit(0)))
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df.withColumn("prefix", F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // buckets))
    d = df.withColumn("_b", F.floor((F.col(order) - F.lit(low)) / F.lit(width)).cast("int"))
    total, before = 0, {}
    for b, s in sorted((r[0], r[1] or 0) for r in d.groupBy("_b").agg(F.sum(weight)).collect()):
        before[b] = total
        total += s
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_b"))
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return d.withColumn("prefix", F.coalesce(F.sum(weight).over(w), F.lit(0)) + offset).drop("_b")


def dart(df: DataFrame, weight: str, share: float, order: str = "id") -> DataFrame:
    """The first row whose running weight reaches the share of the total."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return prefix_weights(df, weight, order=order).where(F.col("prefix") >= F.lit(total * share)).orderBy(order).limit(1)


def degree_stats(graph: DataFrame) -> DataFrame:
    """Of a graph (id, nbrs): the largest, mean and least degree, and nodes with fewer than two."""
    d = F.size("nbrs")
    return graph.agg(F.max(d).cast("long").alias("max_degree"), F.avg(d).alias("avg_degree"), F.min(d).cast("long").alias("min_degree"), F.sum((d < 2).cast("long")).alias("few"))


def majority(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The value with most hits for each group; of equals the one that got there first in the given order."""
    w = Window.partitionBy(by, value).orderBy(order)
    n = df.withColumn("_n", F.row_number().over(w))
    best = Window.partitionBy(by).orderBy(F.desc("_n"), order)
    return n.withColumn("_b", F.row_number().over(best)).where("_b = 1").select(by, value, F.col("_n").cast("long").alias("hits"))


def partition_usage(df: DataFrame, history: str) -> DataFrame:
    """How often each partition was visited."""
    return df.select(F.explode(history).alias("partition_id")).groupBy("partition_id").agg(F.count("*").alias("visits"))


def most_visited(df: DataFrame, history: str) -> DataFrame:
    u = partition_usage(df, history)
    return u.agg(F.min(F.struct((-F.col("visits")).alias("v"), "partition_id")).alias("m")).select("m.partition_id", (-F.col("m.v")).alias("visits"))


def history_metrics(df: DataFrame) -> DataFrame:
    """What a per-query row says about its time and its way through the partitions."""
    e2e = (F.col("receive_timestamp_ns") - F.col("send_timestamp_ns")) / 1000.0
    return df.withColumn("e2e_latency_us", e2e).withColumns(
        {
            "completion_pct": F.col("completion_time_us") / F.col("e2e_latency_us") * 100.0,
            "io_pct": F.col("io_us") / F.col("e2e_latency_us") * 100.0,
            "n_partitions_visited": F.size(F.array_distinct("partition_history")).cast("long"),
            "inter_partition_hops": F.greatest(F.lit(0), F.size("partition_history") - 1).cast("long"),
        }
    )


def event_pairs(events: DataFrame, keys: list[str], tag: str, ts: str, start, end) -> DataFrame:
    """Durations between a start and an end event of a key. Keys with anything but one of each are left out (malformed counts them); negative durations stay and are marked."""
    of = lambda v: F.max(F.when(F.col(tag) == v, F.col(ts)))
    g = events.where(F.col(tag).isin(start, end)).groupBy(*keys).agg(F.count("*").alias("_n"), F.countDistinct(tag).alias("_tags"), of(start).alias("start"), of(end).alias("end"))
    return g.where((F.col("_n") == 2) & (F.col("_tags") == 2)).select(*keys, "start", (F.col("end") - F.col("start")).alias("duration"), (F.col("end") < F.col("start")).alias("negative"))


def malformed_pairs(events: DataFrame, keys: list[str], tag: str, start, end) -> DataFrame:
    g = events.where(F.col(tag).isin(start, end)).groupBy(*keys).agg(F.count("*").alias("_n"), F.countDistinct(tag).alias("_tags"))
    return g.agg(F.sum(((F.col("_n") != 2) | (F.col("_tags") != 2)).cast("long")).alias("malformed"))


def propagate_batches(messages: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_id filled from batches (msg_id, batch_id) where it is zero or null; conflict marks rows that had another one."""
    b = batches.select(F.col("msg_id").alias("_m"), F.col("batch_id").alias("_b"))
    old, new = F.coalesce("batch_id", F.lit(0)), F.coalesce("_b", F.lit(0))
    joined = messages.join(b, F.col("msg_id") == F.col("_m"), "left")
    return joined.withColumn("conflict", (old != 0) & (new != 0) & (old != new)).withColumn("batch_id", F.when(old == 0, new).otherwise(old)).drop("_m", "_b")


def queue_depths(pending: DataFrame, peer: str = "peer") -> DataFrame:
    return pending.groupBy(peer).agg(F.count("*").alias("depth"))


def trimmed_latency(df: DataFrame, column: str, order: str, drop_share: float = 0.1) -> DataFrame:
    """Mean, median (sorted[n / 2]) and p95 without the first share of the queries in the order they were sent (a column without ties)."""
    first = floor_percentile(df, order, {"_from": drop_share})
    kept = df.join(F.broadcast(first)).where(F.col(order) >= F.col("_from"))
    p = floor_percentile(kept, column, {"median": 0.5, "p95": 0.95})
    return p.join(F.broadcast(kept.agg(F.avg(column).alias("mean"))))


def run_table(df: DataFrame, by: list[str]) -> DataFrame:
    """One row for each setting of a run: QPS, latency, hops, inter-partition hops, I/Os, comparisons and recall, as the benchmark prints them."""
    q = qps(df, "send_us", "receive_us", by, 1e6)
    lat = latency_summary(df.withColumn("latency_us", F.col("receive_us") - F.col("send_us")), "latency_us", by)
    m = df.groupBy(*by).agg(F.avg("n_hops").alias("mean_hops"), F.avg("n_inter_partition_hops").alias("mean_inter"), F.avg("n_ios").alias("mean_ios"), F.avg("n_cmps").alias("mean_cmps"), F.avg("recall").alias("recall"))
    return q.join(lat, by).join(m, by)
