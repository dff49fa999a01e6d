"""Readers of run logs: client tables, per-query CSV, counters, events, tagged timestamps. All are text scans and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The columns of the files.
CLIENT = ("L", "beam", "qps", "avg_lat_us", "p999_us", "mean_hops", "mean_inter", "mean_ios", "mean_cmps", "recall_pct")
QUERY = ("query_id", "send_timestamp_ns", "receive_timestamp_ns", "completion_time_us", "io_us", "n_hops", "n_ios", "n_cmps")
PAIRS = tuple((f"BEGIN_{x}", f"END_{x}") for x in ("HANDLER", "DESERIALIZE", "DESERIALIZE_STATE", "DESERIALIZE_VISITED_STATE", "DESERIALIZE_QUERY_EMB", "DESERIALIZE_FULL_RETSET", "DESERIALIZE_RETSET", "PQ_POPULATE", "CREATE_STATE", "ENQUEUE_STATE", "QUERY_MAP_INSERT", "QUERY_MAP_ERASE", "COPY_QUERY_EMB", "DESERIALIZE_QUERY", "ALLOCATE_QUERY", "ALLOCATE_STATE"))
START_END = (("_START", "_END"), ("_SEND", "_RECEIVE"))


def _text(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def client_table(spark: SparkSession, path) -> DataFrame:
    """The rows of numbers in client logs, below the header that names I/O Width and Recall: file, L, beam, ... recall_pct."""
    words = F.split(F.trim("line"), r"\s+")
    number = F.forall("w", lambda x: x.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"))
    rows = _text(spark, path).select("file", words.alias("w")).where((F.size("w") == len(CLIENT)) & number)
    return rows.select("file", *(F.col("w")[i].cast("int" if i < 2 else "double").alias(c) for i, c in enumerate(CLIENT)))


def run_names(name: Column) -> Column:
    """method, dataset, size, servers and beam from a run's folder name; null where it is none."""
    method = F.regexp_extract(name, r"logs_(STATE_SEND|SCATTER_GATHER|SINGLE_SERVER)", 1)
    beam = F.regexp_extract(name, r"BEAMWIDTH_(\d+)", 1)
    data = r"distributed_(\w+)_(\d+[BKMG])"
    servers = F.regexp_extract(name, r"_\d+[BKMG]_(\d+)_\d+_MS", 1)
    ok = (method != "") & (beam != "") & (F.regexp_extract(name, data, 1) != "") & (servers != "")
    return F.when(ok, F.struct(method.alias("method"), F.regexp_extract(name, data, 1).alias("dataset"), F.regexp_extract(name, data, 2).alias("size"), servers.try_cast("int").alias("servers"), beam.try_cast("int").alias("beam")))


def history(text: Column) -> Column:
    """"[0,3,1,]" as integers."""
    return F.transform(F.filter(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x != ""), lambda x: x.cast("int"))


def query_table(spark: SparkSession, path) -> DataFrame:
    """Per-query CSV files (result_L_<L>.csv): L, the numbers, partition_history and partition_history_hop_idx."""
    t = _text(spark, path).where(F.col("line").contains("["))
    plain = F.split(F.regexp_extract("line", r"^([^\[]*),\[", 1), ",")
    lists = F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]"), F.lit(0))
    level = F.regexp_extract("file", r"_(\d+)\.csv$", 1).try_cast("int")
    return t.select(level.alias("L"), *(F.get(plain, F.lit(i)).cast("bigint" if i == 0 else "double").alias(c) for i, c in enumerate(QUERY)), history(F.get(lists, F.lit(0))).alias("partition_history"), history(F.coalesce(F.get(lists, F.lit(1)), F.lit(""))).alias("partition_history_hop_idx"))


def write_query_table(df: DataFrame, path: str) -> None:
    """The same, one file a partition, with a header."""
    bracket = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in QUERY), bracket(F.col("partition_history")), bracket(F.col("partition_history_hop_idx")))
    df.select(line.alias("value")).write.text(path)


def counters(spark: SparkSession, path, warmup_s: float = 30.0) -> DataFrame:
    """Counter CSVs in long form: file, seconds (after the warm-up, from zero), counter, value. Columns differ from file to file only in their numbers of threads and peers."""
    raw = spark.read.option("header", True).csv(path).withColumn("file", F.col("_metadata.file_path"))
    names = [c for c in raw.columns if c not in ("timestamp_ns", "file")]
    w = Window.partitionBy("file")
    t = raw.withColumn("s", (F.col("timestamp_ns").cast("double") - F.min(F.col("timestamp_ns").cast("double")).over(w)) / 1e9).where(F.col("s") >= warmup_s)
    t = t.withColumn("seconds", F.col("s") - F.min("s").over(w)).select("file", "seconds", *(F.col(c).cast("bigint").alias(c) for c in names))
    return t.unpivot(["file", "seconds"], names, "counter", "value").where("value is not null")


def events(spark: SparkSession, path) -> DataFrame:
    """Event logs: file, ts, msg_id, type, action, value (null where the line has none)."""
    p = r"\[(\d+)\]\s+\[(\d+)\]\s+\[(\w+)\]:(\w+)(?:\s+(\d+))?"
    x = lambda i: F.regexp_extract("line", p, i)
    return _text(spark, path).where(F.col("line").rlike(p)).select("file", x(1).cast("bigint").alias("ts"), x(2).cast("bigint").alias("msg_id"), x(3).alias("type"), x(4).alias("action"), x(5).try_cast("bigint").alias("value"))


def event_durations(log: DataFrame, pairs=PAIRS) -> DataFrame:
    """file, msg_id, type, metric, duration, num_msg, visited_state, ts: for each message that has both ends of a pair. A later event of one name replaces an earlier one."""
    last = log.groupBy("file", "msg_id", "type", "action").agg(F.max_by(F.coalesce("value", "ts"), "ts").alias("v"))
    m = last.groupBy("file", "msg_id", "type").agg(F.map_from_entries(F.collect_list(F.struct("action", "v"))).alias("m"))
    every = F.explode(F.array(*(F.struct(F.lit(b.removeprefix("BEGIN_").lower()).alias("metric"), F.lit(b).alias("b"), F.lit(e).alias("e")) for b, e in pairs)))
    t = m.select("file", "msg_id", "type", "m", every.alias("p"))
    get = lambda k: F.try_element_at("m", k)
    return t.select("file", "msg_id", "type", "p.metric", (get(F.col("p.e")) - get(F.col("p.b"))).alias("duration"), get(F.lit("NUM_MSG")).alias("num_msg"), get(F.lit("VISITED_STATE")).alias("visited_state"), get(F.col("p.b")).alias("ts")).where("duration is not null")


def duration_statistics(durations: DataFrame) -> DataFrame:
    """For each type and metric: count, mean, median, min, max and sample deviation in microseconds, and the message counts."""
    us = F.col("duration") / 1e3
    return durations.groupBy("type", "metric").agg(
        F.count("*").alias("n"), F.avg(us).alias("mean_us"), F.median(us).alias("median_us"), F.min(us).alias("min_us"), F.max(us).alias("max_us"), F.stddev_samp(us).alias("std_us"), F.avg("num_msg").alias("mean_num_msg"), F.median("num_msg").alias("median_num_msg"), F.min("num_msg").alias("min_num_msg"), F.max("num_msg").alias("max_num_msg")
    )


def tagged(spark: SparkSession, path) -> DataFrame:
    """Tagged timestamp logs (tag, time in ns, client, message, extra): times in microseconds; ok is false where the message id is no number."""
    t = _text(spark, path).where(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file", F.split(F.trim("line"), r"\s+").alias("w"))
    u = lambda i: F.get("w", F.lit(i)).try_cast("decimal(20,0)")
    return t.select("file", u(0).cast("bigint").alias("tag"), (F.get("w", F.lit(1)).try_cast("double") / 1000).alias("us"), u(2).cast("bigint").alias("client_node_id"), u(3).alias("msg_id"), u(4).alias("extra"), u(3).isNotNull().alias("ok"))


def tag_dictionary(spark: SparkSession, path) -> DataFrame:
    """tag_name, tag_value, msg_id_type."""
    return spark.read.option("header", True).option("comment", "#").schema("tag_name string, tag_value int, msg_id_type string").csv(path)


def tag_pairs(tags: DataFrame) -> DataFrame:
    """start, end (tag values) and msg_id_type of names that differ in a start and an end suffix alone."""
    stem = None
    for i, (s, e) in enumerate(START_END):
        for suffix, side in ((s, "start"), (e, "end")):
            hit = F.col("tag_name").endswith(suffix)
            v = F.struct(F.concat(F.expr(f"substr(tag_name, 1, length(tag_name) - {len(suffix)})"), F.lit(f"#{i}")).alias("stem"), F.lit(side).alias("side"))
            stem = F.when(hit, v) if stem is None else stem.when(hit, v)
    t = tags.select("tag_value", "msg_id_type", stem.alias("s")).where("s is not null")
    of = lambda side: F.max(F.when(F.col("s.side") == side, F.col("tag_value")))
    g = t.groupBy("s.stem").agg(of("start").alias("start"), of("end").alias("end"), F.max(F.when(F.col("s.side") == "start", F.col("msg_id_type"))).alias("msg_id_type"))
    return g.where("start is not null and end is not null").select("start", "end", "msg_id_type")


def with_ids(log: DataFrame, tags: DataFrame) -> DataFrame:
    """query_id, node_id and batch_id by what the tag says the message id is: the dictionary is a small table."""
    t = log.join(F.broadcast(tags.select(F.col("tag_value").alias("_t"), F.col("msg_id_type").alias("_k"))), F.col("tag") == F.col("_t"), "left")
    base = F.lit(4294967296).cast("decimal(20,0)")
    m = F.col("msg_id")
    node = F.pmod(m, base)
    both = F.col("_k").isin("query_id_and_node_id", "not_query_id_and_node_id")
    return t.withColumns({"query_id": F.when(F.col("_k") == "query_id", m.cast("bigint")).when(both, ((m - node) / base).cast("bigint")), "node_id": F.when(both, node.cast("bigint")), "batch_id": F.when(F.col("_k") == "batch_id", m.cast("bigint"))}).drop("_t", "_k")
