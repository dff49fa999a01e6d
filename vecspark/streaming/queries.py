"""Streams of queries and of partial results.

Queries arrive as files or from a rate source; a micro-batch of them is searched as a batch. Partial results of several
partitions are gathered by state: a query is complete when as many parts have come as it says, and late or repeated
parts are ignored."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from vecspark.runtime import settings

VECTORS = "qid long, vec array<double>, sent timestamp"
PARTS = "qid long, part int, parts int, ids array<long>, dists array<double>, at timestamp"
DONE = "qid long, rank long, id long, dist double, parts int"


def query_files(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Open-loop arrivals: parquet files of queries, so many a trigger."""
    return spark.readStream.schema(VECTORS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def query_rate(spark: SparkSession, vectors: DataFrame, per_second: int) -> DataFrame:
    """So many queries a second, taken in turn from a table of vectors (qid 0 to n - 1, vec), joined on the way."""
    n = vectors.count()
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return r.select(F.col("value").alias("arrival"), F.col("timestamp").alias("sent"), F.pmod("value", F.lit(n)).alias("qid")).join(vectors, "qid")


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Search each micro-batch and write its answers to a folder of its own, so that a batch that is repeated replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        search(df.dropDuplicates(["qid"])).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def without_late(parts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Parts once each; what comes more than the delay after the rest is dropped."""
    return parts.withWatermark("at", delay).dropDuplicatesWithinWatermark(["qid", "part"])


class Gather(StatefulProcessor):
    """Keeps a query's best k until all of its parts have come."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "seen array<int>, ids array<long>, dists array<double>, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, ids, dists, done = self.best.get() if self.best.exists() else ([], [], [], False)
        pool = dict(zip(ids, dists))
        seen, need = set(seen), 0
        for df in rows:
            for r in df.itertuples():
                if done or r.part in seen:
                    continue
                seen.add(int(r.part))
                need = int(r.parts)
                for i, d in zip(r.ids, r.dists):
                    pool[int(i)] = min(float(d), pool.get(int(i), float("inf")))
        top = sorted(((d, i) for i, d in pool.items()))[: self.k]
        ready = not done and need and len(seen) >= need
        self.best.update((sorted(seen), [i for _, i in top], [d for d, _ in top], bool(done or ready)))
        if ready:
            yield pd.DataFrame({"qid": [key[0]] * len(top), "rank": range(1, len(top) + 1), "id": [i for _, i in top], "dist": [d for d, _ in top], "parts": [len(seen)] * len(top)})

    def close(self) -> None:
        pass


def gather_stream(parts: DataFrame, k: int) -> DataFrame:
    """Top k of each query, once all of its parts are there."""
    return parts.groupBy("qid").transformWithStateInPandas(statefulProcessor=Gather(k), outputStructType=DONE, outputMode="Append", timeMode="None")


#: Folders by query that parts are kept in; a batch reads those of its own queries.
BUCKETS = 64


def gather_batches(parts: DataFrame, k: int, sink: str, checkpoint: str) -> StreamingQuery:
    """The same without state in the engine, for state stores that don't support it: parts are kept in a folder, and a query that has become complete in a batch is merged then."""
    from vecspark.operators.knn import merge

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        placed = df.withColumn("bucket", F.pmod(F.xxhash64("qid"), F.lit(BUCKETS)).cast("int"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/parts/batch={number}")
        mine = [r.bucket for r in placed.select("bucket").distinct().collect()]
        kept = spark.read.schema(PARTS + ", batch long, bucket int").option("basePath", f"{sink}/parts").parquet(f"{sink}/parts").where((F.col("batch") <= number) & F.col("bucket").isin(mine)).drop("bucket")
        here = df.select("qid").distinct()
        all_ = kept.join(here, "qid").dropDuplicates(["qid", "part"])
        ready = all_.groupBy("qid").agg(F.count("*").alias("n"), F.max("parts").alias("parts")).where("n >= parts")
        before = kept.where(F.col("batch") < number).dropDuplicates(["qid", "part"]).groupBy("qid").agg(F.count("*").alias("n"), F.max("parts").alias("p")).where("n >= p").select("qid")
        ready = ready.join(before, "qid", "left_anti").select("qid", "parts")
        rows = all_.drop("parts").join(ready, "qid").select("qid", "parts", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("dists").alias("dist"))).alias("e"))
        top = merge(rows.select("qid", "e.id", "e.dist"), k)
        top.join(ready, "qid").select("qid", "rank", "id", "dist", "parts").write.mode("overwrite").parquet(f"{sink}/done/batch={number}")

    return parts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waiting(queries: DataFrame, vectors: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Work that comes before or after its query's vector waits for it: both streams have sent and at, which may differ by the delay."""
    q = queries.withWatermark("at", delay).alias("q")
    v = vectors.withWatermark("sent", delay).alias("v")
    near = F.expr(f"q.at BETWEEN v.sent - INTERVAL {delay} AND v.sent + INTERVAL {delay}")
    return q.join(v, (F.col("q.qid") == F.col("v.qid")) & near).select("q.*", "v.vec")


#: States on the workers' disks, written as changes: their size isn't bound by an executor's memory.
STATES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def to_files(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream whose input is there gives, as files in a folder of the shared store: no row passes the driver, and a batch that is repeated replaces itself."""
    spark = stream.sparkSession
    with settings(spark, STATES):
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def counter_windows(events: DataFrame, ts: str = "ts", width: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Counts and sums of samples in tumbling windows, once each is past the delay."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), "counter").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class Counters(StreamingQueryListener):
    """A sample of every stream's state after each batch, as rows of (stream, batch, rows, rows a second, milliseconds, time)."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, float, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond, p.batchDuration, time.time_ns()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stream string, batch long, rows long, rows_per_second double, milliseconds long, timestamp_ns long")

    def write(self, spark: SparkSession, path: str) -> None:
        """The samples as a counter CSV with a header, as vecspark.sources.logs.counters reads it."""
        f = self.frame(spark).select("timestamp_ns", "batch", "rows", F.col("rows_per_second").cast("long").alias("rows_per_second"), "milliseconds")
        f.coalesce(1).write.option("header", True).csv(path)
