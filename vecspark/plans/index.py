"""An index as a folder of tables: build it, open it, search it."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import prep
from vecspark.functions.distance import Metric, matrix, metric
from vecspark.operators import cluster, graph, knn, pq, search
from vecspark.operators.graph import BuildParams
from vecspark.operators.search import SearchParams
from vecspark.runtime import stored

MODES = ("single", "full_precision", "scatter", "scatter_top_n", "state_send", "client_gather", "coordinator")
#: The head goes to every task that starts queries, and a graph of up to so many rows is built by one task.
HEAD_BYTES, SHARD_ROWS = 256 << 20, 50_000
#: Tables that an index may have.
OPTIONAL = ("head", "deleted", "tags")


@dataclass
class Index:
    spark: SparkSession
    metric: Metric
    nodes: DataFrame  # the global graph: vecspark.operators.search.NODES
    local: DataFrame  # a graph inside each partition, same columns
    entries: DataFrame  # partition_id, id: where a local search starts
    medoids: DataFrame  # partition_id, vec
    book: pq.Codebook
    entry: int
    max_norm: float
    head: DataFrame | None = None  # id, vec, nbrs, entry: a graph over a sample, where queries find their seeds
    deleted: DataFrame | None = None  # id: answers leave them out, paths still lead through them
    tags: DataFrame | None = None  # id, tag: names that answers get
    _files: search.Files | None = None
    _local_files: search.Files | None = None
    _whole: object = None
    _seeds: search.Seeds | None = None

    @classmethod
    def build(cls, df: DataFrame, partitions: int | DataFrame, name: str | Metric = "l2", chunks: int = 32, p: BuildParams = BuildParams(), shards: int | None = None, head_share: float = 0.05, slack: float = 0.05, head_levels: bool = False) -> Index:
        """From vectors (id, vec): prepare for the metric, train and encode, assign homes (or take them: id, partition_id), build the graphs.

        The global graph is built in overlapping shards of at most some SHARD_ROWS, merged and connected, or at once if one shard
        holds all; local graphs are built partition by partition. A graph over a sample (head) gives each query its seeds
        if head_share is above 0; with head_levels it is over the levels of links around the entry instead."""
        m, spark, norm = metric(name), df.sparkSession, 1.0
        base = df.select("id", F.col("vec").cast("array<double>").alias("vec"))
        if m is Metric.MIPS:
            base, norm = prep.augment(base, "vec")
        elif m is Metric.COSINE:
            base = base.withColumn("vec", prep.normalize(F.col("vec")))
        base = stored(base, "vectors")
        entry = cluster.entry_point(base).first().id
        book = pq.train(base, min(chunks, len(base.select("vec").first()[0])))
        codes = stored(pq.encode(base, book), "codes")
        homes = cluster.balanced(base, partitions, slack) if isinstance(partitions, int) else partitions
        homes = stored(homes.select("id", F.col("partition_id").cast("int").alias("partition_id")), "homes")
        if shards is None:
            shards = -(-2 * base.count() // SHARD_ROWS) if base.count() > SHARD_ROWS else 1  # each row has two shards
        if shards > 1:
            # merging cuts lists, so that nodes may be lost
            links = graph.connected(stored(graph.merged_build(base, shards, p).select("id", "nbrs"), "merged"), base, entry, p.degree)
        else:
            links = graph.build_shards(base.withColumn("shard", F.lit(0)), "shard", p).select("id", "nbrs")
        nodes = stored(search.node_table(base, links, codes, homes), "nodes")
        own = stored(graph.build_shards(base.join(homes, "id"), "partition_id", p), "local-graphs")
        local = stored(search.node_table(base, own.select("id", "nbrs"), codes, homes), "local-nodes")
        entries = stored(own.where("entry").select("partition_id", "id"), "entries")
        medoids = stored(base.join(cluster.medoids(base.join(homes, "id"), "partition_id"), "id").select("partition_id", "vec"), "medoids")
        head = None
        if head_share:
            some = cluster.sample(base, head_share, 7)
            if head_levels:
                some = base.join(graph.head_nodes(links, spark.createDataFrame([(entry,)], "id long"), head_share), "id", "left_semi")
            if some.limit(1).count():
                head = stored(graph.build_shards(some.withColumn("shard", F.lit(0)), "shard", BuildParams(min(32, p.degree), 64)).drop("shard"), "head")
        return cls(spark, m, nodes, local, entries, medoids, book, entry, norm, head)

    def save(self, folder: str) -> None:
        self.nodes.repartition("partition_id").sortWithinPartitions("id").write.partitionBy("partition_id").parquet(f"{folder}/nodes")
        self.local.repartition("partition_id").sortWithinPartitions("id").write.partitionBy("partition_id").parquet(f"{folder}/local")
        self.entries.coalesce(1).write.parquet(f"{folder}/entries")
        self.medoids.coalesce(1).write.parquet(f"{folder}/medoids")
        self.book.frame(self.spark).coalesce(1).write.parquet(f"{folder}/codebook")
        for name in OPTIONAL:
            if (t := getattr(self, name)) is not None:
                t.write.parquet(f"{folder}/{name}")
        meta = {"metric": self.metric.value, "entry": int(self.entry), "max_norm": float(self.max_norm), "centroid": [float(x) for x in self.book.centroid], "format": 2, "tables": [n for n in OPTIONAL if getattr(self, n) is not None]}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{folder}/meta")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
        if meta.get("format") != 2:
            raise ValueError(f"{folder} is no index of this version")
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        nodes = read("nodes").withColumn("partition_id", F.col("partition_id").cast("int"))
        local = read("local").withColumn("partition_id", F.col("partition_id").cast("int"))
        return cls(spark, metric(meta["metric"]), nodes, local, read("entries"), read("medoids"), pq.Codebook.of(meta["centroid"], read("codebook")), meta["entry"], meta["max_norm"], **{n: read(n) for n in meta["tables"]})

    def check(self) -> None:
        """Every node has a home and codes, every link leads to a node, the entry is there."""
        ids = self.nodes.select(F.col("id").alias("n"))
        lost = self.nodes.select(F.explode("nbrs").alias("n")).distinct().join(ids, "n", "left_anti").limit(1).count()
        if lost or self.nodes.where(F.col("partition_id").isNull() | (F.size("codes") != self.book.chunks)).limit(1).count() or not self.nodes.where(F.col("id") == self.entry).count():
            raise ValueError("the index is inconsistent")

    def prepare(self, queries: DataFrame) -> DataFrame:
        """Queries (qid, vec) as the index holds its vectors."""
        return queries.select("qid", prep.prepare_query(F.col("vec").cast("array<double>"), self.metric).alias("vec"))

    def files(self) -> search.Files:
        """The global graph as partitions' files, laid out once."""
        self._files = self._files or search.laid_out(self.nodes)
        return self._files

    def local_files(self) -> search.Files:
        """The partitions' own graphs the same way."""
        self._local_files = self._local_files or search.laid_out(self.local)
        return self._local_files

    def whole(self):
        """The whole graph as every task of the modes in one place needs it, sent once."""
        self._whole = self._whole or search.whole(self.nodes, self.book, self.seeds())
        return self._whole

    def seeds(self) -> search.Seeds:
        """Where global searches start: the head's nodes nearest to each query, or the entry if there is no head."""
        if self._seeds is None:
            codes = self.nodes.select("id", "codes", "partition_id")
            if self.head is None:
                t = codes.where(F.col("id") == self.entry).toArrow()
                self._seeds = search.Seeds(t["id"].to_numpy(), matrix(t["codes"], np.int64), t["partition_id"].to_numpy().astype(np.int64))
            else:
                n, dim, degree = self.head.agg(F.count("*"), F.max(F.size("vec")), F.max(F.size("nbrs"))).first()
                if n * 8 * (dim + degree + self.book.chunks) > HEAD_BYTES:
                    raise ValueError("the head doesn't fit a worker: build the index with a smaller share")
                t = self.head.join(codes, "id").orderBy("id").toArrow()
                ids = t["id"].to_numpy()
                links = graph.padded([np.searchsorted(ids, n) for n in t["nbrs"].to_pylist()])
                self._seeds = search.Seeds(ids, matrix(t["codes"], np.int64), t["partition_id"].to_numpy().astype(np.int64), matrix(t["vec"]), links, int(t["entry"].to_numpy(zero_copy_only=False).argmax()))
        return self._seeds

    # --- changes ---------------------------------------------------------------------------------------------------

    def delete(self, ids: DataFrame) -> Index:
        """Lazy: answers leave these ids out; unknown ones don't matter."""
        none = self.spark.createDataFrame([], "id long")
        return replace(self, deleted=stored(graph.delete(self.deleted or none, ids, self.nodes), "deleted"))

    def consolidated(self, p: BuildParams = BuildParams(), compact: bool = False) -> Index:
        """An index without the deleted ids, its links repaired; the entry anew, a head of what is left. As repairs and cuts lose nodes, the entry leads to every node again, and the head to the entry. compact: ids from 0 on without gaps, in the old ones' order; tags keep the names."""
        gone = self.deleted if self.deleted is not None else self.spark.createDataFrame([], "id long")
        kept = lambda t: t.join(gone.select("id"), "id", "left_anti")
        vectors, codes, homes = (stored(kept(self.nodes).select("id", c), f"kept-{c}") for c in ("vec", "codes", "partition_id"))
        graphs = {n: stored(graph.consolidate(getattr(self, n).select("id", "vec", "nbrs"), gone, p).select("id", "nbrs"), f"{n}-links") for n in ("nodes", "local")}
        head = None if self.head is None else kept(self.head).select("id")
        entry = cluster.entry_point(vectors).first().id
        if head is not None:
            graphs["nodes"] = graph.rooted(graphs["nodes"], vectors, entry, head)
        graphs["nodes"] = graph.connected(graphs["nodes"], vectors, entry, p.degree)
        entries = kept(self.entries)
        lost = self.entries.join(entries, "partition_id", "left_anti").select("partition_id")
        centre = cluster.medoids(vectors.join(homes, "id").join(lost, "partition_id"), "partition_id").select("partition_id", "id")
        entries = stored(entries.select("partition_id", "id").unionByName(centre), "entries")
        whole = graphs["local"].join(vectors, "id").join(homes, "id")
        graphs["local"] = stored(graph.reconnected(whole, entries, p.degree), "local-links")
        tags = kept(self.tags) if self.tags is not None else None
        if compact:
            named = stored(_dense(vectors.select("id")), "names")
            name = lambda t, c="id": t.join(named.select(F.col("id").alias(c), "new"), c).drop(c).withColumnRenamed("new", c)
            tags = stored(name(tags if tags is not None else vectors.select("id", F.col("id").alias("tag"))), "tags")
            vectors, codes, homes, entries = (stored(name(t), "renamed") for t in (vectors, codes, homes, entries))
            for k, g in graphs.items():
                edges = name(name(g.select("id", F.posexplode("nbrs").alias("p", "n"))), "n").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("e"))
                graphs[k] = stored(vectors.select("id").join(edges, "id", "left").select("id", F.coalesce(F.transform("e", lambda x: x["n"]), F.array().cast("array<long>")).alias("nbrs")), f"{k}-links")
            head = name(head) if head is not None else None
            entry = None if entry is None else named.where(F.col("id") == entry).first().new
        nodes = stored(search.node_table(vectors, graphs["nodes"], codes, homes), "nodes")
        local = stored(search.node_table(vectors, graphs["local"], codes, homes), "local-nodes")
        if head is not None:
            head = stored(graph.build_shards(head.join(vectors, "id").withColumn("shard", F.lit(0)), "shard", BuildParams(min(32, p.degree), 64)).drop("shard"), "head")
        return Index(self.spark, self.metric, nodes, local, entries, self.medoids, self.book, entry, self.max_norm, head, None, tags)

    # --- search ----------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int = 10, size: int = 64, beam: int = 4, mode: str = "state_send", top_n: int = 2, seeds: int = 10, round_robin: bool = False, moves: bool | None = None) -> DataFrame:
        """qid, id, dist (exact squared L2 as the index holds vectors), hops, ios, cmps, inter_hops, history; for mips also inner (the inner product of the original vectors, for a query of unit norm); with tags also tag.

        Deleted ids are searched through and left out of the answers: all that a search has expanded is looked at for k others."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
        q, p = self.prepare(queries), SearchParams(k if self.deleted is None else max(k, size), size, beam, seeds)
        at = getattr(self.deleted, "_stored_at", None)
        if at and (mode not in ("state_send", "client_gather", "coordinator") or not (moves and mode != "coordinator") and search.mapped(self.files())) and size >= self.nodes.count():
            p = replace(p, k=k, gone=at)  # all is expanded, and workers leave them out themselves
        if mode in ("single", "full_precision"):
            found = search.single(q, self.whole(), p, exact=mode == "full_precision")
        elif mode == "scatter":
            found = search.scatter(q, self.local_files(), self.entries, self.book, p)
        elif mode == "scatter_top_n":
            found = search.scatter(q, self.local_files(), self.entries, self.book, p, knn.route(q, self.medoids, top_n))
        elif mode == "coordinator":
            found = search.coordinator(q, self.nodes, self.book, self.seeds(), p, self.files() if size >= self.nodes.count() else None)
        else:
            found = search.state_send(q, self.nodes, self.book, self.seeds(), p, mode == "client_gather", self.files(), round_robin, moves)
        if self.deleted is not None:
            found = knn.ranked(found.join(self.deleted.select("id"), "id", "left_anti"), k).select(*found.columns)
        if self.metric is Metric.MIPS:
            # |a - b|^2 = 2 - 2 a.b for unit vectors; b is the original divided by the largest norm
            found = found.withColumn("inner", (1 - F.col("dist") / 2) * F.lit(self.max_norm))
        if self.tags is not None:
            found = found.join(self.tags.select("id", "tag"), "id", "left")
        return found


def _dense(ids: DataFrame) -> DataFrame:
    """(id, new): new counts from 0 in the order of id. Ranks come from counts of ranges, so no task orders all rows."""
    from vecspark.operators.metrics import prefix_weights

    return prefix_weights(ids.withColumn("w", F.lit(1).cast("long")), "w", exclusive=True).select("id", F.col("prefix").cast("long").alias("new"))
