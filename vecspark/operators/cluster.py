"""Sampling, clustering and partitioning of vectors (id, vec)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.functions.distance import l2sq, matrix, pairwise, to_rows
from vecspark.functions.prep import MODULUS, portable_hash, ram_estimate
from vecspark.runtime import stored

# --- sampling ------------------------------------------------------------------------------------------------------


def sample(df: DataFrame, share: float, salt: int = 0) -> DataFrame:
    """The rows whose hash is below the share: the same ones every time, none if there are none."""
    return df.where(portable_hash(F.col("id"), salt) < int(share * MODULUS))


def random_rows(df: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """n rows in hash order: distinct pivots."""
    return df.orderBy(portable_hash(F.col("id"), salt), "id").limit(n)


def random_partitions(df: DataFrame, parts: int, salt: int = 0) -> DataFrame:
    """Equal slices of the hash order, the remainder to the last. Ranks come from counts of hash ranges, so no task orders all rows."""
    n = df.count()
    size = max(1, n // parts)
    buckets = max(1, min(1 << 12, n // 100_000))
    h = df.select("id", portable_hash(F.col("id"), salt).alias("h")).withColumn("bucket", F.floor(F.col("h") / (MODULUS / buckets)))
    counts = sorted((r[0], r[1]) for r in h.groupBy("bucket").count().collect())
    before, total = {}, 0
    for b, c in counts:
        before[b] = total
        total += c
    offset = F.create_map(*(F.lit(x) for b in before.items() for x in b)) if before else F.create_map(F.lit(0), F.lit(0))
    r = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "id")) - 1 + F.element_at(offset, F.col("bucket"))
    return h.select("id", F.least(F.floor(r / size), F.lit(parts - 1)).cast("int").alias("partition_id"))


def random_tags(df: DataFrame, parts: int, salt: int = 0) -> DataFrame:
    return df.select("id", F.pmod(portable_hash(F.col("id"), salt), F.lit(parts)).cast("int").alias("partition_id"))


# --- centres -------------------------------------------------------------------------------------------------------


def centroids(df: DataFrame, by: str) -> DataFrame:
    """The mean vector of each group, with its size. Positions are summed apart, with partial sums before the shuffle."""
    p = df.select(by, F.posexplode("vec").alias("p", "x")).groupBy(by, "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return p.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("vec"), F.max("n").alias("n"))


def centroid(df: DataFrame) -> DataFrame:
    return centroids(df.withColumn("_all", F.lit(0)), "_all").select("vec")


def entry_point(df: DataFrame) -> DataFrame:
    """The row nearest to the mean of all."""
    c = centroid(df).select(F.col("vec").alias("c"))
    d = df.join(F.broadcast(c)).select(l2sq(F.col("vec"), F.col("c")).alias("dist"), "id")
    return d.agg(F.min(F.struct("dist", "id")).alias("m")).select("m.id", "m.dist")


def medoids(df: DataFrame, by: str, candidates: int | None = None, references: int | None = None) -> DataFrame:
    """Of each partition the row with the least sum of distances to the others. Both sides are hash samples of a stated size (all rows if None).

    The sum of squared distances to a set is n * |x|^2 - 2 * x . sum + sum of |y|^2, so references are aggregated once and no pairs are made."""
    w = Window.partitionBy(by).orderBy(portable_hash(F.col("id"), 42), "id")
    r = df.withColumn("_r", F.row_number().over(w)) if candidates or references else df.withColumn("_r", F.lit(0))
    ref = r if references is None else r.where(F.col("_r") <= references)
    mean = centroids(ref, by).select(by, F.col("vec").alias("c"), "n")
    spread = ref.join(F.broadcast(mean), by).groupBy(by).agg(F.sum(l2sq(F.col("vec"), F.col("c"))).alias("s"))
    cand = r if candidates is None else r.where(F.col("_r") <= candidates)
    cost = cand.join(F.broadcast(mean), by).join(F.broadcast(spread), by).select(by, "id", (F.col("n") * l2sq(F.col("vec"), F.col("c")) + F.col("s")).alias("cost"))
    return cost.groupBy(by).agg(F.min(F.struct("cost", "id")).alias("m")).select(by, F.col("m.id").alias("id"), F.col("m.cost").alias("cost"))


def cluster_sizes(df: DataFrame, centers: DataFrame, share: float = 0.01, k: int = 1) -> DataFrame:
    """Sizes of the clusters, estimated from a hash sample of the rows."""
    a = assign(sample(df, share), centers, k)
    return a.groupBy("partition_id").agg(F.round(F.count("*") / share).cast("long").alias("n"))


# --- k-means -------------------------------------------------------------------------------------------------------


def assign(df: DataFrame, centers: DataFrame, k: int = 1) -> DataFrame:
    """Each row to its k nearest centres: id, partition_id, dist, rank. Centres are few and go to every task."""
    t = centers.select("id", F.col("vec").cast("array<double>")).toArrow()
    ids, c = t["id"].to_numpy(), matrix(t["vec"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                x = matrix(part.column(1))
                d = pairwise("l2", x, c)
                n = min(k, len(c))
                some = min(n + 4, len(c))  # a margin, for what the product rounds
                close = np.argpartition(d, some - 1, axis=1)[:, :some] if some < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)
                exact = to_rows("l2", x[:, None, :], c[close])
                order = np.lexsort((ids[close], exact), axis=1)[:, :n]
                yield pa.record_batch(
                    [pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(ids[np.take_along_axis(close, order, 1)].ravel()), pa.array(np.take_along_axis(exact, order, 1).ravel()), pa.array(np.tile(np.arange(1, n + 1), len(x)))],
                    names=["id", "partition_id", "dist", "rank"],
                )

    return df.select("id", F.col("vec").cast("array<double>")).mapInArrow(near, "id long, partition_id long, dist double, rank long")


def lloyd_step(df: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new centres, residual). A task sends one row of sums for each centre; an empty cluster becomes zero."""
    t = centers.select("id", F.col("vec").cast("array<double>")).orderBy("id").toArrow()
    ids, c = t["id"].to_numpy(), matrix(t["vec"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, rest = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                x = matrix(b.slice(at, 8192).column(0))
                near = pairwise("l2", x, c).argmin(axis=1)
                np.add.at(total, near, x)
                n += np.bincount(near, minlength=len(c))
                rest += np.bincount(near, to_rows("l2", x, c[near]), len(c))
        yield pa.record_batch([pa.array(ids), pa.array(list(total), pa.list_(pa.float64())), pa.array(n), pa.array(rest)], names=["id", "s", "n", "r"])

    part = df.select(F.col("vec").cast("array<double>")).mapInArrow(sums, "id long, s array<double>, n long, r double")
    new = part.groupBy("id").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(c.shape[1])))
    new = new.select("id", "n", "r", F.transform(F.array(*(f"s{i}" for i in range(c.shape[1]))), lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(F.lit(0.0))).alias("vec"))
    return new.select("id", "vec", "n"), new.agg(F.sum("r").alias("residual"))


def kmeans(df: DataFrame, centers: DataFrame, iterations: int = 20, change: float = 1e-5, eps: float = 1e-12) -> tuple[DataFrame, float]:
    """Lloyd's iterations from the given centres until the residual hardly changes. Only the centres come to the driver."""
    spark, last = df.sparkSession, None
    for _ in range(iterations):
        new, residual = lloyd_step(df, centers)
        rows = new.select("id", "vec").collect()
        now = residual.first()[0] or 0.0
        centers = spark.createDataFrame([(r.id, r.vec) for r in rows], "id long, vec array<double>")
        if now < eps or (last is not None and abs(last - now) <= change * last):
            return centers, now
        last = now
    return centers, last or 0.0


def plus_plus(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k-means++ pivots of a training sample: each next row is drawn with a weight of its squared distance to the pivots so far, by a dart from the seed."""
    rng = np.random.default_rng(seed)
    spark = df.sparkSession
    first = random_rows(df, 1, seed).select("id", F.col("vec").cast("array<double>").alias("vec")).first()
    if first is None:
        return spark.createDataFrame([], "id long, vec array<double>")
    chosen = [(first.id, first.vec)]
    for _ in range(k - 1):
        pivots = spark.createDataFrame(chosen, "id long, vec array<double>")
        weights = assign(df, pivots).groupBy("id").agg(F.min("dist").alias("w"))
        total = weights.agg(F.sum("w")).first()[0] or 0.0
        if total <= 0:
            break
        buckets = weights.withColumn("b", F.pmod(F.col("id"), F.lit(1024))).groupBy("b").agg(F.sum("w").alias("w")).orderBy("b").collect()
        at = rng.random() * total
        for r in buckets:
            if at <= r.w or r is buckets[-1]:
                break
            at -= r.w
        run = F.sum("w").over(Window.orderBy("id"))
        row = weights.where((F.pmod(F.col("id"), F.lit(1024)) == r.b) & (F.col("w") > 0)).withColumn("run", run).where(F.col("run") >= min(at, r.w * (1 - 1e-12))).orderBy("id").first()
        picked = df.where(F.col("id") == row.id).select("id", F.col("vec").cast("array<double>").alias("vec")).first()
        chosen.append((picked.id, picked.vec))
    return spark.createDataFrame(chosen, "id long, vec array<double>")


# --- partitions ----------------------------------------------------------------------------------------------------


def shards_within(df: DataFrame, ram_bytes: float, degree: int, replicas: int = 2, first: int = 3, share: float = 1.0) -> DataFrame:
    """Centres such that the largest cluster's index is estimated to fit the memory; more centres until it does. It is an error if it can't: a single row, or copies of one, need more."""
    dim, n = len(df.select("vec").first()[0]), df.count()
    # as many as equal clusters would take, at least
    parts, before = max(first, int(np.ceil(replicas * n * ram_estimate(1, dim, degree) / ram_bytes))), None
    while True:
        centers, _ = kmeans(df, random_rows(df, parts).withColumn("id", F.row_number().over(Window.orderBy("id")).cast("long") - 1), 10)
        largest = cluster_sizes(df, centers, share, replicas).agg(F.max("n")).first()[0] or 0
        if ram_estimate(largest, dim, degree) <= ram_bytes:
            return centers
        if parts >= n or (before == largest and parts > n // 2):
            raise ValueError(f"{parts} centres leave a cluster of {largest} rows: over {ram_bytes:.0f} bytes")
        parts, before = max(parts + 2, parts * 5 // 4), largest


#: Rows on which centres and prices of balanced partitions are fitted, at most; every row is placed.
FIT_ROWS = 50_000


def balanced(df: DataFrame, parts: int, slack: float = 0.01, iterations: int = 10, rounds: int = 40, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Disjoint partitions of near-equal size around k-means centres: id, partition_id.

    Every centre has a price, raised while its cluster is over capacity and lowered while it is under; rows go to the
    centre with the least distance plus price. Centres and prices are fitted on a hash sample of bounded size. What is
    still over capacity in the end moves, the rows nearest to the centre last, to partitions with room."""
    n = df.count()
    room = int(np.ceil(n / parts * (1 + slack)))
    t = (df if n <= fit_rows else sample(df, fit_rows / n, 11)).select("id", F.col("vec").cast("array<double>")).toArrow().sort_by("id")
    x, ids = matrix(t["vec"]), t["id"].to_numpy()
    order = np.lexsort((ids, (ids * np.int64(2654435761)) % MODULUS))
    c = x[np.sort(order[:parts])]
    for _ in range(iterations):
        near = pairwise("l2", x, c).argmin(axis=1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    d = pairwise("l2", x, c)
    spread = float(np.median(pairwise("l2", c, c)[~np.eye(len(c), dtype=bool)])) if len(c) > 1 else 1.0
    price, step = np.zeros(len(c)), 0.25 * spread
    for _ in range(rounds):
        share = np.bincount((d + price).argmin(axis=1), minlength=len(c)) / max(1, len(x)) * len(c)
        if share.max() <= 1 + slack:
            break
        price += step * (share - 1)
        step *= 0.9
    return _settle(_priced(df, c, price, 1), len(c), room)


def _priced(df: DataFrame, c: np.ndarray, price: np.ndarray, k: int) -> DataFrame:
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = pairwise("l2", matrix(b.column(1)), c) + price
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(d, order, 1).ravel()), pa.array(np.tile(np.arange(1, k + 1), b.num_rows))], names=["id", "partition_id", "cost", "choice"])

    return df.select("id", F.col("vec").cast("array<double>")).mapInArrow(near, "id long, partition_id int, cost double, choice long")


def _settle(choices: DataFrame, parts: int, room: int) -> DataFrame:
    """First choices up to the room, by cost; the others fill what is left of the partitions in the order of their ids."""
    w = Window.partitionBy("partition_id").orderBy("cost", "id")
    first = choices.where("choice = 1").withColumn("r", F.row_number().over(w))
    stays = first.where(F.col("r") <= room).select("id", F.col("partition_id"))
    moves = first.where(F.col("r") > room).select("id")
    held = {r[0]: r[1] for r in stays.groupBy("partition_id").count().collect()}
    ends, total = [], 0
    for p in range(parts):
        total += room - held.get(p, 0)
        ends.append(total)
    from vecspark.operators.metrics import prefix_weights

    slots = prefix_weights(moves.withColumn("w", F.lit(1).cast("long")), "w").select("id", F.col("prefix").alias("slot"))
    place = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e < F.col("slot")))
    return stays.unionByName(slots.select("id", F.least(place, F.lit(parts - 1)).cast("int").alias("partition_id")))


def cut_share(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """cut: the share of the links (id, nbrs) that leave their partition (id, partition_id)."""
    e = graph.select("id", F.explode("nbrs").alias("n"))
    a = parts.select("id", F.col("partition_id").alias("p"))
    met = e.join(a, "id").join(a.select(F.col("id").alias("n"), F.col("p").alias("o")), "n")
    return met.agg(F.avg((F.col("p") != F.col("o")).cast("double")).alias("cut"))


def by_links(graph: DataFrame, start: DataFrame, parts: int, slack: float = 0.05, rounds: int = 10) -> DataFrame:
    """Partitions (id, partition_id) of a graph (id, nbrs) that cut fewer links than start does and hold some 1 + slack times the mean at most (but for what hashes of equal gains differ by).

    Each round a node of every second hash looks where most of its neighbours are, by links either way, and wishes to move
    there if it gains by that. As many move from one partition to another as the other way round, and more where there is
    room, the largest gains first: counts of the gains (degrees, so few) say down to which one, and a share of those with
    the last one goes by hash."""
    e = graph.select("id", F.explode("nbrs").alias("n"))
    both = stored(e.unionByName(e.select(F.col("n").alias("id"), F.col("id").alias("n"))).groupBy("id", "n").agg(F.count("*").alias("w")), "links")
    now = stored(start.select("id", F.col("partition_id").cast("int").alias("partition_id")), "partitions")
    n = now.count()
    room = int(np.ceil(n / parts * (1 + slack)))
    for k in range(rounds):
        votes = both.join(now.select(F.col("id").alias("n"), "partition_id"), "n").groupBy("id", "partition_id").agg(F.sum("w").alias("v"))
        own = now.select("id", F.col("partition_id").alias("p"))
        best = votes.join(own, "id").groupBy("id", "p").agg(F.max(F.struct("v", (-F.col("partition_id")).alias("m"))).alias("b"), F.max(F.when(F.col("partition_id") == F.col("p"), F.col("v"))).alias("held"))
        gain = F.col("b.v") - F.coalesce("held", F.lit(0))
        wish = best.where((gain > 0) & (F.pmod(portable_hash(F.col("id"), k), F.lit(2)) == 0)).select("id", "p", (-F.col("b.m")).alias("to"), gain.alias("gain"))
        wish = stored(wish, "wishes")
        sizes = {r[0]: r[1] for r in now.groupBy("partition_id").count().collect()}
        counts: dict[tuple[int, int], list] = {}
        for r in wish.groupBy("p", "to", "gain").count().collect():  # a row for each two partitions and gain
            counts.setdefault((r["p"], r["to"]), []).append((r["gain"], r["count"]))
        total = {x: sum(c for _, c in gains) for x, gains in counts.items()}
        bars = []
        for (p, q), gains in sorted(counts.items()):
            free = min(total[p, q], total.get((q, p), 0))
            more = max(0, min(total[p, q] - free, room - sizes.get(q, 0)))
            free, sizes[q] = free + more, sizes.get(q, 0) + more
            for g, c in sorted(gains, reverse=True):
                bars.append((p, q, g, max(0.0, min(1.0, free / c))))
                free -= c
        if not any(b[3] > 0 for b in bars):
            break
        admitted = F.broadcast(now.sparkSession.createDataFrame(bars, "p int, to int, gain long, share double"))
        moved = wish.join(admitted, ["p", "to", "gain"]).where(portable_hash(F.col("id"), 100 + k) < F.floor(F.col("share") * MODULUS)).select("id", "to")
        now = stored(now.join(moved, "id", "left").select("id", F.coalesce("to", "partition_id").alias("partition_id")), "partitions")
    return now


def overlapping(df: DataFrame, centers: DataFrame, share: float) -> DataFrame:
    """id and homes: the nearest centre's partition, and for the share of rows with the smallest margin the second nearest one's too."""
    a = assign(df, centers, 2).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "partition_id", "dist"))).alias("a"))
    m = a.select("id", F.col("a")[0]["partition_id"].alias("p1"), F.get("a", F.lit(1))["partition_id"].alias("p2"), (F.get("a", F.lit(1))["dist"] - F.col("a")[0]["dist"]).alias("margin"))
    cut = m.agg(F.percentile("margin", F.lit(share)).alias("cut")).first()[0]
    second = F.col("p2").isNotNull() & (F.col("margin") <= F.lit(cut)) if share > 0 and cut is not None else F.lit(False)
    return m.select("id", F.when(second, F.array("p1", "p2")).otherwise(F.array("p1")).alias("homes"))


def homes(parts: DataFrame) -> DataFrame:
    """Rows (id, partition_id) as one row an id: homes, ascending."""
    return parts.groupBy("id").agg(F.sort_array(F.collect_set("partition_id")).alias("homes"))


def flatten_homes(df: DataFrame) -> DataFrame:
    return df.select("id", F.explode("homes").alias("partition_id"))


def id_lists(parts: DataFrame) -> DataFrame:
    """The ascending ids of each partition as pieces of bounded length (a partition isn't collected into one row)."""
    piece = parts.select("partition_id", "id", F.floor(F.col("id") / 65_536).alias("piece"))
    return piece.groupBy("partition_id", "piece").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def vectors_of(df: DataFrame, parts: DataFrame, partition: int) -> DataFrame:
    """The rows (id, vec) that parts (id, partition_id) have in one partition."""
    return df.join(parts.where(F.col("partition_id") == partition).select("id"), "id", "left_semi")


def assignment(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode("ids").alias("id"), "partition_id")
