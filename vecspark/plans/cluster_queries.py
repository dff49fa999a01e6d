"""Queries on sampling, clustering and partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.functions import prep
from vecspark.operators import cluster
from vecspark.plans.registry import SQL_VECTORS, base_of, query, rounded, sql_l2, vectors

_HASH = "((id + {salt}) * 2654435761) % 4294967296"
_SUMS = "select {by}, list(x order by p) as vec from (select {by}, p, avg(x) as x from (select {by}, unnest(vec) as x, unnest(range(64)) as p from {t}) group by all) group by all"
_CENTERS = "c as (select row_number() over (order by id) - 1 as id, vec from (select * from b order by " + _HASH.format(salt=0) + ", id limit 8))"


def _long(df, key):
    return df.select(key, F.posexplode("vec").alias("p", "x")).select(key, F.col("p").cast("long"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


def _centers(v):
    from pyspark.sql.window import Window

    return cluster.random_rows(base_of(v), 8).select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("id"), "vec")


@query(f"with {SQL_VECTORS}, m as ({_SUMS.format(by='1 as one', t='v').replace('group by all', 'group by all')}) select p, round(x, 6) + 0.0 as x from (select unnest(vec) as x, unnest(range(64)) as p from m)")
def dataset_centroid(spark, sf):
    return _long(cluster.centroid(vectors(spark, sf)).withColumn("k", F.lit(0)), "k").drop("k")


@query(f"with {SQL_VECTORS}, m as (select list(x order by p) as m from (select p, avg(x) as x from (select unnest(vec) as x, unnest(range(64)) as p from v) group by p)) select id, round({sql_l2('vec', 'm')}, 6) as dist from v, m order by {sql_l2('vec', 'm')}, id limit 1")
def entry_point(spark, sf):
    return rounded(cluster.entry_point(vectors(spark, sf)), "dist")


@query(f"with {SQL_VECTORS}, s as (select x.label, x.id, sum({sql_l2('x.vec', 'y.vec')}) as cost from v x join v y on x.label = y.label group by all) select label, id, round(cost, 5) as cost from (select *, row_number() over (partition by label order by cost, id) as r from s) where r = 1")
def partition_medoids(spark, sf):
    return rounded(cluster.medoids(vectors(spark, sf), "label"), "cost", digits=5)


@query(f"with {SQL_VECTORS}, {_CENTERS} select id, partition_id, round(dist, 6) as dist, rank from (select b.id, c.id as partition_id, {sql_l2('b.vec', 'c.vec')} as dist, row_number() over (partition by b.id order by {sql_l2('b.vec', 'c.vec')}, c.id) as rank from b, c) where rank <= 2")
def nearest_center_k2(spark, sf):
    v = vectors(spark, sf)
    return rounded(cluster.assign(base_of(v), _centers(v), 2), "dist")


_ASSIGNED = f"with {SQL_VECTORS}, {_CENTERS}, a as (select * from (select b.id, b.vec, c.id as cid, {sql_l2('b.vec', 'c.vec')} as dist, row_number() over (partition by b.id order by {sql_l2('b.vec', 'c.vec')}, c.id) as r from b, c) where r = 1)"


@query(f"{_ASSIGNED}, m as ({_SUMS.format(by='cid', t='a')}) select cid as id, p, round(x, 6) + 0.0 as x from (select cid, unnest(vec) as x, unnest(range(64)) as p from m)")
def lloyd_one_iteration(spark, sf):
    v = vectors(spark, sf)
    return _long(cluster.lloyd_step(base_of(v), _centers(v))[0], "id")


@query(f"{_ASSIGNED} select round(sum(dist), 6) as residual from a")
def kmeans_residual(spark, sf):
    v = vectors(spark, sf)
    return rounded(cluster.lloyd_step(base_of(v), _centers(v))[1], "residual")


@query(f"with {SQL_VECTORS}, h as (select id, row_number() over (order by {_HASH.format(salt=3)}, id) - 1 as r, count(*) over () as n from v) select id, least(r // (n // 7), 6)::int as partition_id from h")
def random_partition(spark, sf):
    return cluster.random_partitions(vectors(spark, sf), 7, 3)


@query(f"with {SQL_VECTORS} select id, ({_HASH.format(salt=1)} % 12)::int as partition_id from v")
def random_tags(spark, sf):
    return cluster.random_tags(vectors(spark, sf), 12, 1)


@query(f"with {SQL_VECTORS} select id from v where {_HASH.format(salt=5)} < 1073741824")
def hash_sample_slice(spark, sf):
    return cluster.sample(vectors(spark, sf), 0.25, 5).select("id")


@query(f"with {SQL_VECTORS} select id from v order by {_HASH.format(salt=0)}, id limit 16")
def random_pivots(spark, sf):
    return cluster.random_rows(vectors(spark, sf), 16).select("id")


@query(f"with {SQL_VECTORS}, {_CENTERS}, r as (select b.id, c.id as p, {sql_l2('b.vec', 'c.vec')} as dist, row_number() over (partition by b.id order by {sql_l2('b.vec', 'c.vec')}, c.id) as rank from b, c), m as (select x.id, x.p as p1, y.p as p2, y.dist - x.dist as margin from r x join r y using (id) where x.rank = 1 and y.rank = 2), k as (select quantile_cont(margin, 0.3) as cut from m) select id, p1 as partition_id from m union all select id, p2 from m, k where margin <= cut")
def overlap_assignment(spark, sf):
    v = vectors(spark, sf)
    return cluster.flatten_homes(cluster.overlapping(base_of(v), _centers(v), 0.3))


@query(f"with {SQL_VECTORS}, {_CENTERS}, r as (select b.id, c.id as p, row_number() over (partition by b.id order by {sql_l2('b.vec', 'c.vec')}, c.id) as rank from b, c) select id, string_agg(p::varchar, ',' order by p) as homes from r where rank <= 2 group by id")
def homes_of_points(spark, sf):
    v = vectors(spark, sf)
    a = cluster.assign(base_of(v), _centers(v), 2).select("id", "partition_id")
    return cluster.homes(a).select("id", F.array_join("homes", ",").alias("homes"))


@query("select label::int as partition_id, vec_id // 65536 as piece, string_agg(vec_id::varchar, ' ' order by vec_id) as ids from embeddings group by all")
def partition_id_lists(spark, sf):
    v = vectors(spark, sf).select("id", F.col("label").cast("int").alias("partition_id"))
    return cluster.id_lists(v).select("partition_id", "piece", F.array_join("ids", " ").alias("ids"))


@query("select vec_id as id, label::int as partition_id from embeddings")
def partition_assignment(spark, sf):
    v = vectors(spark, sf).select("id", F.col("label").cast("int").alias("partition_id"))
    return cluster.assignment(cluster.id_lists(v)).select("id", "partition_id")


@query(f"with {SQL_VECTORS}, {_CENTERS}, a as (select b.id, c.id as p, row_number() over (partition by b.id order by {sql_l2('b.vec', 'c.vec')}, c.id) as rank from b, c where {_HASH.format(salt=0).replace('id', 'b.id')} < 2147483648) select p as partition_id, round(count(*) / 0.5)::bigint as n from a where rank = 1 group by p")
def cluster_size_estimate(spark, sf):
    v = vectors(spark, sf)
    return cluster.cluster_sizes(base_of(v), _centers(v), 0.5)


_SIZES = "i as (select unnest([1, 999, 1000, 17500, 250000, 10000000]) as n), j as (select unnest([0, 10000, 100000, 64000000]) as budget), d as (select unnest([3, 64, 500]) as dim)"


@query(f"with {_SIZES} select n::bigint as n, budget::bigint as budget, dim::bigint as dim, greatest(1, least(budget // n, dim, 128))::bigint as chunks, round(1.1 * (n::double * 32 * 4 * 1.3 + n::double * dim * 4), 3)::double as ram, (case when n < 1000 then 1000 else 1000 + floor(100 * log2(n // 1000)) end)::bigint as sample from i, j, d")
def sizing_rules(spark, sf):
    rows = [(n, m, d, prep.pq_chunks(m, n, d), round(prep.ram_estimate(n, d, 32), 3), prep.medoid_sample_size(1000, n)) for n in (1, 999, 1000, 17_500, 250_000, 10_000_000) for m in (0, 10_000, 100_000, 64_000_000) for d in (3, 64, 500)]
    return spark.createDataFrame(rows, "n long, budget long, dim long, chunks long, ram double, sample long")


@query("select count(*) as n, true as balanced, 5::bigint as parts from embeddings")
def balanced_partitions(spark, sf):
    """Disjoint partitions of five hundredths above the mean at most; every row has one."""
    v = vectors(spark, sf)
    n = v.count()
    sizes = cluster.balanced(v, 5, 0.05).groupBy("partition_id").agg(F.count("*").alias("k"), F.countDistinct("id").alias("d"))
    return sizes.agg(F.sum("d").alias("n"), (F.max("k") <= -(-n * 105 // 500)).alias("balanced"), F.count("*").alias("parts"))


@query("select true as fits, count(*)::bigint as n from embeddings")
def shards_within_memory(spark, sf):
    """Centres for clusters whose index fits a sixth of what all rows take: every one does, and no row is left out."""
    v = base_of(vectors(spark, sf))
    ram = prep.ram_estimate(v.count(), 64, 16) / 6
    sizes = cluster.assign(v, cluster.shards_within(v, ram, 16, 1)).groupBy("partition_id").agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") * F.lit(prep.ram_estimate(1, 64, 16)) <= ram).alias("fits"), F.sum("n").alias("n"))


@query(f"{_ASSIGNED} select true as better, 8::bigint as k from a limit 1")
def kmeans_improves(spark, sf):
    """k-means++ and Lloyd's iterations leave less than random pivots do after one."""
    v = vectors(spark, sf)
    _, trained = cluster.kmeans(base_of(v), cluster.plus_plus(base_of(v), 8), 10)
    once = cluster.lloyd_step(base_of(v), _centers(v))[1].first()[0]
    return spark.createDataFrame([(bool(trained < once), 8)], "better boolean, k long")


@query()
def kmeans_trained(spark, sf):
    """Residual of k-means from k-means++ pivots."""
    v = base_of(vectors(spark, sf))
    _, residual = cluster.kmeans(v, cluster.plus_plus(v, 8), 10)
    return spark.createDataFrame([(8, float(residual))], "k long, residual double")
