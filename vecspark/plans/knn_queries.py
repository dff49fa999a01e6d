"""Queries on distances, preparation, exact neighbours, routing, merges and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.functions import prep as P
from vecspark.operators import knn as K
from vecspark.plans.registry import SQL_VECTORS, base_of, queries_of, query, rounded, sql_dot, sql_l2, vectors

_TOP = "select qid, id, round(dist, 6) + 0.0 as dist, rank from (select *, row_number() over (partition by qid order by dist, id) as rank from d) where rank <= 10"
_L2 = f"with {SQL_VECTORS}, d as (select qid, id, {sql_l2('q.vec', 'b.vec')} as dist from q, b) "


@query(_L2 + _TOP)
def knn_l2_top10(spark, sf):
    v = vectors(spark, sf)
    return rounded(K.nearest(queries_of(v), base_of(v), 10), "dist")


@query(f"with {SQL_VECTORS}, d as (select qid, id, 1 - {sql_dot('q.vec', 'b.vec')} as dist from q, b) " + _TOP)
def knn_cosine_top10(spark, sf):
    v = vectors(spark, sf)
    return rounded(K.nearest(queries_of(v), base_of(v), 10, "cosine"), "dist")


@query(f"with {SQL_VECTORS}, d as (select qid, id, -{sql_dot('q.vec', 'b.vec')} as dist from q, b) " + _TOP)
def knn_ip_top10(spark, sf):
    v = vectors(spark, sf)
    return rounded(K.inner_products(queries_of(v), base_of(v), 10), "dist")


_SCALED = f"""with v as (select vec_id as id, list_transform(embedding::double[], lambda x: x * (1 + vec_id % 7)) as vec, label from embeddings),
n as (select *, {sql_dot('vec', 'vec')} as n2 from v), q as (select id as qid, list_transform(vec, lambda x: x / sqrt(n2)) || [0.0::double] as vec from n where id % 100 = 0),
b0 as (select * from n), m as (select sqrt(max(n2)) as m from b0),
b as (select id, list_transform(vec, lambda x: x / m) || [sqrt(greatest(0.0, 1 - n2 / (m * m)))] as vec, n2, m from b0, m)"""


def _mips(spark, sf):
    v = vectors(spark, sf).withColumn("vec", F.transform("vec", lambda x: x * (1 + F.col("id") % 7)))
    q = queries_of(v).withColumn("vec", P.prepare_query(F.col("vec"), "mips"))
    b, m = P.augment(base_of(v), "vec")
    return q, b, m


@query(_SCALED + f", d as (select qid, id, {sql_l2('q.vec', 'b.vec')} as dist from q, b) " + _TOP)
def knn_mips_augmented(spark, sf):
    q, b, _ = _mips(spark, sf)
    return rounded(K.nearest(q, b, 10, "mips"), "dist")


@query(_SCALED + " select id, round(vec[65], 6) as last, round(list_sum(list_transform(vec, lambda x: x * x)), 6) as norm_sq, round(m, 6) as max_norm from b")
def mips_augment(spark, sf):
    _, b, m = _mips(spark, sf)
    return b.select("id", F.round(F.element_at("vec", 65), 6).alias("last"), F.round(D.norm_sq(F.col("vec")), 6).alias("norm_sq"), F.round(F.lit(m), 6).alias("max_norm"))


@query(f"select vec_id as id, round({sql_dot('embedding::double[]', 'embedding::double[]')}, 6) as norm_sq from embeddings")
def vec_norms(spark, sf):
    return vectors(spark, sf).select("id", F.round(D.norm_sq(F.col("vec")), 6).alias("norm_sq"))


def _long(df, digits=None):
    """id, pos and value of each coordinate; zeros without a sign."""
    x = F.col("x") if digits is None else F.round("x", digits) + F.lit(0.0)
    return df.select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), x.alias("x"))


def _sql_long(select, digits=None):
    x = "x" if digits is None else f"round(x, {digits}) + 0.0"
    return f"select id, pos, {x} as x from (select id, unnest(range(64)) as pos, unnest(vec) as x from ({select}))"


_N = f"with n as (select vec_id as id, list_transform(embedding::double[], lambda x: x * (vec_id % 5)) as vec from embeddings), s as (select *, {sql_dot('vec', 'vec')} as n2 from n) "


def _by_five(spark, sf):
    return vectors(spark, sf).select("id", F.transform("vec", lambda x: x * (F.col("id") % 5)).alias("vec"))


@query(_N + _sql_long("select id, list_transform(vec, lambda x: case when n2 < 1.1920928955078125e-07 then 0.0 else x / sqrt(n2) end) as vec from s", 6))
def normalize_cosine(spark, sf):
    return _long(_by_five(spark, sf).select("id", P.normalize(F.col("vec")).alias("vec")), 6)


@query(_N + _sql_long("select id, list_transform(vec, lambda x: round(case when n2 < 1.1920928955078125e-07 then 0.0 else abs(x) / sqrt(n2) * 255 end)::smallint) as vec from s"))
def normalize_uint8(spark, sf):
    return _long(_by_five(spark, sf).select("id", P.normalize(F.transform("vec", lambda x: F.abs(x)), "uint8").alias("vec")))


@query(_N + _sql_long("select id, list_transform(vec, lambda x: round(case when n2 < 1.1920928955078125e-07 then 0.0 else x / sqrt(n2) * 127 end)::smallint) as vec from s"))
def normalize_int8(spark, sf):
    return _long(_by_five(spark, sf).select("id", P.normalize(F.col("vec"), "int8").alias("vec")))


@query(_N + _sql_long("select id, list_transform(vec, lambda x: x / sqrt(n2 + 1.1920928955078125e-07)) as vec from s", 6))
def normalize_file(spark, sf):
    return _long(P.normalize_rows(_by_five(spark, sf), "vec"), 6)


_BYTES = "list_transform(embedding::double[], lambda x: round(abs(x) * 255)::smallint)"


@query(f"with v as (select vec_id as id, {_BYTES}::double[] as vec from embeddings), q as (select id as qid, vec from v where id % 100 = 0), b as (select * from v), d as (select qid, id, {sql_l2('q.vec', 'b.vec')} as dist from q, b) " + _TOP)
def knn_uint8_top10(spark, sf):
    v = vectors(spark, sf).withColumn("vec", P.convert(F.transform("vec", lambda x: F.round(F.abs(x) * 255)), "uint8"))
    return rounded(K.nearest(queries_of(v), base_of(v), 10, "l2", "uint8"), "dist")


@query(f"with v as (select vec_id as id, {_BYTES}::double[] as vec from embeddings), q as (select id as qid, vec from v where id % 100 = 0), b as (select * from v), d as (select qid, id, 65025 - {sql_dot('q.vec', 'b.vec')} as dist from q, b) " + _TOP)
def knn_cosine_uint8_top10(spark, sf):
    v = vectors(spark, sf).withColumn("vec", P.convert(F.transform("vec", lambda x: F.round(F.abs(x) * 255)), "uint8"))
    return rounded(K.nearest(queries_of(v), base_of(v), 10, "cosine", "uint8"), "dist")


@query(_sql_long("select vec_id as id, embedding::double[] as vec from embeddings"))
def convert_types(spark, sf):
    return _long(vectors(spark, sf).select("id", P.convert(F.col("vec"), "float").cast("array<double>").alias("vec")))


@query(f"with {SQL_VECTORS}, c as (select label, list(x order by p) as c from (select label, p, avg(x) as x from (select label, unnest(vec) as x, unnest(range(64)) as p from v) group by all) group by label) " + _sql_long("select id, list_transform(list_zip(vec, c), lambda z: z[1] - z[2]) as vec from v join c using (label)", 6))
def residuals(spark, sf):
    from vecspark.operators.cluster import centroids

    v = vectors(spark, sf)
    c = centroids(v, "label").select("label", F.col("vec").alias("c"))
    return _long(v.join(F.broadcast(c), "label").select("id", P.residual(F.col("vec"), F.col("c")).alias("vec")), 6)


@query("select vec_id as id, (vec_id % 1000 * 4294967296::decimal(20,0) + vec_id * 7)::decimal(20,0)::varchar as message, vec_id % 1000 as qid, vec_id * 7 as node from embeddings")
def packed_message_ids(spark, sf):
    v = vectors(spark, sf).select("id", P.pack_id(F.col("id") % 1000, F.col("id") * 7).alias("m"))
    q, n = P.unpack_id(F.col("m"))
    return v.select("id", F.col("m").cast("string").alias("message"), q.alias("qid"), n.alias("node"))


@query("select vec_id as id, case when vec_id % 3 = 0 then vec_id + 1000000 else vec_id end as global_id from embeddings")
def apply_tags(spark, sf):
    v = vectors(spark, sf).select("id", F.col("id").alias("g"))
    tags = v.where("id % 3 = 0").select(F.col("id").alias("local_id"), (F.col("id") + 1_000_000).alias("global_id"))
    return P.tagged(v, tags, "g").select("id", F.col("g").alias("global_id"))


@query(f"with {SQL_VECTORS}, m as (select label, list(x order by p) as vec from (select label, p, avg(x) as x from (select label, unnest(vec) as x, unnest(range(64)) as p from b) group by all) group by label), d as (select qid, label as partition_id, {sql_l2('q.vec', 'm.vec')} as dist from q, m) select qid, partition_id::bigint as partition_id, round(dist, 6) as dist, rank from (select *, row_number() over (partition by qid order by dist, partition_id) as rank from d) where rank <= 3")
def route_top_n_partitions(spark, sf):
    from vecspark.operators.cluster import centroids

    v = vectors(spark, sf)
    m = centroids(base_of(v), "label").select(F.col("label").cast("long").alias("partition_id"), "vec")
    return rounded(K.route(queries_of(v), m, 3), "dist")


@query(_L2 + _TOP)
def scatter_gather_exact(spark, sf):
    """Exact top 10 of every partition (by label), merged: one scan."""
    v = vectors(spark, sf)
    return rounded(K.merge(K.nearest_by(queries_of(v), base_of(v), "label", 10), 10), "dist")


@query(_L2 + ", p as (select qid, id, dist, rank % 2 = 0 as expanded from (select *, row_number() over (partition by qid order by dist, id) as rank from d) where rank <= 20) select qid, id, round(dist, 6) as dist, expanded, rank from (select *, row_number() over (partition by qid order by dist, id) as rank from p) where rank <= 15")
def merge_candidate_pools(spark, sf):
    v = vectors(spark, sf)
    t = K.nearest(queries_of(v), base_of(v), 20).withColumn("expanded", F.col("rank") % 2 == 0)
    low, high = t.where("rank <= 12").drop("rank"), t.where("rank > 8").drop("rank")
    return rounded(K.merge_pools(low, high, 15), "dist")


_TRUTH = _L2 + ", t as (select qid, id, dist, rank from (select *, row_number() over (partition by qid order by dist, id) as rank from d) where rank <= 30), "


def _truth(spark, sf, k=30):
    v = vectors(spark, sf)
    return K.nearest(queries_of(v), base_of(v), k)


@query(_TRUTH + "r as (select qid, id from t where rank <= 10 and (qid + id) % 4 <> 0) select round(100.0 * (select count(*) from r) / (10 * count(distinct qid)), 6) as recall from t")
def recall_at_10(spark, sf):
    t = _truth(spark, sf)
    return K.recall(t.where("rank <= 10 and (qid + id) % 4 <> 0"), t, 10)


@query(_TRUTH + "u as (select qid, id, rank, round(dist, 1) as dist from t), l as (select qid, dist as last from u where rank = 10), a as (select u.qid, u.id from u join l using (qid) where dist <= last), r as (select qid, id from (select *, row_number() over (partition by qid order by dist, id) as rk from u where rank > 5) where rk <= 10) select round(100.0 * (select count(*) from r join a using (qid, id)) / (10 * count(distinct qid)), 6) as recall from u")
def recall_ties(spark, sf):
    t = _truth(spark, sf).withColumn("dist", F.round("dist", 1))
    return K.recall(t.where("rank > 5"), t, 10)


@query(_TRUTH + "a as (select *, row_number() over (partition by qid order by rank) as n from t where id % 3 <> 0), r as (select qid, id from (select *, row_number() over (partition by qid order by dist, id) as rk from t where id % 2 = 0) where rk <= 10) select round(100.0 * (select count(*) from r join a using (qid, id) where n <= 10) / (10 * (select count(distinct qid) from a)), 6) as recall")
def recall_active(spark, sf):
    t = _truth(spark, sf)
    return K.recall_active(t.where("id % 2 = 0"), t, base_of(vectors(spark, sf)).where("id % 3 <> 0"), 10)
