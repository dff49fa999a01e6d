"""Queries on product quantisation, with fixed pivots (the first rows' own parts) so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.operators import cluster, knn, pq
from vecspark.plans.registry import SQL_VECTORS, base_of, queries_of, query, rounded, sql_dot, sql_l2, vectors

CHUNKS, PIVOTS, WIDTH = 8, 64, 8
_MEAN = f"with {SQL_VECTORS}, mean as (select list(x order by p) as m from (select p, avg(x) as x from (select unnest(vec) as x, unnest(range(64)) as p from b) group by p)), c as (select id, list_transform(list_zip(vec, m), lambda z: z[1] - z[2]) as vec from b, mean)"
_PARTS = f"part as (select id, ch as chunk, vec[ch * {WIDTH} + 1:ch * {WIDTH} + {WIDTH}] as p from c, (select unnest(range({CHUNKS})) as ch))"
_PIV = f"piv as (select chunk, p as pv, row_number() over (partition by chunk order by id) - 1 as code from part where id < {PIVOTS})"
#: The pivots of pq.fixed.
FIXED_PIVOTS = f"{_MEAN}, {_PARTS}, {_PIV}"
_CODES = f"code as (select id, chunk, code from (select part.id, part.chunk, piv.code, row_number() over (partition by part.id, part.chunk order by {sql_l2('p', 'pv')}, piv.code) as r from part join piv using (chunk)) where r = 1)"
_QPART = f"qc as (select qid, list_transform(list_zip(vec, m), lambda z: z[1] - z[2]) as vec from q, mean), qpart as (select qid, ch as chunk, vec[ch * {WIDTH} + 1:ch * {WIDTH} + {WIDTH}] as p from qc, (select unnest(range({CHUNKS})) as ch)), lut as (select qid, chunk, code, {sql_l2('p', 'pv')} as dist from qpart join piv using (chunk))"
_ADC = f"{_MEAN}, {_PARTS}, {_PIV}, {_CODES}, {_QPART}, d as (select qid, id, sum(dist) as dist from lut join code using (chunk, code) group by qid, id), r as (select *, row_number() over (partition by qid order by round(dist, 9), id) as rank from d)"


def _book(spark, sf):
    v = vectors(spark, sf)
    return v, pq.fixed(base_of(v), CHUNKS, PIVOTS)


@query(f"{_MEAN} select p, round(x, 6) + 0.0 as x from (select unnest(m) as x, unnest(range(64)) as p from mean)")
def pq_centroid(spark, sf):
    c = cluster.centroid(base_of(vectors(spark, sf)))
    return c.select(F.posexplode("vec").alias("p", "x")).select(F.col("p").cast("long"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("with d as (select unnest(range(1, 130)) as dim), c as (select dim, unnest(range(1, least(dim, 40) + 1)) as chunks from d), k as (select dim, chunks, unnest(range(chunks)) as chunk from c) select dim, chunks, chunk, chunk * (dim // chunks) + least(chunk, dim % chunks) as start, (chunk + 1) * (dim // chunks) + least(chunk + 1, dim % chunks) as end from k")
def pq_chunk_offsets(spark, sf):
    """Every number of dimensions up to 129 in every number of chunks up to 40."""
    rows = [(dim, n, c, a, b) for dim in range(1, 130) for n in range(1, min(dim, 40) + 1) for o in [pq.chunk_offsets(dim, n)] for c, (a, b) in enumerate(zip(o, o[1:]))]
    return spark.createDataFrame(rows, "dim long, chunks long, chunk long, start long, end long")


@query(f"{_MEAN}, {_PARTS}, {_PIV}, {_CODES} select id, chunk, code from code")
def pq_encode_fixed_pivots(spark, sf):
    v, book = _book(spark, sf)
    return pq.encode(base_of(v), book).select("id", F.posexplode("codes").alias("chunk", "code")).select("id", F.col("chunk").cast("long"), F.col("code").cast("long"))


@query(f"{_MEAN}, {_PARTS}, {_PIV}, {_QPART} select qid, chunk, code, round(dist, 6) as dist from lut")
def pq_lut(spark, sf):
    v, book = _book(spark, sf)
    return rounded(pq.lookup(queries_of(v), book).select("qid", F.col("chunk").cast("long"), F.col("code").cast("long"), "dist"), "dist")


@query(f"{_ADC} select qid, id, round(round(dist, 9), 6) as dist, rank from r where rank <= 10")
def pq_adc_top10(spark, sf):
    v, book = _book(spark, sf)
    found = pq.nearest_by_codes(queries_of(v), pq.encode(base_of(v), book), book, 30)
    return rounded(knn.ranked(rounded(found.drop("rank"), "dist", digits=9), 10), "dist")


@query(f"{_ADC}, e as (select qid, id, {sql_l2('q.vec', 'b.vec')} as dist from r join q using (qid) join b using (id) where rank <= 30) select qid, id, round(dist, 6) as dist, rank from (select *, row_number() over (partition by qid order by dist, id) as rank from e) where rank <= 10")
def pq_adc_rerank(spark, sf):
    v, book = _book(spark, sf)
    found = pq.nearest_by_codes(queries_of(v), pq.encode(base_of(v), book), book, 40)
    best = knn.ranked(rounded(found.drop("rank"), "dist", digits=9), 30)
    return rounded(pq.rerank(queries_of(v), base_of(v), best, 10), "dist")


@query(f"{_MEAN}, {_PARTS}, {_PIV}, {_CODES}, s as (select a.chunk, a.code as x, b.code as y, {sql_l2('a.pv', 'b.pv')} as dist from piv a join piv b using (chunk)), d as (select l.id as qid, r.id, sum(dist) as dist from code l join code r using (chunk) join s on s.chunk = l.chunk and s.x = l.code and s.y = r.code where l.id % 100 = 0 group by all), r as (select *, row_number() over (partition by qid order by round(dist, 9), id) as rank from d) select qid, id, round(round(dist, 9), 6) as dist, rank from r where rank <= 10")
def pq_sdc_top10(spark, sf):
    """Distances of codes to codes: both sides are coded."""
    v, book = _book(spark, sf)
    found = pq.nearest_by_codes(queries_of(v), pq.encode(base_of(v), book), book, 40, symmetric=True)
    return rounded(knn.ranked(rounded(found.drop("rank"), "dist", digits=9), 10), "dist")


@query(f"{_MEAN}, {_PARTS}, {_PIV}, qp as (select qid, ch as chunk, vec[ch * {WIDTH} + 1:ch * {WIDTH} + {WIDTH}] as p from q, (select unnest(range({CHUNKS})) as ch)) select qid, chunk, code, round(-{sql_dot('p', 'pv')}, 6) + 0.0 as dist from qp join piv using (chunk)")
def pq_lut_inner(spark, sf):
    """The tables of negated inner products."""
    v, book = _book(spark, sf)
    t = pq.lookup(queries_of(v), book, inner=True).select("qid", F.col("chunk").cast("long"), F.col("code").cast("long"), "dist")
    return t.withColumn("dist", F.round("dist", 6) + F.lit(0.0))


@query()
def pq_trained_recall(spark, sf):
    """Recall at 10 of trained codes with 40 candidates reranked, and of the codes alone."""
    v = vectors(spark, sf)
    q, b = queries_of(v), base_of(v)
    book = pq.train(b, 16)
    found = pq.nearest_by_codes(q, pq.encode(b, book), book, 40)
    truth = knn.nearest(q, b, 10)
    one = knn.recall(found, truth, 10).select(F.lit("codes").alias("by"), "recall")
    return one.unionByName(knn.recall(pq.rerank(q, b, found, 10), truth, 10).select(F.lit("reranked").alias("by"), "recall"))


@query("select 'codes' as by, true as enough union all select 'reranked', true")
def pq_recall_bounds(spark, sf):
    """Whether trained codes find half of the neighbours by themselves, and 95 of 100 with 40 candidates reranked."""
    return pq_trained_recall(spark, sf).select("by", (F.col("recall") >= F.when(F.col("by") == "codes", 50).otherwise(95)).alias("enough"))
