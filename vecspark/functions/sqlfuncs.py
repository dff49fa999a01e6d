"""Vector functions for Spark SQL.

``register`` defines l2sq, cosine_dist, neg_ip, vec_norm_sq, vec_normalize and adc as SQL functions, whose bodies Catalyst
sees and inlines, and vector_search as a table function over a registered index."""

from __future__ import annotations

from pyspark.sql import SparkSession

# adc: lut is a list of rows (one a chunk), codes a list of places in them
BODIES = {
    "l2sq": ("a array<double>, b array<double>", "double", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "cosine_dist": ("a array<double>, b array<double>", "double", "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "neg_ip": ("a array<double>, b array<double>", "double", "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm_sq": ("a array<double>", "double", "aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)"),
    "vec_normalize": ("a array<double>", "array<double>", "transform(array(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)), n -> transform(a, x -> if(n < 1.1920928955078125E-7D, 0D, x / sqrt(n))))[0]"),
    "adc": ("lut array<array<double>>, codes array<smallint>", "double", "aggregate(zip_with(lut, codes, (r, c) -> element_at(r, c + 1)), 0D, (s, x) -> s + x)"),
}


def register(spark: SparkSession) -> None:
    for name, (args, out, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")


def register_search(spark: SparkSession, name: str, index) -> None:
    """A table function name(query array<double>, k int, size int): a row for each neighbour. Workers read the nodes they need from the index's files; only the codebook and the seeds are sent. For many queries use Index.search."""
    from pyspark.sql.functions import udtf

    from vecspark.functions.distance import Metric
    from vecspark.operators.pq import adc
    from vecspark.operators.search import SearchParams, State, everything, opened

    if index.metric is not Metric.L2:
        raise ValueError("the table function takes queries as they are: an l2 index")
    sent, files = spark.sparkContext.broadcast((index.book, index.seeds())), index.files()

    @udtf(returnType="rank: bigint, id: bigint, dist: double")
    class VectorSearch:
        def eval(self, query, k: int, size: int):
            import numpy as np

            book, seeds = sent.value
            q, p = np.array(query, float), SearchParams(k, size, 4)
            lut = book.table(q[None, :])[0]
            at = seeds.of(q[None, :], p.seeds)[0]
            s = State.start(q, seeds.ids[at], adc(lut, seeds.codes[at]), seeds.homes[at], size)
            home = int(s.homes[0])
            if whole := everything(files, size):
                found = whole.search(q, lut, s.ids, home, p)[:2]
            else:
                while home is not None:
                    home = opened(files, home).run(s, lut, p)
                found = s.best(k)
            for rank, (i, d) in enumerate(zip(*found), 1):
                yield rank, int(i), float(d)

    spark.udtf.register(name, VectorSearch)
