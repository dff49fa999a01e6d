"""Registry of queries: a function (spark, sf_dir) -> DataFrame and, where there is one, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Every id divisible by it is a query; the base is all rows.
EVERY = 100


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec (doubles), label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def queries_of(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "vec")


def base_of(v: DataFrame) -> DataFrame:
    return v


#: The same three tables for SQL.
SQL_VECTORS = f"""v as (select vec_id as id, embedding::double[] as vec, label from embeddings),
q as (select id as qid, vec from v where id % {EVERY} = 0), b as (select * from v)"""


def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})  # no negative zeros
