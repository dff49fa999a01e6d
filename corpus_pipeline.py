"""A training corpus from raw documents: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result to the
shared folder and reads it again as the next stage's docs. All stages but the last return the columns of documents.
Rows are never sampled or capped: a stage drops a row only for its own reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import decontaminate, jaccard, packing, quality, secrets
from vecspark.llm.common import table
from vecspark.runtime import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that go are broadcast up to so many (of some 20 bytes); above, they meet the others by a shuffle.
BROADCAST_ROWS = 200_000


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """docs with the text's hash: a row is known by doc_id and text, so null and repeated doc_ids lose nothing."""
    return _columns(docs).withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))


def _met(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs (with _th) that are (left_semi) or aren't (left_anti) among keys (doc_id, th), which are stored."""
    keys = keys.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_text"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_doc"]) & (docs["_th"] == keys["_text"]), how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: judged row by row, without a join."""
    judged = quality.keep(docs)
    return _columns(judged)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard 0.8 or more) stays: the row whose doc_id, then text's hash, is least. Of rows that repeat with one doc_id and text the first by the other columns stays."""
    found = stored(jaccard.verdicts(docs), "near-duplicates")
    kept = _met(_named(docs), found.where(~F.col("stays")), "left_anti")
    again = found.where("stays and copies > 1")
    if again.count():
        rest = [c for c in COLUMNS if c != "doc_id"]
        one = _met(kept, again, "left_semi").groupBy("doc_id", "_th").agg(F.min(F.struct(*rest)).alias("x")).select("doc_id", "x.*")
        kept = _columns(_met(kept, again, "left_anti")).unionByName(_columns(one))
    return _columns(kept)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a test item go."""
    found = stored(decontaminate.leaking(docs, table(spark, sf_dir, "benchmark")), "leaks")
    return _columns(_met(_named(docs), found, "left_anti"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; every document stays. n_chars follows the text."""
    t = F.col("text")
    masked = F.when(t.isNotNull(), secrets.redact(t, secrets.spans(t)))
    return _columns(docs).withColumn("text", masked).withColumn("n_chars", F.when(t.isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]
#: Components of near copies and packing can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
