"""Benchmark decontamination in DataFrame functions alone.

Which test items does a document contain? Texts are lower-cased and cut at ASCII white space; an item's shingles are its
runs of five words (an item of fewer words is one shingle of all of them), and a document contains the item if it has at
least ``threshold`` of its distinct shingles.

Size-partitioned MinHash search: an item of n shingles belongs to the size partition that fixes how many it may miss,
n - ceil(threshold * n), and its sketch is one more than that of its smallest hashes. A document that contains the item
misses fewer shingles than the sketch has, so at least one sketch hash is among the document's: the search loses
nothing, however long the document. Sketches are short and those of all items are looked up at once while a document's
hashes stream by. What is found is verified by exact shingle containment.

A document meets only the size partitions whose items need no more shingles than it has.

What comes of the search is ids alone, in the shared folder. Items and candidates are broadcast only where their measured
bytes are below ``broadcast_bytes``; else they meet the documents by a shuffle, on the text's hash as well as the doc_id,
so that neither a null nor a repeated doc_id makes a hot key. Null and empty texts contain nothing, items without words
are in nothing. Rows that share a doc_id (null too) are judged each for itself; ``contained`` gives the largest
containment for that doc_id, ``leaking`` names the rows. Other columns are ignored; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import NEAR, SHINGLE, let, words
from vecspark.runtime import stored

BROADCAST_BYTES = 64 << 20


def _runs(w: Column, k: Column | int, of) -> Column:
    """of(each run of k words), repeats included; none where there are fewer."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: of(F.slice(w, i, k)))).otherwise(F.array())


def _joined(run: Column) -> Column:
    return F.array_join(run, " ")


def _least(percent: int, n: Column) -> Column:
    """The fewest of n shingles that reach the threshold: in whole numbers, so that both engines agree."""
    return F.floor((n * percent + 99) / 100).cast("int")


def item_sketches(items: DataFrame, threshold: float = NEAR) -> DataFrame:
    """item_id, k (words of a shingle), shingles (distinct), least (shingles a document needs) and sketch (hashes)."""
    percent = round(threshold * 100)
    w = items.select("item_id", words(F.lower(F.coalesce("text", F.lit("")))).alias("w")).where(F.size("w") > 0)
    s = w.select("item_id", "w", F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
    s = s.select("item_id", "k", F.array_distinct(_runs(F.col("w"), F.col("k"), _joined)).alias("shingles"), F.array_distinct(_runs(F.col("w"), F.col("k"), lambda r: F.xxhash64(r))).alias("hashes"))
    return s.select("item_id", "k", "shingles", _least(percent, F.size("shingles")).alias("least"), "hashes").select(
        "item_id", "k", "shingles", "least", F.slice(F.array_sort("hashes"), F.lit(1), F.size("hashes") - F.col("least") + 1).alias("sketch")
    )


def found_in(docs: DataFrame, items: DataFrame, threshold: float = NEAR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, th (the text's hash), item_id, n_shingles and n_found of the rows that reach the threshold."""
    sketches = stored(item_sketches(items, threshold), "item-sketches")
    size = F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s) + 16)) + F.sum(F.size("sketch")) * 24
    fewest = {r.k: r.least for r in sketches.groupBy("k").agg(F.min("least").alias("least")).collect()}  # five lengths
    few = (sketches.agg(size).first()[0] or 0) <= broadcast_bytes
    maybe = F.broadcast if few else lambda x: x
    text = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("t"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"))
    w = text.select("doc_id", "th", words(F.col("t")).alias("w"))
    entries = maybe(sketches.select("item_id", "k", "least", F.explode("sketch").alias("h")))
    found = None
    for k in sorted(fewest):
        hashes = _runs(F.col("w"), k, lambda r: F.xxhash64(r))
        # an outer explode and no filter, which would cut the texts into words once more; own apart, or the words would go along with every shingle
        sized = w.select("doc_id", "th", "w", (F.size("w") - k + 1).alias("own"))
        h = sized.select("doc_id", "th", "own", F.explode_outer(F.when(F.col("own") >= fewest[k], hashes if few else F.array_distinct(hashes))).alias("h"))
        one = h.join(entries.where(F.col("k") == k), "h").where("least <= own").select("doc_id", "th", "item_id")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.select("doc_id", F.lit(0).cast("long").alias("th"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    candidates = stored(found.distinct(), "candidates")
    n = candidates.count()
    pairs = candidates.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "item_id")
    pairs = F.broadcast(pairs) if n * 64 <= broadcast_bytes else pairs
    met = w.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    met = met.join(maybe(sketches.select("item_id", "k", "shingles", "least")), "item_id")
    of = _runs(F.col("w"), F.col("k"), _joined)
    counted = met.select("doc_id", "th", "item_id", "least", F.size("shingles").alias("n_shingles"), let(of, lambda s: F.size(F.array_intersect(F.col("shingles"), s))).alias("n_found"))
    return counted.where("n_found >= least").select("doc_id", "th", "item_id", "n_shingles", "n_found")


def leaking(docs: DataFrame, items: DataFrame, threshold: float = NEAR) -> DataFrame:
    """doc_id and th (xxhash64 of the text, null as empty) of the rows that contain an item."""
    return found_in(docs, items, threshold).select("doc_id", "th").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = NEAR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of what reaches the threshold."""
    kept = found_in(docs, items, threshold, broadcast_bytes).groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return kept.select("doc_id", "item_id", F.col("n_shingles").cast("long"), F.col("n_found").cast("long"), (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def sql(threshold: float = NEAR) -> str:
    """The same for DuckDB: every shingle of every document against every item."""
    cut = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
with iw as (select item_id, {cut} as w from benchmark),
i as (select item_id, w, least(len(w), {SHINGLE}) as k from iw where len(w) > 0),
s as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as g from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as p from i)),
n as (select item_id, count(*) as n from s group by item_id),
dw as (select doc_id, {cut} as w from documents),
d as (select distinct doc_id, k, array_to_string(w[p:p + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from dw, (select distinct k from i))),
f as (select d.doc_id, s.item_id, count(*) as n_found from d join s on d.g = s.g and d.k = s.k group by all)
select doc_id, item_id, n as n_shingles, n_found, n_found / n as containment from f join n using (item_id)
where n_found >= (n * {round(threshold * 100)} + 99) // 100"""
