"""Sharding by histogram sort, in DataFrame functions alone.

Rows are ordered by a key: the text's hash, then the doc_id's. Copies of one text are therefore neighbours and stay in
one shard unless a splitter falls among them, which a hot text needs. Splitters are probed, not sampled: each round
counts the exact bytes and rows below candidate boundaries within every open bracket (one small aggregate for all
brackets, over a table of keys and sizes in the shared folder) and narrows the bracket to the bin that holds the target,
until a boundary lies within the tolerance or one key remains. Then the rows are exchanged once.

Within a shard rows are dealt out by bins of some ``task_bytes``: leading digits of the key, as many as the bytes ask for,
and where one text alone holds more than that, digits of the doc_id's hash as well. So no task sorts a whole shard or a hot
text, at any size; bins are counted exactly, and a running count over them gives each its first slot. What comes to the
driver is a few thousand counts a round, whatever the input. Bins' counts and hot texts are broadcast only below
``broadcast_bytes`` as counted.

A null text has no bytes, a null doc_id is a key like any other, rows that repeat wholly have one key and stay together,
rows that differ in other columns alone are ordered by these, other columns go along, an empty table gives no rows. Law: ``bytes``; shard sizes differ by the tolerance and a row."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.runtime import stored

EXTRA = 8
#: Digits of the text's hash; as many of the doc_id's follow.
HASH = 16
#: Digits of the key that each round probes in a bracket: 16 ** DIGITS bins.
FIRST, DIGITS = 3, 2


def key(doc_id: Column, text: Column) -> Column:
    hexa = lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))
    return F.concat(hexa(F.coalesce(text, F.lit(""))), hexa(doc_id))


def size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + EXTRA).cast("long")


@dataclass
class Bracket:
    """Keys from low on and below high ("" is past all) hold the target; bytes and rows below low, and in the bracket."""

    low: str
    high: str
    bytes_below: int
    rows_below: int
    bytes: int
    rows: int
    least: str
    most: str


@dataclass(frozen=True)
class Splitter:
    key: str
    bytes_below: int
    rows_below: int


def _common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def _bins(keys: DataFrame, prefixes: dict[str, int] | None) -> dict[str, list[tuple]]:
    """(prefix, bytes, rows, least key, most key) of the bins under each prefix; prefixes: how long a bin's name is there."""
    if prefixes is None:
        named = keys.select(F.lit("").alias("p"), F.substring("key", 1, FIRST).alias("b"), "key", "size")
    else:
        cases = None
        for p, n in prefixes.items():
            hit = F.col("key").startswith(p)
            value = F.struct(F.lit(p).alias("p"), F.substring("key", 1, n).alias("b"))
            cases = F.when(hit, value) if cases is None else cases.when(hit, value)
        named = keys.select(cases.alias("x"), "key", "size").where("x is not null").select("x.p", "x.b", "key", "size")
    out: dict[str, list[tuple]] = {}
    for r in named.groupBy("p", "b").agg(F.sum("size"), F.count("*"), F.min("key"), F.max("key")).collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return {p: sorted(x) for p, x in out.items()}


def splitters(keys: DataFrame, targets: list[tuple[float, float]], first: list[tuple]) -> tuple[list[Splitter], int]:
    """For each (bytes, tolerance) a boundary with about so many bytes below it; the rounds taken. first: the bins of the first round."""

    def within(bins: list[tuple], at: float, high: str, below: int, rows: int) -> Bracket:
        ends = list(accumulate(b[1] for b in bins))
        i = min(bisect_right(ends, at - below), len(bins) - 1)
        name, size, n, least, most = bins[i]
        nxt = bins[i + 1][0] if i + 1 < len(bins) else high
        return Bracket(name, nxt, below + ends[i] - size, rows + sum(b[2] for b in bins[:i]), size, n, least, most)

    brackets = [within(first, at, "", 0, 0) for at, _ in targets]
    found: list[Splitter | None] = [None] * len(targets)
    rounds = 1
    while True:
        wanted: dict[str, int] = {}
        for i, (b, (at, tolerance)) in enumerate(zip(brackets, targets)):
            if found[i]:
                continue
            low, high = at - b.bytes_below, b.bytes_below + b.bytes - at
            if min(low, high) <= tolerance or b.least == b.most:
                up = high < low
                found[i] = Splitter(b.high if up else b.low, b.bytes_below + up * b.bytes, b.rows_below + up * b.rows)
            else:
                p = _common(b.least, b.most)
                wanted[p] = min(len(b.least), len(p) + DIGITS)
        if not wanted:
            return found, rounds  # type: ignore[return-value]
        rounds += 1
        bins = _bins(keys, wanted)
        for i, b in enumerate(brackets):
            if not found[i]:
                p = _common(b.least, b.most)
                brackets[i] = within(bins[p], targets[i][0], b.high, b.bytes_below, b.rows_below)


def _digits(total: Column | int, task_bytes: int) -> Column:
    """Hexadecimal digits that cut so many bytes into parts of task_bytes."""
    return F.greatest(F.lit(0), F.ceil(F.log(16.0, F.lit(total).cast("double") / task_bytes if isinstance(total, int) else total / task_bytes))).cast("int")


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, task_bytes: int = 8 << 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """docs with size, shard and slot added (columns of these names are replaced)."""
    docs = docs.drop("size", "shard", "slot")
    keyed = docs.withColumns({"_key": key(F.col("doc_id"), F.col("text")), "size": size(F.col("text"))})
    keys = stored(keyed.select(F.col("_key").alias("key"), "size"), "shard-keys")
    first = _bins(keys, None).get("", [])
    total = sum(b[1] for b in first)
    cuts: list[Splitter] = []
    if first and shards > 1:
        part = total / shards
        cuts, _ = splitters(keys, [(part * i, tolerance * part / 2) for i in range(1, shards)], first)
        for i in range(1, len(cuts)):  # boundaries within their tolerances can't cross, but keep them in order where parts are tiny
            cuts[i] = max(cuts[i - 1], cuts[i], key=lambda s: s.bytes_below)
    past = "g"  # above every hexadecimal digit
    ends = [c.key or past for c in cuts]
    hot = keys.groupBy(F.substring("key", 1, HASH).alias("_text")).agg(F.sum("size").alias("b")).where(F.col("b") > task_bytes)
    hot = stored(hot.select("_text", _digits(F.col("b"), task_bytes).alias("_more")), "hot-texts")
    small = F.broadcast if hot.count() * 64 <= broadcast_bytes else lambda x: x
    own = _digits(max(total, 1), task_bytes)

    def binned(rows: DataFrame, name: str) -> DataFrame:
        k = F.col(name)
        place = F.lit(0)
        for end in ends:
            place = place + F.when(k >= end, 1).otherwise(0)
        met = rows.withColumn("_text", F.substring(k, 1, HASH)).join(small(hot), "_text", "left")
        cut = F.substring(k, F.lit(1), F.least(F.lit(2 * HASH), F.when(F.col("_more").isNull(), own).otherwise(F.col("_more") + HASH)))
        return met.withColumns({"shard": place.cast("int"), "_bin": cut}).drop("_text", "_more")

    counts = binned(keys, "key").groupBy("shard", "_bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = stored(counts.select("shard", "_bin", (before - F.col("n")).alias("_start")), "bin-starts")
    starts = F.broadcast(starts) if starts.count() * 64 <= broadcast_bytes else starts
    order = Window.partitionBy("shard", "_bin").orderBy("_key", F.col("doc_id").asc_nulls_first(), F.xxhash64(*(F.col(c).cast("string") for c in docs.columns)))
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * task_bytes)))
    return (
        binned(keyed, "_key")
        .join(starts, ["shard", "_bin"])
        .repartition(tasks, "shard", "_bin")
        .withColumn("slot", F.row_number().over(order).cast("long") - 1 + F.col("_start"))
        .select(*docs.columns, "size", "shard", "slot")
    )
