import random
from collections import defaultdict

from vecspark.llm import sharding


def held(rows, got, shards):
    """Sizes of the shards, after the checks that hold for any result."""
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.size == len((r.text or "").encode()) + 8
    assert set(by) <= set(range(shards)) and len(got) == len(rows)
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(x[:2]) for x in rows)
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    return [sum(r.size for r in by[k]) for k in range(shards)]


def test_sizes_are_near_equal_with_a_hot_text_and_long_ones(spark):
    rng = random.Random(3)
    rows = [(i, "copy " * 40 if i % 3 == 0 else "x" * rng.randrange(400) + str(i)) for i in range(6000)] + [(9000 + i, "long " * 2000) for i in range(5)] + [(None, "n"), (7, None), (8, "")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, slot int")
    sizes = held(rows, sharding.shard(d, 24, task_bytes=20_000).collect(), 24)
    mean = sum(sizes) / 24
    assert max(abs(s - mean) for s in sizes) <= 0.002 * mean + 12_000


def test_ties_few_rows_and_no_rows(spark):
    rows = [(1, "same")] * 50 + [(2, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    held(rows, sharding.shard(d, 24).collect(), 24)
    assert sharding.shard(d.limit(0), 24).count() == 0
    assert held([(1, "a")], sharding.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 24).collect(), 24)


def test_equal_texts_are_neighbours(spark):
    rows = [(i, f"text {i % 50}") for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.text].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 3


def test_places_follow_from_the_rows_alone(spark):
    """Ties in doc_id and text are ordered by the other columns, however the rows come in; small bins change no shard."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([None, "same", "same", f"t{i}" * rng.randrange(90)]), i) for i in range(800)]
    got = []
    for n, task in ((1, 8 << 20), (7, 8 << 20), (3, 64), (3, 1000)):
        rng.shuffle(rows)
        d = spark.createDataFrame(rows, "doc_id long, text string, x long").repartition(n)
        r = sharding.shard(d, 5, task_bytes=task).collect()
        held(rows, r, 5)
        got.append({(x.x, x.shard, x.slot if task > 1000 else None) for x in r})
    assert got[0] == got[1] and {(a, b) for a, b, _ in got[0]} == {(a, b) for a, b, _ in got[2]} == {(a, b) for a, b, _ in got[3]}
