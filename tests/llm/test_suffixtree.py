import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa

from vecspark.llm import suffixtree
from vecspark.runtime import shared_root


def corpus():
    rng = random.Random(4)
    tongues = [["the", "of", "And", "running.", "word,", "tested"], ["el", "de", "Niño", "según.", "casa,", "él"], ["der", "Straße", "und", "für", "haus.", "über,"]]
    rows = []
    for i in range(400):
        t = rng.choice(tongues)
        rows.append((i, rng.choice([" ", "\n"]).join(rng.choice(t) if rng.random() < 0.7 else "".join(rng.choices("abcé1", k=rng.randrange(1, 8))) for _ in range(rng.choice([0, 1, 2, 30, 120])))))
    phrase = "und the de haus. of el for el de haus. of der"
    rows += [(500 + i, f"{rows[i][1]} {phrase}") for i in range(40)]
    return rows + [(1000, None), (1001, ""), (1002, "long " * 20_000), (None, "the of"), (7, rows[7][1]), (7, rows[7][1])]


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [""]


def brute(rows, depth, frequent, contexts, gain, discount=0.7):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [tokens(t) for i, t in rows if not held(i)]
    c = Counter(w for t in train for w in t)
    total, distinct = sum(c.values()), len(c)
    words = sorted({w for _, t in rows for w in tokens(t)} - {""})
    shape = dict(zip(words, suffixtree.shapes(pa.array(words)).tolist()))
    often = {w for w in c if w and c[w] >= frequent}
    symbol = lambda w: ("end",) if w == "" else ("word", w) if w in often else ("shape", shape[w])
    n, v = Counter(), Counter()
    for w, k in c.items():
        n[symbol(w)] += k
        v[symbol(w)] += 1
    every = [("end",), *(("shape", k) for k in range(suffixtree.SHAPES)), *(("word", w) for w in often)]
    root = {s: (n[s] + 1) / (total + len(every)) for s in every}
    follows, seen = defaultdict(Counter), Counter()
    for t in train:
        x = [symbol(w) for w in t]
        for i in range(len(x)):
            for d in range(1, depth + 1):
                if i >= d:
                    follows[tuple(x[i - d : i])][x[i]] += 1
    seen = {k: sum(f.values()) for k, f in follows.items()}
    p = {(): root}

    def state(k):
        while k not in p:
            k = k[1:]
        return k

    tried = 0
    for k in sorted(seen, key=len):
        if seen[k] < contexts:
            continue
        tried += 1
        parent, f, kinds = p[state(k[1:])], follows[k], len(follows[k])
        bits = 0.0
        for s, m in f.items():  # each occurrence by all the others
            others = (max(m - 1 - discount, 0) + discount * (kinds - (m == 1)) * parent[s]) / max(seen[k] - 1, 1)
            bits += m * math.log2(max(others / parent[s], 1e-3))
        if bits >= gain * seen[k]:
            p[k] = {s: (max(f[s] - discount, 0) + discount * kinds * parent[s]) / seen[k] for s in every}
    assert 20 < len(p) < tried and max(map(len, p)) >= 3  # the test rejects some
    assert all(abs(sum(q.values()) - 1) < 1e-9 for q in p.values())
    out = []
    for i, t in rows:
        w = tokens(t)
        x = [symbol(a) for a in w]
        score = 0.0
        for j, (a, s) in enumerate(zip(w, x)):
            score += math.log10(p[state(tuple(x[max(0, j - depth) : j]))][s])
            if s[0] == "shape":
                score += math.log10((c[a] + 1) / (n[s] + v[s] + 1))
        out.append((i, held(i), len(w), sum(c[a] > 0 for a in w), total, sum(math.log10((c[a] + 1) / (total + distinct + 1)) for a in w), score))
    return out


def test_matches_brute_force_and_beats_the_base(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(5)
    want = sorted(brute(rows, 4, 30, 15, 0.05), key=str)
    got = sorted((tuple(r) for r in suffixtree.score(d, 4, 30, 15, 0.05).collect()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-12)
    assert np.allclose([x[6] for x in got], [x[6] for x in want], rtol=1e-5)
    out = [x for x in got if x[1] and x[2] > 5]
    assert sum(x[6] for x in out) > sum(x[5] for x in out)


def test_hot_contexts_follow_the_same_rules(spark):
    """Where contexts are dealt in pieces, the test and the smoothing are those of all others."""
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(brute(rows, 4, 30, 15, 0.05), key=str)
    got = sorted((tuple(r) for r in suffixtree.score(d, 4, 30, 15, 0.05, hot=60).collect()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[6] for x in got], [x[6] for x in want], rtol=1e-5)


def test_hot_contexts_are_the_same_in_pieces():
    """What is asked of a hot context in two buckets is answered as in one."""
    rng = np.random.default_rng(1)
    c, q = rng.integers(0, 50_000, 60), rng.dirichlet(np.ones(60))
    total = np.array([int(c.sum())])
    assert total[0] >= suffixtree.HOT
    kinds, kept = suffixtree.contexts_tested(total, np.zeros(60, int), c, q, 0.05)
    whole = suffixtree.smoothed(c, q, total[0], kinds[0], kept[0])
    parts = []
    for k in (0, 1):
        kinds, some = suffixtree.contexts_tested(total, np.zeros(30, int), c[k::2], q[k::2], 0.05)
        parts.append(suffixtree.smoothed(c[k::2], q[k::2], total[0], kinds[0], some[0]))
    assert kept.all() and abs(whole.sum() - 1) < 1e-9
    assert np.allclose(whole[0::2], parts[0]) and np.allclose(whole[1::2], parts[1])


def test_passages_that_repeat_are_scored_apart(spark):
    rng = random.Random(6)
    fresh = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(80))
    often = fresh()
    rows = [(i, fresh()) for i in range(200)] + [(1000 + i, f"{fresh()} {often}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixtree.score(d).collect()
    mean = lambda rs: sum(r.score for r in rs) / sum(r.n_tokens for r in rs)
    assert mean([r for r in got if r.doc_id >= 1000]) > 0.75 * mean([r for r in got if r.doc_id < 1000])


def test_symbols_of_a_shape_sum_to_one():
    words = ["a", "ab.", "abc,", "niño", "straße.", "ABCDEF", "9", "...", "é", "日本", "日本。"]
    s = suffixtree.shapes(pa.array(words))
    assert s.min() >= 0 and s.max() < suffixtree.SHAPES
    assert (suffixtree.shapes(pa.array(["zz", *words]).slice(1)) == s).all()


def test_empty_and_wordless_tables(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert suffixtree.score(d.limit(0)).count() == 0
    got = suffixtree.score(d).collect()
    assert {r.n_tokens for r in got} == {1} and all(r.score <= 0 for r in got)


def test_questions_take_few_bytes_in_many_buckets(spark):
    """Symbols, contexts and their counts are small in messages, into however many buckets a block's questions are dealt."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(4000)])
    rows = [(i, " ".join(words[np.minimum(rng.zipf(1.3, 200), 4000) - 1])) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    shuffled = lambda: sum(at.apply(i).totalShuffleWrite() for at in [spark.sparkContext._jsc.sc().statusStore().executorList(True)] for i in range(at.size()))
    before, partitions = shuffled(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")  # buckets too
        assert suffixtree.score(d, 2).count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert shuffled() - before < 330_000


def test_levels_keep_little_on_disk(spark, monkeypatch):
    """The second level's logarithms follow from counts, so no file holds them for each block."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(4000)])
    rows = [(i, " ".join(words[np.minimum(rng.zipf(1.3, 200), 4000) - 1])) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder, sizes, forget = Path(shared_root(spark).removeprefix("file://"), "vecspark"), [], suffixtree.forget
    kept = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    monkeypatch.setattr(suffixtree, "forget", lambda *tables: (sizes.append(kept()), forget(*tables)))
    before = kept()
    assert suffixtree.score(d, 2).count() == 1000
    assert max(sizes) - before < 450_000
