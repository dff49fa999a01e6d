import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm import substrings
from vecspark.llm.fmindex import FMIndex, repeated_stretches


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=18), min_size=1, max_size=10), st.integers(1, 7))
def test_matching_statistics_against_counting(streams, least):
    text, start = [], []
    for s in streams:
        start.append(len(text))
        text += [*s, 0]
    t = np.array(text)
    found = repeated_stretches(FMIndex(t, 4, 32), t, np.array(start), np.array([len(s) for s in streams]), least)
    got = [set() for _ in streams]
    for k, a, b in zip(*found):
        assert b - a >= least
        got[k] |= set(range(a, b))
    grams = Counter(tuple(s[i : i + least]) for s in streams for i in range(len(s) - least + 1))
    for k, s in enumerate(streams):
        assert got[k] == {i + j for i in range(len(s) - least + 1) if grams[tuple(s[i : i + least])] > 1 for j in range(least)}


def brute(rows, window):
    words = [[w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w] for _, t in rows]
    grams = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {i + j for i in range(len(w) - window + 1) if grams[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    v = [f"w{i}" for i in range(500)] + ["é", "\xa0x", "#"]
    passages = [rng.choices(v, k=n) for n in (9, 20, 34, 35, 36, 80)]
    rows = []
    for i in range(150):
        w = rng.choices(v, k=rng.choice([0, 10, 60, 300]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(passages) + w[at:]
        if i % 10 == 3 and rows:
            w = (rows[-1][1] or "").split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = "edit"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    line = " ".join(passages[1])
    rows += [(1000 + i, f"{' '.join(rng.choices(v, k=40))} {line} {' '.join(rng.choices(v, k=40))}") for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "same " * 400), (2003, "same " * 34), (2004, "ab ba " * 60), (None, rows[5][1]), (None, "x"), (7, rows[7][1]), (7, rows[7][1])]
    return rows + [(3000 + i, rows[20][1]) for i in range(60)]


def test_matches_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, th int, seg string").repartition(3)
    want = brute(rows, 35)
    assert sum(x[2] > 0 for x in want) > 40
    for shard, hot in ((500_000, 100_000), (300, 150), (300, 1_000_000)):  # small shards and hot anchors
        got = sorted((tuple(r) for r in substrings.remove_repeats(d, shard=shard, hot=hot).collect()), key=str)
        assert got == want


def test_other_windows_and_empty_tables(spark):
    rows = corpus()[:60]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substrings.remove_repeats(d, window=10, gram=4).collect()), key=str) == brute(rows, 10)
    assert substrings.remove_repeats(d.limit(0)).count() == 0
