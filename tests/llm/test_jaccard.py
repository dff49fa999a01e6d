import random

import corpus_pipeline
from vecspark.llm import jaccard


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """The least doc_id of each row's component."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(k, least[find(i)]) for i, (k, _) in enumerate(rows)]


def corpus():
    rng = random.Random(3)
    v = [f"w{i}" for i in range(400)]
    rows, line = [], [rng.choice(v) for _ in range(60)]
    for i in range(300):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 2, 3, 4, 8, 12])):
                w[rng.randrange(len(w))] = rng.choice(v)
            w = w[: rng.choice([len(w), len(w) - 3])]
        else:
            w = [rng.choice(v) for _ in range(rng.choice([7, 40, 150, 400]))] + line * (rng.random() < 0.4)
        rows.append((1000 - i, " ".join(w)))
    group = [rng.choice(v) for _ in range(200)]
    for i in range(60):  # one large group
        w = list(group)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(v)
        rows.append((3000 + i, " ".join(w)))
    return rows + [(4000 + i, t) for i, t in enumerate([None, "", " \n", "a copy", "A  copy", "a b c d e", "a b c d e f"])]


def test_components_match_brute_force(spark, monkeypatch):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, x int").repartition(3)
    want = sorted(brute(rows))
    for most in (jaccard.MOST, 5):  # whatever order the sample gives
        monkeypatch.setattr(jaccard, "MOST", most)
        assert sorted(map(tuple, jaccard.near_duplicates(d).collect())) == want
    assert len(set(c for _, c in want)) < len({shingles(t) for _, t in rows})  # there were links


def test_stage_removes_near_copies_and_keeps_others(spark):
    rng = random.Random(4)
    w = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near, far = list(w), list(w)
    for i in range(10, 300, 60):  # 5 words changed: 25 of 296 shingles differ
        near[i] += "x"
    for i in range(10, 300, 20):  # 15 words: similarity below 0.8
        far[i] += "x"
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [1, 3]


def test_nulls_and_empty(spark):
    d = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "z")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert jaccard.near_duplicates(d.limit(0)).count() == 0


def test_a_group_of_near_copies_is_joined_without_its_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for at in range(5, 55, 5):  # ten groups that share most shingles; texts link within a group
        for i in range(30):
            rows.append((len(rows), " ".join([*base[:at], f"x{rng.random()}", *base[at + 1 :]])))
    tested, verified = [], jaccard._verified

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
    assert sum(tested) < 4 * len(rows)
