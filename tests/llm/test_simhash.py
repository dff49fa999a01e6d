import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm import simhash


def fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, radius=2):
    """The least index of each one's component."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2**64 - 1), st.integers(0, 3)), min_size=1, max_size=300), st.integers(0, 2))
def test_bit_sliced_links_are_the_near_ones(some, radius):
    rng = random.Random(len(some))
    rows = set()
    for key, base, flips in some:
        base = base if flips == 3 else 0x0123456789ABCDEF
        for _ in range(flips):
            base ^= 1 << rng.randrange(64)
        rows.add((key, base))
    rows = sorted(rows)
    a, b = simhash.star_links(np.array([k for k, _ in rows]), np.array([f for _, f in rows], np.uint64), radius)
    got = {}
    for x, y in zip(a.tolist(), b.tolist()):
        got.setdefault(x, set()).add(y)
    want = {}
    for k in {k for k, _ in rows}:
        f = [x for q, x in rows if q == k]
        for i, r in enumerate(brute(f, radius)):
            if r != i:
                want.setdefault(f[i], set()).add(f[r])
    assert got == want


def test_fingerprints_follow_the_contract():
    for t in ["", "one", "One TWO", "a b c", "é ß A\tb\x0bc\x1cd e f", "the the the the", "x " * 500]:
        assert int(simhash.fingerprints_of([simhash.shingle_hashes(t)])[0]) == fingerprint(t)


def corpus(n=400):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([5, 80, 400]))]
        rows.append((1000 - i, " ".join(w)))
    return rows + [(2000 + i, t) for i, t in enumerate([None, "", " \n", "copy of a text"] + ["copy of a text"] * 40)]


def test_components_match_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    fps = [fingerprint(t) for _, t in rows]
    least = {}
    for (i, _), r in zip(rows, brute(fps)):
        least[r] = min(least.get(r, i), i)
    want = {i: (f, least[r]) for (i, _), f, r in zip(rows, fps, brute(fps))}
    for block in (4096, 16):  # hot buckets dealt out
        got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(d, block=block).collect()}
        assert got == want
    assert len(set(least.values())) < len(set(fps))  # there were links


def test_chains_nulls_and_empty(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    assert {(r.a, r.b) for r in simhash.components(e).collect()} == {(i, 1) for i in range(2, 41)} | {(100, 90), (95, 90)}
    d = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_long_texts_are_cut_in_pieces(monkeypatch):
    rng = random.Random(9)
    text = " \n".join(rng.choice(["Alpha", "beta", "\u00c9t\u00e9", "g"]) + str(rng.randrange(99)) for _ in range(3000))
    for words in (1, 3, 5):
        whole = simhash.shingle_hashes(text, words)
        monkeypatch.setattr(simhash, "PIECE", 100)
        monkeypatch.setattr(simhash, "LAID", 64)
        assert (simhash.shingle_hashes(text, words) == whole).all()
        assert simhash.long_fingerprint(simhash.shingle_runs(text.encode(), words))[0] == simhash.fingerprints_of([whole])[0]
        monkeypatch.undo()
    assert int(simhash.long_fingerprint(simhash.shingle_runs(text.encode(), 3))[0]) == fingerprint(text)
    for t in ("", " ", "a", "a b", "a b c"):
        assert int(simhash.long_fingerprint(simhash.shingle_runs(t.encode(), 3))[0]) == fingerprint(t)


def test_hot_buckets_are_split_by_their_open_bits(spark):
    """Many fingerprints that share half their bits: links are the same however small the parts."""
    rng = random.Random(10)
    fps = {(0xABCD1234 << 32) | sum(1 << b for b in rng.sample(range(12), rng.randrange(7))) << rng.choice([0, 3, 16]) for _ in range(600)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    d = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = sorted(signed[i] for i, r in enumerate(brute(fps)) if r != i)
    for block in (16, 100, 4096):
        roots = {r.a: r.b for r in simhash.components(simhash.links(d, 2, block)).collect()}
        classes = {}
        for i, r in enumerate(brute(fps)):
            classes.setdefault(r, set()).add(roots.get(signed[i], signed[i]))
        assert all(len(c) == 1 for c in classes.values()) and len(classes) == len({min(c) for c in classes.values()})
    assert want
