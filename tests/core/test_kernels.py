import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.functions import distance as D
from vecspark.functions import prep as P
from vecspark.operators import graph as G
from vecspark.operators import pq
from vecspark.operators.search import Part, SearchParams, State


def test_metrics_are_known_or_refused():
    assert D.metric("l2") is D.Metric.L2
    with pytest.raises(ValueError):
        D.metric("euclid")
    with pytest.raises(ValueError):
        D.distance("mips", "uint8")


def test_pairwise_agrees_with_rows():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5, 7)), rng.normal(size=(9, 7))
    for m in ("l2", "cosine"):
        want = np.array([[D.to_rows(m, x, y[None])[0] for y in b] for x in a])
        assert np.allclose(D.pairwise(m, a, b), want)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 64), st.integers(1, 64))
def test_chunks_cover_the_dimensions(dim, chunks):
    chunks = min(dim, chunks)
    o = pq.chunk_offsets(dim, chunks)
    w = np.diff(o)
    assert o[0] == 0 and o[-1] == dim and len(w) == chunks and max(w) - min(w) <= 1 and list(w) == sorted(w, reverse=True)


def test_codes_and_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 10))
    mean = x.mean(axis=0)
    o = pq.chunk_offsets(10, 3)
    book = pq.Codebook(mean, o, [pq._lloyd((x - mean)[:, a:b], 16, 0) for a, b in zip(o, o[1:])])
    codes = book.encode(x)
    decoded = book.decode(codes)
    assert ((decoded - x) ** 2).sum(1).mean() < ((x - mean) ** 2).sum(1).mean() / 2
    q = rng.normal(size=10)
    assert np.allclose(pq.adc(book.table(q[None])[0], codes), ((decoded - q) ** 2).sum(1))
    t = book.between()
    assert np.allclose(sum(t[c, codes[0, c], codes[1, c]] for c in range(3)), ((decoded[0] - decoded[1]) ** 2).sum())
    assert np.allclose(pq.adc(book.inner_table(q[None])[0], codes), -(decoded - mean) @ q)


def naive_prune(ids, dist, x, degree, pool, alpha):
    """Candidates by (distance, id), once each; in rounds of growing slack take each that no chosen nearer one covers."""
    rows = []
    for k in np.lexsort((ids, dist))[:pool]:
        if ids[k] not in [ids[r] for r in rows]:
            rows.append(k)
    chosen, slack = [], 1.0
    while slack <= alpha:
        for place, k in enumerate(rows):
            if k in chosen or len(chosen) >= degree:
                continue
            cover = [dist[k] / ((x[k] - x[c]) ** 2).sum() for c in chosen if rows.index(c) < place]
            if max(cover, default=0) <= slack:
                chosen.append(k)
        slack *= 1.2
    return sorted(ids[k] for k in chosen)


def test_prune_follows_the_rule():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    p = G.BuildParams(degree=8, alpha=1.5, pool=60)
    for node in range(10):
        ids = np.array([i for i in range(80) if i != node] + [3 if node != 3 else 4])
        d = D.to_rows("l2", x[node], x[ids])
        kept = G.prune(ids, d, x[ids], p)
        assert kept[0] == ids[np.lexsort((ids, d))[0]]
        assert sorted(kept.tolist()) == naive_prune(ids, d, x[ids], 8, 60, 1.5)
        assert len(G.prune(ids, d, x[ids], G.BuildParams(degree=30, alpha=1.2, saturate=True))) == 30
    assert not len(G.prune(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 4)), p))


def naive_evict(node, ids, x, alpha):
    d = lambda a, b: float(((a - b) ** 2).sum())
    rows = sorted(range(len(ids)), key=lambda k: (d(node, x[k]), ids[k]))
    new, slack = len(ids) - 1, alpha
    while slack >= 1 - 1e-5:
        for k in reversed(rows):
            if k != new:
                far = k if d(node, x[k]) > d(node, x[new]) else new
                if d(node, x[far]) > slack * d(x[k], x[new]):
                    return [ids[r] for r in rows if r != far]
        slack /= 1.2
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a != new and d(node, x[b]) > alpha * d(x[a], x[b]):
                return [ids[r] for r in rows if r != b]
    return [ids[r] for r in rows[:-1]]


def test_eviction_follows_the_rule():
    rng = np.random.default_rng(4)
    gone = set()
    for n in range(400):
        x = rng.normal(size=(9, rng.integers(2, 12)))
        ids = rng.permutation(50)[:8]
        p = G.BuildParams(degree=7, alpha=float(rng.choice([1.0, 1.2, 1.5])))
        kept = G.evict(x[8], ids, x[:8], p).tolist()
        assert kept == naive_evict(x[8], ids.tolist(), x[:8], p.alpha)
        gone.add(len(set(ids.tolist()) - set(kept)) and int(np.flatnonzero(~np.isin(ids, kept))[0]))
    assert len(gone) > 4


@pytest.mark.parametrize("n", [1, 2, 5, 200])
def test_built_graphs_are_bounded_and_connected(n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 6))
    if n == 200:
        x[50:60] = x[50]  # copies
    p = G.BuildParams(6, 20, 40)
    nbrs, entry = G.build(x, p)
    assert G.reachable(nbrs, entry).all()
    assert all(i not in a and len(set(a.tolist())) == len(a) and len(a) <= 7 for i, a in enumerate(nbrs))
    if n == 200:
        hits = 0
        for q in rng.normal(size=(30, 6)):
            ids, d = G.greedy(x, nbrs, q, entry, 60)
            best = ids[np.lexsort((ids, d))[:5]]
            want = np.lexsort((np.arange(n), D.to_rows("l2", q, x)))[:5]
            hits += len(set(best.tolist()) & set(want.tolist()))
        assert hits >= 0.9 * 150


def test_pool_rules():
    s = State.start(np.zeros(1), np.array([5, 3, 5]), np.array([2.0, 1.0, 2.0]), np.array([0, 1, 0]), 3)
    assert s.ids.tolist() == [3, 5]
    s.add(np.array([9, 3, 8, 8]), np.array([1.0, 1.0, 0.5, 0.5]), np.zeros(4, np.int64), 3)
    assert s.ids.tolist() == [8, 3, 9] and s.cmps == 2
    here, away = s.frontier(2, 0)
    assert s.ids[here].tolist() == [8] and away is None
    s.done[here] = True
    here, away = s.frontier(1, 0)
    assert not len(here) and away == 1
    s.exact_id, s.exact_d = [4, 2, 4], [1.0, 1.0, 1.0]
    assert s.best(5)[0].tolist() == [2, 4]


def test_small_rules():
    assert P.pq_chunks(0, 10, 64) == 1 and P.pq_chunks(10**9, 10, 64) == 64 and P.pq_chunks(10**9, 10, 512) == 128
    assert P.medoid_sample_size(1000, 500) == 1000 and P.medoid_sample_size(1000, 8_500) == 1300
    r = P.rotation(5)
    assert np.allclose(r @ r.T, np.eye(5))


@pytest.mark.parametrize("size", [1, 8, 30, 300])
def test_searches_in_step_find_what_one_by_one_does(size):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = rng.normal(size=(250, 8))
    nbrs, entry = G.build(x, G.BuildParams(8, 24, 48))
    book = pq.Codebook(x.mean(axis=0), [0, 4, 8], [pq._lloyd((x - x.mean(axis=0))[:, a : a + 4], 32, 0) for a in (0, 4)])
    codes, ids = book.encode(x), np.arange(250) * 3 + 1
    order = rng.permutation(250)  # rows in any order
    t = pa.table({"id": ids[order], "vec": list(x[order]), "codes": list(codes[order]), "nbrs": pa.array([ids[nbrs[i]].tolist() for i in order], pa.list_(pa.int64())), "nbr_codes": pa.array([codes[nbrs[i]].ravel().tolist() for i in order], pa.list_(pa.int16())), "nbr_homes": pa.array([[0] * len(nbrs[i]) for i in order], pa.list_(pa.int32()))})
    part, p = Part.of(t), SearchParams(5, size, 3)
    q = rng.normal(size=(40, 8))
    tables = book.table(q)
    at = part.rows(np.array([ids[entry]]))
    many = part.run_many(q, tables, np.broadcast_to(at, (40, 1)), p)
    for i in range(40):
        s = State.start(q[i], part.ids[at], pq.adc(tables[i], part.codes[at]), np.zeros(1, np.int64), size)
        part.run(s, tables[i], p)
        found, d = s.best(5)
        assert many[i][0].tolist() == found.tolist() and np.allclose(many[i][1], d) and (many[i][2], many[i][3]) == (s.hops, s.ios)


def _nodes(n, degree, homes, seed):
    """A random graph as an index has it: (codebook, parts by home, all as one)."""
    from vecspark.operators.pq import Codebook
    from vecspark.operators.search import Part

    rng = np.random.default_rng(seed)
    ids, x = np.sort(rng.choice(10 * n, n, False)), np.round(rng.normal(size=(n, 4)))
    codes = rng.integers(0, 3, (n, 2)).astype(np.int16)  # few codes: many equal distances
    links = [rng.choice(n, rng.integers(1, degree + 1), False) for _ in range(n)]
    home = rng.integers(0, homes, n)

    def part(own, h):
        sizes = [len(links[i]) for i in own]
        flat = np.concatenate([links[i] for i in own])
        return Part(h, ids[own], x[own], codes[own], np.concatenate([[0], np.cumsum(sizes)]), ids[flat], codes[flat], home[flat].astype(np.int32))

    return rng.random((2, 3)), {h: part(np.flatnonzero(home == h), h) for h in range(homes)}, part(np.arange(n), None), x, home


def test_pools_of_all_nodes_expand_what_sorted_pools_do():
    from vecspark.operators import search
    from vecspark.operators.pq import adc

    for seed in range(6):
        table, parts, one, x, home = _nodes(400, 3, 3, seed)
        p, seeds = search.SearchParams(7, 400, 5), np.array([3, 90, 90, 211])
        for links, homes in ((one.links(), None), (one.links(), home)):
            start = None if homes is None else int(home[90])
            seen, hops, cmps, history = search.expanded_all(search.code_distances(table, one.codes), links, seeds, p.beam, homes, start)
            best, d = search.best_of(x[0], [(slice(None), one.x)], seen, p.k)
            if homes is None:
                (ids, dist, *cost), = one.run_many(x[:1], table[None], seeds[None], p)
                want = ids.tolist(), dist.tolist(), cost
            else:
                s = search.State.start(x[0], one.ids[seeds], adc(table, one.codes[seeds]), home[seeds], p.size)
                while start is not None:
                    start = parts[start].run(s, table, p)
                want = s.best(p.k)[0].tolist(), s.best(p.k)[1].tolist(), [s.hops, s.ios, s.cmps]
                assert history == s.history and len(history) > 2
            assert (one.ids[best].tolist(), d.tolist(), [hops, int(seen.sum()), cmps]) == want
        assert (search.reached(one.links(), 3) == search.expanded_all(np.zeros(400), one.links(), seeds[:1], 5)[0]).all()


def test_pools_of_all_nodes_take_time_in_proportion():
    import time

    from vecspark.operators import search

    class Book:
        def table(self, q):
            return np.random.default_rng(1).random((len(q), 2, 3))

    _, _, one, x, _ = _nodes(40_000, 12, 1, 9)
    began = time.time()
    rows = search._many(one, list(range(16)), x[:16], Book(), np.zeros((16, 1), int), search.SearchParams(10, 40_000, 16), [])
    rows += search._exactly(one, list(range(16)), x[:16], np.zeros((16, 1), int), search.SearchParams(10, 40_000, 16))
    assert len(rows) == 320 and time.time() - began < 30
