import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm import packing, tokenfiles
from vecspark.llm.tokens import Coder, coder, public_path

PARTS = st.sampled_from([" ", "\n", "\t", "the", "of", "Aé", "straße", "'s", "don't", ".", ",!", "12", "²", "_", "日本", "<|endoftext|>", "|", "\xa0", "\r", "", "×", "ª", "a"])
TEXTS = [None, "", " ", "\n\n", "one two", "A line.\nAnother  line with  runs.\n\n", "word " * 9000, "é" * 3000, "x <|endoftext|> y", "tail \n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_piecewise_ids_are_the_library_ids(text):
    c = coder(public_path())
    assert c.ids(text) == c.whole(text)


def expected(rows, end):
    c = Coder(public_path())
    return [(i, np.array([*c.tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for i, t in rows]


def test_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)]) for i in range(60)]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start int, ids string")
    folder = f"file://{tmp_path}/t"
    m = tokenfiles.write(d, folder)
    got = tokenfiles.read_documents(spark, folder).orderBy("doc_id").collect()
    before = 0
    for r, (i, ids) in zip(got, sorted(expected(rows, 2))):
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, before, len(ids) // 4, ids)
        before += len(ids) // 4
    assert len(got) == 60
    for s in m.collect():  # random access, padding and masks
        shard = tokenfiles.Shard(folder, s.shard)
        n = -(-s.n_tokens // tokenfiles.LENGTH)
        ids = [shard.sequence(k) for k in reversed(range(n))][::-1]
        assert all(b.buffers()[1].address == shard._batch(k // tokenfiles.BATCH).column(1).values.buffers()[1].address for k, (_, b) in enumerate(ids) if k // tokenfiles.BATCH == shard._last[0])  # views
        ids = [(a, b.to_numpy(zero_copy_only=False)) for a, b in ids]
        assert all(len(a) == len(b) == tokenfiles.LENGTH for a, b in ids)
        assert sum(int(b.sum()) for _, b in ids) == s.n_tokens
        assert zlib.crc32(b"".join(a[b].astype("<u4").tobytes() for a, b in ids)) == zlib.crc32(shard.ids(0, s.n_tokens))


def test_files_of_an_empty_table_and_of_ties(spark, tmp_path):
    d = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (None, "z")], "doc_id long, text string")
    tokenfiles.write(d.limit(0), f"file://{tmp_path}/e")
    assert tokenfiles.read_documents(spark, f"file://{tmp_path}/e").count() == 0
    tokenfiles.write(d, f"file://{tmp_path}/f")
    assert [r.doc_id for r in tokenfiles.read_documents(spark, f"file://{tmp_path}/f").orderBy("start").collect()] == [None, 5, 5, 5]


def check_pieces(rows, got, end, capacity):
    want = dict(expected(rows, end))
    parts, windows = {}, {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(parts) == set(want)
    for i, p in parts.items():
        assert b"".join(x[2] for x in sorted(p)) == want[i]
        assert [x[0] for x in sorted(p)] == list(np.cumsum([0, *(x[1] for x in sorted(p))])[:-1])
        assert {x[3] for x in p} == {len(want[i]) // 4}
    for w in windows.values():
        assert [x[0] for x in sorted(w)] == list(np.cumsum([0, *(x[1] for x in sorted(w))])[:-1])
        assert sum(x[1] for x in w) <= capacity
    return [sum(x[1] for x in w) for w in windows.values()]


def test_packing_is_whole_and_close(spark):
    rows = [(i, "some words here " * (i * 37 % 400) + (TEXTS[i % len(TEXTS)] or "")) for i in range(300)]
    d = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, length int").coalesce(1)
    full = check_pieces(rows, packing.pack(d).collect(), 1, 2048)
    assert all(x == 2048 or x & (x - 1) == 0 for x in full)
    whole = packing.pack(d, cut=False).collect()
    check_pieces(rows, whole, 1, 2048)
    assert packing.pack(d.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40), st.booleans())
def test_windows(sizes, cut):
    out = packing.windows_of(sizes, 64, cut)
    seen = sorted((i, at, n) for w in out for i, at, n in w)
    for i, s in enumerate(sizes):
        mine = [(at, n) for j, at, n in seen if j == i]
        assert [at for at, _ in mine] == list(np.cumsum([0, *(n for _, n in mine)])[:-1]) and sum(n for _, n in mine) == s
    assert all(0 < n for _, _, n in seen) and all(sum(n for _, _, n in w) <= 64 for w in out)


def test_differencing_is_near_equal_and_the_count_rises():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 200, 400).tolist()
    sums = [sum(sizes[i] for i in b) for b in packing.differencing(sizes, 20)]
    assert max(sums) - min(sums) <= 2
    assert len(packing.windows_of([40, 40, 40], 64, cut=False)) == 3  # two windows would do by the total


def test_packing_of_nulls_and_repeated_rows(spark):
    """Every piece is what a plain encoding of its row has at that place; rows that share an id are packed each for itself."""
    rows = [(None, "some words"), (None, None), (3, "again " * 700), (3, "again " * 700), (3, "other text"), (None, "some words"), (9, "")] + [(100 + i, "w " * (i * 53 % 3000)) for i in range(40)]
    c = Coder(public_path())
    whole = {}
    for i, t in rows:
        whole.setdefault(i, []).append(np.array([*c.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for cut in (True, False):
        d = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, sequence_id string, offset long").repartition(3)
        got = packing.pack(d, cut=cut).collect()
        windows, held = {}, {}
        for r in got:
            assert r.length == len(r.ids) // 4 > 0
            assert any(len(x) == 4 * r.doc_tokens and x[4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids) for x in whole[r.doc_id])
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
            held[r.doc_id] = held.get(r.doc_id, 0) + r.length
        assert held == {i: sum(map(len, x)) // 4 for i, x in whole.items()}
        for w in windows.values():
            assert [a for a, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:k]) for k in range(len(w))]
            n = sum(n for _, n in w)
            assert n <= 2048 and (not cut or n == 2048 or n & (n - 1) == 0)
