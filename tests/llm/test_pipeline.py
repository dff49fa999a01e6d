import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_secrets import base as base_spans
from tests.llm.test_jaccard import brute as near
from vecspark.llm.tokens import Coder, public_path
from vecspark.runtime import stored


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    common = "the of and to in is that it for on was be as by with at".split()
    v = [f"{a}{b}" for a in ("ri", "mo", "ta", "lo", "ne") for b in ("ver", "un", "ble", "st", "ck", "nd")]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(v) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    rows = [(i, text(rng.choice([60, 200, 900]))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(20)]
    rows += [(200 + i, f"{text(50)} {items[i][1]} {text(50)}") for i in range(5)]
    rows += [(300 + i, text(60) + f' token = "{rng.randrange(1 << 160):040x}" ' + text(40)) for i in range(5)]
    rows += [(400, None), (401, ""), (402, "too short"), (403, "### $$$ " * 50), (None, text(70)), (5, text(80))]
    f = tmp_path_factory.mktemp("tables")
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{f}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{f}/benchmark.parquet")
    return f"{f}", rows, items


def text_hash(spark, t):
    return spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]


def classes(texts):
    return [c for _, c in near(list(enumerate(texts)))]


def test_rows_are_known_by_id_and_text(spark, tmp_path):
    """Only copies go, whatever doc_ids are shared or null."""
    rng = random.Random(5)
    a, b, e, x = (" ".join(f"{p}{rng.randrange(3000)}" for _ in range(80)) for p in "abex")
    rows = [(3, a), (5, a), (5, b), (None, e), (None, f"{x} {b}"), (7, e), (None, x), (None, x), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, l, "s", 1) for l, (i, t) in zip("abcdefghij", rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert {(r.doc_id, r.text or "", r.lang) for r in got} == {(3, a, "a"), (5, b, "c"), (7, e, "f"), (None, f"{x} {b}", "e"), (None, x, "g"), (9, "", "i")} and len(got) == 6
    spark.createDataFrame([(1, b[: len(b) // 2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.lang) for r in clean) == sorted((str(i), l) for l, (i, t) in zip("abcdefghij", rows) if b not in (t or ""))


def test_each_stage_does_its_part(spark, folder):
    f, rows, items = folder
    docs = spark.read.parquet(f"{f}/documents.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, f), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        steps.append({(r.doc_id, r.text, r.n_chars) for r in docs.collect()})
        assert len(steps[-1]) == docs.count()
    quality, near, clean, masked = steps
    assert {(i, t) for i, t, _ in quality} == {(i, t) for i, t in rows if i not in (400, 401, 402, 403)}
    left = sorted(((i, t) for i, t, _ in quality), key=lambda x: (x[0] is None, x[0] or 0, text_hash(spark, x[1])))
    firsts = {}
    for k, c in enumerate(classes([t for _, t in left])):
        firsts.setdefault(c, left[k])
    assert {(i, t) for i, t, _ in near} == set(firsts.values())
    bad = {i for i, _ in leaks([(k, t) for k, (_, t, _) in enumerate(sorted(near, key=str))], items)}
    assert bad and clean == {x for k, x in enumerate(sorted(near, key=str)) if k not in bad}
    assert {i for i, _, _ in masked} == {i for i, _, _ in clean}
    assert len(masked) == len(clean)
    for i, t, n in masked:
        assert not base_spans(t) and n == len(t)
        assert "[SECRET]" in t or (i, t, n) in clean
    assert sum("[SECRET]" in t for _, t, _ in masked) == sum(bool(base_spans(t)) for _, t, _ in clean) > 0


def test_run_packs_what_is_left(spark, folder):
    f, _, _ = folder
    docs = spark.read.parquet(f"{f}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, f), "stage")
    c = Coder(public_path())
    ids = lambda t: np.array([*c.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
    want, got = {}, {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(ids(r.text))
    assert len(want[5]) == 2  # one doc_id, two texts
    for r in sorted(corpus_pipeline.run(spark, f).collect(), key=lambda r: (str(r.doc_id), r.start)):
        got.setdefault(r.doc_id, []).append(bytes(r.ids))
    for i in want:
        if len(want[i]) == 1:
            assert b"".join(got[i]) == want[i][0]
        else:
            assert sum(map(len, got[i])) == sum(map(len, want[i]))
    assert got.keys() == want.keys()
