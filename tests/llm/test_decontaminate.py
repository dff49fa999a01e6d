import random

from vecspark.llm import decontaminate


def shingles(words, k):
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in items:
            v = (s or "").lower().split()
            if not v:
                continue
            k = min(5, len(v))
            need = shingles(v, k)
            n = len(need & shingles(w, k))
            if 100 * n >= 80 * len(need):
                out[d, i] = max(out.get((d, i), (0, 0)), (n, len(need)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    v = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 3, 5, 6, 12, 40])))) for i in range(30)] + [(90, None), (91, ""), (92, "the the the the the the the")]
    docs = []
    for i in range(300):
        w = rng.choices(v, k=rng.choice([0, 4, 30, 600]))
        for _ in range(rng.randrange(3)):
            p = rng.choice(items)[1] or ""
            p = p.split()
            for _ in range(rng.randrange(3)):
                if p:
                    p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + [x.upper() for x in p] + w[at:]
        docs.append((i, " \n".join(w)))
    docs += [(None, items[5][1]), (None, "x"), (7, items[6][1]), (500, None), (501, "long " * 30_000 + (items[4][1])), (502, "the " * 9)]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert len(want) > 40
    for rows in (decontaminate.BROADCAST_BYTES, 0):  # by broadcast and by shuffles
        got = {(r.doc_id, r.item_id): (r.n_found, r.n_shingles) for r in decontaminate.contained(d, b, broadcast_bytes=rows).collect()}
        assert got == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained(d, b).count() == 1
    assert decontaminate.contained(d.limit(0), b).count() == 0
    assert decontaminate.contained(d, b.limit(0)).count() == 0
