import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CLEAN = "The river ran past the old mill and into the valley where it met the sea at dawn. Few of the people who lived there had ever seen a ship, but they knew that the tide was on their side."
TEXTS = [None, "", " \n\t", "a b c", CLEAN, CLEAN.upper(), "\n".join([CLEAN] * 9), "same " * 40_000, " | ".join(CLEAN.split()), "x\n\nx \nx", "one two three four five six seven eight " * 2, "é\x0b日本\x1c #"]


def test_measures_and_verdicts(spark):
    rows = [(i, t, "extra", 5) for i, t in enumerate(TEXTS)] + [(None, CLEAN, None, None), (4, CLEAN, "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, w string, n_words int")
    got = quality.quality_rules(d).collect()
    assert len(got) == len(rows)
    for r in got:
        m = brute(r.text)
        assert tuple(r[n] for n in NAMES) == m, r.text[:50]
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert r.kept == (not r.failed_rules) and (r.kept == (r.text == CLEAN))
    stay = quality.keep(d)
    assert stay.columns == d.columns
    assert sorted(map(str, stay.collect())) == sorted(str(r) for r in d.collect() if r.text == CLEAN)
    assert quality.quality_rules(d.limit(0)).count() == 0 and quality.keep(d.limit(0)).count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc", "\n", " ", "#", "É"]), max_size=60), min_size=40, max_size=40))
def test_any_text(spark, some):
    rows = [(i, " ".join(x)) for i, x in enumerate(some)]
    for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert tuple(r[n] for n in NAMES) == brute(r.text)


def test_the_plan_has_no_user_function(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.quality_rules(d).select("kept", F.size("failed_rules"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
