import random

from vecspark.llm import licenses
from vecspark.llm.licenses import TEMPLATES, tokens


def brute(text):
    """Templates whose words stand in the text in a row, but those inside a longer one that does."""
    w = [x for x, _, _ in tokens(text or "")]
    out = []
    for k, t in TEMPLATES.items():
        want = [x for x, _, _ in tokens(t)]
        out += [(i, i + len(want), k) for i in range(len(w) - len(want) + 1) if w[i : i + len(want)] == want]
    return sorted(k for a, b, k in out if not any(c <= a and b <= d and (c, d) != (a, b) for c, d, _ in out))


def prose(rng, n):
    return " ".join("".join(rng.choices("abdeilnorst", k=rng.randrange(2, 9))) for _ in range(n))


def test_exact_wordings_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(6)
    rows = []
    for i, (_, t) in enumerate(list(TEMPLATES.items()) * 2):
        sep = rng.choice(["\n", "\n\n"])
        rows.append((i, prose(rng, rng.choice([0, 20, 300])) + sep + (t if i % 2 else t.upper().replace(". ", ".\n")) + sep + prose(rng, rng.choice([0, 30]))))
    rows += [(900, None), (901, ""), (902, prose(rng, 20_000)), (903, "my driving license expired, no warranty on that"), (None, "Released under the MIT License."), (7, rows[7][1])]
    rows.append((904, prose(rng, 9000) + " Licensed under CC BY-SA 4.0. " + prose(rng, 9000)))
    rows.append((905, "Released under the MIT License.\nline\nLicensed under CC BY 4.0."))
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = {}
    for r in licenses.scan(d).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        mine = sorted(r.license for r in got.get(i, []) if r.exact)
        assert sorted(brute(t) * (2 if i == 7 else 1)) == mine, (i, brute(t), mine)  # row 7 is there twice
        for r in got.get(i, []):
            if r.exact and i != 7:
                assert [x for x, _, _ in tokens(t[r.start : r.end])] == [x for x, _, _ in tokens(TEMPLATES[r.license])]
    assert not {900, 901, 902, 903} & set(got)
    assert {r.license for r in got[905]} == {"MIT-notice", "CC-BY-4.0-notice"}
    assert licenses.scan(d.limit(0)).count() == 0


def test_changed_wordings_are_counted():
    s = licenses.Scanner(TEMPLATES)
    t = TEMPLATES["MIT"].replace("merge, publish, distribute, ", "").replace("The above copyright", "The very above copyright")
    (found,) = s.scan(t)
    assert found[3] == "MIT" and found[6] == 3 and found[7] == 1 and not found[8]
    assert not list(s.scan(" ".join(TEMPLATES["MIT"].split()[::3])))


def test_reductions_rank_the_template_first():
    s = licenses.Scanner(TEMPLATES)
    for k, t in TEMPLATES.items():
        ranked = s.reductions(" ".join(w for w, _, _ in tokens(t)))
        assert dict((x, r) for r, x in ranked)[k] >= ranked[0][0] - 0.05


def test_a_short_notice_is_found_however_many_templates_rank_before_it():
    s = licenses.Scanner(TEMPLATES)
    short = [k for k in TEMPLATES if len(s.words[k]) <= 6]
    long_ = sorted(TEMPLATES, key=lambda k: -len(s.words[k]))
    for k in short:
        # pieces of long templates, none of them enough for its wording, save more bytes than the notice
        part = " ".join(" ".join(s.words[x][: len(s.words[x]) // 4]) for x in long_[:10])
        text = f"license {part} {TEMPLATES[k]} {part}"
        rank = [x for _, x in s.reductions(" ".join(w for w, _, _ in licenses.tokens(text)))].index(k)
        assert rank >= 8
        assert k in {r[3] for r in s.scan(text)}


def test_versions_and_names_decide():
    s = licenses.Scanner(TEMPLATES)
    for text, want in {
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": {"LGPL-2.1-notice"},
        "This work is licensed under the GNU General Public License, version 1.": set(),
        "Licensed under the Apache License, Version 1.1.": set(),
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": {"CC-BY-3.0"},
        "This work is licensed under a Creative Commons Attribution 2.0 International License.": set(),
        "Released under the license.": set(),
        "SPDX-License-Identifier: GPL-1.0-only": set(),
        "Licensed under CC BY-SA 3.0.": set(),
        "This work is licensed under the free GNU General Public License, version 3.": {"GPL-3.0-notice"},
    }.items():
        assert {r[3] for r in s.scan(text)} == want, text
