"""Secret scans in DataFrame functions alone.

Base patterns give the spans of assignments, access keys and long hexadecimal runs. On top, candidate strings (unbroken
runs of 20 or more letters, digits and ``+/_=-``) are read by a sliding window for each character class they belong to.
The window's state is a count for each character: the one that enters is added, the one that leaves is taken away, and
the sum of c*log2(c) that the Shannon entropy needs follows from these two counts. Runs whose window reaches the class's
threshold are added as ``entropy`` spans, unless the allow list explains them. The allow list and the thresholds never
touch base spans.

All work is in proportion to the text: runs are read in pieces, places of matches are summed up in two levels.

A null text counts as empty: no spans. Null doc_ids stay null, repeated rows are scanned each for itself, other
columns are ignored. Positions are code points, ends exclusive."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import let, texts

#: kind, pattern, group that is measured, least characters of it, a cheaper pattern that every text with a span matches
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)


@dataclass(frozen=True)
class CharClass:
    """Runs of ``least`` or more of one alphabet that match all of needs; stretches of window symbols are measured, bits is the least entropy."""

    name: str
    alphabet: str
    needs: tuple[str, ...]
    least: int
    window: int
    bits: float


#: Every candidate is a whole run of these.
RUN = r"[0-9A-Za-z+/_=-]{20,}"
#: Prose words and names never have all that a class needs at its entropy.
CLASSES = (
    CharClass("hex", "[0-9A-Fa-f]", ("[0-9]", "[A-Fa-f]"), 24, 24, 3.0),
    CharClass("base64", "[0-9A-Za-z+/_=-]", ("[0-9]", "[A-Z]", "[a-z]"), 20, 20, 3.7),
    CharClass("base36", "[0-9a-z]", ("[0-9][a-z]+[0-9]", "[a-z][0-9]+[a-z]"), 20, 20, 3.6),
    CharClass("base32", "[0-9A-Z]", ("[0-9][A-Z]+[0-9]", "[A-Z][0-9]+[A-Z]"), 20, 20, 3.6),
    CharClass("letters", "[A-Za-z]", ("[a-z][A-Z]{2}", "[a-z][A-Z][a-z][A-Z]|[A-Z]{2}[a-z][A-Z]"), 24, 24, 3.9),
)
#: Strings that look random but are no secrets: UUIDs, digests named as such, examples, runs of one repeated unit, alphabets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)^(sha1|sha224|sha256|sha384|sha512|md5)[-_=]",
    r"(?i)(example|sample|dummy|placeholder|changeme|xxxx)",
    r"^(.{1,4})\1+$",
    r"(?i)^0?123456789abcdef|^abcdefghij",
)


def scan_fold(items: Column, state: Column, step, emit, kind: str) -> Column:
    """What emit(state, item), an array, gives for each item in turn, in one array; step gives the next state. kind: the type of the result.

    Blocks of some sqrt(n) items are folded by themselves, so that n items copy n * sqrt(n) references and not n * n."""
    none = F.array().cast(kind)

    def blocks(xs: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: F.slice(xs, i * block + 1, block))

    def inner(start: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.struct(start.alias("s"), none.alias("out")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], emit(a["s"], x)).alias("out")))

    def whole(xs: Column) -> Column:
        start = F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(blocks(xs), start, lambda a, b: let(inner(a["s"], b), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out"))))["out"])

    return let(items, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def _located(text: Column, pattern: str) -> Column:
    """(start, m: text) of the pattern's leftmost matches: what lies between the matches gives their places."""

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        return scan_fold(
            F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")),
            F.lit(0),
            lambda at, x: at + x["g"] + F.length(x["m"]),
            lambda at, x: F.array(F.struct((at + x["g"]).alias("start"), x["m"].alias("m"))),
            "array<struct<start:int,m:string>>",
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


#: What sums of logarithms may lack of a threshold that is met exactly.
ROUNDING = 1e-9
NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _base_spans(text: Column, rank: int) -> Column:
    kind, pattern, group, least, cheap = BASE[rank]
    found = F.filter(_located(text, pattern), lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(cheap), spans).otherwise(F.array().cast(NO_SPANS))


#: Characters of a run that are taken apart at once, and the characters that a window counts: those from FIRST on.
PIECE, FIRST, ALPHABET = 4096, ord("+"), ord("z") - ord("+") + 1


def window_entropy(s: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits, of a window over s (characters from + to z). State: the window, a count for each character, the sum of c*log2(c) over the counts and the largest entropy so far."""
    xlog = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))

    def added(counts: Column, at: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at - 1), F.array(F.element_at(counts, at) + by), F.slice(counts, at + 1, ALPHABET - at))

    def slot(c: Column) -> Column:
        return F.ascii(c) - (FIRST - 1)

    def leave(a: Column) -> Column:
        def without(at: Column) -> Column:
            c = F.element_at(a["n"], at)
            return F.struct(F.substring(a["win"], 2, window).alias("win"), added(a["n"], at, -1).alias("n"), (a["s1"] - F.get(xlog, c) + F.get(xlog, c - 1)).alias("s1"), a["best"].alias("best"))

        return F.when(F.length(a["win"]) == window, let(slot(a["win"]), without)).otherwise(a)

    def enter(a: Column, x: Column) -> Column:
        def within(at: Column) -> Column:
            c = F.element_at(a["n"], at)
            return let(a["s1"] - F.get(xlog, c) + F.get(xlog, c + 1), lambda s1: F.struct(F.concat(a["win"], x).alias("win"), added(a["n"], at, 1).alias("n"), s1.alias("s1"), F.when(F.length(a["win"]) == window - 1, F.greatest(a["best"], F.lit(math.log2(window)) - s1 / window)).otherwise(a["best"]).alias("best")))

        return let(slot(x), within)

    start = F.struct(F.lit("").alias("win"), F.array_repeat(F.lit(0), ALPHABET).alias("n"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("best"))
    pieces = F.regexp_extract_all(s, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    return F.aggregate(pieces, start, lambda a, piece: F.aggregate(F.split(piece, ""), a, lambda b, x: let(leave(b), lambda c: enter(c, x))))["best"]


def _entropy_spans(text: Column, classes) -> Column:
    def secret(x: Column) -> Column:
        m, allowed, found = x["m"], F.lit(False), F.lit(False)
        for a in ALLOW:
            allowed = allowed | m.rlike(a)
        for c in classes:
            own = m.rlike(f"^{c.alphabet}{{{c.least},}}$")
            for need in c.needs:
                own = own & m.rlike(need)
            found = found | (own & (window_entropy(m, c.window) >= c.bits - ROUNDING))
        return ~allowed & found

    spans = F.transform(F.filter(_located(text, RUN), secret), lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), (x["start"] + F.length(x["m"])).alias("end"), F.lit("entropy").alias("kind")))
    return F.when(text.rlike(RUN), spans).otherwise(F.array().cast(NO_SPANS))


def _spans(text: Column, classes) -> tuple[Column, Column]:
    base = F.array_sort(F.concat(*(_base_spans(text, i) for i in range(len(BASE)))))
    return base, _entropy_spans(text, classes)


def _all(base: Column, more: Column) -> Column:
    return F.when(F.size(more) > 0, F.array_sort(F.concat(base, more))).otherwise(base)


def spans(text: Column, classes=CLASSES) -> Column:
    """All spans of a text, in order."""
    base, more = _spans(text, classes)
    return let(F.struct(base.alias("base"), more.alias("more")), lambda s: _all(s["base"], s["more"]))


def scan(docs: DataFrame, classes=CLASSES) -> DataFrame:
    """doc_id, text, base (its spans) and spans (base and entropy): arrays of start, rank of the kind, end and kind, in order."""
    base, more = _spans(F.col("text"), classes)
    d = texts(docs).select("doc_id", "text", base.alias("base"), more.alias("more"))
    return d.select("doc_id", "text", "base", _all(F.col("base"), F.col("more")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that a span covers replaced by mark; overlapping spans give one mark. spans are in order."""
    gap = "array<struct<a:int,b:int>>"
    ends = F.struct(F.length(text).alias("start"), F.length(text).alias("end"))
    every = F.concat(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.array(ends))
    gaps = scan_fold(every, F.lit(0), lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.when(x["start"] < at, F.array().cast(gap)).otherwise(F.array(F.struct(at.alias("a"), x["start"].alias("b")))), gap)

    def cut(pieces: Column, g: Column) -> Column:
        first, last = F.floor(g["a"] / PIECE).cast("int"), F.floor(g["b"] / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), g["a"] - first * PIECE + 1, g["b"] - g["a"])

    # pieces of equal length: a stretch is cut from the few that hold it, wherever in the text it lies
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    marked = let(pieces, lambda p: F.array_join(F.transform(gaps, lambda g: cut(p, g)), mark))
    return F.when(F.size(spans) > 0, marked).otherwise(text)


def sql(classes=CLASSES) -> str:
    """The contract's columns for DuckDB. Its expressions have no look-around: runs are found whole and judged after, entropies are taken window by window."""
    assign = BASE[0][1].replace("'", "''")

    def found(kind: str, rank: int, pattern: str, where: str) -> str:
        cut = f"regexp_split_to_array(text, '{pattern}')"
        return f"""select doc_id, '{kind}' as kind, {rank} as rank, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as a, m[i] as s
from (select doc_id, {cut} as g, regexp_extract_all(text, '{pattern}') as m, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) as i from d where regexp_matches(text, '{pattern}')) where {where}"""

    allowed = " or ".join(f"regexp_matches(s, '{a}')" for a in ALLOW if "\\1" not in a)
    repeated = " or ".join(f"(length(s) > {k} and length(s) % {k} = 0 and s = repeat(substr(s, 1, {k}), length(s) // {k}))" for k in (1, 2, 3, 4))
    lengths = sorted({c.window for c in classes})
    judged = " or ".join(" and ".join([f"regexp_full_match(s, '{c.alphabet}{{{c.least},}}')", *(f"regexp_matches(s, '{n}')" for n in c.needs), f"h{c.window} >= {c.bits} - 1e-9"]) for c in classes)

    def windows(w: int) -> str:
        return f"""h{w} as (select doc_id, a, max(h) as h{w} from (select doc_id, a, p, -sum(n / {w}.0 * log2(n / {w}.0)) as h from (select doc_id, a, p, c, count(*) as n
from (select doc_id, a, p, substr(s, p + unnest(range({w})), 1) as c from (select doc_id, a, s, unnest(range(1, length(s) - {w - 2})) as p from runs where length(s) >= {w})) group by all) group by all) group by all)"""

    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
base as ({found("assign", 0, assign, f"length(regexp_extract(m[i], '{assign}', 2)) >= 8")}
union all {found("access", 1, "AKIA[A-Z0-9]{12,}", "true")}
union all {found("hex", 2, "[0-9a-f]{32,}", "true")}),
runs as (select * from ({found("entropy", 3, RUN, "true")}) where not ({allowed} or {repeated})),
{", ".join(map(windows, lengths))},
more as (select doc_id, kind, rank, a, s from runs {" ".join(f"left join h{w} using (doc_id, a)" for w in lengths)} where {judged}),
b as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || a || ':' || a + length(s), ',' order by a, rank) as j from base group by doc_id),
e as (select doc_id, string_agg(kind || ':' || a || ':' || a + length(s), ',' order by a, rank) as j from (select * from base union all select * from more) group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(b.j, '')) as base_sha256, coalesce(e.j, '') as spans
from d left join b using (doc_id) left join e using (doc_id)"""
