"""Quality rules: a table of thresholds compiled into Spark projections, without user functions.

``measure`` adds what the rules look at, ``verdict`` is the compiled table and ``quality_rules`` applies both.
A null text counts as an empty one: no words, so the base rule rejects it. A null doc_id stays null; repeated
rows are judged each for itself; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import NOT_SPACE, SPACE, let, texts, words

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for on was be as by with at from an are this or not his but which have had were "
    "de la que el en y a los se del las un por con no una su para es al lo como más o "
    "le les et des du dans une est pour pas sur qui par au ce il sont avec plus "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine er sie es an werden aus"
).split()

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A text fails if 100 * part is above (or, for below, under) percent * whole; whole 1 makes it an absolute limit."""

    name: str
    part: str
    whole: str
    percent: int
    below: bool = False
    least_words: int = 0

    def fails(self, m) -> Column:
        whole = F.lit(1) if self.whole == "1" else m(self.whole)
        left, right = m(self.part) * 100, whole * self.percent
        return (m("n_words") >= self.least_words) & ((left < right) if self.below else (left > right))


#: The base: too short, or too much of it in windows of words found twice or more.
BASE = (Rule("length", "n_words", "1", 2000, below=True), Rule("repeated_windows", "n_repeat_words", "n_words", 30))
#: The method's own limits.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 30),
    Rule("mean_word_long", "word_chars", "n_words", 1200),
    Rule("mean_word_short", "word_chars", "n_words", 200, below=True),
    Rule("stop_words", "n_stop_words", "n_words", 5, below=True, least_words=40),
    Rule("capitals", "n_caps_words", "n_words", 40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
    Rule("stuttered_words", "n_echo_words", "n_words", 40),
)


def _repeated(w: Column) -> Column:
    """Words covered by a window that the text has twice or more. Windows are compared by a 64-bit hash; the sort runs only in texts with a repeat."""

    def covered(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(at, lambda s: F.filter(F.transform(s, lambda e, k: F.when((e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"])), lambda i: i.isNotNull()))
        return let(F.array_sort(same), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    hashes = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))


def _measures(t: Column, w: Column, l: Column) -> list[Column]:
    """Of a text without null, its words and its lines that have some."""
    count = lambda f: F.size(F.filter(w, f)).cast("long")
    return [
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(l).cast("long").alias("n_lines"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        _repeated(w).alias("n_repeat_words"),
        count(lambda x: F.lower(x).isin(STOP_WORDS)).alias("n_stop_words"),
        count(lambda x: x.rlike("^[^a-z]*[A-Z][^a-z]*$")).alias("n_caps_words"),
        F.size(F.filter(F.transform(w, lambda x, i: x == F.get(w, i - 1)), lambda x: x)).cast("long").alias("n_echo_words"),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measures to doc_id and text."""
    d = texts(docs).select("*", words(F.col("text")).alias("w"), _lines(F.col("text")).alias("l"))
    return d.select("doc_id", "text", *_measures(F.col("text"), F.col("w"), F.col("l")))


def any_of(rules, m=F.col) -> Column:
    return reduce(lambda a, b: a | b, (r.fails(m) for r in rules))


def quality_rules(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """doc_id, text, the measures, base_failed, the names of failed rules and kept."""
    failed = F.filter(F.array(*(F.when(r.fails(F.col), F.lit(r.name)) for r in (*base, *rules))), lambda x: x.isNotNull())
    return measure(docs).select("*", any_of(base).alias("base_failed"), failed.alias("failed_rules"), (~any_of((*base, *rules))).alias("kept"))


def keep(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """The rows that no rule rejects, with all their columns. One condition, in which each measure is taken once."""
    t = F.coalesce(F.col("text"), F.lit(""))
    seen = F.struct(words(t).alias("w"), _lines(t).alias("l"))
    return docs.where(let(seen, lambda s: let(F.struct(*_measures(t, s["w"], s["l"])), lambda m: ~any_of((*base, *rules), lambda n: m[n]))))


def sql(rules=RULES, base=BASE) -> str:
    """The same for DuckDB, over documents."""

    def fails(r: Rule) -> str:
        return f"(n_words >= {r.least_words} and 100 * {r.part} {'<' if r.below else '>'} {r.percent} * {r.whole})"

    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
rep as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as n_repeat_words from rep group by doc_id),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
        len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*$')))::bigint as n_caps_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::bigint as n_echo_words
      from w left join cov using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" or ".join(map(fails, base))} as base_failed,
  not ({" or ".join(map(fails, (*base, *rules)))}) as kept from m"""
