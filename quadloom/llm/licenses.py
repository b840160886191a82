"""License scans with ordered signature rules, in DataFrame functions alone.

Three steps over each text, in one projection and without a shuffle:

* base phrases: words are runs of digits, a-z (after lower-casing A-Z) and
  characters beyond ASCII; places where a phrase's words stand consecutively
  are counted over the whole text;
* rules: the words of each text that any gate word occurs in are cut into windows
  of ``WINDOW`` words and as many around them as a match can have; those that hold
  a gate word are tried against the rules whose keyword they hold
  (``license_rules``), at every word, which gives intervals;
* suppression: an interval inside another of higher priority goes; at equal
  priority the longer holds, then the earlier rule. A window keeps what begins
  among its own words, and sees all that could lie around it. So the work grows
  with a text's length, however many matches it holds.

Signatures, as base phrases, may run over lines' ends. Between the word license
and a name that follows it there must be none: a heading and the next line are
two statements, each with its own rule.

Defined results: null text is empty and has no words, labels or places; score
is the largest weight of a detection that holds (0.4 for a base phrase), else
0; rows are judged one by one and other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.license_rules import HEADING, gates, most_words, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
BASE_WEIGHT = 0.4
#: Own words of a window.
WINDOW = 128

ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(text: Column) -> Column:
    """Words joined by single spaces, with a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _NOT_WORD, " ")), F.lit(" "))


def _lines(text: Column) -> Column:
    """As _words, but with a line feed where a line ends."""
    marked = F.regexp_replace(F.regexp_replace(text, _NOT_WORD.replace(r"\x00-\x2F", r"\x00-\x09\x0B-\x2F"), " "), r" ?\n[ \n]*", "\n")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(marked, r"^[ \n]+|[ \n]+$", "")), F.lit(" "))


def _in_lines(pattern: str) -> str:
    """A pattern for _lines; the words of HEADING stay in one line."""
    return HEADING + pattern.removeprefix(HEADING).replace(" ", "[ \\n]")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _windows() -> str:
    """SQL: of the words ``__toks`` (those that begin a line are marked by a line feed) windows (s: joined, t: with line ends, lo, hi: where own words begin)."""
    around = most_words()
    plain = lambda x: f"replace(array_join({x}, ' '), '\\n', '')"
    cut = f"transform(sequence(0, cast((size(__toks) - 1) div {WINDOW} as int)), i -> named_struct('before', least(i * {WINDOW}, {around}), 'held', slice(__toks, greatest(i * {WINDOW} - {around}, 0) + 1, least(i * {WINDOW}, {around}) + {WINDOW + around})))"
    lo = f"if(w.before = 0, 1, length({plain('slice(w.held, 1, w.before)')}) + 2)"
    hi = f"length({plain(f'slice(w.held, 1, w.before + {WINDOW})')}) + 2"
    return f"transform({cut}, w -> named_struct('s', concat(' ', {plain('w.held')}, ' '), 't', concat(replace(concat(' ', array_join(w.held, ' ')), ' \\n', '\\n'), ' '), 'lo', {lo}, 'hi', {hi}))"


def _rule_hits() -> str:
    """SQL: the surviving (label, weight) that begin among the own words of a window ``z``."""
    by_keyword: dict[str, list[str]] = {}
    for i, r in enumerate(rules()):
        lines = r.pattern.startswith(HEADING)
        pattern = _in_lines(r.pattern) if lines else r.pattern
        # at every word: a match has no width, its words are looked ahead at
        at = f"(?<=[ \n])(?=({pattern})[ \n])"
        by_keyword.setdefault(r.keyword, []).append(f"named_struct('pat', {_quoted(at)}, 'lines', {str(lines).lower()}, 'label', {_quoted(r.label)}, 'p', {r.priority}, 'w', {r.weight}D, 'i', {i})")
    keywords = f"array({', '.join(_quoted(k) for k in by_keyword)})"
    table = "map(" + ", ".join(f"{_quoted(k)}, array({', '.join(v)})" for k, v in by_keyword.items()) + ")"
    tried = f"flatten(transform(filter({keywords}, k -> contains(z.s, k)), k -> element_at({table}, k)))"
    spans = """aggregate(
        zip_with(split(if(r.lines, z.t, z.s), r.pat), regexp_extract_all(if(r.lines, z.t, z.s), r.pat, 1), (g, x) -> named_struct('gap', length(g), 'len', length(x))),
        named_struct('pos', 0, 'out', cast(array() as array<struct<a: int, b: int>>)),
        (acc, y) -> if(y.len is null, acc, named_struct('pos', acc.pos + y.gap, 'out', concat(acc.out, array(named_struct('a', acc.pos + y.gap, 'b', acc.pos + y.gap + y.len))))),
        acc -> acc.out)"""
    hits = f"flatten(transform(filter({tried}, r -> if(r.lines, z.t, z.s) rlike r.pat), r -> transform({spans}, y -> named_struct('a', y.a, 'b', y.b, 'label', r.label, 'p', r.p, 'w', r.w, 'i', r.i))))"
    beats = "g.a <= h.a and g.b >= h.b and (g.p > h.p or g.p = h.p and (g.b - g.a > h.b - h.a or g.b - g.a = h.b - h.a and g.i < h.i))"
    kept = f"transform(array({hits}), hs -> filter(hs, h -> h.a >= z.lo and h.a < z.hi and not exists(hs, g -> {beats})))[0]"
    return f"array_distinct(transform({kept}, h -> named_struct('label', h.label, 'w', h.w)))"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with the columns ADDED; columns of those names are replaced."""
    names = [c for c in docs.columns if c not in ADDED]
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(*names, low.alias("__low")).withColumn("__words", _words(F.col("__low")))
    words = F.col("__words")
    n_words = F.when(F.length(words) <= 2, F.lit(0)).otherwise(_spaces(words) - 1)
    places = []
    for phrase, label in BASE_PHRASES:
        inner = phrase.count(" ")
        parts = F.split(words, f"(?<= ){phrase}(?= )", -1)
        found = F.when(
            F.contains(words, F.lit(f" {phrase} ")),
            F.struct(
                (F.size(parts) - 1).alias("n"),
                (_spaces(F.element_at(parts, 1)) - 1).alias("first"),
                (_spaces(words) - _spaces(F.element_at(parts, -1)) - inner - 1).alias("last"),
                F.lit(label).alias("label"),
            ),
        )
        places.append(found)
    gated = reduce(lambda a, b: a | b, [F.contains(words, F.lit(g)) for g in gates()])
    toks = F.split(F.replace(F.trim(_lines(F.col("__low"))), F.lit("\n"), F.lit(" \n")), " ")
    rows = rows.select(*names, n_words.cast("long").alias("n_words"), F.array_compact(F.array(*places)).alias("__base"), F.when(gated, toks).alias("__toks"))
    rows = rows.withColumn("__windows", F.expr(f"if(__toks is null, null, {_windows()})")).drop("__toks")
    some = " or ".join(f"contains(z.s, {_quoted(g)})" for g in gates())
    rows = rows.withColumn("__gated", F.expr(f"filter(__windows, z -> {some})")).drop("__windows")
    hits = F.when(F.size("__gated") > 0, F.expr(f"flatten(transform(__gated, z -> {_rule_hits()}))"))
    rows = rows.withColumn("__hits", F.coalesce(hits, F.expr("cast(array() as array<struct<label: string, w: double>>)")))
    base = F.col("__base")
    total = F.aggregate(base, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    labels = lambda x: F.transform(x, lambda y: y["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.greatest(F.when(F.size(base) > 0, F.lit(BASE_WEIGHT)), F.array_max(F.transform("__hits", lambda y: y["w"])), F.lit(0.0))
    return rows.select(
        *names, "n_words", total.alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["last"])).cast("long").alias("last_word"),
        joined(labels(base)).alias("base_labels"), joined(F.concat(labels(base), labels(F.col("__hits")))).alias("labels"), score.alias("score"),
    )
