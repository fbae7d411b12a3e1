"""Search terms, concepts and tokens as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import vocabulary as V


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: keeps trees small where a value is used often."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def none_array() -> Column:
    return F.array().cast("array<string>")


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def normalise_term(value: Column) -> Column:
    """Trimmed, lower-cased, single-spaced, without punctuation at the ends."""
    spaced = F.regexp_replace(F.lower(F.btrim(text_of(value))), r"(?U)\s+", " ")
    return F.btrim(spaced, F.lit(V.TERM_EDGE))


def concept_key(term: Column) -> Column:
    return F.concat(F.lit("concept:"), F.substring(F.sha1(normalise_term(term)), 1, 16))


def is_useful(token: Column) -> Column:
    return (F.length(token) >= 2) & ~token.isin(V.STOP_TERMS) & ~token.rlike(r"(?U)^\d+$")


def latin_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text_of(text), F.lit(V.LATIN_TOKEN), F.lit(1)), normalise_term), is_useful)


def cjk_tokens(text: Column, longest: int = 6) -> Column:
    """A run of 2 to 12 characters once as a whole, and all its n-grams of 2 to ``longest``."""

    def grams(run: Column) -> Column:
        n = F.length(run)
        whole = F.when(n.between(2, 12), F.array(run)).otherwise(none_array())
        sizes = F.sequence(F.lit(2), F.least(F.lit(longest), n))
        each = F.flatten(F.transform(sizes, lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: run.substr(at, size))))
        return F.when(n >= 2, F.concat(whole, each)).otherwise(none_array())

    return F.filter(F.flatten(F.transform(F.regexp_extract_all(text_of(text), F.lit(V.CJK_RUN), F.lit(1)), grams)), is_useful)


def tokenize(text: Column) -> Column:
    """All terms of a text, repeats included."""
    return F.concat(latin_tokens(text), cjk_tokens(text))


def raw_tokens(text: Column) -> Column:
    """``tokenize`` before its terms are trimmed and chosen: what is left to do is done on rows."""
    return F.concat(F.regexp_extract_all(text_of(text), F.lit(V.LATIN_TOKEN), F.lit(1)), cjk_tokens(text))


def trimmed_token(token: Column) -> Column:
    """``normalise_term`` of a token, which holds no white space."""
    return F.btrim(F.lower(token), F.lit(V.TERM_EDGE))


def is_term(token: Column) -> Column:
    """``is_useful`` of a trimmed token; those start with a letter, so none is a number."""
    return (F.length(token) >= 2) & ~token.isin(V.STOP_TERMS)


def top_terms(text: Column, limit: int = 24) -> Column:
    """The most frequent terms of a short text: by count, then length, then the term itself."""
    tokens = tokenize(text)
    counted = F.transform(F.array_distinct(tokens), lambda t: F.struct((-F.size(F.filter(tokens, lambda x: x == t))).alias("n"), (-F.length(t)).alias("l"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(counted), lambda s: s["t"]), 1, limit)


def is_concept(term: Column) -> Column:
    return is_useful(term) & (F.length(term) <= 32)


def extract_concepts(*values: Column, limit: int = 16) -> Column:
    """Phrases of each value, then its top terms, value by value; the first ``limit`` of them."""
    parts = []
    for value in values:
        parts.append(F.filter(F.transform(F.split(text_of(value), V.TERM_SPLIT), normalise_term), is_concept))
        parts.append(F.filter(top_terms(value, limit), is_concept))
    return F.slice(F.array_distinct(F.concat(*parts)), 1, limit)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a text, lower-cased, holds any of the words."""
    return let(F.lower(text_of(text)), lambda low: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)))


def hit_count(text: Column, words: list[str]) -> Column:
    """Occurrences of all words in a text, summed."""

    def count(low: Column) -> Column:
        each = [((F.length(low) - F.length(F.replace(low, F.lit(w.lower()), F.lit("")))) / len(w)).cast("int") for w in words]
        return sum(each[1:], each[0])

    return let(F.lower(text_of(text)), count)


def looks_retired(text: Column, title: Column) -> Column:
    """Retired staff pages: by title, by the first 40 lines, or by three mentions and no active word."""
    part = F.lower(F.substring(text_of(text), 1, 12000))
    lines = F.filter(F.transform(F.split(part, r"\r?\n"), lambda x: F.btrim(x)), lambda x: x != "")
    head = F.array_join(F.slice(lines, 1, 40), "\n")
    early = (hit_count(head, V.RETIRED) > 0) & (hit_count(head, V.ACTIVE) == 0)
    return contains_any(title, V.RETIRED) | early | ((hit_count(part, V.RETIRED) >= 3) & (hit_count(part, V.ACTIVE) == 0))


def compact_lines(text: Column, limit: int = 500) -> Column:
    """Each distinct line once, in order, cut at ``limit`` characters."""
    lines = F.filter(F.transform(F.split(text_of(text), "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.array_join(F.transform(F.array_distinct(lines), lambda x: F.substring(x, 1, limit)), "\n")


def distinct_lines(text: Column) -> Column:
    """The lines with single spaces, each once whatever its case, in order.

    Repeats are found as neighbours of a sorted array, so long texts take n log n.
    """
    tidy = F.transform(F.split(text_of(text), r"\r\n|\r|\n"), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " ")))
    lines = F.filter(F.transform(tidy, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), x.alias("line"))), lambda s: s["line"] != "")
    fresh = let(F.array_sort(lines), lambda a: F.filter(a, lambda s, i: (i == 0) | (s["key"] != F.get(a, i - 1)["key"])))
    return F.transform(F.array_sort(F.transform(fresh, lambda s: F.struct(s["at"], s["line"], s["key"]))), lambda s: F.struct(s["line"].alias("line"), s["key"].alias("key")))


def _any_of(words: list[str]) -> Column:
    return F.lit("|".join(re.escape(w) for w in words))


def signal_lines(text: Column, limit: int = 500, short: int = 160) -> Column:
    """What a page says about people: lines with a signal and the lines beside them; noise goes if short.

    Marks are spread by one line to both sides over the distinct lines; lines with neither signal nor
    noise stay, and each is cut at ``limit`` characters. A null text gives an empty one.
    """

    def kept(lines: Column) -> Column:
        marks = F.transform(lines, lambda s: F.contains(s["key"], F.lit("@")) | F.rlike(s["key"], _any_of(V.COMPACT_SIGNALS)))

        def chosen(m: Column) -> Column:
            near = lambda i: F.get(m, i) | F.coalesce(F.get(m, i - 1), F.lit(False)) | F.coalesce(F.get(m, i + 1), F.lit(False))
            noise = lambda s: F.rlike(s["key"], _any_of(V.COMPACT_NOISE)) & (F.length(s["line"]) <= short)
            return F.filter(lines, lambda s, i: near(i) | ~noise(s))

        return let(marks, chosen)

    return F.array_join(F.transform(let(distinct_lines(text), kept), lambda s: F.rtrim(F.substring(s["line"], 1, limit))), "\n")


def truncate_middle(text: Column, most: int) -> Column:
    """Head and tail of half the budget each where a text is longer; nothing for a budget of zero."""
    if most <= 0:
        return F.lit("")
    half = max(1, most // 2)
    head, tail = F.regexp_replace(F.substring(text, 1, half), r"(?U)\s+$", ""), F.regexp_replace(F.substring(text, -half, half), r"^(?U)\s+", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit("\n\n...[truncated]...\n\n"), tail))


def spans_exist(spans: Column, text: Column) -> Column:
    """Whether there are spans and each is part of the text."""
    return (F.size(spans) > 0) & F.forall(spans, lambda s: (F.btrim(s) != "") & F.contains(text_of(text), s))


def name_window(text: Column, name: Column, radius: int = 700) -> Column:
    """The text around the first mention of a name: 120 characters before, ``radius`` after."""
    at = F.instr(text_of(text), name)
    start = F.greatest(F.lit(1), at - min(120, radius))
    return F.when(at > 0, F.btrim(F.substring(text, start, at + F.length(name) + radius - start))).otherwise("")
