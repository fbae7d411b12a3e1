"""Containment and likeness joins through shared grams: equi-joins on rare pieces, then the exact test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import let
from quarrylight.sources.tables import saved

#: A side is broadcast only if its counted rows, by their width, stay below this.
BROADCAST_BYTES = 32 << 20
GRAM = 3


def bounded(df: DataFrame, width: int) -> DataFrame:
    """Marked for broadcast if its rows of about ``width`` bytes are few enough."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def word_pairs(words: Column) -> Column:
    """Neighbouring words, joined; a single word for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def letter_grams(word: Column, n: Column | int) -> Column:
    """All runs of ``n`` characters of a word."""
    size = n if isinstance(n, Column) else F.lit(n)
    runs = F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda i: F.substring(word, i, size))
    return F.when(F.length(word) >= size, runs).otherwise(F.array().cast("array<string>"))


def _met(grams: DataFrame, probes: DataFrame) -> DataFrame:
    """(text, span) by each span's rarest gram. ``grams``: (text, gram), distinct; ``probes``: (span, gram)."""
    wanted = bounded(saved(probes.select("gram").distinct()), 64)
    hits = saved(grams.join(wanted, "gram"))
    often = hits.groupBy("gram").agg(F.count("*").alias("df"))
    # a span with a gram that no text holds is in none
    counted = probes.distinct().join(often, "gram", "left")
    rare = counted.groupBy("span").agg(F.min(F.struct("df", "gram")).alias("g"), F.count(F.when(F.col("df").isNull(), 1)).alias("absent")).where("absent = 0")
    return hits.join(bounded(saved(rare.select("span", F.col("g.gram").alias("gram"))), 96), "gram").select("text", "span")


def contained(texts: DataFrame, spans: DataFrame, text_id: str, text: str, span_id: str, span: str) -> DataFrame:
    """(text_id, span_id) wherever a span is part of a text, letter by letter.

    The words of a span but the first and last are whole words of the text, so a long span is looked
    up by its rarest pair of such words; a short one by the rarest letter gram of its longest word
    among the texts' distinct words. Null and empty spans are in no text. Ids should tell rows apart:
    of rows that share an id, each is tested, and a pair counts once.
    """
    held = texts.select(F.col(text_id).alias("text"), F.col(text).alias("whole"))
    asked = saved(spans.select(F.col(span_id).alias("span"), F.col(span).alias("part")).where("part <> ''"))
    words = F.split("part", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    long = asked.where(F.size(words) > 2).select("span", F.explode(F.array_distinct(let(inner, word_pairs))).alias("gram"))
    single = asked.where(F.size(words) == 3).select(F.lit(1)).limit(1)
    parts = []
    if not long.isEmpty():
        grams = F.array_distinct(let(F.split("whole", " "), lambda w: F.concat(word_pairs(w), w) if not single.isEmpty() else word_pairs(w)))
        parts.append(_met(held.select("text", F.explode(grams).alias("gram")), long))
    short = asked.where(F.size(words) <= 2)
    if not short.isEmpty():
        # the longest word of each span, of equals the first
        top = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
        least = short.select("span", top.alias("w")).withColumn("n", F.least(F.lit(GRAM), F.length("w")))
        probes = saved(least.where("n > 0").select("span", F.explode(F.array_distinct(letter_grams(F.col("w"), F.col("n")))).alias("gram")))
        vocabulary = held.select("text", F.explode(F.array_distinct(F.split("whole", " "))).alias("w"))
        sizes = [r.n for r in probes.select(F.length("gram").alias("n")).distinct().collect()]
        grams = F.array_distinct(F.flatten(F.array(*[letter_grams(F.col("w"), n) for n in sorted(sizes)]))) if sizes else F.array()
        if sizes:
            parts.append(_met(vocabulary.select("text", F.explode(grams).alias("gram")).distinct(), probes))
        blank = short.where("trim(both ' ' from part) = ''")  # spaces only: no word to look up
        if not blank.isEmpty():
            gaps = held.select("text", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("n")).where(F.contains("whole", F.repeat(F.lit(" "), F.col("n"))))
            parts.append(gaps.join(blank.select("span", F.length("part").alias("n")), "n").select("text", "span"))
    if not parts:
        return asked.join(held.select("text").limit(0), F.lit(True)).select(F.col("text").alias(text_id), F.col("span").alias(span_id))
    near = reduce(DataFrame.unionByName, parts).distinct()
    sure = near.join(bounded(asked, 4096), "span").join(held, "text").where(F.contains("whole", "part"))
    return sure.select(F.col("text").alias(text_id), F.col("span").alias(span_id)).distinct()


def least_shared(size: Column, threshold: float) -> Column:
    """Letter pairs that texts of ``size`` characters together share at least, if their ratio reaches the threshold.

    Matched blocks have ``threshold * size / 2`` characters, and between two blocks stands at least
    one of the ``(1 - threshold) * size`` others; a block of n characters has n - 1 pairs.
    """
    return F.ceil(size * (threshold / 2) - 1e-9) - F.floor(size * (1 - threshold) + 1e-9) - 1


def like_pairs(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """(a, b), distinct texts, of all pairs whose matching ratio can reach ``threshold`` (above 2/3).

    Of a text's letter pairs, so many of the most frequent ones are left out that a partner still
    shares one of the rest. Pairs too short to share a letter pair are met by single letters.
    """
    l, r = left.select(a).distinct(), right.select(b).distinct()  # noqa: E741
    ratio = threshold / (2 - threshold)  # of the lengths
    fits = (F.length(a) * ratio <= F.length(b) + 1e-9) & (F.length(b) * ratio <= F.length(a) + 1e-9)
    pairs = lambda df, c: df.select(c, F.explode(F.array_distinct(letter_grams(F.col(c), 2))).alias("gram"))
    ours, theirs = saved(pairs(l, a)), saved(pairs(r, b))
    often = theirs.groupBy("gram").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy(a).orderBy(F.coalesce("df", F.lit(0)), "gram"))
    need = least_shared(F.length(a) * (1 + ratio), threshold)
    # repeated letter pairs: a partner shares at least need less the repeats distinct ones
    repeats = F.length(a) - 1 - F.count("*").over(Window.partitionBy(a))
    kept = ours.join(often, "gram", "left").withColumns({"place": rank, "spare": F.greatest(need - repeats, F.lit(1)), "n": F.count("*").over(Window.partitionBy(a))}).where("place <= n - spare + 1")
    met = kept.select(a, "gram").join(theirs, "gram").where(fits).select(a, b).distinct()
    most = int(1 / (1.5 * threshold - 1)) + 1
    letters = lambda df, c: df.where(F.length(c) <= most).select(c, F.explode(F.array_distinct(letter_grams(F.col(c), 1))).alias("gram"))
    tiny = letters(l, a).join(letters(r, b), "gram").where(fits & (F.length(a) + F.length(b) <= most)).select(a, b).distinct()
    return met.unionByName(tiny).distinct()
