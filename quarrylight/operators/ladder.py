"""Matching by ranked rules: the first rung that finds anything wins, of its finds the least id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.grams import contained, like_pairs
from quarrylight.sources.tables import saved


def ladder_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rungs: list[tuple[str, Column, Column]]) -> DataFrame:
    """(left_id, right_id, reason) for each left row that any rung matches.

    A rung is (reason, left key, right key), best first; rows whose key is NULL or empty don't take
    part. Each rung is an equi-join of its own, so no rung degrades to a nested loop; the best
    match is a grouped minimum that combines on the map side.
    """
    parts = []
    for rank, (reason, own, other) in enumerate(rungs):
        a = left.select(F.col(left_id), own.cast("string").alias("_key")).where("_key <> ''")
        b = right.select(F.col(right_id), other.cast("string").alias("_key")).where("_key <> ''").groupBy("_key").agg(F.min(right_id).alias(right_id))
        parts.append(a.join(b, "_key").select(left_id, F.struct(F.lit(rank).alias("rank"), F.col(right_id).alias("id"), F.lit(reason).alias("reason")).alias("m")))
    best = reduce(DataFrame.unionByName, parts).groupBy(left_id).agg(F.min("m").alias("m"))
    return best.select(left_id, F.col("m.id").alias(right_id), F.col("m.reason").alias("reason"))


def any_key_match(left: DataFrame, right: DataFrame, left_id: str, left_keys: Column, right_keys: Column, label: str) -> DataFrame:
    """(left_id, key, label) by the least key that any of several keys of both sides share.

    Of a key's right rows the least label is found first, so a key that many rows of both sides have
    makes no pairs of them.
    """
    a = left.select(left_id, F.explode(F.array_distinct(left_keys)).alias("key")).where("key <> ''")
    b = right.select(F.explode(F.array_distinct(right_keys)).alias("key"), F.struct(label).alias("one")).where("key <> ''").groupBy("key").agg(F.min("one").alias("one"))
    met = a.join(b, "key").groupBy(left_id).agg(F.min(F.struct("key", "one")).alias("m"))
    return met.select(left_id, "m.key", f"m.one.{label}")


def unique_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, condition: Column | None = None, on: str | None = None) -> DataFrame:
    """Pairs of which the left row has exactly one.

    ``on`` is an equality of both sides. If it is all there is, keys with one right row are found
    first, so that no key's rows meet; a further ``condition`` is looked at pair by pair.
    """
    if on and condition is None:
        single = right.groupBy(on).agg(F.min(right_id).alias(right_id), F.countDistinct(right_id).alias("n")).where("n = 1")
        return left.select(left_id, on).distinct().join(single, on).select(left_id, right_id)
    joined = left.join(right, on) if on else left.join(right, condition)
    met = (joined.where(condition) if on else joined).groupBy(left_id).agg(F.min(right_id).alias(right_id), F.countDistinct(right_id).alias("n"))
    return met.where("n = 1").select(left_id, right_id)


def unique_container(left: DataFrame, right: DataFrame, left_id: str, text: str, right_id: str, name: str) -> DataFrame:
    """(left_id, right_id) where a left text holds the name of exactly one right row."""
    pairs = contained(left, right, left_id, text, right_id, name)
    return pairs.groupBy(left_id).agg(F.min(right_id).alias(right_id), F.count("*").alias("n")).where("n = 1").select(left_id, right_id)


def best_fuzzy(targets: DataFrame, candidates: DataFrame, target: str, candidate: str, threshold: float = 0.75, on: str | None = None) -> DataFrame:
    """(target, candidate, score): the best-scoring candidate of each target, at the threshold or above.

    Equal names score 1, contained ones by their share, others by difflib's ratio. Pairs that can
    reach the threshold are found by shared letter grams; ``on``, a blocking column of both sides,
    takes all pairs of a block instead, and is needed for thresholds of 2/3 or less.
    """
    from quarrylight.functions.python_udfs import sequence_ratio

    q, c = match_text(F.col(target)), match_text(F.col(candidate))
    asked, named = targets.withColumn("q", q).where("q <> ''"), candidates.withColumn("c", c).where("c <> ''")
    if on:
        pairs = asked.join(named, on)
    else:
        if threshold <= 0.67:
            raise ValueError("a threshold of 2/3 or less needs a blocking column")
        lefts, rights = asked.select("q").distinct(), named.select("c").distinct()
        near = contained(rights, lefts, "c", "c", "q", "q").select("q", "c").unionByName(contained(lefts, rights, "q", "q", "c", "c").select("q", "c"))
        near = saved(near.unionByName(like_pairs(lefts, rights, "q", "c", threshold)).distinct())
        pairs = asked.join(near, "q").join(named, "c")
    share = F.length("q") / F.length("c")
    inner = F.least(F.lit(0.99), F.greatest(F.lit(0.90), 0.85 + share * 0.15))
    outer = F.least(F.lit(0.89), F.greatest(F.lit(0.75), 0.68 + 0.21 / share))
    native = F.when(F.col("q") == F.col("c"), 1.0).when(F.contains("c", "q"), inner).when(F.contains("q", "c"), outer)
    scored = pairs.withColumn("score", native)
    rest = scored.where("score is null").withColumn("score", sequence_ratio("q", "c"))
    best = scored.where("score is not null").unionByName(rest).groupBy(target).agg(F.max(F.struct("score", (-F.length(candidate)).alias("l"), candidate)).alias("m"))
    return best.select(target, F.col(f"m.{candidate}").alias(candidate), F.col("m.score").alias("score")).where(F.col("score") >= threshold)


def match_text(value: Column) -> Column:
    """A unit's name for comparison: lower case, without punctuation and white space."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)[\s\p{Punct}（）【】《》·、，。；：]+", "")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
