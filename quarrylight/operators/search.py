"""Inverted index, TF-IDF search, concept expansion and three-level ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T


def term_counts(docs: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """The index: (key, term, tf); a key may span columns.

    Rows are brought together by key before their texts are split, so texts move where terms don't;
    what is grouped by key later finds them in place.
    """
    keys = [key] if isinstance(key, str) else key
    spark = docs.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    terms = docs.select(*keys, text).repartition(parts, *keys).select(*keys, F.explode(T.raw_tokens(F.col(text))).alias("term"))
    terms = terms.withColumn("term", T.trimmed_token(F.col("term"))).where(T.is_term(F.col("term")))
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def latin_term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The index of texts without CJK runs, which need no n-grams."""
    return docs.select(key, F.explode(T.latin_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def search(index: DataFrame, terms: list[str], n_docs: DataFrame, key: str, limit: int = 300) -> DataFrame:
    """(key, score, matched) of the best documents for a list of terms.

    Terms are filtered before the counts, so only postings of the query move. ``n_docs`` is a
    one-row table (n) of the number of documents, looked up as a scalar.
    """
    total = n_docs.select("n").scalar()
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").groupBy(key).agg(  # a row for each term of the query
        F.round(F.sum(F.col("tf") * idf(total, F.col("df"))), 6).alias("score"), F.sort_array(F.collect_set("term")).alias("matched")
    )
    return scored.orderBy(F.desc("score"), key).limit(limit)


def boosted(scores: DataFrame, links: DataFrame, weight: float = 0.8, limit: int = 300) -> DataFrame:
    """Scores (key, kind, score) with each person's raised by the concepts that link to them.

    ``links`` is (key, concept). The first ``limit`` links in order count.
    """
    concepts = scores.where("kind = 'concept'").select(F.col("key").alias("concept"), (F.col("score") * weight).alias("gain"))
    used = links.join(concepts, "concept").orderBy("concept", "key").limit(limit)
    gains = used.groupBy("key").agg(F.sum("gain").alias("gain"))
    people = scores.where("kind <> 'concept'").join(gains, "key", "full_outer")
    return people.select("key", F.coalesce("kind", F.lit("professor")).alias("kind"), (F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"))


def clip_share(value: Column, most: Column) -> Column:
    """value / most between 0 and 1; 0 where nothing is above 0."""
    return F.when(most <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(value / most, F.lit(1.0))))


def rank_people(candidates: DataFrame, limit: int = 20) -> DataFrame:
    """The best people of (key, name, org, school, text, completeness, title, context, constraint).

    100 x (0.55 text + 0.15 completeness + 0.10 title + 0.15 context + 0.05 constraint), text and
    context as shares of their maxima over all candidates.
    """
    most = candidates.agg(F.max("text").alias("mt"), F.max("context").alias("mc"))
    text_most, context_most = most.select("mt").scalar(), most.select("mc").scalar()
    parts = 0.55 * clip_share(F.col("text"), text_most) + 0.15 * F.col("completeness") + 0.10 * F.col("title") + 0.15 * clip_share(F.col("context"), context_most) + 0.05 * F.col("constraint")
    scored = candidates.withColumn("score", F.least(F.lit(100.0), F.round(100 * parts, 2)))
    return scored.orderBy(F.desc("score"), "school", "org", "name").limit(limit)


def rank_groups(people: DataFrame, group: str, own: DataFrame, best: int, cap: float, limit: int) -> DataFrame:
    """Groups of ranked people: the mean of their ``best`` top scores and twice their own score, capped.

    ``own`` is (group, own). Works on the list of top people, which is short.
    """
    top = people.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "key"))).where(F.col("r") <= best)
    mean = top.groupBy(group).agg(F.avg("score").alias("mean"), F.count("*").alias("n_best"))
    boost = F.least(F.lit(cap), 2 * F.coalesce("own", F.lit(0.0)))
    scored = mean.join(own, group, "left").select(group, F.least(F.lit(100.0), F.round(F.least(F.lit(100.0), F.col("mean") + boost), 2)).alias("score"))
    return scored.orderBy(F.desc("score"), group).limit(limit)


def recommend(nodes: DataFrame, index: DataFrame, links: DataFrame, query: str, spark, people_limit: int = 20, org_limit: int = 10, school_limit: int = 5) -> dict[str, DataFrame]:
    """Schools, units and people for a free-text wish.

    ``nodes``: (key, kind, name, university_key, org_keys array, location and profile fields);
    ``index``: (key, term, tf); ``links``: (key, concept).
    """
    from quarrylight.functions.classify import title_score
    from quarrylight.functions.people import completeness
    from quarrylight.functions.text import text_of
    from quarrylight.operators.profile import parse_profile

    profile = parse_profile(spark, query)
    terms = list(dict.fromkeys([*profile["top"], *profile["tokens"][:120]]))
    total = nodes.agg(F.count("*").alias("n"))
    scores = search(index, terms, total, "key").join(nodes.select("key", "kind"), "key")
    found = boosted(scores, links)
    context = scores.where("kind <> 'professor'").select(F.col("key").alias("context_key"), F.col("score").alias("context_score"))
    people = found.where("kind = 'professor' and score > 0").orderBy(F.desc("score"), "key").limit(200).join(nodes.drop("kind"), "key").withColumnRenamed("score", "text")
    around = people.select("key", F.explode(F.array_append("org_keys", F.col("university_key"))).alias("context_key")).join(context, "context_key").groupBy("key").agg(F.max("context_score").alias("context"))
    fields = {f: F.col(f) for f in ("research_areas", "bio", "enrollment_pref", "publications", "email", "homepage")}
    place = F.concat_ws(" ", text_of(F.col("location")), text_of(F.col("university_name")), text_of(F.col("org_unit_name")))
    fits = F.exists(F.array(*map(F.lit, profile["locations"])), lambda p: F.contains(place, p)) if profile["locations"] else None
    candidates = people.join(around, "key", "left").withColumns({
        "context": F.coalesce("context", F.lit(0.0)), "completeness": completeness(**fields),
        "title": title_score(F.col("title"), F.col("enrollment_pref"), profile["degrees"], profile["titles"]),
        "constraint": F.when(fits, 1.0).otherwise(0.0) if fits is not None else F.lit(0.5), "school": F.col("university_name"), "org": F.col("org_unit_name"),
    })
    best = rank_people(candidates, people_limit)
    own = lambda name: context.select(F.col("context_key").alias(name), F.col("context_score").alias("own"))
    orgs = rank_groups(best.select("key", "score", F.explode("org_keys").alias("org_key")), "org_key", own("org_key"), 3, 12.0, org_limit)
    schools = rank_groups(best.select("key", "score", F.col("university_key").alias("school_key")), "school_key", own("school_key"), 5, 10.0, school_limit)
    return {"people": best, "org_units": orgs, "schools": schools}
