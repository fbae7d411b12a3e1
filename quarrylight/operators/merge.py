"""Field-by-field merging of records, keepers of duplicate groups, ordered folds of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import people as P
from quarrylight.functions import urls as U
from quarrylight.functions import vocabulary as V
from quarrylight.operators.components import components

PLAIN = ["research_areas", "email", "phone", "bio", "enrollment_pref", "publications"]


def blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) == ""


def fill(current: Column, incoming: Column) -> Column:
    """The current value unless it is NULL or empty."""
    return F.when(blank(current), incoming).otherwise(current)


def overwrite(current: Column, incoming: Column) -> Column:
    return F.when(blank(incoming), current).otherwise(incoming)


def merged_profile(current: str, incoming: str, same_org: Column) -> dict[str, Column]:
    """Columns of a profile after an incoming record, by each field's own policy.

    A record from the same unit overwrites plain fields, another only fills; names stay clean, unit
    names join, titles go by rank, homepages by how personal they look, external links only fill.
    """
    c, i = (lambda f: F.col(f"{current}.{f}")), (lambda f: F.col(f"{incoming}.{f}"))
    out = {
        "name": P.better_name(c("name"), i("name")),
        "org_unit_name": P.merge_org_names(c("org_unit_name"), i("org_unit_name")),
        "title": F.when(blank(i("title")), c("title")).otherwise(P.better_title(c("title"), i("title"))),
        "homepage": U.better_profile_url(c("homepage"), i("homepage")),
        "external_link": fill(c("external_link"), i("external_link")),
    }
    return out | {f: F.when(same_org, overwrite(c(f), i(f))).otherwise(fill(c(f), i(f))) for f in PLAIN}


def merge_records(existing: DataFrame, incoming: DataFrame, keys: list[str], policies: dict[str, Column]) -> DataFrame:
    """Full outer join of both sides by keys; policies see them as ``e`` and ``i`` and give the columns.

    Adds status: created, updated or unchanged. Later rows of the same key must have been folded.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    on = reduce(lambda a, b: a & b, [F.col(f"e.{k}") == F.col(f"i.{k}") for k in keys])
    joined = e.join(i, on, "full_outer")
    new, absent = F.col(f"e.{keys[0]}").isNull(), F.col(f"i.{keys[0]}").isNull()
    kept = {f: F.when(new, F.col(f"i.{f}")).when(absent, F.col(f"e.{f}")).otherwise(c) for f, c in policies.items()}
    same = reduce(lambda a, b: a & b, [F.col(f"e.{f}").eqNullSafe(c) for f, c in kept.items()])
    status = F.when(new, "created").when(absent | same, "unchanged").otherwise("updated")
    return joined.select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"i.{k}")).alias(k) for k in keys], *[c.alias(f) for f, c in kept.items()], status.alias("status"))


def last_write(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key in ``order``, by one grouped maximum."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, "r.*")


def keeper_score(row_id: str, name: str, fields: list[str]) -> Column:
    """Orders rows of a group: clean names, then filled fields, then the least id."""
    full = sum((F.when(blank(F.col(f)), 0).otherwise(1) for f in fields), F.lit(0))
    clean = F.when(F.btrim(name) == P.normalise_name(F.col(name)), 1).otherwise(0)
    return F.struct(clean.alias("clean"), full.alias("full"), (-F.col(row_id)).alias("least"))


def repair_groups(people: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Groups of two or more profiles that share a unit and name, or a personal homepage.

    (reason, match_key, keeper_id, members); of groups with the same members the homepage's counts.
    """
    fields = [f for f in V.REPAIR_FIELDS if f in people.columns]
    rows = people.withColumns({"key": P.normalise_name(F.col("name")), "page": U.profile_homepage(F.col("homepage")), "score": keeper_score("id", "name", fields)})
    by_name = rows.join(affiliations.select(F.col("professor_id").alias("id"), "org_unit_id").distinct(), "id").where("key <> ''").select(
        F.lit(1).alias("order"), F.lit("same_org_name_key").alias("reason"), F.concat_ws(":", F.col("org_unit_id").cast("string"), "key").alias("match_key"), "id", "score")
    by_page = rows.where("page is not null").select(F.lit(0).alias("order"), F.lit("homepage_exact").alias("reason"), F.col("page").alias("match_key"), "id", "score")
    groups = by_name.unionByName(by_page).groupBy("order", "reason", "match_key").agg(F.max_by("id", "score").alias("keeper_id"), F.sort_array(F.collect_set("id")).alias("members"))
    first = groups.where(F.size("members") > 1).groupBy("members").agg(F.min(F.struct("order", "match_key", "reason", "keeper_id")).alias("g"))
    return first.select("g.reason", "g.match_key", "g.keeper_id", "members")


def repair_identities(people: DataFrame, affiliations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged profiles and the map (id, keeper_id) of all that were merged.

    Groups that share members form one identity. Its keeper is the best of them all; each field is
    the keeper's, or else the first one filled in order of id. Where groups chain, this can differ
    from merging them one after the other, which depends on the order.
    """
    groups = repair_groups(people, affiliations)
    edges = groups.select(F.col("members")[0].alias("a"), F.explode("members").alias("b"))
    roots = components(edges)
    fields = [f for f in V.REPAIR_FIELDS if f in people.columns]
    placed = people.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).withColumn("score", keeper_score("id", "name", fields))
    keeper = placed.groupBy("root").agg(F.max_by("id", "score").alias("keeper_id"), F.count("*").alias("n"))
    mapped = placed.join(keeper, "root").withColumn("order", F.struct((F.col("id") != F.col("keeper_id")).alias("later"), "id"))
    filled = lambda f: F.min_by(f, F.when(~blank(F.col(f)), F.col("order")))
    other = [c for c in people.columns if c != "id"]
    merged = mapped.groupBy(F.col("keeper_id").alias("id")).agg(*[filled(c).alias(c) for c in other])
    return merged, mapped.where("n > 1").select("id", "keeper_id")


def resolve_status(current: Column, incoming: Column) -> Column:
    """A node's status after it is found again: done stays, failed and skipped reopen, others only rise."""
    rank = F.create_map(*[x for k, v in V.NODE_STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    reopened = current.isin("failed", "skipped") & incoming.isin("pending", "retry")
    return (
        F.when(F.coalesce(incoming, F.lit("")).isin("") | (incoming == current), current)
        .when(current == "done", current)
        .when(reopened, "retry")
        .when(F.coalesce(rank[incoming], F.lit(0)) >= F.coalesce(rank[current], F.lit(0)), incoming)
        .otherwise(current)
    )


#: Rows of a time slice; one row's array holds no more events.
SLICE = 12  # bits
KNOWN = [*V.NODE_STATUS_RANK]


def _then(states: Column, change: Column) -> Column:
    """The states after a map that has, for each known status and any other, what it becomes or NULL if it stays."""
    at = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KNOWN)), s), F.lit(0)), F.lit(len(KNOWN) + 1))
    return F.transform(states, lambda s: F.coalesce(F.element_at(change, at(s).cast("int")), s))


def fold_status(events: DataFrame, key: str, status: str, seq: str) -> DataFrame:
    """(key, status) after all of a key's events in order.

    What events do to a status is a map over the known statuses and any other, and maps compose. So
    rows are dealt out by ``seq`` and cut into slices; each slice of a key gives a map, then each
    partition of slices, then the key. No row gathers more than 4096 events, or the maps of a level.
    """
    fields = events.select(F.col(key).alias("k"), F.col(status).alias("v"), F.col(seq).alias("s"))
    inorder = fields.repartitionByRange("s").sortWithinPartitions("s", "v", "k").withColumn("at", F.monotonically_increasing_id())
    start = F.array(*map(F.lit, KNOWN), F.lit(None).cast("string"))
    gathered = lambda at, what: F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(what).alias("x")))), lambda e: e["x"])
    slices = inorder.groupBy("k", F.shiftright("at", SLICE).alias("slice")).agg(gathered("at", "v").alias("vs"), F.min_by(F.struct("v"), "at").alias("first"))
    maps = slices.select("k", F.col("slice").alias("at"), "first", F.aggregate("vs", start, lambda states, v: F.transform(states, lambda s: resolve_status(s, v))).alias("map"))
    for level in (F.shiftright("at", 33 - SLICE), F.lit(0)):  # the partition is above bit 33
        joined = maps.groupBy("k", level.alias("level")).agg(gathered("at", "map").alias("maps"), F.min_by("first", "at").alias("first"))
        maps = joined.select("k", F.col("level").alias("at"), "first", F.aggregate("maps", start, _then).alias("map"))
    return maps.select(F.col("k").alias(key), _then(F.array(F.col("first.v")), F.col("map"))[0].alias("status"))


def upsert_nodes(found: DataFrame) -> DataFrame:
    """One row per node_key: the highest priority, base priority and confidence, the least depth."""
    status = fold_status(found, "node_key", "status", "seq")
    best = found.groupBy("node_key").agg(F.max("priority_score").alias("priority_score"), F.max("base_priority").alias("base_priority"), F.max("confidence").alias("confidence"), F.min("depth").alias("depth"))
    return best.join(status, "node_key")


def upsert_edges(found: DataFrame) -> DataFrame:
    """One row per (from, to, type) with the highest confidence."""
    return found.groupBy("from_key", "to_key", "edge_type").agg(F.max("confidence").alias("confidence"))


def upsert_affiliations(found: DataFrame, keys: list[str], source: str, quality: Column) -> DataFrame:
    """One row for each of ``keys``, with the source of the highest ``quality`` and n, how often it was found."""
    return found.groupBy(*keys).agg(F.max_by(source, quality).alias("source"), F.count("*").alias("n"))


def rewrite_keys(df: DataFrame, key: str, moved: DataFrame, unique: list[str], row_id: str = "id") -> DataFrame:
    """Point ``key`` at its new owner by ``moved`` (old, new) and drop what then repeats ``unique``.

    Of repeats, rows that already had the owner stay before moved ones, then the least id.
    """
    joined = df.join(moved.select(F.col("old").alias(key), "new"), key, "left")
    pointed = joined.withColumn("_moved", F.col("new").isNotNull()).withColumn(key, F.coalesce("new", key)).drop("new")
    rest = [c for c in df.columns if c not in unique]
    best = pointed.groupBy(*unique).agg(F.min_by(F.struct(*rest), F.struct("_moved", row_id)).alias("r"))
    return best.select(*unique, "r.*").select(*df.columns)
