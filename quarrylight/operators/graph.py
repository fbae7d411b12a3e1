"""The typed URL graph: keys, priorities, claims, discovery and a frontier over captured pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import urls as U
from quarrylight.functions import vocabulary as V
from quarrylight.functions.text import text_of
from quarrylight.sources.tables import Scratch, saved, shared_dir


def node_key(kind: Column, url: Column, org_name: Column, org_id: Column) -> Column:
    """``kind:...``: units by id or name, pages by URL within their unit if they have one."""
    address, name = U.normalise_url(url), F.btrim(text_of(org_name))
    by_unit = F.when(org_id.isNotNull(), F.concat(F.lit("id:"), org_id.cast("string"))).when(name != "", F.concat(F.lit("name:"), name))
    unit = F.coalesce(org_id.cast("string"), F.nullif(name, F.lit("")))
    by_page = F.when(unit.isNotNull(), F.concat(F.lit("org:"), unit, F.lit(":url:"), address)).otherwise(F.concat(F.lit("url:"), address))
    return F.concat_ws(":", kind, F.when(kind == "org_unit", by_unit).when(address != "", by_page).otherwise(by_unit))


def priority(kind: Column, source: Column, candidate_score: Column, depth: Column) -> Column:
    """Base by kind, 30 more for the manifest, up to 20 for the candidate, two less per level."""
    base = F.coalesce(F.create_map(*[x for k, v in V.BASE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])[kind], F.lit(0.0))
    scored = F.when(kind.isin("faculty_list_url", "faculty_followup_url"), F.greatest(F.lit(-20.0), F.least(F.lit(20.0), candidate_score.cast("double")))).otherwise(0.0)
    return base + F.when(source == "manifest", 30.0).otherwise(0.0) + scored - 2.0 * F.greatest(F.lit(0), depth)


def claimable(nodes: DataFrame, attempted: DataFrame | None = None) -> DataFrame:
    """Nodes that may be claimed, with their priority after backoff."""
    open_ = nodes.where(F.col("status").isin("pending", "retry") & (F.col("attempt_count") < V.MAX_ATTEMPTS))
    if attempted is not None:
        open_ = open_.join(attempted.select("id"), "id", "left_anti")
    return open_.withColumn("effective", F.col("base_priority") - V.BACKOFF * F.col("attempt_count"))


def claim_next(nodes: DataFrame, attempted: DataFrame | None = None, limit: int = 1) -> DataFrame:
    """The nodes to fetch next: by backed-off base priority, confidence, depth, attempts and id."""
    return claimable(nodes, attempted).orderBy(F.desc("effective"), F.desc("confidence"), "depth", "attempt_count", "id").limit(limit)


def _first_of(waiting: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """The rows of ``claim_next`` from claimable ones, without a sort of all in one task.

    Ranges of the order are written; those that fit go whole, and only the range that the limit cuts
    is sorted to it. The driver gets a number a range.
    """
    if waiting.count() <= limit:
        return waiting
    order = [F.desc("effective"), F.desc("confidence"), F.col("depth"), F.col("attempt_count"), F.col("id")]
    placed = scratch.save(waiting.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "placed")
    whole, left, cut = -1, limit, None
    for at, n in sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()):
        if n > left:
            cut = at
            break
        whole, left = at, left - n
    first = placed.where(F.col("range") <= whole)
    return (first if cut is None else first.unionByName(placed.where(F.col("range") == cut).orderBy(*order).limit(left))).drop("range")


def ready_queue(nodes: DataFrame, limit: int) -> DataFrame:
    """The waiting nodes by their current priority, which re-discovery changes."""
    return nodes.where(F.col("status").isin("pending", "retry")).orderBy(F.desc("priority_score"), F.desc("confidence"), "depth", "attempt_count", "id").limit(limit)


def marked(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes after results (id, status): one more attempt and five less priority each."""
    r = results.select("id", F.col("status").alias("new"))
    hit = F.col("new").isNotNull()
    joined = nodes.join(r, "id", "left")
    return joined.withColumns({
        "status": F.coalesce("new", "status"), "attempt_count": F.col("attempt_count") + hit.cast("int"), "priority_score": F.col("priority_score") - F.when(hit, V.BACKOFF).otherwise(0.0)
    }).drop("new")


def recovered(nodes: DataFrame) -> DataFrame:
    """What an earlier run left in progress waits again."""
    stale = F.col("status") == "in_progress"
    return nodes.withColumns({"last_error": F.when(stale, "recovered_stale").otherwise(F.col("last_error")), "status": F.when(stale, "retry").otherwise(F.col("status"))})


def discovered(links: DataFrame, source: str = "source_url") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of found links (source_url, url, kind, edge_type, org_unit_name, score, depth)."""
    key = node_key(F.col("kind"), F.col("url"), F.col("org_unit_name"), F.lit(None).cast("long"))
    origin = node_key(F.lit("faculty_list_url"), F.col(source), F.col("org_unit_name"), F.lit(None).cast("long"))
    rows = links.withColumns({"node_key": key, "from_key": origin, "p": priority(F.col("kind"), F.lit("link"), F.col("score"), F.col("depth"))})
    nodes = rows.groupBy("node_key").agg(F.max("p").alias("priority_score"), F.min("depth").alias("depth"), F.first("url").alias("url"))
    edges = rows.groupBy("from_key", F.col("node_key").alias("to_key"), "edge_type").agg(F.max("confidence").alias("confidence"))
    return nodes, edges


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, depth) of all that ``seeds`` (url) reach over ``links`` (src, dst) within ``max_depth`` steps.

    A breadth-first frontier: each round joins it with the links, drops what was seen, and is
    written to the shared folder; it ends when the frontier is empty.
    """
    seen = saved(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.select(F.col("url").alias("src")).join(links, "src").select(F.col("dst").alias("url")).distinct()
        frontier = saved(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def claim_loop(nodes: DataFrame, links: DataFrame, at_once: int, rounds: int | None = None, max_depth: int = 3) -> DataFrame:
    """Nodes after claiming the ``at_once`` best, reading their pages and adding what these link to, until none waits.

    ``nodes`` has (id, base_priority, confidence, depth, status, attempt_count), ``links`` (src, dst,
    base_priority, confidence) the captured pages. A claimed node with a page is done, one without is
    tried again in the next run; what it links to waits one level deeper, unless it is known or too
    deep. A node is claimed once a run. Adds round, NULL for what was never claimed; ``rounds`` is a
    bound on them. A round writes what changed only, as the log's next part: the nodes it claimed,
    ``at_once`` at most, and those it found. The state is the log, read anew; what waits is kept beside
    it, so a round looks at no node that is done with.
    """
    spark, at = nodes.sparkSession, f"{shared_dir(nodes.sparkSession)}/claims-{uuid.uuid4().hex}"
    fields = "id", "base_priority", "confidence", "depth", "status", "attempt_count"
    seeds = nodes.select(*fields)
    seeds.write.parquet(f"{at}/nodes/part=0")
    # the empty first part gives the claims a schema
    seeds.limit(0).select("id", "depth", F.lit(True).alias("got"), F.lit(0).alias("round")).write.parquet(f"{at}/claims/part=0")
    state = seeds.schema
    claim_schema = spark.read.parquet(f"{at}/claims/part=0").schema
    known = lambda: spark.read.schema(state).parquet(f"{at}/nodes/*")
    taken = lambda: spark.read.schema(claim_schema).parquet(f"{at}/claims/*")
    scratch = Scratch(spark)
    waiting = scratch.save(claimable(seeds), "waiting")
    k = 0
    while rounds is None or k < rounds:
        k += 1
        best = scratch.save(_first_of(waiting, at_once, scratch).select("id", "depth"), "best")
        if best.isEmpty():
            break
        # one pass over the links serves pages and finds
        met = scratch.save(links.join(best.withColumnRenamed("id", "src"), "src"), "met")
        paged = met.select(F.col("src").alias("id"), F.lit(True).alias("has_page")).distinct()
        best.join(paged, "id", "left").select("id", "depth", F.coalesce("has_page", F.lit(False)).alias("got"), F.lit(k).alias("round")).write.parquet(f"{at}/claims/part={k}")
        found = met.where(F.col("depth") < max_depth)
        found = found.groupBy(F.col("dst").alias("id")).agg(F.max("base_priority").alias("base_priority"), F.max("confidence").alias("confidence"), (F.min("depth") + 1).cast(state["depth"].dataType).alias("depth"))
        new = found.join(known().select("id"), "id", "left_anti").select("id", "base_priority", "confidence", "depth", F.lit("pending").alias("status"), F.lit(0).cast(state["attempt_count"].dataType).alias("attempt_count"))
        new.write.parquet(f"{at}/nodes/part={k}")
        added = claimable(spark.read.schema(state).parquet(f"{at}/nodes/part={k}"))
        waiting = scratch.save(waiting.join(best.select("id"), "id", "left_anti").select(*added.columns).unionByName(added), "waiting")
    scratch.free("waiting", "placed", "best", "met")
    joined = known().join(taken().select("id", "got", "round"), "id", "left")
    hit = F.col("got").isNotNull()
    return joined.select("id", "base_priority", "confidence", "depth", F.when(F.col("got"), "done").when(hit, "retry").otherwise(F.col("status")).alias("status"), (F.col("attempt_count") + hit.cast("int")).alias("attempt_count"), "round")


def knowledge_graph(universities: DataFrame, units: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (source_key, node_type, name) and edges (source, target, relation, weight) of directory tables.

    universities: (university_key, name, location); units: (org_key, name, university_key);
    people: (person_key, name, org_key, title, concepts array, recruits array).
    """
    from quarrylight.functions.text import concept_key

    concepts = people.select(F.explode(F.concat("concepts", "recruits", F.array_compact(F.array("title")))).alias("name")).distinct()
    concepts = concepts.select(concept_key(F.col("name")).alias("source_key"), "name").groupBy("source_key").agg(F.min("name").alias("name"))
    node = lambda df, key, kind: df.select(F.col(key).alias("source_key"), F.lit(kind).alias("node_type"), "name")
    nodes = node(universities, "university_key", "university").unionByName(node(units, "org_key", "org_unit")).unionByName(node(people, "person_key", "professor")).unionByName(node(concepts, "source_key", "concept"))

    def edge(df: DataFrame, a: Column, b: Column, relation: str) -> DataFrame:
        return df.select(a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"), F.lit(1.0).alias("weight")).where("source is not null and target is not null")

    located = universities.where(F.btrim("location") != "")
    each = lambda column, n: people.select("person_key", F.explode(F.slice(column, 1, n)).alias("term"))
    edges = (
        edge(located, F.col("university_key"), concept_key(F.col("location")), "LOCATED_IN")
        .unionByName(edge(units, F.col("university_key"), F.col("org_key"), "HAS_ORG_UNIT"))
        .unionByName(edge(people, F.col("person_key"), F.col("org_key"), "AFFILIATED_WITH"))
        .unionByName(edge(each("concepts", 12), F.col("person_key"), concept_key(F.col("term")), "RESEARCHES"))
        .unionByName(edge(each("recruits", 4), F.col("person_key"), concept_key(F.col("term")), "RECRUITS_FOR"))
        .unionByName(edge(people.where(F.btrim("title") != ""), F.col("person_key"), concept_key(F.col("title")), "HAS_TITLE"))
    )
    return nodes, edges.distinct()
