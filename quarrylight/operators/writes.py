"""The directory's writes as table-in, table-out steps: units, tasks, moves between tables, records, ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import people as P
from quarrylight.functions import parsing as J
from quarrylight.functions.text import text_of
from quarrylight.operators.ladder import ladder_match
from quarrylight.operators.merge import fill, overwrite

RECRAWL = "completion_recrawl_"
RESOLVED = "completion_recrawl_repaired"


def get_or_create_units(units: DataFrame, incoming: DataFrame, quality: Column) -> DataFrame:
    """Units (name, url, kind, status) after incoming ones: matched by URL, then by name, else created.

    A match takes kind and status; its URL gives way only to one of better ``quality`` (an expression
    over ``url``). Adds outcome: created, matched or untouched. Incoming rows of one URL and name
    must have been folded; of several that match one unit, the greatest name's counts.
    """
    i = incoming.select(F.col("name").alias("i_name"), F.col("url").alias("i_url"), F.col("kind").alias("i_kind"), F.col("status").alias("i_status"), quality.alias("i_quality"))
    met = ladder_match(i, units.select("name", "url"), "i_name", "name", [("url", F.col("i_url"), F.col("url")), ("name", F.col("i_name"), F.col("name"))])
    last = i.join(met, "i_name").groupBy("name").agg(F.max(F.struct("i_name", "i_url", "i_kind", "i_status", "i_quality")).alias("i"))
    kept = units.withColumn("quality", quality).join(last, "name", "left")
    better = (text_of(F.col("url")) == "") | (F.col("i.i_quality") > F.col("quality"))
    kept = kept.select(
        "name", F.when(F.col("i").isNotNull() & better, F.coalesce("i.i_url", "url")).otherwise(F.col("url")).alias("url"), F.coalesce("i.i_kind", "kind").alias("kind"), F.coalesce("i.i_status", "status").alias("status"),
        F.when(F.col("i").isNotNull(), "matched").otherwise("untouched").alias("outcome"),
    )
    new = i.join(met.select("i_name"), "i_name", "left_anti")
    return kept.unionByName(new.select(F.col("i_name").alias("name"), F.col("i_url").alias("url"), F.col("i_kind").alias("kind"), F.col("i_status").alias("status"), F.lit("created").alias("outcome")))


def repointed(rows: DataFrame, parents: DataFrame, unit: str, key: list[str]) -> DataFrame:
    """Rows of child units moved to the parents (child_id, parent_id); of collisions by ``key`` and unit the parent's own stays.

    Adds moved. The keeper is a grouped minimum, so no window meets a large unit.
    """
    moved = rows.join(parents.select(F.col("child_id").alias(unit), "parent_id"), unit, "left").withColumn("moved", F.col("parent_id").isNotNull()).withColumn(unit, F.coalesce("parent_id", unit)).drop("parent_id")
    rest = [c for c in moved.columns if c not in (*key, unit)]
    first = moved.groupBy(*key, unit).agg(F.min(F.struct("moved", *[c for c in rest if c != "moved"])).alias("r"))
    return first.select(*key, unit, "r.*")


def merge_sections(tables: dict[str, tuple[DataFrame, list[str]]], units: DataFrame, parents: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Sub-departments merged into their parents: (tables re-pointed, units left, counters per table).

    ``tables`` maps a name to a table with org_unit_id and its own key columns.
    """
    out = {name: repointed(df, parents, "org_unit_id", key) for name, (df, key) in tables.items()}
    counts = [
        out[name].agg(F.lit(name).alias("table_name"), F.count_if("moved").alias("moved"), (F.lit(0) + F.count("*")).alias("kept")).crossJoin(df.agg(F.count("*").alias("before"))).select("table_name", "moved", (F.col("before") - F.col("kept")).alias("dropped"))
        for name, (df, _) in tables.items()
    ]  # one row each
    return {name: df.drop("moved") for name, df in out.items()}, units.join(parents.select(F.col("child_id").alias("id")), "id", "left_anti"), reduce(DataFrame.unionByName, counts)


def unit_names(affiliations: DataFrame, units: DataFrame) -> DataFrame:
    """(professor_id, org_unit_name): the names of a person's units in the order of their ids, each once."""
    named = affiliations.join(units.select(F.col("id").alias("org_unit_id"), "name"), "org_unit_id")
    listed = named.groupBy("professor_id").agg(F.sort_array(F.collect_set(F.struct("org_unit_id", "name"))).alias("u"))
    return listed.select("professor_id", F.array_join(F.array_distinct("u.name"), " / ").alias("org_unit_name"))


def upsert_recrawls(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tasks (page_hash, source_url, status, attempt, priority, last_error) with ``wanted`` (source_url, reason, priority) to be read again.

    The key is the URL's SHA-256; blank URLs are left out. A known task starts anew as a retry.
    """
    w = wanted.where(F.btrim(text_of(F.col("source_url"))) != "").select(F.sha2(F.btrim("source_url"), 256).alias("page_hash"), F.btrim("source_url").alias("w_url"), F.col("reason").alias("w_reason"), F.col("priority").alias("w_priority"))
    w = w.groupBy("page_hash").agg(F.max(F.struct("w_priority", "w_reason", "w_url")).alias("w"))
    hit = F.col("w").isNotNull()
    both = tasks.join(w, "page_hash", "full_outer")
    return both.select(
        "page_hash", F.coalesce("source_url", "w.w_url").alias("source_url"), F.when(hit, "retry").otherwise(F.col("status")).alias("status"), F.when(hit, 0).otherwise(F.col("attempt")).alias("attempt"),
        F.when(hit, F.col("w.w_priority")).otherwise(F.col("priority")).alias("priority"), F.when(hit, F.concat(F.lit(RECRAWL), "w.w_reason")).otherwise(F.col("last_error")).alias("last_error"),
    )


def resolved_recrawls(tasks: DataFrame, urls: DataFrame) -> DataFrame:
    """Waiting recrawl tasks whose URL is among ``urls`` (url) are done."""
    hit = tasks.join(urls.select(F.col("url").alias("source_url"), F.lit(True).alias("hit")).distinct(), "source_url", "left")
    done = F.coalesce("hit", F.lit(False)) & F.col("status").isin("pending", "retry") & F.startswith(F.coalesce("last_error", F.lit("")), F.lit(RECRAWL))
    return hit.withColumns({"status": F.when(done, "done").otherwise(F.col("status")), "last_error": F.when(done, RESOLVED).otherwise(F.col("last_error"))}).drop("hit")


def moved_rows(source: DataFrame, target: DataFrame, ids: DataFrame, change: dict[str, Column] | None = None, key: list[str] = ["name", "org_unit_id"]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """The rows of ``source`` named in ``ids`` (id) put into ``target``, which has the same columns: (source, target) after.

    ``change`` sets columns of what moves. A target row of the same key takes what it lacks instead
    of getting a twin.
    """
    moving = source.join(ids.select("id").distinct(), "id", "left_semi").withColumns(change or {})
    rest = [c for c in target.columns if c not in key]
    moving = moving.groupBy(*key).agg(F.min(F.struct(*rest)).alias("m")).select(*key, F.struct(*[F.col(f"m.{c}").alias(c) for c in rest]).alias("m"))
    both = target.select(*key, F.struct(*rest).alias("t")).join(moving, key, "full_outer")
    merged = both.select(*key, *[F.when(F.col("t").isNull(), F.col(f"m.{c}")).when(F.col("m").isNull() | F.lit(c == "id"), F.col(f"t.{c}")).otherwise(fill(F.col(f"t.{c}"), F.col(f"m.{c}"))).alias(c) for c in rest])
    return source.join(ids.select("id").distinct(), "id", "left_anti"), merged.select(*target.columns)


def saved_records(people: DataFrame, records: DataFrame, academicians: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of extracted records (name, org_unit_id, title, email, bio, homepage) into the directory.

    Retired people and post-docs are left out, as are rows whose name is empty or no name; names and
    titles are made plain; records of academicians go to their table, the rest are upserted by name
    and unit, where a value given overwrites and a missing one keeps. Returns (people, academicians,
    counters by outcome). Rows of one person in a batch fold first, the later value by text wins.
    """
    said = F.concat_ws(" ", "title", "bio")
    clean = records.withColumns({"name": P.normalise_name(F.col("name")), "said": said})
    outcome = F.when(J.retired_or_postdoc(F.col("said")), "skipped_retired").when((F.col("name") == "") | P.is_not_a_name(F.col("name")), "rejected_name").when(
        P.claims_academician(F.col("name"), F.col("title"), F.col("bio")) | (P.normalise_title(F.col("title")) == "院士"), "academician"
    ).otherwise("person")
    routed = clean.withColumns({"outcome": outcome, "title": P.normalise_title(F.col("title"))}).drop("said")
    fields = ["title", "email", "bio", "homepage"]
    fold = lambda kind: routed.where(F.col("outcome") == kind).groupBy("name", "org_unit_id").agg(*[F.max(F.nullif(f, F.lit(""))).alias(f) for f in fields])

    def upsert(known: DataFrame, new: DataFrame) -> DataFrame:
        both = known.alias("k").join(new.alias("n"), ["name", "org_unit_id"], "full_outer")
        return both.select("name", "org_unit_id", *[overwrite(F.col(f"k.{f}"), F.col(f"n.{f}")).alias(f) for f in fields])

    return upsert(people, fold("person")), upsert(academicians, fold("academician")), routed.groupBy("outcome").agg(F.count("*").alias("n"))


def cached(cache: DataFrame, fetched: DataFrame, at: str = "fetched_at") -> DataFrame:
    """The page cache after new fetches: all columns of a URL come from its latest fetch."""
    rest = [c for c in cache.columns if c not in ("url", at)]
    last = cache.unionByName(fetched).groupBy("url").agg(F.max(F.struct(at, *rest)).alias("r"))
    return last.select("url", *[F.col(f"r.{c}").alias(c) for c in cache.columns if c != "url"])


def with_failures(failures: DataFrame, tasks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extraction failures appended, and tasks of which one says ``resolver = 'retry'`` waiting again."""
    again = new.where("resolver = 'retry'").select(F.col("task_id").alias("id"), F.lit(True).alias("again")).distinct()
    flipped = tasks.join(again, "id", "left").withColumn("status", F.when(F.col("again"), "retry").otherwise(F.col("status"))).drop("again")
    return failures.unionByName(new.select(*failures.columns)), flipped


def ledger(audits: DataFrame, run_id: str) -> DataFrame:
    """One row of a run: its findings, changes and errors (a JSON object of counts by issue)."""
    by_issue = audits.groupBy("issue_type").agg(F.count("*").alias("n"), F.count_if(F.col("action") != "report_only").alias("changed"), F.count_if(F.col("action") == "failed").alias("failed"))
    one = by_issue.agg(F.sum("n").alias("findings"), F.sum("changed").alias("changes"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("failed") > 0, F.struct("issue_type", "failed")))))).alias("errors"))
    return one.select(F.lit(run_id).alias("run_id"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("changes", F.lit(0)).alias("changes"), "errors")


def batch_summary(summaries: DataFrame) -> DataFrame:
    """(counter, n) summed over the runs' summaries (source, counters: map of numbers)."""
    return summaries.select(F.explode("counters").alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("n"))


def seeded(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph nodes (kind, address) and edges (src, dst, type) of a manifest (root, unit, unit_url, faculty_urls, listing_url)."""
    unit = F.concat(F.lit("org_unit:"), "unit")
    page = lambda kind, url: F.concat(F.lit(f"{kind}:"), url)
    flat = manifest.select("*", F.explode_outer("faculty_urls").alias("faculty_url"))
    edges = [
        flat.select(F.concat(F.lit("root:"), "root").alias("src"), unit.alias("dst"), F.lit("has_unit").alias("type")),
        flat.where("faculty_url <> ''").select(unit.alias("src"), page("faculty_list_url", F.col("faculty_url")).alias("dst"), F.lit("has_faculty_list").alias("type")),
        flat.where("listing_url <> ''").select(page("org_listing_url", F.col("listing_url")).alias("src"), unit.alias("dst"), F.lit("lists_unit").alias("type")),
    ]
    edges = reduce(DataFrame.unionByName, edges).distinct()
    keys = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    return keys.select(F.substring_index("key", ":", 1).alias("kind"), F.expr("substring(key, instr(key, ':') + 1)").alias("address")), edges
