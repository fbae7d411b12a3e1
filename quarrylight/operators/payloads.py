"""Extracted payloads made fit for saving, and the units of a page as graph rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import parsing as J
from quarrylight.functions import people as P
from quarrylight.functions import profiles as R
from quarrylight.functions import urls as U
from quarrylight.functions import vocabulary as V
from quarrylight.functions.text import contains_any, text_of
from quarrylight.operators.graph import node_key, priority

FILLED = ["title", "email", "research_areas", "bio"]
FIELDS = ["name", "title", "email", "research_areas", "bio", "homepage"]
CENTRES = next(words for kind, words in V.EXCLUDED_UNITS if kind == "teaching_experiment_center")


def _person(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields.get(f, F.lit(None).cast("string")).cast("string").alias(f) for f in FIELDS])


def _filled(person: Column, record: Column, links: Column) -> Column:
    """A person with the fields that are missing from the page's own record, if it is theirs, and with a homepage from links on their name."""
    same = record.isNotNull() & (P.normalise_name(person["name"]) == record["name"])
    own = {f: F.when((F.btrim(text_of(person[f])) == "") & same, record[f]).otherwise(person[f]) for f in FILLED}
    named = F.filter(links, lambda x: P.normalise_name(x["name"]) == P.normalise_name(person["name"]))
    longest = F.array_max(F.transform(named, lambda x: F.struct(F.length(x["url"]).alias("n"), x["url"].alias("u"))))["u"]
    home = F.when(F.btrim(text_of(person["homepage"])) == "", longest).otherwise(person["homepage"])
    return _person({"name": person["name"], **own, "homepage": home})


def normalised_payloads(payloads: DataFrame, tasks: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads as they are to be saved, and counters of what became of them.

    ``payloads``: task_id, org_unit_name, org_unit_url, source_url, professors (an array of structs
    of FIELDS); ``tasks``: task_id, detail, org_unit_name, org_unit_url, source_url, page_text,
    page_url; ``aliases``: canonical, alias. What comes from list pages is suppressed, and so is what
    names a teaching centre. A payload under another name of the task's unit, or under a department
    within it, goes to the task's unit; any other keeps its name, or gets the task's. Missing fields
    are filled from the page's own record, homepages from links on the person's name. A detail task
    without a payload gets one from its page, if that makes a record. Counters count payloads.
    """
    t = tasks.select("task_id", "detail", *[F.col(c).alias(f"task_{c.removeprefix('org_')}") for c in ("org_unit_name", "org_unit_url", "source_url")], "page_text", F.coalesce("page_url", "source_url").alias("page_at"))
    t = t.withColumn("record", F.when(F.col("detail"), R.snapshot_record(F.col("page_text"), F.col("page_at"))))
    said = payloads.withColumn("given", F.lit(True))
    met = t.join(said, "task_id", "left").where("given or record is not null")
    incoming, own = F.btrim(text_of(F.col("org_unit_name"))), F.btrim(text_of(F.col("task_unit_name")))
    name = F.coalesce(F.nullif(incoming, F.lit("")), F.nullif(own, F.lit("")), F.lit("Unknown"))
    met = met.withColumns({"incoming": incoming, "own": own, "effective": name})
    known = aliases.select(F.btrim("canonical").alias("own"), F.btrim("alias").alias("incoming"), F.lit(True).alias("aliased")).distinct()
    met = met.join(known, ["own", "incoming"], "left")
    moves = (F.col("incoming") != "") & ~F.col("own").isin("", "Unknown") & (F.col("incoming") != F.col("own"))
    route = (
        F.when(~F.col("detail"), "list_suppressed").when(contains_any(F.col("effective"), CENTRES), "teaching_center_dropped").when(F.col("given").isNull(), "synthesized")
        .when(moves & F.coalesce("aliased", F.lit(False)), "alias_rewritten").when(moves & J.is_section_name(F.col("incoming")), "sub_department_rewritten").otherwise("kept")
    )
    met = met.withColumns({"route": route, "links": J.name_links(F.col("page_text"))})
    to_task = F.col("route").isin("alias_rewritten", "sub_department_rewritten")
    record = F.col("record")
    from_page = F.array(_person({f: record[f] for f in ("name", *FILLED)}))
    people = F.when(F.col("given"), F.coalesce("professors", F.array().cast(from_page_type()))).otherwise(from_page)
    filled = F.transform(people, lambda p: _filled(p, record, F.col("links")))
    kept = met.where(~F.col("route").isin("list_suppressed", "teaching_center_dropped"))
    out = kept.select(
        "task_id", F.when(to_task, F.col("own")).otherwise(F.col("effective")).alias("org_unit_name"),
        F.when(to_task, F.coalesce("task_unit_url", "org_unit_url")).otherwise(F.coalesce(F.nullif("org_unit_url", F.lit("")), F.col("task_unit_url"))).alias("org_unit_url"),
        F.coalesce(F.nullif("source_url", F.lit("")), F.col("task_source_url")).alias("source_url"), filled.alias("professors"), "route",
    )
    return out, met.groupBy("route").agg(F.count("*").alias("n"))


def from_page_type() -> str:
    return "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"


def recorded_units(units: DataFrame, edge_type: str = "discovered_on_page") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of units (id, name, url) found on pages (source_url).

    A page is a done listing node, its units wait, and an edge leads from the page to each. A unit
    without a page has a node and no edge; of rows with one key one node is made.
    """
    page, none = U.normalise_url(U.clean_url(F.col("source_url"))), F.lit(None).cast("long")
    rows = units.withColumn("page", F.coalesce(page, F.lit(""))).withColumn("to_key", node_key(F.lit("org_unit"), F.col("url"), F.col("name"), F.col("id")))
    rows = rows.withColumn("from_key", F.when(F.col("page") != "", node_key(F.lit("org_listing_url"), F.col("page"), F.lit(""), none)))
    at = lambda kind: priority(F.lit(kind), F.lit("page"), F.lit(0.0), F.lit(0))
    listing = rows.where("from_key is not null").select(F.col("from_key").alias("node_key"), F.lit("org_listing_url").alias("type"), F.col("page").alias("url"), F.lit("done").alias("status"), at("org_listing_url").alias("priority_score"), F.lit(1).alias("depth"))
    unit = rows.select(F.col("to_key").alias("node_key"), F.lit("org_unit").alias("type"), F.coalesce("url", F.lit("")).alias("url"), F.lit("pending").alias("status"), at("org_unit").alias("priority_score"), F.lit(1).alias("depth"))
    nodes = reduce(DataFrame.unionByName, [listing, unit]).groupBy("node_key").agg(*[F.min(c).alias(c) for c in ("type", "url", "status", "priority_score", "depth")])
    edges = rows.where("from_key is not null").select("from_key", "to_key", F.lit(edge_type).alias("edge_type"), F.lit(1.0).alias("confidence")).distinct()
    return nodes, edges
