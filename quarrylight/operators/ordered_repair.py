"""Identity repair one merge after the other, as a fixed order of candidates asks for it.

A merged profile has its keeper's name, all units and perhaps a new homepage, so merges make new
candidates. Profiles fall into cells such that no merge ever links two cells; in each round every
cell carries out its first candidate. As cells don't touch, that is the sequence of single merges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import people as P
from quarrylight.functions import urls as U
from quarrylight.functions import vocabulary as V
from quarrylight.functions.text import let
from quarrylight.operators.components import components
from quarrylight.operators.merge import blank, keeper_score
from quarrylight.sources.tables import Scratch, spread

REASONS = {0: "homepage_exact", 1: "same_org_name_key"}


def _keys(rows: DataFrame, units: DataFrame, by: str) -> DataFrame:
    """(by, order, match_key) of every key that rows of a profile, or a cell, can be matched on."""
    names = rows.where("name_key <> ''").select(by, "name_key").distinct()
    named = names.join(units.select(by, "org_unit_id").distinct(), by).select(by, F.lit(1).alias("order"), F.concat_ws(":", F.col("org_unit_id").cast("string"), "name_key").alias("match_key"))
    paged = rows.where("homepage is not null").select(by, F.lit(0).alias("order"), F.col("homepage").alias("match_key"))
    return named.unionByName(paged).distinct()


def closed_cells(people: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, cell): any name of a cell may come to meet any of its units, so cells that could share such a pair are one."""
    cells = scratch.save(people.select("id", F.col("id").alias("cell")), "cells")
    while True:
        keys = _keys(people.join(cells, "id"), units.join(cells, "id"), "cell")
        least = keys.groupBy("order", "match_key").agg(F.min("cell").alias("a"))
        edges = scratch.save(keys.join(least, ["order", "match_key"]).where("a <> cell").select("a", F.col("cell").alias("b")), "links")
        if edges.isEmpty():
            scratch.free("links")
            return cells
        roots = components(edges).select(F.col("node").alias("cell"), "root")
        cells = scratch.save(cells.join(roots, "cell", "left").select("id", F.coalesce("root", "cell").alias("cell")), "cells")


def repair_in_order(people: DataFrame, affiliations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, affiliations (professor_id, org_unit_id) and the log of merges, when no candidate is left.

    Candidates are two or more profiles that share a homepage, then those that share a unit and a
    name, each in order of the key; of equal sets the first counts. The keeper has a clean name, most
    fields, the least id. It keeps its fields and takes missing ones from the others in order of id,
    and the better of all URLs. The log is (round, reason, match_key, id, keeper_id). Names and
    homepages are normalised first; null ids are left out.
    """
    scratch, spark = Scratch(people.sparkSession), people.sparkSession
    fields = [f for f in V.REPAIR_FIELDS if f in people.columns]
    links = [f for f in ("homepage", "external_link") if f in people.columns]
    clean = let(P.normalise_name(F.col("name")), lambda name: F.when(name != "", name).otherwise(F.col("name")))
    # many profiles fit into few bytes, and a task takes long to normalise them
    rows = spread(people.where("id is not null")).withColumns({"homepage": U.profile_homepage(F.col("homepage")), "name": clean})
    rows = scratch.save(rows.withColumn("name_key", F.coalesce(P.normalise_name(F.col("name")), F.lit(""))), "start")
    units = affiliations.select(F.col("professor_id").alias("id"), "org_unit_id").where("id is not null").distinct()
    cells = closed_cells(rows, units, scratch)
    rows = scratch.save(rows.join(cells, "id").select(*rows.columns, "cell"), "rows")
    units = scratch.save(units.join(cells, "id").select("id", "org_unit_id", "cell"), "units")
    scratch.free("start", "cells")
    settled, settled_units, log, turn = [], [], [], 0
    while True:
        keyed = scratch.save(_keys(rows, units, "id").join(rows.select("id", "cell", keeper_score("id", "name", fields).alias("score")), "id"), "keyed")
        # a set of members is told by its size and two sums of hashes
        one = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(38,0)"))
        sets = keyed.groupBy("cell", "order", "match_key").agg(F.max_by("id", "score").alias("keeper_id"), F.count("*").alias("n"), one(1).alias("s1"), one(2).alias("s2")).where("n > 1")
        distinct = sets.groupBy("cell", "n", "s1", "s2").agg(F.min(F.struct("order", "match_key", "keeper_id")).alias("g"))
        first = distinct.groupBy("cell").agg(F.min("g").alias("g")).select("cell", "g.*")
        first = scratch.save(first, "first")
        if first.isEmpty():
            break
        turn += 1
        members = scratch.save(keyed.join(first, ["cell", "order", "match_key"]).select("id", "keeper_id", "order", "match_key"), "members")
        reason = F.element_at(F.create_map(*[F.lit(x) for p in REASONS.items() for x in p]), F.col("order"))
        log.append(scratch.save(members.where("id <> keeper_id").select(F.lit(turn).alias("round"), reason.alias("reason"), "match_key", "id", "keeper_id"), f"log-{turn}"))
        # cells without a candidate are done
        busy = first.select("cell")
        settled.append(scratch.save(rows.join(busy, "cell", "left_anti").select(*rows.columns), f"settled-{turn}"))
        settled_units.append(scratch.save(units.join(busy, "cell", "left_anti").select(*units.columns), f"settled-units-{turn}"))
        placed = rows.join(busy, "cell").join(members.select("id", "keeper_id"), "id", "left").withColumn("to", F.coalesce("keeper_id", "id"))
        place = F.struct((F.col("id") != F.col("to")).alias("later"), "id")
        merged = {c: F.min_by(c, place) for c in rows.columns if c not in ("id", *fields)}
        merged |= {f: F.min_by(f, F.when(~blank(F.col(f)), place)) for f in fields}
        depth = lambda u: F.greatest(F.lit(0), U.slashes(U.path_of(u)) - 1)
        for f in links:
            best = F.struct(U.profile_url_quality(F.col(f)).alias("q"), depth(F.col(f)).alias("d"), (F.col("id") == F.col("to")).alias("own"), (-F.col("id")).alias("first"))
            merged[f] = F.max_by(f, F.when(~blank(F.col(f)), best))
        folded = placed.groupBy(F.col("to").alias("id")).agg(*[e.alias(c) for c, e in merged.items()])
        moved = units.join(busy, "cell").join(members.select("id", "keeper_id"), "id", "left").select(F.coalesce("keeper_id", "id").alias("id"), "org_unit_id", "cell").distinct()
        rows, units = scratch.save(folded.select(*rows.columns), "rows"), scratch.save(moved, "units")
    scratch.free("keyed", "first", "members")
    whole = reduce(DataFrame.unionByName, [*settled, rows]).select(*people.columns)
    units = reduce(DataFrame.unionByName, [*settled_units, units]).select(F.col("id").alias("professor_id"), "org_unit_id")
    empty = spark.createDataFrame([], f"round int, reason string, match_key string, id {rows.schema['id'].dataType.simpleString()}, keeper_id {rows.schema['id'].dataType.simpleString()}")
    return whole, units, reduce(DataFrame.unionByName, log, empty)
