"""Connected components for identity repair: hook to the least neighbour and jump, until stable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.tables import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the least node of each component, for edges (a, b).

    Every round names each node by its least neighbour or itself, follows the names twice, and
    contracts the edges to the new names, so that edges within a component vanish and long chains
    halve. A node's name is looked up in a table of its own, so a giant component is no one key. What
    a round supersedes is deleted; the result's table stays.
    """
    scratch = Scratch(edges.sparkSession)
    rest = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = scratch.save(nodes.withColumn("root", F.col("node")), "labels")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.first("a")).alias("low")), "low")
        names = low
        for step in ("once", "twice"):  # a name's own name is lower still, or the same
            up = low.select(F.col("name").alias("low"), F.col("low").alias("lower"))
            names = scratch.save(names.join(up, "low", "left").select("name", F.coalesce("lower", "low").alias("low")), f"names-{step}")
        labels = scratch.save(labels.join(names, labels["root"] == names["name"], "left").select("node", F.coalesce("low", "root").alias("root")), "labels")
        to = lambda c: names.select(F.col("name").alias(c), F.col("low").alias(f"{c}2"))
        moved = rest.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        rest = scratch.save(moved.distinct(), "edges")
    scratch.free("edges", "low", "names-once", "names-twice")
    return labels
