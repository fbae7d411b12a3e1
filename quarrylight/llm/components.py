"""Connected components by distributed union-find: hook to the least neighbour, jump, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.store import drop, save


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label each node of ``edges`` with the least node of its component: (node, root).

    Every round, each root hooks to its least neighbouring root, pointer jumping turns the hooks
    into stars, and the edges are contracted; local minima are at most half of the roots left, so
    the rounds grow with the logarithm of the nodes. Only distinct edges between different roots
    are kept. Nodes without an edge to another node don't appear. Null ends and loops are ignored.
    Each round's tables are written to the shared folder, and superseded ones are deleted.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    live, live_at = save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, labels_at = None, None
    while not live.isEmpty():
        # the least neighbour, summed up on the map side
        hooks = live.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("parent"))
        hooks, hooks_at = _stars(hooks)
        nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if labels is None:
            grown = nodes.join(hooks.withColumnRenamed("root", "node"), "node", "left").select("node", F.coalesce("parent", "node").alias("root"))
        else:
            grown = labels.join(hooks, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        new_labels, new_labels_at = save(grown, "labels")
        left = live.join(hooks.select(F.col("root").alias("a"), F.col("parent").alias("pa")), "a", "left")
        both = left.join(hooks.select(F.col("root").alias("b"), F.col("parent").alias("pb")), "b", "left")
        moved = both.select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        new_live, new_live_at = save(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for path in (live_at, labels_at, hooks_at):
            if path:
                drop(spark, path)
        live, live_at, labels, labels_at = new_live, new_live_at, new_labels, new_labels_at
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _stars(hooks: DataFrame) -> tuple[DataFrame, str]:
    """Jump until every parent is a root: (root, parent) for the roots that hooked."""
    spark = hooks.sparkSession
    hooks, path = save(hooks, "hooks")
    while True:
        up = hooks.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
        jumped = hooks.join(up, "parent", "left").select("root", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        jumped, jumped_at = save(jumped, "hooks")
        drop(spark, path)
        hooks, path = jumped.select("root", "parent"), jumped_at
        if jumped.where("moved").isEmpty():
            return hooks, path
