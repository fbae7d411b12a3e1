"""Ladders, merges, cascades, uniqueness and export checks over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import ladder as M
from quarrylight.operators import merge as R
from quarrylight.operators.grams import contained
from quarrylight.plans.base import Catalog, table
from quarrylight.sources import sinks
from quarrylight.sources.tables import saved

catalog = Catalog()


@catalog("ladder_match", """WITH c AS (SELECT c_custkey, c_nationkey || '|' || right(c_name, 3) AS k1, CAST(floor(c_acctbal / 50) AS BIGINT) AS k2 FROM customer), s AS (SELECT s_suppkey, s_nationkey || '|' || right(s_name, 3) AS k1, CAST(floor(s_acctbal / 50) AS BIGINT) AS k2 FROM supplier),
m AS (SELECT c_custkey, 0 AS rung, min(s_suppkey) AS s_suppkey, 'same_nation_name' AS reason FROM c JOIN s USING (k1) GROUP BY 1 UNION ALL SELECT c_custkey, 1, min(s_suppkey), 'balance' FROM c JOIN s USING (k2) GROUP BY 1)
SELECT c_custkey, arg_min(s_suppkey, rung) AS s_suppkey, arg_min(reason, rung) AS reason FROM m GROUP BY 1""")
def ladder_match(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    name = lambda n, x: F.concat_ws("|", F.col(n).cast("string"), F.right(F.col(x), F.lit(3)))
    return M.ladder_match(c, s, "c_custkey", "s_suppkey", [
        ("same_nation_name", name("c_nationkey", "c_name"), name("s_nationkey", "s_name")), ("balance", F.floor(F.col("c_acctbal") / 50), F.floor(F.col("s_acctbal") / 50))])


@catalog("any_key_match", """SELECT c_custkey, min(key) AS key FROM (SELECT c_custkey, unnest(list_distinct(['n:' || c_nationkey, 'b:' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)])) AS key FROM customer) WHERE key IN (SELECT 'n:' || s_nationkey FROM supplier UNION SELECT 'b:' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) FROM supplier) GROUP BY 1""")
def any_key(spark, d):
    s = table(spark, d, "supplier")
    keys = lambda n, b: F.array(F.concat(F.lit("n:"), F.col(n).cast("string")), F.concat(F.lit("b:"), F.floor(F.col(b)).cast("string")))
    return M.any_key_match(table(spark, d, "customer"), s, "c_custkey", keys("c_nationkey", "c_acctbal"), keys("s_nationkey", "s_acctbal"), "s_suppkey").select("c_custkey", "key")


@catalog("unique_parent_containment", """SELECT p_partkey, min(r_name) AS parent FROM (SELECT DISTINCT p_partkey, w AS r_name FROM part JOIN (SELECT DISTINCT string_split(p_type, ' ')[1] AS w FROM part) t ON contains(p_type, w)) GROUP BY 1 HAVING count(*) = 1""")
def unique_parent(spark, d):
    part = table(spark, d, "part")
    parents = part.select(F.split("p_type", " ")[0].alias("parent")).distinct().withColumn("name", F.col("parent"))
    return M.unique_container(part.select("p_partkey", "p_type"), parents, "p_partkey", "p_type", "parent", "name")


@catalog("unique_parent_same_key", "SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1 HAVING count(*) = 1")
def unique_same_key(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return M.unique_match(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), s, "c_custkey", "s_suppkey", on="k")


@catalog("fuzzy_best_match", """WITH names AS (SELECT n_name AS candidate, lower(regexp_replace(n_name, '[ _]', '', 'g')) AS c FROM nation), forms AS (
  SELECT candidate AS own, ' ' || upper(candidate) AS said FROM names UNION ALL SELECT candidate, candidate || ' Republic' FROM names
  UNION ALL SELECT candidate, left(c, length(c) - 1) FROM names UNION ALL SELECT candidate, substr(c, 1, length(c) // 2) || '0' || substr(c, length(c) // 2 + 2) FROM names),
asked AS (SELECT DISTINCT own, said, lower(regexp_replace(said, '[ _]', '', 'g')) AS q FROM forms),
scored AS (SELECT said, candidate, CASE WHEN q = c THEN 1.0::DOUBLE WHEN contains(c, q) THEN least(0.99::DOUBLE, greatest(0.90::DOUBLE, 0.85::DOUBLE + length(q)::DOUBLE / length(c) * 0.15::DOUBLE))
  WHEN contains(q, c) THEN least(0.89::DOUBLE, greatest(0.75::DOUBLE, 0.68::DOUBLE + 0.21::DOUBLE / (length(q)::DOUBLE / length(c))))
  WHEN own = candidate THEN 2.0::DOUBLE * (length(c) - 1) / (2 * length(c)) END AS score FROM asked, names),
r AS (SELECT *, row_number() OVER (PARTITION BY said ORDER BY score DESC, length(candidate), candidate DESC) AS r FROM scored WHERE score >= 0.75)
SELECT said, candidate, score FROM r WHERE r = 1""")
def fuzzy_best(spark, d):
    """Names in other letters, longer, shorter, and with a letter changed, among all names."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("candidate"))
    low = M.match_text(F.col("candidate"))
    half = F.floor(F.length(low) / 2).cast("int")
    changed = F.concat(F.substring(low, F.lit(1), half), F.lit("0"), F.substring(low, half + 2, F.length(low)))
    forms = F.array(F.concat(F.lit(" "), F.upper("candidate")), F.concat("candidate", F.lit(" Republic")), F.substring(low, F.lit(1), F.length(low) - 1), changed)
    return M.best_fuzzy(names.select(F.explode(forms).alias("said")).distinct(), names, "said", "candidate")


@catalog("merge_policy", """WITH e AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal > 0), i AS (SELECT c_custkey, upper(c_name) AS c_name, 'NEW' AS c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT c_custkey, CASE WHEN e.c_custkey IS NULL THEN i.c_name WHEN i.c_custkey IS NULL THEN e.c_name ELSE i.c_name END AS c_name, CASE WHEN e.c_custkey IS NULL THEN i.c_mktsegment ELSE coalesce(nullif(e.c_mktsegment, ''), i.c_mktsegment) END AS c_mktsegment,
CASE WHEN e.c_custkey IS NULL THEN 'created' WHEN i.c_custkey IS NULL THEN 'unchanged' WHEN e.c_name = i.c_name AND e.c_mktsegment IS NOT NULL THEN 'unchanged' ELSE 'updated' END AS status FROM e FULL JOIN i USING (c_custkey)""")
def merge_policy(spark, d):
    c = table(spark, d, "customer")
    existing = c.where("c_acctbal > 0").withColumn("c_mktsegment", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment"))).select("c_custkey", "c_name", "c_mktsegment")
    incoming = c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_mktsegment").withColumns({"c_name": F.upper("c_name"), "c_mktsegment": F.lit("NEW")})
    policies = {"c_name": R.overwrite(F.col("e.c_name"), F.col("i.c_name")), "c_mktsegment": R.fill(F.col("e.c_mktsegment"), F.col("i.c_mktsegment"))}
    return R.merge_records(existing, incoming, ["c_custkey"], policies)


@catalog("last_write_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def last_write(spark, d):
    return R.last_write(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], F.col("event_id"))


@catalog("affiliation_upsert", "SELECT l_partkey, l_suppkey, arg_max(l_orderkey, [l_quantity, -l_orderkey, -l_linenumber]) AS source, count(*) AS n FROM lineitem GROUP BY 1, 2")
def affiliations(spark, d):
    order = F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber"))
    return R.upsert_affiliations(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey", order)


@catalog("edge_upsert", "SELECT l_suppkey AS from_key, l_partkey AS to_key, l_returnflag AS edge_type, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2, 3")
def edges(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_key"), F.col("l_partkey").alias("to_key"), F.col("l_returnflag").alias("edge_type"), F.col("l_discount").alias("confidence"))
    return R.upsert_edges(found)


_RANK = "list_position(['pending', 'retry', 'in_progress', 'skipped', 'failed', 'done'], {})"


@catalog("node_upsert_fold", f"""SELECT CAST(user_id AS VARCHAR) AS node_key, max(value) AS priority_score, max(value) AS base_priority, 1.0::DOUBLE AS confidence, CAST(min(event_id % 4) AS INT) AS depth,
list_reduce(list(['pending', 'retry', 'in_progress', 'skipped', 'failed', 'done'][event_id % 6 + 1] ORDER BY event_id), lambda c, i: CASE WHEN c = i OR c = 'done' THEN c WHEN c IN ('failed', 'skipped') AND i IN ('pending', 'retry') THEN 'retry' WHEN {_RANK.format("i")} >= {_RANK.format("c")} THEN i ELSE c END) AS status FROM events GROUP BY 1""")
def node_fold(spark, d):
    """Statuses fold in event order."""
    status = F.element_at(F.array(*map(F.lit, ["pending", "retry", "in_progress", "skipped", "failed", "done"])), (F.col("event_id") % 6 + 1).cast("int"))
    found = table(spark, d, "events").select(F.col("user_id").cast("string").alias("node_key"), status.alias("status"), F.col("event_id").alias("seq"), F.col("value").alias("priority_score"), F.col("value").alias("base_priority"), F.lit(1.0).alias("confidence"), (F.col("event_id") % 4).cast("int").alias("depth"))
    return R.upsert_nodes(found)


@catalog("node_upsert_extremes", "SELECT user_id, max(value) AS priority_score, min(event_id % 4) AS depth FROM events GROUP BY 1")
def node_extremes(spark, d):
    found = table(spark, d, "events").select(F.col("user_id").alias("node_key"), F.col("value").alias("priority_score"), F.col("value").alias("base_priority"), F.lit(1.0).alias("confidence"), (F.col("event_id") % 4).alias("depth"), F.lit("pending").alias("status"), F.col("event_id").alias("seq"))
    return R.upsert_nodes(found).select(F.col("node_key").alias("user_id"), "priority_score", "depth")


@catalog("key_rewrite_dedupe", """SELECT k, l_suppkey, arg_min(l_orderkey, [m, l_orderkey, l_linenumber]) AS kept FROM (SELECT CASE WHEN p_size = 1 THEN l_partkey + 1 ELSE l_partkey END AS k, CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS m, lineitem.* FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2""")
def key_rewrite(spark, d):
    """Every part of size 1 merges into the one after it; the pairs stay unique."""
    moved = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1).alias("new"))
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    joined = rows.withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    return R.rewrite_keys(joined, "l_partkey", moved, ["l_partkey", "l_suppkey"]).select(F.col("l_partkey").alias("k"), "l_suppkey", F.col("l_orderkey").alias("kept"))


@catalog("cascade_cleanup", """SELECT 'nation' AS entity, count(*) AS deleted FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))""")
def cascade(spark, d):
    """What goes with a region, level by level, by semi joins."""
    nations = table(spark, d, "nation").where("n_regionkey = 1")
    customers = table(spark, d, "customer").join(nations.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    orders = table(spark, d, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    count = lambda df, name: df.agg(F.lit(name).alias("entity"), F.count("*").alias("deleted"))
    return count(nations, "nation").union(count(customers, "customer")).union(count(orders, "orders"))


@catalog("orphan_detection", """SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 49""")
def orphan_detection(spark, d):
    rows = table(spark, d, "lineitem")
    left = rows.where("l_returnflag = 'N' and l_quantity > 49").select("l_suppkey")
    return rows.where("l_returnflag = 'R'").select("l_suppkey").distinct().join(left, "l_suppkey", "left_anti")


@catalog("fk_check", """SELECT 'orders' AS child, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def fk_check(spark, d):
    a = sinks.orphans(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")
    b = sinks.orphans(table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey")
    return a.agg(F.lit("orders").alias("child"), F.count("*").alias("orphans")).union(b.agg(F.lit("lineitem").alias("child"), F.count("*").alias("orphans")))


@catalog("repeated_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated(spark, d):
    return sinks.repeated_keys(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@catalog("public_projection", "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY 1")
def public_projection(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).orderBy("id")


@catalog("identity_components", """WITH RECURSIVE e AS (SELECT c_custkey AS id, unnest(['n:' || c_nationkey || ':' || CAST(floor(c_acctbal / 40) AS BIGINT), 's:' || c_mktsegment || ':' || CAST(floor(c_acctbal / 25) AS BIGINT)]) AS key FROM customer), n AS (SELECT DISTINCT x.id AS a, y.id AS b FROM e x JOIN e y USING (key)),
r(node, root) AS (SELECT DISTINCT a, a FROM n UNION SELECT n.b, r.root FROM r JOIN n ON n.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def identity_components(spark, d):
    """All customers, joined to a fixpoint where two share a nation or a segment and a like balance, through each key's least customer."""
    from quarrylight.operators.components import components

    key = lambda kind, by, width: F.concat_ws(":", F.lit(kind), F.col(by).cast("string"), F.floor(F.col("c_acctbal") / width).cast("string"))
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(key("n", "c_nationkey", 40), key("s", "c_mktsegment", 25))).alias("key"))
    hub = e.groupBy("key").agg(F.min("id").alias("a"))
    found = components(e.join(hub, "key").select("a", F.col("id").alias("b")))
    every = e.select(F.col("id").alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


@catalog("identity_components_documents")
def identity_components_documents(spark, d):
    """All documents, joined to a fixpoint by equal text or a shared benchmark passage; SQL would need all pairs of a hot key."""
    from quarrylight.operators.components import components

    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", "text")
    items = table(spark, d, "benchmark").select(F.md5("text").alias("item"), F.col("text").alias("span")).where("span <> ''").distinct()
    same = docs.where("btrim(text) <> ''").select("doc_id", F.concat(F.lit("t:"), F.md5("text")).alias("key"))
    shared = contained(docs, items, "doc_id", "text", "item", "span").select("doc_id", F.concat(F.lit("p:"), F.col("item")).alias("key"))
    keyed = saved(same.unionByName(shared).distinct())
    hub = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    found = components(keyed.join(hub, "key").select("a", F.col("doc_id").alias("b")))
    every = docs.select(F.col("doc_id").alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


@catalog("backup_comparison", """SELECT 'customer' AS "table", count(*) AS active, count(*) FILTER (c_acctbal > 0) AS backup, count(*) - count(*) FILTER (c_acctbal > 0) AS gained FROM customer
UNION ALL SELECT 'orders', count(*), 0, count(*) FROM orders""")
def backup(spark, d):
    """The live tables against the newer of two backups, which has customers only."""
    from quarrylight.operators.steward import compared_with_newest

    c = table(spark, d, "customer")
    kept = {"old": {"customer": c.where("c_acctbal > 5000")}, "new": {"customer": c.where("c_acctbal > 0")}}
    files = spark.createDataFrame([("new", 20), ("old", 10)], "path string, modified int")
    return compared_with_newest({"customer": c, "orders": table(spark, d, "orders")}, files, kept.__getitem__)


@catalog("incremental_skip", "SELECT p_partkey FROM part WHERE p_size > 25")
def incremental_skip(spark, d):
    """Parts whose content hash the ledger doesn't hold."""
    from quarrylight.sources.tables import changed_sources

    files = table(spark, d, "part").select("p_size", F.col("p_partkey").cast("string").alias("path"), F.to_json(F.struct("p_name", "p_brand", "p_size")).alias("content"))
    ledger = files.where("p_size <= 25").select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    return changed_sources(files, ledger).select(F.col("path").cast("long").alias("p_partkey"))
