"""Queues, claims, ranking and traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.functions import urls as U
from quarrylight.operators import graph as G
from quarrylight.operators import search as S
from quarrylight.operators.ladder import ranked
from quarrylight.plans.base import Catalog, table

catalog = Catalog()


def order_nodes(spark, d):
    """Orders as graph nodes: the priority class is the base, the lines are the attempts."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    o = table(spark, d, "orders").join(lines, "o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "retry").otherwise("pending").alias("status"), (F.col("lines") % 5).cast("int").alias("attempt_count"),
        (100.0 - 10 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("base_priority"), (100.0 - 10 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority_score"), F.col("o_totalprice").alias("confidence"), (F.col("o_custkey") % 4).cast("int").alias("depth"),
    )


_NODES = """(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'retry' ELSE 'pending' END AS status, n % 5 AS attempt_count, 100.0::DOUBLE - 10 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS base_priority, o_totalprice AS confidence, o_custkey % 4 AS depth
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


@catalog("priority_claim", f"SELECT id, CAST(base_priority - 5.0 * attempt_count AS DOUBLE) AS effective FROM {_NODES} WHERE status IN ('pending', 'retry') AND attempt_count < 3 ORDER BY effective DESC, confidence DESC, depth, attempt_count, id LIMIT 25")
def priority_claim(spark, d):
    return G.claim_next(order_nodes(spark, d), limit=25).select("id", "effective")


@catalog("ready_queue", f"SELECT id, depth::INT AS depth FROM {_NODES} WHERE status IN ('pending', 'retry') ORDER BY base_priority DESC, confidence DESC, depth, attempt_count, id LIMIT 50")
def ready_queue(spark, d):
    return G.ready_queue(order_nodes(spark, d), 50).select("id", "depth")


@catalog("stale_recovery", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'pending' THEN 'retry' ELSE status END AS status FROM {_NODES}) GROUP BY 1")
def stale_recovery(spark, d):
    stale = order_nodes(spark, d).withColumns({"status": F.when(F.col("status") == "pending", "in_progress").otherwise(F.col("status")), "last_error": F.lit(None).cast("string")})
    return G.recovered(stale).groupBy("status").agg(F.count("*").alias("n"))


@catalog("mark_results", f"SELECT id, CASE WHEN depth = 0 THEN 'failed' ELSE status END AS status, CAST(attempt_count + CASE WHEN depth = 0 THEN 1 ELSE 0 END AS INT) AS attempt_count FROM {_NODES}")
def mark_results(spark, d):
    nodes = order_nodes(spark, d)
    return G.marked(nodes, nodes.where("depth = 0").select("id", F.lit("failed").alias("status"))).select("id", "status", "attempt_count")


@catalog("balanced_selection", """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k, bool_or(o_orderstatus IN ('F', 'O')) OVER (PARTITION BY o_custkey) AS has_main FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE (o_orderstatus IN ('F', 'O') AND k <= 2) OR (o_orderstatus = 'P' AND NOT has_main AND k <= 1)""")
def balanced(spark, d):
    """Up to two of each main class of a parent, one of the rest only if there is no main one."""
    from pyspark.sql import Window

    o = ranked(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    main = F.col("o_orderstatus").isin("F", "O")
    o = o.withColumn("has_main", F.max(main).over(Window.partitionBy("o_custkey")))
    return o.where((main & (F.col("rank") <= 2)) | (~main & ~F.col("has_main") & (F.col("rank") <= 1))).select("o_custkey", "o_orderkey")


_PEOPLE = """people AS (SELECT c_custkey AS key, c_name AS name, 'n' || c_nationkey AS org, 'r' || n_regionkey AS school, c_acctbal + 1000 AS text, (c_custkey % 7) / 6.0::DOUBLE AS completeness, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN 0.7 ELSE 0.2 END AS title, CAST(c_nationkey AS DOUBLE) AS context, CASE WHEN n_regionkey = 2 THEN 1.0 ELSE 0.0 END AS cons FROM customer JOIN nation ON n_nationkey = c_nationkey),
clip AS (SELECT *, CASE WHEN max(text) OVER () <= 0 THEN 0 ELSE greatest(0, least(text / max(text) OVER (), 1)) END AS t, CASE WHEN max(context) OVER () <= 0 THEN 0 ELSE greatest(0, least(context / max(context) OVER (), 1)) END AS c FROM people),
top AS (SELECT *, least(100.0, round(100 * (0.55::DOUBLE * t + 0.15::DOUBLE * completeness + 0.10::DOUBLE * title + 0.15::DOUBLE * c + 0.05::DOUBLE * cons), 2)) AS score FROM clip ORDER BY score DESC, school, org, name LIMIT 60)"""


def _people(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    title = F.when(F.col("c_mktsegment") == "BUILDING", 1.0).when(F.col("c_mktsegment") == "MACHINERY", 0.7).otherwise(0.2)
    rows = c.select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("org"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("school"), (F.col("c_acctbal") + 1000).alias("text"),
        ((F.col("c_custkey") % 7) / 6.0).alias("completeness"), title.alias("title"), F.col("c_nationkey").cast("double").alias("context"), F.when(F.col("n_regionkey") == 2, 1.0).otherwise(0.0).alias("constraint"))
    return S.rank_people(rows, 60)


@catalog("rank_professors", f"WITH {_PEOPLE} SELECT key, school, org, CAST(score AS DOUBLE) AS score FROM top")
def rank_professors(spark, d):
    return _people(spark, d).select("key", "school", "org", "score")


def _groups_sql(group: str, best: int, cap: float, limit: int) -> str:
    return f"""WITH {_PEOPLE}, b AS (SELECT {group} AS g, score, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, key) AS r FROM top)
SELECT g AS {group}, CAST(least(100.0, round(least(100.0, avg(score) + least({cap}, 2 * 3.0)), 2)) AS DOUBLE) AS score FROM b WHERE r <= {best} GROUP BY 1 ORDER BY score DESC, 1 LIMIT {limit}"""


@catalog("rank_org_units", _groups_sql("org", 3, 12.0, 10))
def rank_orgs(spark, d):
    people = _people(spark, d)
    return S.rank_groups(people.select("key", "score", "org"), "org", people.select("org").distinct().withColumn("own", F.lit(3.0)), 3, 12.0, 10)


@catalog("rank_schools", _groups_sql("school", 5, 10.0, 5))
def rank_schools(spark, d):
    people = _people(spark, d)
    return S.rank_groups(people.select("key", "score", "school"), "school", people.select("school").distinct().withColumn("own", F.lit(3.0)), 5, 10.0, 5)


@catalog("concept_boost_score", """WITH s AS (SELECT p_partkey AS concept, p_retailprice * 0.8::DOUBLE AS gain FROM part WHERE p_size = 7), l AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS concept FROM lineitem), u AS (SELECT * FROM l JOIN s USING (concept) ORDER BY concept, key LIMIT 300)
SELECT key, round(sum(gain), 4) AS gain FROM u GROUP BY 1""")
def concept_boost(spark, d):
    scores = table(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("c"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("key"), F.lit("concept").alias("kind"), F.col("p_retailprice").alias("score"))
    links = table(spark, d, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("key"), F.concat(F.lit("c"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("concept")).distinct()
    return S.boosted(scores, links).select(F.col("key").cast("long").alias("key"), F.round("score", 4).alias("gain"))


@catalog("frontier_bfs", """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS src, l_orderkey + l_linenumber * 32 AS dst FROM lineitem), r(url, depth) AS (SELECT min(src), 0 FROM l UNION SELECT dst, depth + 1 FROM r JOIN l ON src = url WHERE depth < 3)
SELECT url, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1""")
def frontier(spark, d):
    """A breadth-first frontier over a graph of order keys; each round is written and anti-joined."""
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + F.col("l_linenumber") * 32).alias("dst")).distinct()
    return G.crawl(links.agg(F.min("src").alias("url")), links, 3)


def order_links(spark, d):
    """Orders as pages that link to others by their lines; large orders have no page."""
    l = table(spark, d, "lineitem")  # noqa: E741
    links = l.groupBy(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + F.col("l_linenumber") * 32).alias("dst")).agg(F.max("l_quantity").alias("base_priority"))
    return links.where("src % 7 <> 0").withColumn("confidence", (F.col("dst") % 10).cast("double"))


@catalog("claim_loop", """WITH RECURSIVE t AS (SELECT o_orderkey AS id, (o_orderkey - 1) // 2 AS up FROM orders WHERE o_orderkey > 0), r AS (SELECT o_orderkey AS id, 0 AS depth FROM orders WHERE o_orderkey = 0 UNION ALL SELECT t.id, r.depth + 1 FROM t JOIN r ON t.up = r.id)
SELECT id, CASE WHEN id = 0 THEN 60.0 ELSE 40.0 + id % 50 END::DOUBLE AS base_priority, CASE WHEN id = 0 THEN 1.0 ELSE id % 10 END::DOUBLE AS confidence, depth, CASE WHEN id IN (SELECT up FROM t) THEN 'done' ELSE 'retry' END AS status, 1 AS attempt_count FROM r""")
def claim_loop(spark, d):
    """Every order is claimed, from the first one on over a tree of links, a quarter of all at once at most."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    seeds = o.where("id = 0").select("id", F.lit(60.0).alias("base_priority"), F.lit(1.0).alias("confidence"), F.lit(0).alias("depth"), F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"))
    links = o.where("id > 0").select(F.floor((F.col("id") - 1) / 2).alias("src"), F.col("id").alias("dst"), (40.0 + F.col("id") % 50).alias("base_priority"), (F.col("id") % 10).cast("double").alias("confidence"))
    return G.claim_loop(seeds, links, max(20, o.count() // 4), max_depth=64).drop("round")


@catalog("discovered_nodes", r"""SELECT DISTINCT 'faculty_list_url:url:' || regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h AS node_key, 83.0::DOUBLE AS priority_score, 1 AS depth FROM (SELECT url, unnest(regexp_extract_all(html, '<a [^>]*?href="(/[^"]*)"', 1)) AS h FROM pages)""")
def discovered_nodes(spark, d):
    """Nodes of the links that captured pages hold."""
    found = H.page_links(table(spark, d, "pages"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source_url"))
    links = found.join(pages, "id").select("source_url", "url", F.lit("faculty_list_url").alias("kind"), F.lit("discovered").alias("edge_type"), F.lit("").alias("org_unit_name"), F.lit(0).alias("score"), F.lit(1).alias("depth"), F.lit(1.0).alias("confidence"))
    return G.discovered(links)[0].select("node_key", "priority_score", "depth")


@catalog("knowledge_graph_edges", """SELECT relation, count(*) AS n FROM (
SELECT DISTINCT 'HAS_ORG_UNIT' AS relation, n_regionkey::VARCHAR AS a, n_nationkey::VARCHAR AS b FROM nation UNION SELECT 'AFFILIATED_WITH', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer
UNION SELECT 'HAS_TITLE', c_custkey::VARCHAR, c_mktsegment FROM customer UNION SELECT 'LOCATED_IN', r_regionkey::VARCHAR, r_name FROM region UNION SELECT 'RESEARCHES', c_custkey::VARCHAR, c_mktsegment FROM customer) GROUP BY 1""")
def kg_edges(spark, d):
    u = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("university_key"), F.col("r_name").alias("name"), F.col("r_name").alias("location"))
    o = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("org_key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("university_key"))
    p = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("person_key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("org_key"), F.col("c_mktsegment").alias("title"), F.array("c_mktsegment").alias("concepts"), F.array().cast("array<string>").alias("recruits"))
    return G.knowledge_graph(u, o, p)[1].groupBy("relation").agg(F.count("*").alias("n"))


@catalog("host_node_keys", r"""SELECT page_id, 'detail_url:url:' || lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') || regexp_extract(url, '(\?[^#]*)', 1) AS node_key FROM pages""")
def node_keys(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", G.node_key(F.lit("detail_url"), F.col("url"), F.lit(None).cast("string"), F.lit(None).cast("long")).alias("node_key"))


@catalog("priority_function", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 85.0 ELSE 75.0 END + CASE WHEN o_custkey % 2 = 0 THEN 30.0 ELSE 0.0 END + CASE WHEN o_orderstatus = 'F' THEN greatest(-20.0, least(20.0, CAST(o_custkey % 50 AS DOUBLE))) ELSE 0.0 END - 2.0 * (o_custkey % 4) AS p FROM orders""")
def priority_function(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "faculty_list_url").otherwise("detail_url")
    p = G.priority(kind, F.when(F.col("o_custkey") % 2 == 0, "manifest").otherwise("link"), F.col("o_custkey") % 50, (F.col("o_custkey") % 4).cast("int"))
    return o.select("o_orderkey", p.alias("p"))


@catalog("source_roots", "SELECT regexp_extract(url, '([a-z0-9-]+\\.[a-z0-9-]+)(?:[/?#:]|$)', 1) AS source_root, count(*) AS n FROM pages GROUP BY 1")
def source_roots(spark, d):
    return table(spark, d, "pages").groupBy(U.site_root(U.host_of(F.col("url"))).alias("source_root")).agg(F.count("*").alias("n"))
