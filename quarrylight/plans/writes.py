"""The directory's writes over stand-ins: customers are people, nations units, suppliers academicians, orders tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import parsing as J
from quarrylight.operators import steward
from quarrylight.operators import writes as W
from quarrylight.plans.base import Catalog, table

catalog = Catalog()


@catalog("unit_get_or_create", """WITH u AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'http://n' || n_nationkey || '.cn' END AS url, 'old' AS kind, 'known' AS status, n_nationkey AS k FROM nation)
SELECT name, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'https://n' || k || '.cn' ELSE url END AS url, CASE WHEN k % 2 = 0 OR k % 5 = 1 AND k % 3 <> 0 THEN 'new' ELSE kind END AS kind, CASE WHEN k % 2 = 0 OR k % 5 = 1 AND k % 3 <> 0 THEN 'seen' ELSE status END AS status, CASE WHEN k % 2 = 0 OR k % 5 = 1 AND k % 3 <> 0 THEN 'matched' ELSE 'untouched' END AS outcome FROM u
UNION ALL SELECT 'NEW ' || name, url, 'new', 'seen', 'created' FROM (SELECT name, CASE WHEN k % 3 = 0 THEN 'http://other' || k || '.cn' ELSE url END AS url, k FROM u) WHERE k % 5 = 1 AND k % 2 = 1 AND k % 3 = 0""")
def unit_get_or_create(spark, d):
    """Even nations come by name, some odd ones under a new name by their URL, some are new."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    known = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("http://n"), k.cast("string"), F.lit(".cn")))
    units = n.select(F.col("n_name").alias("name"), known.alias("url"), F.lit("old").alias("kind"), F.lit("known").alias("status"))
    even = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("https://n"), k.cast("string"), F.lit(".cn")).alias("url"))
    odd = n.where("n_nationkey % 5 = 1 and n_nationkey % 2 = 1").select(F.concat(F.lit("NEW "), "n_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("http://other"), k.cast("string"), F.lit(".cn"))).otherwise(known).alias("url"))
    incoming = even.unionByName(odd).withColumns({"kind": F.lit("new"), "status": F.lit("seen")})
    return W.get_or_create_units(units, incoming, F.when(F.col("url") == "", 0).otherwise(1))


_PAIRS = "(SELECT n_nationkey AS child_id, n_nationkey - 20 AS parent_id FROM nation WHERE n_nationkey >= 20)"


def affiliations(spark, d):
    """People in the unit of their nation and, some, in another."""
    c = table(spark, d, "customer")
    own = c.select(F.col("c_custkey").alias("professor_id"), F.col("c_nationkey").alias("org_unit_id"))
    return own.unionByName(c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("professor_id"), ((F.col("c_nationkey") + 5) % 25).cast(own.schema["org_unit_id"].dataType).alias("org_unit_id"))).distinct()


_AFFILIATIONS = "(SELECT c_custkey AS professor_id, c_nationkey AS org_unit_id FROM customer UNION SELECT c_custkey, (c_nationkey + 5) % 25 FROM customer WHERE c_custkey % 4 = 0)"


def section_parents(spark, d):
    return table(spark, d, "nation").where("n_nationkey >= 20").select(F.col("n_nationkey").alias("child_id"), (F.col("n_nationkey") - 20).alias("parent_id"))


@catalog("section_merge", f"SELECT DISTINCT professor_id, CAST(coalesce(parent_id, org_unit_id) AS BIGINT) AS org_unit_id FROM {_AFFILIATIONS} LEFT JOIN {_PAIRS} ON child_id = org_unit_id")
def section_merge(spark, d):
    a = affiliations(spark, d)
    out, _, _ = W.merge_sections({"affiliations": (a, ["professor_id"])}, table(spark, d, "nation").withColumnRenamed("n_nationkey", "id"), section_parents(spark, d))
    return out["affiliations"].select("professor_id", F.col("org_unit_id").cast("long").alias("org_unit_id"))


@catalog("section_merge_counters", f"""WITH a AS (SELECT professor_id, coalesce(parent_id, org_unit_id) AS u, parent_id IS NOT NULL AS moved FROM {_AFFILIATIONS} LEFT JOIN {_PAIRS} ON child_id = org_unit_id), g AS (SELECT professor_id, u, bool_and(moved) AS moved FROM a GROUP BY 1, 2),
t AS (SELECT o_orderkey, coalesce(parent_id, o_custkey % 25) AS u, parent_id IS NOT NULL AS moved FROM orders LEFT JOIN {_PAIRS} ON child_id = o_custkey % 25)
SELECT 'affiliations' AS table_name, count_if(moved)::BIGINT AS moved, (SELECT count(*) FROM a) - count(*) AS dropped FROM g UNION ALL SELECT 'tasks', count_if(moved)::BIGINT, 0 FROM t""")
def section_merge_counters(spark, d):
    tasks = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("org_unit_id"))
    units = table(spark, d, "nation").withColumnRenamed("n_nationkey", "id")
    return W.merge_sections({"affiliations": (affiliations(spark, d), ["professor_id"]), "tasks": (tasks, ["o_orderkey"])}, units, section_parents(spark, d))[2]


@catalog("scope_cleanup", f"SELECT count(*) AS units, sum(n)::BIGINT AS affiliations FROM (SELECT u, count(DISTINCT professor_id) AS n FROM (SELECT professor_id, coalesce(parent_id, org_unit_id) AS u FROM {_AFFILIATIONS} LEFT JOIN {_PAIRS} ON child_id = org_unit_id WHERE org_unit_id NOT IN (1, 2, 3)) GROUP BY 1)")
def scope_cleanup(spark, d):
    """Excluded units go with their rows, then sections merge: what is left."""
    gone = table(spark, d, "nation").where("n_nationkey in (1, 2, 3)").select(F.col("n_nationkey").alias("org_unit_id"))
    left = affiliations(spark, d).join(gone, "org_unit_id", "left_anti")
    out, units, _ = W.merge_sections({"affiliations": (left, ["professor_id"])}, table(spark, d, "nation").withColumnRenamed("n_nationkey", "id"), section_parents(spark, d))
    return out["affiliations"].groupBy("org_unit_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("units"), F.sum("n").alias("affiliations"))


@catalog("refreshed_unit_names", f"SELECT professor_id, string_agg(n_name, ' / ' ORDER BY org_unit_id) AS org_unit_name FROM {_AFFILIATIONS} JOIN nation ON n_nationkey = org_unit_id GROUP BY 1")
def refreshed_unit_names(spark, d):
    return W.unit_names(affiliations(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


def recrawl_tasks(spark, d):
    url = F.concat(F.lit("http://t/"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select(F.sha2(url, 256).alias("page_hash"), url.alias("source_url"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"), F.lit(2).alias("attempt"), F.lit(0).alias("priority"), F.lit("timeout").alias("last_error"))


@catalog("recrawl_upsert", """WITH w AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT sha256('http://t/' || o_orderkey) AS page_hash, 'http://t/' || o_orderkey AS source_url, CASE WHEN k IS NOT NULL THEN 'retry' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status, CASE WHEN k IS NULL THEN 2 ELSE 0 END AS attempt, CASE WHEN k IS NULL THEN 0 ELSE 7 END AS priority, CASE WHEN k IS NULL THEN 'timeout' ELSE 'completion_recrawl_gap' END AS last_error FROM orders LEFT JOIN w ON k = o_orderkey
UNION ALL SELECT sha256('http://new'), 'http://new', 'retry', 0, 7, 'completion_recrawl_gap'""")
def recrawl_upsert(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("http://t/"), F.col("l_orderkey").cast("string")).alias("source_url"))
    other = table(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, " http://new ").otherwise(" ").alias("source_url"))
    return W.upsert_recrawls(recrawl_tasks(spark, d), lines.unionByName(other).withColumns({"reason": F.lit("gap"), "priority": F.lit(7)}))


@catalog("recrawl_resolved", """SELECT 'http://t/' || o_orderkey AS source_url, CASE WHEN hit AND o_orderstatus <> 'F' THEN 'done' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status, CASE WHEN hit AND o_orderstatus <> 'F' THEN 'completion_recrawl_repaired' WHEN o_orderkey % 2 = 0 THEN 'completion_recrawl_gap' END AS last_error
FROM (SELECT *, o_orderkey % 2 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) AS hit FROM orders)""")
def recrawl_resolved(spark, d):
    tasks = recrawl_tasks(spark, d).withColumn("last_error", F.when(F.regexp_extract("source_url", "([0-9]+)$", 1).cast("long") % 2 == 0, "completion_recrawl_gap"))
    urls = table(spark, d, "lineitem").where("l_quantity > 25").select(F.concat(F.lit("http://t/"), F.col("l_orderkey").cast("string")).alias("url"))
    return W.resolved_recrawls(tasks, urls).select("source_url", "status", "last_error")


def _people(spark, d, name, key, prefix):
    phone = F.when(F.col(f"{prefix}_{key}") % 2 == 0, F.concat(F.lit(prefix), F.col(f"{prefix}_{key}").cast("string")))
    return table(spark, d, name).select(
        F.col(f"{prefix}_{key}").cast("long").alias("id"), F.right(F.col(f"{prefix}_name"), F.lit(2)).alias("name"), F.col(f"{prefix}_nationkey").cast("long").alias("org_unit_id"), F.lit(None).cast("string").alias("title"), phone.alias("phone"),
    )


_MOVE = """p AS (SELECT c_custkey AS id, right(c_name, 2) AS name, c_nationkey AS org_unit_id, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey END AS phone FROM customer WHERE c_acctbal > 5000),
a AS (SELECT s_suppkey AS id, right(s_name, 2) AS name, s_nationkey AS org_unit_id, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey END AS phone FROM supplier)"""


@catalog("academician_promotion", f"""WITH {_MOVE}, first AS (SELECT name, org_unit_id, min(id) AS id FROM p GROUP BY 1, 2), m AS (SELECT p.* FROM p JOIN first USING (name, org_unit_id, id))
SELECT coalesce(a.id, m.id)::BIGINT AS id, name, org_unit_id::BIGINT AS org_unit_id, CASE WHEN m.id IS NOT NULL THEN '院士' END AS title, coalesce(a.phone, m.phone) AS phone FROM a FULL JOIN m USING (name, org_unit_id)""")
def academician_promotion(spark, d):
    """Rich customers are promoted; an academician of that name and unit gains what they lack."""
    people, known = _people(spark, d, "customer", "custkey", "c"), _people(spark, d, "supplier", "suppkey", "s")
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("long").alias("id"))
    return W.moved_rows(people, known, rich, {"title": F.lit("院士")})[1]


@catalog("academician_demotion", """WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)
SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0) AS academicians, count(*) AS people, coalesce(count_if(title = '教授'), 0)::BIGINT AS demoted FROM (
SELECT coalesce(c.id, m.id) AS id, CASE WHEN m.id IS NOT NULL THEN '教授' END AS title FROM (SELECT c_custkey AS id, right(c_name, 2) AS name, c_nationkey AS u FROM customer) c FULL JOIN (SELECT min(s_suppkey) AS id, right(s_name, 2) AS name, s_nationkey AS u FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 2, 3) m USING (name, u))""")
def academician_demotion(spark, d):
    """Suppliers in debt go back among people with the title their texts give."""
    people, known = _people(spark, d, "customer", "custkey", "c"), _people(spark, d, "supplier", "suppkey", "s")
    poor = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("long").alias("id"))
    left, more = W.moved_rows(known, people, poor, {"title": F.lit("教授")})
    return left.agg(F.count("*").alias("academicians")).crossJoin(more.agg(F.count("*").alias("people"), F.count_if(F.col("title") == "教授").alias("demoted")))  # one row each


@catalog("save_pipeline", """WITH r AS (SELECT lpad((o_custkey % 500)::VARCHAR, 4, '0') AS name, o_custkey % 25 AS u, CASE o_orderpriority[1] WHEN '1' THEN 'Professor, retired' WHEN '2' THEN 'Academician' WHEN '3' THEN '' ELSE 'Associate Professor' END AS said, o_orderstatus || '@x.cn' AS email FROM orders),
n AS (SELECT 'N' || name AS name, u, max(CASE WHEN said = 'Associate Professor' THEN '副教授' END) AS title, max(email) AS email FROM r WHERE said IN ('', 'Associate Professor') GROUP BY 1, 2),
k AS (SELECT 'N' || right(c_name, 4) AS name, c_nationkey AS u, '讲师' AS title, min(c_mktsegment) AS email FROM customer GROUP BY 1, 2)
SELECT name, u::BIGINT AS org_unit_id, coalesce(n.title, k.title) AS title, coalesce(n.email, k.email) AS email FROM k FULL JOIN n USING (name, u)""")
def save_pipeline(spark, d):
    return _saved(spark, d)[0].select("name", "org_unit_id", "title", "email")


@catalog("save_pipeline_counters", "SELECT CASE o_orderpriority[1] WHEN '1' THEN 'skipped_retired' WHEN '2' THEN 'academician' ELSE 'person' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def save_pipeline_counters(spark, d):
    return _saved(spark, d)[2]


def _saved(spark, d):
    digit = F.substring("o_orderpriority", 1, 1)
    none = F.lit(None).cast("string")
    title = F.when(digit == "1", "Professor, retired").when(digit == "2", "Academician").when(digit == "3", "").otherwise("Associate Professor")
    records = table(spark, d, "orders").select(F.concat(F.lit("N"), F.lpad((F.col("o_custkey") % 500).cast("string"), 4, "0")).alias("name"), (F.col("o_custkey") % 25).cast("long").alias("org_unit_id"), title.alias("title"), F.concat("o_orderstatus", F.lit("@x.cn")).alias("email"), none.alias("bio"), none.alias("homepage"))
    people = table(spark, d, "customer").groupBy(F.concat(F.lit("N"), F.right("c_name", F.lit(4))).alias("name"), F.col("c_nationkey").cast("long").alias("org_unit_id")).agg(F.min("c_mktsegment").alias("email")).select("name", "org_unit_id", F.lit("讲师").alias("title"), "email", none.alias("bio"), none.alias("homepage"))
    return W.saved_records(people, records, people.where(F.lit(False)))


@catalog("page_cache_upsert", "SELECT 'u' || user_id AS url, arg_max(event_type, event_id) AS text, max(event_id) AS fetched_at FROM events GROUP BY 1")
def page_cache_upsert(spark, d):
    pages = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("text"), F.col("event_id").alias("fetched_at"))
    return W.cached(pages.where("fetched_at % 2 = 0"), pages.where("fetched_at % 2 = 1"))


@catalog("failure_append", "SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'retry' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END AS status, count(*) AS n FROM orders GROUP BY 1")
def failure_append(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"))
    new = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.lit("no_data").alias("failure_type"), F.when(F.col("l_returnflag") == "R", "retry").alias("resolver"))
    return W.with_failures(new.where(F.lit(False)), tasks, new)[1].groupBy("status").agg(F.count("*").alias("n"))


_AUDITS = "(SELECT p_brand AS issue_type, CASE WHEN p_size < 10 THEN 'report_only' WHEN p_size > 48 THEN 'failed' ELSE 'applied' END AS action FROM part)"


@catalog("run_ledger", f"""SELECT 'r1' AS run_id, sum(n)::BIGINT AS findings, sum(changed)::BIGINT AS changes, '{{' || coalesce(string_agg('"' || issue_type || '":' || failed, ',' ORDER BY issue_type) FILTER (failed > 0), '') || '}}' AS errors FROM (SELECT issue_type, count(*) AS n, count_if(action <> 'report_only') AS changed, count_if(action = 'failed') AS failed FROM {_AUDITS} GROUP BY 1)""")
def run_ledger(spark, d):
    action = F.when(F.col("p_size") < 10, "report_only").when(F.col("p_size") > 48, "failed").otherwise("applied")
    return W.ledger(table(spark, d, "part").select(F.col("p_brand").alias("issue_type"), action.alias("action")), "r1")


@catalog("batch_summary", "SELECT counter, sum(n)::BIGINT AS n FROM (SELECT 'open' AS counter, count_if(o_orderstatus = 'O') AS n FROM orders UNION ALL SELECT 'all', count(*) FROM orders) GROUP BY 1")
def batch_summary(spark, d):
    per = table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("source")).agg(F.create_map(F.lit("open"), F.count_if(F.col("o_orderstatus") == "O"), F.lit("all"), F.count("*")).alias("counters"))
    return W.batch_summary(per)


@catalog("seed_manifest", """SELECT 'root:' || r_name AS src, 'org_unit:' || n_name AS dst, 'has_unit' AS type FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT DISTINCT 'org_unit:' || n_name, 'faculty_list_url:http://f/' || s_suppkey % 7, 'has_faculty_list' FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'org_listing_url:http://l/' || r_regionkey, 'org_unit:' || n_name, 'lists_unit' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey > 0""")
def seed_manifest(spark, d):
    pages = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_set(F.concat(F.lit("http://f/"), (F.col("s_suppkey") % 7).cast("string"))).alias("faculty_urls"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(pages, "n_nationkey", "left")
    listing = F.when(F.col("r_regionkey") > 0, F.concat(F.lit("http://l/"), F.col("r_regionkey").cast("string"))).otherwise("")
    return W.seeded(n.select(F.col("r_name").alias("root"), F.col("n_name").alias("unit"), F.lit("").alias("unit_url"), "faculty_urls", listing.alias("listing_url")))[1]


@catalog("section_audit", "SELECT 'org_unit' AS entity_type, n_nationkey::BIGINT AS entity_id, 'sub_department' AS issue_type, 'parent ' || (n_nationkey - 20) AS reason, 'merged' AS action FROM nation WHERE n_nationkey >= 20")
def section_audit(spark, d):
    pairs = section_parents(spark, d).withColumnRenamed("child_id", "id")
    found = steward.audit(pairs, "org_unit", "sub_department", F.concat(F.lit("parent "), F.col("parent_id").cast("string")), F.lit(1.0), True, action="merged")
    return found.select("entity_type", "entity_id", "issue_type", "reason", "action")


# -- reads that the writes build on ----------------------------------------------------------------


@catalog("exclusion_list", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def exclusion_list(spark, d):
    tried = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(tried, "o_orderkey", "left_anti")


@catalog("enriched_names", "SELECT DISTINCT trim(right(c_name, 5)) AS name FROM customer WHERE c_nationkey = 7 AND (c_acctbal > 5000 OR c_mktsegment = 'BUILDING')")
def enriched_names(spark, d):
    c = table(spark, d, "customer").where("c_nationkey = 7")
    rich = c.select(F.btrim(F.right("c_name", F.lit(5))).alias("name"), F.when(F.col("c_acctbal") > 5000, "x").alias("research_areas"), F.when(F.col("c_mktsegment") == "BUILDING", "y").alias("bio"))
    return rich.where("research_areas is not null or bio is not null").select("name").distinct()


@catalog("list_org_units", "SELECT n_nationkey AS id, n_name AS name FROM nation ORDER BY 1 LIMIT 10")
def list_org_units(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).orderBy("id").limit(10)


@catalog("list_professors", "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY 1")
def list_professors(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).orderBy("id")


@catalog("professor_affiliation_join", f"SELECT org_unit_id::BIGINT AS org_unit_id, count(*) AS people, count(DISTINCT c_mktsegment) AS segments FROM {_AFFILIATIONS} JOIN customer ON c_custkey = professor_id GROUP BY 1")
def professor_affiliation_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("professor_id"), "c_mktsegment")
    return affiliations(spark, d).join(c, "professor_id").groupBy(F.col("org_unit_id").cast("long").alias("org_unit_id")).agg(F.count("*").alias("people"), F.countDistinct("c_mktsegment").alias("segments"))


@catalog("academician_unit_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def academician_unit_join(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@catalog("multi_lookup", "SELECT p_partkey, p_size::BIGINT AS size FROM part WHERE 'part:' || p_partkey IN (SELECT DISTINCT 'part:' || l_partkey FROM lineitem WHERE l_quantity = 50)")
def multi_lookup(spark, d):
    """Nodes by a list of keys, and a field of their JSON."""
    wanted = table(spark, d, "lineitem").where("l_quantity = 50").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("source_key")).distinct()
    nodes = table(spark, d, "part").select("p_partkey", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("source_key"), F.to_json(F.struct("p_size")).alias("payload"))
    return nodes.join(wanted, "source_key").select("p_partkey", F.from_json("payload", "p_size bigint").getField("p_size").alias("size"))


@catalog("units_without_manual", "SELECT n_name FROM nation WHERE lower(n_name) NOT IN (SELECT lower(trim(r_name)) FROM region) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def units_without_manual(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 8000").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("key"))
    manual = rich.unionByName(table(spark, d, "region").select(F.lower(F.btrim("r_name")).alias("key"))).distinct()
    return table(spark, d, "nation").withColumn("key", F.lower(F.btrim("n_name"))).join(manual, "key", "left_anti").select("n_name")


@catalog("ordered_dedupe", "SELECT p_partkey, list_aggregate(list_transform(list_sort(list_distinct(list_transform(w, lambda x: list_position(w, x)))), lambda i: w[i]), 'string_agg', ' ') AS words FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part)")
def ordered_dedupe(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")), " ").alias("words"))


@catalog("target_signatures", "SELECT n_regionkey::BIGINT AS target, string_agg(lower(n_name), ',' ORDER BY lower(n_name)) AS urls, count(*) AS n FROM nation GROUP BY 1")
def target_signatures(spark, d):
    """Listing URLs gathered per target; the same URL in other letters is one signature."""
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("target"), F.explode(F.array(F.lower("n_name"), F.lower(F.initcap("n_name")))).alias("url"))
    return rows.groupBy("target").agg(F.sort_array(F.collect_set("url")).alias("u")).select("target", F.array_join("u", ",").alias("urls"), F.size("u").cast("long").alias("n"))


@catalog("context_keys", "SELECT DISTINCT k FROM (SELECT 'university:' || r_name AS k FROM region UNION ALL SELECT 'org_unit:' || n_name FROM nation)")
def context_keys(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.explode(F.array(F.concat(F.lit("university:"), "r_name"), F.concat(F.lit("org_unit:"), "n_name"))).alias("k")).distinct()


@catalog("source_prefixes", "SELECT doc_id, left(sha1(lower('/DB/' || source || '/' || lang)), 16) AS prefix FROM documents")
def source_prefixes(spark, d):
    return table(spark, d, "documents").select("doc_id", J.source_prefix(F.concat(F.lit("/DB/"), "source", F.lit("/"), "lang")).alias("prefix"))


@catalog("section_prefixes", r"""WITH p AS (SELECT page_id, lower(trim(regexp_extract(coalesce(url, ''), '^[^:]*://[^/?#]*([^?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '.htm' WHEN 1 THEN '/x.PHP' ELSE '' END)) AS p FROM pages)
SELECT page_id, CASE WHEN regexp_matches(p, '^.*/[^/]+\.(htm|html|shtml)$') THEN regexp_extract(p, '^(.*/[^/]+)\.(htm|html|shtml)$', 1) WHEN regexp_matches(p, '^[^/]+\.(htm|html|shtml)$') THEN '/' || regexp_extract(p, '^([^/]+)\.(htm|html|shtml)$', 1) WHEN regexp_matches(p, '^.+/[^/]*$') THEN regexp_extract(p, '^(.+)/[^/]*$', 1) ELSE p END AS prefix FROM p""")
def section_prefixes(spark, d):
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/?#]*([^?#]*)", 1)
    ending = F.when(F.col("page_id") % 3 == 0, ".htm").when(F.col("page_id") % 3 == 1, "/x.PHP").otherwise("")
    return table(spark, d, "pages").select("page_id", J.section_prefix(F.concat(path, ending)).alias("prefix"))


@catalog("json_link_lists", """SELECT doc_id, 'http://s/' || source || ' http://l/' || lang AS urls FROM documents""")
def json_link_lists(spark, d):
    """Answers of three shapes: a list, an object with objects, and a fenced object within other text."""
    a, b = F.concat(F.lit("http://s/"), "source"), F.concat(F.lit("http://l/"), "lang")
    plain = F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]'))
    objects = F.concat(F.lit('{"n": 1, "faculty_links": [{"url": "'), a, F.lit('"}, {"url": " '), b, F.lit(' "}, ""]}'))
    fenced = F.concat(F.lit('Here:\n```json\n{"urls": '), plain, F.lit("}\n```\nDone."))
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").select("doc_id", F.array_join(J.json_links(F.when(k == 0, plain).when(k == 1, objects).otherwise(fenced)), " ").alias("urls"))


@catalog("metadata_merge", "SELECT c_custkey, c_mktsegment AS a, string_agg(x, ',' ORDER BY x) AS b FROM (SELECT DISTINCT c_custkey, c_mktsegment, unnest(['s' || c_custkey % 7, 'p' || c_nationkey, 'q', 'q']) AS x FROM customer) GROUP BY 1, 2")
def metadata_merge(spark, d):
    none = F.lit(None).cast("array<string>")
    old = F.create_map(F.lit("a"), F.array(F.lit("old")), F.lit("b"), F.array(F.concat(F.lit("s"), (F.col("c_custkey") % 7).cast("string")), F.lit("q")))
    new = F.create_map(F.lit("a"), F.array("c_mktsegment"), F.lit("b"), F.array(F.lit("q"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))), F.lit("c"), none)
    m = table(spark, d, "customer").select("c_custkey", J.merged_metadata(old, new).alias("m"))
    return m.select("c_custkey", F.array_join(F.col("m")["a"], ",").alias("a"), F.array_join(F.sort_array(F.col("m")["b"]), ",").alias("b"))


@catalog("anchor_names", "SELECT c_custkey, lower(right(c_name, 6)) AS name FROM customer")
def anchor_names(spark, d):
    said = F.concat(F.lit(" Associate Professor "), F.right("c_name", F.lit(6)), F.lit(" 副教授"))
    return table(spark, d, "customer").select("c_custkey", J.anchor_name(said).alias("name"))


@catalog("pagination_links", r"SELECT c_custkey, 'http://h' || c_nationkey || '.cn/list?page=2 http://h' || c_nationkey || '.cn/index_3.htm' AS links FROM customer")
def pagination_links(spark, d):
    host = F.concat(F.lit("http://h"), F.col("c_nationkey").cast("string"), F.lit(".cn"))
    links = F.array(*[F.concat(host, F.lit(x)) for x in ("/list?page=2", "/about", "/list?page=1", "/list?page=2", "/seen?page=9", "/index_3.htm")], F.lit("http://other.cn/list?page=4"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(J.pagination_links(links, F.concat(host, F.lit("/list?page=1")), F.array(F.concat(host, F.lit("/seen?page=9")))), " ").alias("links"))


@catalog("name_homepages", "SELECT c_custkey, right(c_name, 4) AS name, 'http://h/' || c_custkey || '/home' AS url FROM customer")
def name_homepages(spark, d):
    """Of a page's markdown links of one name, the longest URL."""
    name, base = F.right("c_name", F.lit(4)), F.concat(F.lit("http://h/"), F.col("c_custkey").cast("string"))
    text = F.concat(F.lit("See ["), name, F.lit("]("), base, F.lit(") and [ "), name, F.lit(" ]("), base, F.lit("/home) or []("), base, F.lit("/other/page)."))
    links = table(spark, d, "customer").select("c_custkey", F.explode(J.name_links(text)).alias("l"))
    return links.groupBy("c_custkey", "l.name").agg(F.max_by("l.url", F.struct(F.length("l.url"), "l.url")).alias("url"))


@catalog("rich_profiles", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 160 AND doc_id % 2 = 0 AND doc_id % 5 <> 0")
def rich_profiles(spark, d):
    docs = table(spark, d, "documents")
    text = F.lit("教授。研究方向：")
    said = F.concat_ws(" ", F.when(F.col("doc_id") % 2 == 0, text), F.col("text"))
    clean = F.regexp_replace(F.lower(said), "professor|lecturer|education", "")
    rich = J.is_rich_profile(F.when(F.length(F.btrim("text")) >= 160, clean).otherwise(""), F.lit("http://x/t"), F.lit(True), F.col("doc_id") % 5 != 0)
    return docs.where(rich & (F.col("doc_id") % 2 == 0)).select("doc_id")


@catalog("prompt_payload", """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 100) || ' ... ' || right(text, 100) ELSE coalesce(text, '') END AS body FROM documents""")
def prompt_payload(spark, d):
    payload = J.compact_payload({"text": F.col("text"), "lang": F.col("lang")}, 200)
    return table(spark, d, "documents").select("doc_id", F.from_json(payload, "text string, lang string").getField("text").alias("body"))
