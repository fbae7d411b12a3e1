"""Repairs, list pages, unit discovery and skills over stand-in tasks, pages and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.functions import people as P
from quarrylight.functions import urls as U
from quarrylight.operators import routes as R
from quarrylight.plans.base import Catalog, table
from quarrylight.sources.tables import newest_first, saved, spread

catalog = Catalog()


@catalog("repair_replay", """WITH t AS (SELECT o_orderkey AS id, 'https://h' || o_custkey % 7 || '.edu.cn/info/1/' || o_orderkey // 2 AS url, o_orderstatus = 'F' AS done, o_orderpriority LIKE '1-%' AS link FROM orders),
n AS (SELECT 'faculty_list_url:url:' || url AS k, url FROM t WHERE id % 3 = 0 UNION SELECT 'pagination_url:url:' || url, url FROM t WHERE id % 4 = 0 UNION SELECT 'detail_url:url:' || url, CASE WHEN id % 2 = 1 THEN url || '0/old' ELSE url END FROM t WHERE id % 5 = 0),
w AS (SELECT url, arg_max(done, id) AS done, 'detail_url:url:' || url AS target FROM t GROUP BY 1),
o AS (SELECT k, w.* FROM n JOIN w USING (url)),
f AS (SELECT url, any_value(done) AS done, any_value(target) AS target, coalesce(min(k) FILTER (k = target), min(k)) AS first FROM o GROUP BY 1),
l AS (SELECT f.*, first <> target AND target IN (SELECT k FROM n) AS conflict FROM f),
fates AS (
  SELECT k AS key, 'duplicate' AS action, 'skipped' AS status, 'repair_duplicate_of:' || l.target AS error FROM o JOIN l USING (url) WHERE k <> first
  UNION ALL SELECT first, CASE WHEN conflict THEN 'supersede' ELSE 'retarget' END, CASE WHEN conflict THEN 'skipped' WHEN done THEN 'done' ELSE 'pending' END, CASE WHEN conflict THEN 'repair_superseded_by:' || target WHEN done THEN 'repair_replayed' ELSE 'repair_refetch_required' END FROM l
  UNION ALL SELECT target, 'take_over', CASE WHEN done THEN 'done' ELSE 'pending' END, CASE WHEN done THEN 'repair_replayed' ELSE 'repair_refetch_required' END FROM l WHERE conflict
  UNION ALL SELECT target, 'create', CASE WHEN done THEN 'done' ELSE 'pending' END, CASE WHEN done THEN 'repair_replayed' ELSE 'repair_refetch_required' END FROM w WHERE url NOT IN (SELECT url FROM o) AND target NOT IN (SELECT k FROM n))
SELECT 'task' AS kind, CAST(id AS VARCHAR) AS key, CASE WHEN done THEN 'save' WHEN link THEN 'save_and_reopen' ELSE 'reopen' END AS action, CASE WHEN done THEN 'done' ELSE 'pending' END AS status, CASE WHEN done THEN 'repair_replayed' ELSE 'repair_refetch_required' END AS last_error, 1 AS replay FROM t
UNION ALL SELECT 'node', key, action, status, error, 1 FROM fates UNION ALL SELECT 'record', CAST(id AS VARCHAR), NULL, NULL, NULL, 1 FROM t WHERE done OR link""")
def repair_replay(spark, d):
    """All orders as failed tasks, two to a URL; their nodes of other kinds, some of them twice, some keys held by other URLs. The replay of its own results logs nothing."""
    o = spread(table(spark, d, "orders"))
    url = F.concat(F.lit("https://h"), (F.col("o_custkey") % 7).cast("string"), F.lit(".edu.cn/info/1/"), F.floor(F.col("o_orderkey") / 2).cast("string"))
    record = lambda on: F.when(on, F.struct(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("name")))
    t = o.select(
        F.col("o_orderkey").alias("id"), url.alias("source_url"), F.lit("list_page").alias("task_kind"), F.lit("failed").alias("status"), F.lit(3).alias("attempt"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("last_error"),
        record(F.col("o_orderstatus") == "F").alias("snapshot_record"), record(F.col("o_orderpriority").startswith("1-")).alias("link_record"),
    )
    t = saved(t)
    kinds = [("faculty_list_url", 3), ("pagination_url", 4), ("detail_url", 5)]
    at = lambda kind: F.when((F.col("id") % 2 == 1) & F.lit(kind == "detail_url"), F.concat("source_url", F.lit("0/old"))).otherwise(F.col("source_url"))
    found = [t.where(F.col("id") % n == 0).select(F.concat(F.lit(f"{kind}:url:"), "source_url").alias("node_key"), F.lit(kind).alias("type"), at(kind).alias("url")) for kind, n in kinds]
    n = saved(reduce(DataFrame.unionByName, found).distinct()).select("*", F.lit("failed").alias("status"), F.lit(2).alias("attempt_count"), F.lit(60.0).alias("priority_score"), F.lit(60.0).alias("base_priority"), F.lit(None).cast("string").alias("last_error"))
    none = F.lit(None).cast("long")
    tasks, nodes, records, log = R.replay(t, n, none)
    tasks, nodes = saved(tasks), saved(nodes)
    again = R.replay(tasks, nodes, none)[3]
    pick = lambda log, k: log.select(F.col("table").alias("kind"), "key", "action", F.get_json_object("after", "$.status").alias("status"), F.get_json_object("after", "$.last_error").alias("last_error"), F.lit(k).alias("replay"))
    empty = F.lit(None).cast("string")
    kept = records.select(F.lit("record").alias("kind"), F.col("id").cast("string").alias("key"), empty.alias("action"), empty.alias("status"), empty.alias("last_error"), F.lit(1).alias("replay"))
    return reduce(DataFrame.unionByName, [pick(log, 1), pick(again, 2), kept])


@catalog("list_page_routes", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'missing_source_url' WHEN c_custkey % 5 = 0 THEN 'redirect:redirect_to_home' WHEN c_custkey % 7 = 3 THEN 'non_edu_cn_task_url' END AS error, c_custkey % 2 = 0 AS person, c_nationkey FROM customer),
counts AS (SELECT count(*) FILTER (error IS NULL) AS done, count(*) FILTER (error IN ('missing_source_url', 'non_edu_cn_task_url')) AS list_skipped, count(*) FILTER (error LIKE 'redirect:%') AS redirect_skipped,
  count(*) FILTER (error IS NULL AND person) AS list_page_profile_rescued, count(*) FILTER (error IS NULL AND NOT person) AS list_save_suppressed, count(*) FILTER (error IS NULL AND c_nationkey < 12) AS list_known_org_unit_processed FROM c)
SELECT 'node:' || k AS key, CASE WHEN error IS NULL THEN 'done' ELSE 'skipped' END AS status, error, NULL::VARCHAR AS name, NULL::BIGINT AS n FROM c
UNION ALL SELECT 'saved:' || k, NULL, NULL, 'N' || lpad(CAST(k AS VARCHAR), 6, 'x'), NULL FROM c WHERE error IS NULL AND person
UNION ALL SELECT 'counter', NULL, NULL, name, n FROM (UNPIVOT counts ON COLUMNS(*) INTO NAME name VALUE n)""")
def list_page_routes(spark, d):
    """Customers as fetched list pages: some lost, some redirected, some off the domain; every other one is a person's page after all."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    host = F.concat(F.lit("https://h"), text(F.col("c_nationkey")), F.when(k % 7 == 3, ".example.com").otherwise(".edu.cn"))
    asked = F.when(k % 11 != 0, F.concat(host, F.lit("/szdw/list"), text(k), F.lit(".htm")))
    got = F.when(k % 11 != 0, F.when(k % 5 == 0, F.concat(host, F.lit("/"))).otherwise(asked))
    person = F.concat(F.lit("# N"), F.lpad(text(k), 6, "x"), F.lit("\n职称：副教授\nE-mail: x"), text(k), F.lit("@b.cn"))
    fetched = table(spark, d, "customer").select(text(k).alias("node_key"), asked.alias("asked"), got.alias("got"), F.when(k % 2 == 0, person).otherwise("Faculty list\nmore of it").alias("text"), F.when(F.col("c_nationkey") < 12, "物理学院").otherwise("Unknown").alias("label"))
    outcomes, records, counters = R.traverse_lists(saved(fetched))
    none = F.lit(None).cast("string")
    a = outcomes.select(F.concat(F.lit("node:"), "node_key").alias("key"), F.col("node_status").alias("status"), F.col("last_error").alias("error"), none.alias("name"), F.lit(None).cast("long").alias("n"))
    b = records.select(F.concat(F.lit("saved:"), "node_key").alias("key"), none.alias("status"), none.alias("error"), "name", F.lit(None).cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [a, b, counters.select(F.lit("counter").alias("key"), none.alias("status"), none.alias("error"), "name", "n")])


_LINKS = """l AS (SELECT page_id AS root, host, h, 'https://' || host || h || CASE WHEN contains(h, 'ing') THEN '/jgsz' ELSE '' END AS link FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1))) AS h FROM pages) WHERE h LIKE '/%')"""


def _site_links(spark, d):
    pages = table(spark, d, "pages").select("page_id", U.host_of(F.col("url")).alias("host"), F.explode(F.array_distinct(H.hrefs(F.col("html")))).alias("h")).where("h like '/%'")
    return pages.select(F.col("page_id").alias("root"), "host", "h", F.concat(F.lit("https://"), "host", "h", F.when(F.contains("h", F.lit("ing")), "/jgsz").otherwise("")).alias("link"))


@catalog("unit_discovery", f"""WITH {_LINKS}, t AS (SELECT root, link, CASE WHEN contains(h, 'tion') THEN 0 WHEN root % 2 = 0 AND contains(h, 'the') THEN 1 WHEN root % 3 = 0 THEN 2 END AS tier FROM l),
b AS (SELECT root, min(tier) AS tier FROM t GROUP BY 1 HAVING min(tier) IS NOT NULL),
s AS (SELECT DISTINCT root, link, tier, contains(link, 'jgsz') AS listing, CASE WHEN regexp_matches(lower(link), '/jgsz|/yxsz|/zzjg|/jxjg|/xysz|/xybm|/jxkydw|_yjjg|jgsz|yxsz|zzjg|xybm|jxkydw|yjjg') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(link), 'college|school|department|academy|/xy/|/yx/|xueyuan|yuanxi') THEN 3 ELSE 0 END
  - CASE WHEN regexp_matches(lower(link), '/xygk|/xxgk|/about|/overview|/intro|/history|/leader|/news|/notice') THEN 4 ELSE 0 END + CASE WHEN length(regexp_extract(link, '://[^/?#]*([^?#]*)', 1)) - length(replace(regexp_extract(link, '://[^/?#]*([^?#]*)', 1), '/', '')) <= 3 THEN 1 ELSE 0 END AS score FROM t JOIN b USING (root, tier)),
r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY listing DESC, score DESC, length(link) DESC, lower(link), link) AS rank, bool_or(listing) OVER (PARTITION BY root) AS preferred FROM s)
SELECT root, link, tier, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20 AND (listing OR NOT preferred) UNION ALL SELECT page_id, url, 3, 1 FROM pages WHERE page_id NOT IN (SELECT root FROM b)""")
def unit_discovery(spark, d):
    """Every page as a home page: links by a keyword, else those a model gave, else probed ones, else itself."""
    links = _site_links(spark, d)
    roots = table(spark, d, "pages").select(F.col("page_id").alias("root"), F.col("url").alias("link"), U.host_of(F.col("url")).alias("start_host"))
    has = lambda w: F.contains("h", F.lit(w))
    tiers = [links.where(has("tion")), links.where((F.col("root") % 2 == 0) & has("the")), links.where(F.col("root") % 3 == 0)]
    return R.discover_unit_pages(roots, tiers)


@catalog("checked_units", f"""WITH {_LINKS}, p AS (SELECT root, host, h, row_number() OVER (PARTITION BY root ORDER BY h) AS i, 'https://' || host || '/home/' || root AS page FROM l)
SELECT page, 'unit ' || h AS name, 'https://' || host || h AS url, NULL::VARCHAR AS kind, CASE WHEN contains(h, 'an') THEN 'category' WHEN i % 3 = 0 THEN 'not_on_page' ELSE 'accepted' END AS state FROM p WHERE i % 3 <> 1
UNION ALL SELECT page, '', '', NULL, 'incomplete' FROM p WHERE i = 1 UNION ALL SELECT page, 'elsewhere', 'https://other.site.invalid/x', NULL, 'off_site' FROM p WHERE i = 1""")
def checked_units(spark, d):
    """Each page's links as proposed units, some relative, some that the page doesn't have, each checked against it."""
    from pyspark.sql import Window

    links = _site_links(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("root").orderBy("h"))).withColumn("page", F.concat(F.lit("https://"), "host", F.lit("/home/"), F.col("root").cast("string")))
    links = saved(links.select("page", "host", "h", "i"))
    named = links.where("i % 3 <> 1").select("page", F.concat(F.lit("unit "), "h").alias("name"), F.col("h").alias("url"))
    odd = links.where("i = 1").select("page", F.explode(F.array(F.struct(F.lit("").alias("name"), F.lit(" ").alias("url")), F.struct(F.lit("elsewhere").alias("name"), F.lit("https://other.site.invalid/x").alias("url")))).alias("u")).select("page", "u.*")
    # the page has all but every third link
    pages = links.groupBy("page", F.col("host").alias("start_host")).agg(F.collect_list(F.when(F.col("i") % 3 != 0, F.concat(F.lit("https://"), "host", "h"))).alias("links")).withColumn("text", F.lit("no address here"))
    return R.checked_units(named.unionByName(odd).withColumn("kind", F.lit(None).cast("string")), pages, F.contains("name", F.lit("an")))


@catalog("skill_choice", """WITH k AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS name, p_brand AS brand, p_size AS priority, p_partkey % 4 = 0 AS every, p_partkey % 3 AS needs, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1 + p_partkey % 50 END AS budget, rtrim(repeat(p_name || ' ' || p_type || ' ', 30)) AS body FROM part),
s AS (SELECT p_brand AS state, count(*) % 3 AS have FROM part GROUP BY 1),
m AS (SELECT s.state, k.* FROM k JOIN s ON every OR brand = state WHERE needs <= have)
SELECT state, CAST(row_number() OVER (PARTITION BY state ORDER BY priority, name) AS INT) AS rank, name, md5('## Skill: ' || name || E'\\nVersion: 1\\nApplies to: ' || CASE WHEN every THEN '*' ELSE brand END || E'\\nAllowed tools: ' || CASE needs WHEN 0 THEN '(none)' WHEN 1 THEN 'one' ELSE 'one, two' END || E'\\nInstructions:\\n' ||
  CASE WHEN budget IS NULL OR length(body) <= greatest(128, budget * 4) THEN body ELSE rtrim(substr(body, 1, greatest(128, budget * 4))) || E'\\n[truncated by skill token_budget]' END) AS rendered_md5 FROM m""")
def skill_choice(spark, d):
    """Parts as skill files, their front matter read; brands as states with none, one or two tools."""
    part, line = table(spark, d, "part"), lambda name, v: F.concat(F.lit(f"{name}: "), v)
    k = F.col("p_partkey")
    body = F.rtrim(F.repeat(F.concat("p_name", F.lit(" "), "p_type", F.lit(" ")), 30))
    needs = F.when(k % 3 == 1, line("allowed_tools", F.lit("one"))).when(k % 3 == 2, line("allowed_tools", F.lit("one; two,one")))
    content = F.concat_ws("\n", F.lit("---"), line("applies_to", F.when(k % 4 == 0, "*").otherwise(F.col("p_brand"))), needs, line("priority", F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))), F.when(k % 5 != 0, line("token_budget", (1 + k % 50).cast("string"))), F.lit("---"), body, F.lit(""))
    files = part.select(F.lpad(k.cast("string"), 8, "0").alias("stem"), content.alias("content"))
    tools = F.slice(F.array(F.lit("one"), F.lit("two")), F.lit(1), (F.count("*") % 3).cast("int"))
    states = part.groupBy(F.col("p_brand").alias("state")).agg(tools.alias("tools"))
    return R.select_skills(R.skills_of(files), states).select("state", "rank", "name", F.md5("rendered").alias("rendered_md5"))


@catalog("form_pages", """WITH c AS (SELECT c_custkey AS k, 2 + c_custkey % 9 AS top, c_custkey % 3 AS style, c_custkey % 2 = 0 AS jump, 1 + c_nationkey % 3 AS here FROM customer)
SELECT k AS id, 'f' || k AS form, 'f' || k || 'NOW' AS field, p::INT AS page_index, top::INT AS total_pages FROM (SELECT *, unnest(CASE WHEN jump THEN range(1, top + 1) ELSE [2, top] END) AS p FROM c) WHERE p > 1 AND p <> here GROUP BY ALL""")
def form_pages(spark, d):
    """Customers as pages with a form: set by subscript in either quotes or by name, with or without a jump to any page."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    name = F.concat(F.lit("f"), text(k))
    at = F.when(k % 3 == 0, F.concat(F.lit("document.forms['"), name, F.lit("']"))).when(k % 3 == 1, F.concat(F.lit("document.forms[&quot;"), name, F.lit("&quot;]"))).otherwise(F.concat(F.lit("document."), name))
    link = lambda p: F.concat(F.lit('<a href="javascript:'), at, F.lit("."), name, F.lit("NOW.value="), text(p), F.lit(";"), at, F.lit('.submit()">'), text(p), F.lit("</a>"))
    jump = F.when(k % 2 == 0, F.concat(F.lit('<input name="'), name, F.lit('GOPAGE">'))).otherwise(F.lit(""))
    html = F.concat(F.lit('<form name="'), name, F.lit('"><a href="/plain">x</a><span class="this-page"> '), text(1 + F.col("c_nationkey") % 3), F.lit(" </span>"), link(F.lit(2)), link(2 + k % 9), jump, F.lit("</form>"))
    pages = table(spark, d, "customer").select(k.alias("page_id"), F.lit("https://a.edu.cn/x.jsp").alias("url"), html.alias("html"))
    return H.form_pagination(pages).drop("synthetic_url")


#: Sentences about a person (``{n}``), and whether they claim the title.
CLAIMS = [
    ("带领团队攻关，2019年当选中国工程院院士", True), ("{n}，中国科学院院士，博士生导师。", True), ("教授, 博导, 中国工程院院士", True), ("毕业于北京，导师为张三院士。", False), ("与荷兰皇家科学院院士Maarten教授合作。", False),
    ("王华明院士领衔的创新团队骨干成员。", False), ("参与基金、院士工作站项目。", False), ("[两院院士](https://a.edu.cn/x)\n## {n}", False), ("{n} was elected academician in 2010.", True), ("His advisor is an academician.", False), ("教授", False),
]
#: Sentences of biographies, and the fields they name.
FIELDS = [
    ("研究方向：{n}学；视觉、图像处理。生于北京。", "{n}学；视觉；图像处理"), ("在{n}材料和纳米等方面取得了重要研究成果。", "{n}材料；纳米"), ("率先倡导环境和{n}研究。", "环境和{n}"), ("主要从事{n}计算等方面的研究。", "{n}计算"),
    ("在教学方面取得优异评价。", None), ("长期在{n}学院方面开展招生工作。", None), ("主要从事委员会{n}研究。", None), ("他喜欢{n}。", None),
]


def _cases(cases: list[tuple], k: str) -> str:
    quoted = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''").replace("{n}", "' || n || '") + "'"
    return "CASE " + " ".join(f"WHEN {k} % {len(cases)} = {i} THEN {quoted(want)}" for i, (_, want) in enumerate(cases)) + " END"


def _said(spark, d, cases):
    k, n = F.col("c_custkey"), F.concat(F.lit("N"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    said = reduce(lambda rest, i: F.when(k % len(cases) == i, F.replace(F.lit(cases[i][0]), F.lit("{n}"), n)).otherwise(rest), range(len(cases)), F.lit(None).cast("string"))
    return table(spark, d, "customer").select("c_custkey", n.alias("n"), said.alias("said"))


@catalog("academician_claims", f"SELECT c_custkey, {_cases(CLAIMS, 'c_custkey')} AS claims FROM customer")
def academician_claims(spark, d):
    """Customers' biographies, which claim the title, mention another's, or neither."""
    return _said(spark, d, CLAIMS).select("c_custkey", P.claims_academician(F.col("n"), F.col("said")).alias("claims"))


@catalog("research_fields", f"SELECT c_custkey, {_cases(FIELDS, 'c_custkey')} AS fields FROM (SELECT c_custkey, 'N' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS n FROM customer)")
def research_fields(spark, d):
    """The fields that customers' biographies name."""
    return _said(spark, d, FIELDS).select("c_custkey", P.infer_research(F.col("said")).alias("fields"))


@catalog("newest_of_each", "SELECT o_custkey % 10 AS part, arg_max(o_orderkey, [o_orderdate::VARCHAR, lpad(CAST(o_orderkey AS VARCHAR), 12, '0')]) AS newest, count(*) AS n FROM orders GROUP BY 1")
def newest_of_each(spark, d):
    """Orders as files with a time each: of every folder the newest, of equal times the last by name."""
    o = table(spark, d, "orders")
    files = o.select((F.col("o_custkey") % 10).alias("part"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), F.col("o_orderdate").alias("modified"), "o_orderkey")
    best = newest_first(files, "part")
    return best.join(files, ["part", "path"]).join(files.groupBy("part").agg(F.count("*").alias("n")), "part").select("part", F.col("o_orderkey").alias("newest"), "n")


@catalog("payload_normalisation", """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS kind, o_orderkey % 5 = 0 AS lists, o_orderstatus = 'F' AS blank FROM orders),
r AS (SELECT *, CASE WHEN lists THEN 'list_suppressed' WHEN kind = 1 THEN 'teaching_center_dropped' WHEN kind = 5 THEN 'synthesized' WHEN kind = 2 THEN 'alias_rewritten' WHEN kind = 3 THEN 'sub_department_rewritten' ELSE 'kept' END AS route FROM o)
SELECT id AS task_id, CASE WHEN kind = 4 THEN '化学学院' ELSE '物理学院' END AS org_unit_name, CASE WHEN kind = 4 THEN 'https://hx.a.edu.cn/' ELSE 'https://wl.a.edu.cn/' END AS org_unit_url, route, 'N' || lpad(CAST(id AS VARCHAR), 8, 'x') AS name,
  CASE WHEN kind = 5 OR blank THEN '副教授' ELSE '讲师' END AS title, 'x' || id || '@b.cn' AS email, 'https://wl.a.edu.cn/p/' || id AS homepage FROM r WHERE route NOT IN ('list_suppressed', 'teaching_center_dropped')""")
def payload_normalisation(spark, d):
    """Orders as extraction tasks: payloads of list pages, teaching centres, aliases, departments, other units, and none."""
    from quarrylight.operators import payloads as N

    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    name = F.concat(F.lit("N"), F.lpad(text(k), 8, "x"))
    page = F.concat(F.lit("# "), name, F.lit("\n职称：副教授\nE-mail x"), text(k), F.lit("@b.cn\n["), name, F.lit("](https://wl.a.edu.cn/p/"), text(k), F.lit(") [other](https://wl.a.edu.cn/longer/address)"))
    o = table(spark, d, "orders")
    tasks = o.select(k.alias("task_id"), (k % 5 != 0).alias("detail"), F.lit("物理学院").alias("org_unit_name"), F.lit("https://wl.a.edu.cn/").alias("org_unit_url"), F.lit("https://wl.a.edu.cn/x").alias("source_url"), page.alias("page_text"), F.lit(None).cast("string").alias("page_url"))
    unit = F.when(k % 6 == 1, "实验教学中心").when(k % 6 == 2, "理学院物理部").when(k % 6 == 3, "光学系").when(k % 6 == 4, "化学学院").otherwise("")
    none = F.lit(None).cast("string")
    person = F.struct(name.alias("name"), F.when(F.col("o_orderstatus") != "F", "讲师").alias("title"), F.lit(" ").alias("email"), none.alias("research_areas"), none.alias("bio"), none.alias("homepage"))
    given = o.where(k % 6 != 5).select(k.alias("task_id"), unit.alias("org_unit_name"), F.when(k % 6 == 4, "https://hx.a.edu.cn/").otherwise("").alias("org_unit_url"), none.alias("source_url"), F.array(person).alias("professors"))
    aliases = spark.createDataFrame([("物理学院", "理学院物理部")], "canonical string, alias string")
    out, _ = N.normalised_payloads(given, tasks, aliases)
    return out.select("task_id", "org_unit_name", "org_unit_url", "route", F.explode("professors").alias("p")).select("task_id", "org_unit_name", "org_unit_url", "route", "p.name", "p.title", "p.email", "p.homepage")


@catalog("recorded_units", """WITH u AS (SELECT s_suppkey AS id, s_name AS name, 'https://u' || s_suppkey || '.edu.cn/' AS url, CASE WHEN s_suppkey % 4 <> 0 THEN 'https://n' || s_nationkey || '.edu.cn/jgsz.htm' END AS page FROM supplier)
SELECT 'node' AS row, 'org_listing_url:url:' || page AS key, 'done' AS status, 90.0::DOUBLE AS score, NULL::VARCHAR AS to_key FROM u WHERE page IS NOT NULL GROUP BY page
UNION ALL SELECT 'node', 'org_unit:id:' || id, 'pending', 100.0::DOUBLE, NULL FROM u
UNION ALL SELECT 'edge', 'org_listing_url:url:' || page, NULL, 1.0::DOUBLE, 'org_unit:id:' || id FROM u WHERE page IS NOT NULL""")
def recorded_units(spark, d):
    """Suppliers as units that were found on their nation's listing page, or on none."""
    from quarrylight.operators import payloads as N

    s, text = table(spark, d, "supplier"), lambda c: F.col(c).cast("string")
    page = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("https://n"), text("s_nationkey"), F.lit(".edu.cn/jgsz.htm")))
    nodes, edges = N.recorded_units(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://u"), text("s_suppkey"), F.lit(".edu.cn/")).alias("url"), page.alias("source_url")))
    none = F.lit(None).cast("string")
    a = nodes.select(F.lit("node").alias("row"), F.col("node_key").alias("key"), "status", F.col("priority_score").alias("score"), none.alias("to_key"))
    return a.unionByName(edges.select(F.lit("edge").alias("row"), F.col("from_key").alias("key"), none.alias("status"), F.col("confidence").alias("score"), "to_key"))
