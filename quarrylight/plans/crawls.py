"""Crawl decisions over the captured pages and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.functions import profiles as R
from quarrylight.functions import urls as U
from quarrylight.operators import crawl as K
from quarrylight.plans.base import Catalog, table
from quarrylight.plans.pages import _NOISE, _any

catalog = Catalog()


@catalog("fetch_gate", r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, url, strlen(url) % 5 AS depth, regexp_extract(lower(regexp_extract(url, '://([^/?#]*)', 1)), '([^.]+\.[^.]+)$', 1) AS root, regexp_matches(url, '[?]') AS q FROM pages)
SELECT page_id, CASE WHEN depth > 3 THEN 'depth' WHEN root <> 'example.com' THEN 'external' WHEN q THEN 'visited' WHEN page_id % 3 = 0 THEN 'already_crawled' END AS skip FROM p""")
def fetch_gate(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", (F.octet_length("url") % 5).alias("depth"))
    visited = pages.where(F.contains("url", F.lit("?"))).select(U.normalise_url(F.col("url")).alias("url"))
    crawled = pages.where("page_id % 3 = 0").select(U.normalise_url(F.col("url")).alias("url"))
    return K.fetch_gate(pages, "www.example.com", 3, visited, crawled).select("page_id", "skip")


@catalog("task_upsert", """WITH l AS (SELECT *, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq FROM lineitem)
SELECT l_orderkey, arg_max(l_linenumber, [l_quantity::BIGINT, -seq]) AS page_hash, CASE WHEN count(*) FILTER (l_returnflag <> 'N') = 0 THEN 'pending' ELSE arg_max(CASE l_returnflag WHEN 'R' THEN 'retry' ELSE 'done' END, seq) FILTER (l_returnflag <> 'N') END AS status, max(l_linenumber % 4) AS attempt, arg_max(l_suppkey, seq) AS priority FROM l GROUP BY 1""")
def task_upsert(spark, d):
    """Lines as upserts of their order's task, in line order; quantities stand for snapshot lengths."""
    l = table(spark, d, "lineitem")  # noqa: E741
    status = F.when(F.col("l_returnflag") == "N", "pending").when(F.col("l_returnflag") == "R", "retry").otherwise("done")
    tasks = l.select("l_orderkey", F.col("l_linenumber").alias("page_hash"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("snapshot"), status.alias("status"), (F.col("l_linenumber") % 4).alias("attempt"), F.col("l_suppkey").alias("priority"), F.lit(None).cast("string").alias("last_error"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("seq"))
    return K.merged_tasks(tasks, ["l_orderkey"]).select("l_orderkey", "page_hash", "status", "attempt", "priority")


@catalog("unit_page_ranking", """WITH l AS (SELECT DISTINCT page_id, h AS link FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS h FROM pages)),
s AS (SELECT *, CASE WHEN regexp_matches(lower(link), '/jgsz|/yxsz|/zzjg|/jxjg|/xysz|/xybm|/jxkydw|_yjjg|jgsz|yxsz|zzjg|xybm|jxkydw|yjjg') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(link), 'college|school|department|academy|/xy/|/yx/|xueyuan|yuanxi') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(lower(link), '/xygk|/xxgk|/about|/overview|/intro|/history|/leader|/news|/notice') THEN 4 ELSE 0 END + CASE WHEN length(link) - length(replace(link, '/', '')) <= 3 THEN 1 ELSE 0 END AS score FROM l)
SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(link) DESC, lower(link), link) AS INT) AS rank FROM s""")
def unit_pages(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("link"))
    return K.rank_unit_pages(links, "page_id", F.lit("")).select("page_id", "link", "rank")


@catalog("unit_pool", "WITH t AS (SELECT p_partkey, p_brand, CASE WHEN regexp_matches(lower(p_type), 'college|school|department|academy|faculty|xueyuan|yuanxi') THEN 0 ELSE 1 END AS tier FROM part) SELECT p_partkey FROM (SELECT *, min(tier) OVER (PARTITION BY p_brand) AS best FROM t) WHERE tier = best")
def unit_pool(spark, d):
    units = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    return K.unit_pool(units, "p_brand").select("p_partkey")


@catalog("resume_decisions", "SELECT c_custkey, coalesce(n, 0) > 0 AND coalesce(p, 0) = 0 AND c_acctbal >= 0 AS skip FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) USING (c_custkey)")
def resume(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    runs = table(spark, d, "customer").join(per, "c_custkey", "left").select("c_custkey", F.when(F.col("c_acctbal") >= 0, "completed").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("professors"), F.coalesce("p", F.lit(0)).alias("retryable"), F.lit(0).alias("recoverable"))
    return K.resume_decisions(runs).select("c_custkey", "skip")


_PATH = "lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1))"
_PERSON = f"""(regexp_matches({_PATH}, '/info/[0-9]+/[0-9]+|(faculty|teacher|teachers|professor|szdw)details?/') OR (regexp_matches({_PATH}, '/({R.PERSON_DIRECTORIES})/([^/]+/)*([a-z][a-z0-9_]*)(\\.s?html?)?/?$') AND NOT regexp_matches({_PATH}, '/({R.NO_PERSON})(\\.s?html?)?/?$|(list|index)(\\.s?html?)?/?$')))"""


@catalog("node_gate", f"""WITH g AS (SELECT page_id AS id, CASE WHEN {_any("lower(url)", ["/login", "tplloginaccount", "signin"])} OR {_NOISE} THEN 'noise_or_login_candidate' WHEN strlen(url) % 6 > 4 THEN 'detail_depth_excess' WHEN strlen(url) % 6 > 3 AND NOT {_PERSON} THEN 'profile_depth_gate'
WHEN min(CASE WHEN page_id % 2 = 0 THEN page_id END) OVER (PARTITION BY url) <> page_id THEN 'duplicate_url' END AS error FROM pages) SELECT id, CASE WHEN error IS NOT NULL THEN 'skipped' WHEN id % 2 = 0 THEN 'done' ELSE 'pending' END AS status, error FROM g""")
def node_gate(spark, d):
    """Pages as nodes, gated by noise, depth and pages that others have."""
    nodes = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.lit("detail_url").alias("kind"), F.when(F.col("page_id") % 2 == 0, "done").otherwise("pending").alias("status"), (F.octet_length("url") % 6).alias("depth"))
    return K.node_gate(nodes, 3).select("id", "status", "error")


@catalog("detail_links", """WITH l AS (SELECT s_nationkey AS n, s_suppkey AS k, s_suppkey % 4 AS kind, s_suppkey % 3 = 0 AS person FROM supplier), u AS (
SELECT n, CASE kind WHEN 0 THEN '/szdw/info/' || n || '/' || k || '.htm' WHEN 1 THEN '/info/' || n || '/' || k || '.htm' WHEN 2 THEN '/szdw/x' || k || '.htm' END AS path, CASE kind WHEN 0 THEN 3 + 4 + 4 + 4 + 2 WHEN 1 THEN 2 + 4 + 4 WHEN 2 THEN 1 + 4 + 2 END + CASE WHEN person THEN 3 ELSE 0 END AS score FROM l WHERE kind < 2 OR kind = 2 AND person)
SELECT 'http://h' || n || '.cn/szdw.htm' AS page_url, 'http://h' || n || '.cn' || path AS url, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, length(path), path DESC) AS INT) AS rank FROM u""")
def detail_links(spark, d):
    """Suppliers as the links of their nation's directory: articles in and out of its section, other pages, files."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    host, kind = F.concat(F.lit("http://h"), nation, F.lit(".cn")), F.col("s_suppkey") % 4
    article = F.concat(F.lit("info/"), nation, F.lit("/"), key, F.lit(".htm"))
    path = F.when(kind == 0, F.concat(F.lit("/szdw/"), article)).when(kind == 1, F.concat(F.lit("/"), article)).when(kind == 2, F.concat(F.lit("/szdw/x"), key, F.lit(".htm"))).otherwise(F.concat(F.lit("/szdw/x"), key, F.lit(".pdf")))
    name = F.when(F.col("s_suppkey") % 3 == 0, "Wang Wei").otherwise("see more")
    links = table(spark, d, "supplier").select(F.concat(host, F.lit("/szdw.htm")).alias("page_url"), F.concat(host, path).alias("url"), name.alias("anchor_text"))
    return K.detail_links(links)


_LINES = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\r\n]+'), lambda x: trim(x)), lambda x: x <> '')"


@catalog("page_gate", f"""WITH d AS (SELECT doc_id AS id, text, {_LINES} AS lines FROM documents)
SELECT id, CASE WHEN len(list_filter(lines, lambda x: {_any("lower(x)", R.NOISE_LINES)})) / greatest(1, len(lines)) >= 0.35 AND NOT contains(lower(text), '@') AND NOT {_any("lower(text)", R.SIGNALS)} THEN 'text_noise_ratio' END AS reason FROM d
UNION ALL SELECT -1 - c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'notice_issuance_title' WHEN 1 THEN 'recent_school_news_opening' WHEN 2 THEN 'text_noise_ratio' END FROM customer""")
def page_gate(spark, d):
    """Why documents, and texts made up for customers, can't be profiles."""
    kind = F.col("c_custkey") % 5
    said = F.when(kind == 0, "## 关于 2024 年招生的通知\n各学院").when(kind == 1, "首页\n近日我院 举行会议").when(kind == 2, "notice\nmore").when(kind == 3, "notice\nmail a@b.cn").otherwise("Wang Wei\nbooks")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("id"), said.alias("text")))
    return texts.select("id", R.page_gate(F.lit("http://a.example/x"), F.col("text")).alias("reason"))


@catalog("snapshot_records", """SELECT c_custkey, 'N' || right(c_name, 5) AS name, CASE c_custkey % 3 WHEN 0 THEN '副教授' WHEN 1 THEN NULL ELSE '教授' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'x' || c_custkey || '@b.cn' END AS email, CASE WHEN c_nationkey < 12 THEN '光学；' || c_mktsegment END AS research_areas
FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 3 <> 1 OR c_custkey % 2 = 0 OR c_nationkey < 12)""")
def snapshots(spark, d):
    """Customers as profile pages: some are notices, some say nothing about their person."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    title = F.when(k % 3 == 0, "职称：副教授、博导").when(k % 3 == 2, "职务: Professor").otherwise("无")
    lines = F.concat_ws("\n", F.when(k % 7 == 0, "关于某些事项的通知"), F.concat(F.lit("# 1. N"), F.right("c_name", F.lit(5))), title, F.when(k % 2 == 0, F.concat(F.lit("E-mail x"), k.cast("string"), F.lit("@b.cn"))), F.when(F.col("c_nationkey") < 12, F.concat(F.lit("研究方向： 光学；"), "c_mktsegment")).otherwise(none))
    records = table(spark, d, "customer").select("c_custkey", R.snapshot_record(lines, F.lit("http://a.example/x")).alias("r"))
    return records.where("r is not null").select("c_custkey", "r.name", "r.title", "r.email", "r.research_areas")
