"""URL and page rules over captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import classify as C
from quarrylight.functions import html as H
from quarrylight.functions import urls as U
from quarrylight.functions import vocabulary as V
from quarrylight.operators.ladder import ranked
from quarrylight.plans.base import Catalog, table

catalog = Catalog()
_HOST = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"
_PATH = "lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1))"
_ROOT = "regexp_extract({}, '([^.]+\\.[^.]+)$', 1)"
_NORM = r"lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') || regexp_extract(url, '(\?[^#]*)', 1)"


def pages(spark, d):
    return table(spark, d, "pages")


@catalog("url_normalise", f"SELECT page_id, {_NORM} AS url FROM pages")
def url_normalise(spark, d):
    return pages(spark, d).select("page_id", U.normalise_url(F.col("url")).alias("url"))


@catalog("site_root", f"SELECT page_id, {_HOST} AS host, {_ROOT.format(_HOST)} AS root FROM pages")
def site_root(spark, d):
    return pages(spark, d).select("page_id", U.host_of(F.col("url")).alias("host"), U.site_root(U.host_of(F.col("url"))).alias("root"))


@catalog("pagination_flag", f"SELECT page_id, regexp_matches(url, '{V.PAGINATION}') AS paged FROM pages")
def pagination_flag(spark, d):
    return pages(spark, d).select("page_id", U.is_pagination(F.col("url")).alias("paged"))


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.lower()}')" for w in words) + ")"


_TOKENS = f"list_filter(regexp_split_to_array({_PATH}, '[^a-z0-9]+'), lambda t: t <> '')"
_IN = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_NOISE = f"""((list_has_any({_TOKENS}, {_IN(V.PROMOTIONAL)}) AND NOT ({_any("lower(url)", V.FACULTY_DIRECTORIES)} AND {_any("lower(url)", V.FACULTY_WORDS)}))
 OR len(list_filter({_TOKENS}, lambda t: list_contains({_IN([w for w in V.NOISE_TOKENS if w not in V.PROMOTIONAL])}, t) OR regexp_full_match(t, '({"|".join(V.NOISE_STEMS)})[0-9]*'))) > 0
 OR contains(lower(url), '规章制度') OR regexp_matches({_PATH}, '/20[0-9]{{2}}/[0-9]{{2}}(/[0-9]{{2}})?/'))"""


@catalog("noise_url_flag", f"SELECT page_id, {_NOISE} AS noise FROM pages")
def noise_flag(spark, d):
    return pages(spark, d).select("page_id", U.is_noise(F.col("url")).alias("noise"))


@catalog("page_type", f"""SELECT page_type, count(*) AS n FROM (SELECT CASE WHEN {_HOST} LIKE 'faculty.%' OR {_HOST} LIKE 'faculty-%' THEN 'faculty_platform' WHEN {_HOST} LIKE 'www.%' AND {_PATH} IN ('/', '/index.htm', '/index.html', '') THEN 'university_homepage'
WHEN {_HOST} NOT LIKE 'www.%' AND {_HOST} NOT LIKE 'faculty%' AND {_PATH} IN ('/', '/index.htm', '/index.html', '') THEN 'college_subdomain_homepage' WHEN regexp_matches({_PATH}, 'szdw|szll|teacher|faculty|szrc|jszy|szgk|rydw') THEN 'likely_faculty_list'
WHEN regexp_matches({_PATH}, 'xy|yxsz|xbyx|department|school|college|yuan') THEN 'college_page' WHEN regexp_matches({_PATH}, 'xxgk|zzjg|jgsz|jxgl|about|news') THEN 'admin_page' WHEN contains({_PATH}, '/en/index.htm') THEN 'individual_teacher_page'
WHEN contains({_PATH}, 'page') OR contains(url, 'PAGENUM') THEN 'pagination' ELSE 'other' END AS page_type FROM pages) GROUP BY 1""")
def page_type(spark, d):
    return pages(spark, d).groupBy(U.page_type(F.col("url")).alias("page_type")).agg(F.count("*").alias("n"))


@catalog("host_histogram", f"SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1, 2 ORDER BY n DESC, scheme, host LIMIT 15")
def host_histogram(spark, d):
    counts = pages(spark, d).groupBy(U.part(F.col("url"), 1).alias("scheme"), U.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "scheme", "host").limit(15)


@catalog("profile_url_quality", f"""SELECT page_id, CAST(CASE WHEN {_PATH} IN ('', '/') THEN -200 ELSE (CASE WHEN regexp_matches(p, '/info/|/profile|/detail|/show|/mentor') THEN 70 ELSE 0 END + CASE WHEN regexp_matches(p, '/info/[0-9]+/[0-9]+(\\.s?html?)?$') THEN 30 ELSE 0 END
+ CASE WHEN regexp_matches(p, '/(teacher|teachers|faculty|people)/[^/]+') THEN 35 ELSE 0 END + CASE WHEN regexp_matches(p, '\\.(htm|html|shtml)$') THEN 4 ELSE 0 END + greatest(0, length(p) - length(replace(p, '/', '')) - 2) - CASE WHEN regexp_matches(p, '/szdw|/szll|/jsdw|/team|/staff|/directory') THEN 55 ELSE 0 END) END AS INT) AS quality FROM (SELECT *, rtrim({_PATH}, '/') AS p FROM pages)""")
def profile_quality(spark, d):
    return pages(spark, d).select("page_id", U.profile_url_quality(F.col("url")).alias("quality"))


@catalog("href_extract", """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1))) AS href FROM pages""")
def href_extract(spark, d):
    return pages(spark, d).select("page_id", F.explode(F.array_distinct(H.hrefs(F.col("html")))).alias("href"))


@catalog("same_site_links", f"""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*?href="(/[^"/][^"]*)"', 1))) AS href FROM pages) GROUP BY 1""")
def same_site(spark, d):
    """Links that stay on their page's site, counted once each; relative ones do."""
    found = H.hrefs(F.col("html"))
    links = pages(spark, d).select("page_id", U.site_root(U.host_of(F.col("url"))).alias("root"), F.explode(F.array_distinct(found)).alias("href"))
    own = F.col("href").rlike("^/[^/]") | (U.site_root(U.host_of(F.col("href"))) == F.col("root"))
    return links.where(own).groupBy("page_id").agg(F.count("*").alias("n"))


@catalog("structural_links", r"""WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="(/[^"]*)">', 1) AS h, regexp_extract_all(html, '<li><a href="/[^"]*">([^<]*)</a>', 1) AS t FROM pages),
x AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h[i] AS url, t[i] AS anchor_text, i FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM l))
SELECT page_id, url, arg_max(anchor_text, [length(anchor_text), -i]) AS anchor_text, '' AS heading_text, 'ul>nav' AS context, CAST(min(i) AS INT) AS link_order FROM x GROUP BY page_id, url""")
def structural_links(spark, d):
    links = H.page_links(pages(spark, d))
    return links.select(F.col("id").alias("page_id"), "url", "anchor_text", "heading_text", F.array_join("context", ">").alias("context"), "link_order")


@catalog("candidate_assessment", f"""WITH l AS (SELECT page_id, 'http://' || substr(h, 2) AS url FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1))) AS h FROM pages)),
c AS (SELECT page_id, url, {_any("lower(url)", V.LOGIN_HINTS)} AS rejected, {_any("lower(url)", V.FULL_LIST)} AS full_hit, {_any("lower(url)", V.FULL_STRONG)} AS strong, {_any("lower(url)", V.CATEGORY_LIST)} AS cat, {_any("lower(url)", V.ELITE_LIST)} AS elite, {_any("lower(url)", V.NAV_WORDS)} AS nav, {_NOISE} AS nu, {_any("lower(url)", V.NOISE_WORDS)} AS nw, regexp_matches(url, '{V.PAGINATION}') AS paged, {_any("lower(url)", V.FACULTY_WORDS)} AS fac FROM l),
s AS (SELECT *, CASE WHEN rejected THEN -100 ELSE CASE WHEN full_hit THEN 12 ELSE 0 END + CASE WHEN cat THEN 7 ELSE 0 END + CASE WHEN elite THEN 5 ELSE 0 END + CASE WHEN nav THEN 2 ELSE 0 END + CASE WHEN fac THEN 3 ELSE 0 END - CASE WHEN paged THEN 2 ELSE 0 END - CASE WHEN nu OR nw THEN 14 ELSE 0 END - CASE WHEN nu THEN 8 ELSE 0 END END AS score FROM c)
SELECT page_id, url, CAST(score AS INT) AS score, CASE WHEN rejected OR nu OR (nw AND score <= 0) THEN 'noise_or_login' WHEN cat AND NOT strong THEN 'category_list' WHEN full_hit THEN 'full_list' WHEN elite THEN 'elite_list' ELSE 'unknown' END AS page_type FROM s""")
def candidates(spark, d):
    """The links of all pages, assessed by their URL."""
    links = pages(spark, d).select("page_id", F.explode(F.array_distinct(H.hrefs(F.col("html")))).alias("h")).select("page_id", F.concat(F.lit("http://"), F.substring("h", 2, 1 << 30)).alias("url"))
    none = F.lit(None).cast("string")
    assessed = links.withColumn("a", C.assess_candidate(F.col("url"), none, none, F.lit(None).cast("array<string>")))
    return assessed.select("page_id", "url", "a.score", "a.page_type")


@catalog("faculty_link_ranking", f"""WITH l AS (SELECT DISTINCT page_id, h FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS h FROM pages)),
s AS (SELECT *, CASE WHEN {_any("lower(h)", V.STRONG_FACULTY)} THEN 6 ELSE 0 END - CASE WHEN {_any("lower(h)", V.WEAK_FACULTY)} THEN 8 ELSE 0 END - CASE WHEN regexp_matches(h, '{V.PAGINATION}') THEN 3 ELSE 0 END AS score FROM l)
SELECT page_id, h, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(h) DESC, lower(h), h) AS INT) AS rank FROM s""")
def faculty_links(spark, d):
    from quarrylight.functions.text import contains_any

    links = pages(spark, d).select("page_id", F.explode(F.array_distinct(H.hrefs(F.col("html")))).alias("h"))
    score = F.when(contains_any(F.col("h"), V.STRONG_FACULTY), 6).otherwise(0) - F.when(contains_any(F.col("h"), V.WEAK_FACULTY), 8).otherwise(0) - F.when(U.is_pagination(F.col("h")), 3).otherwise(0)
    return ranked(links, ["page_id"], [score.desc(), F.desc(F.length("h")), F.lower("h"), F.col("h")]).select("page_id", "h", "rank")


@catalog("excluded_units", """SELECT n_name, CASE WHEN regexp_matches(lower(n_name || ' ' || r_name), '(^|[^a-z0-9])music([^a-z0-9]|$)') THEN 'arts:music' WHEN regexp_matches(lower(n_name || ' ' || r_name), '(^|[^a-z0-9])asia([^a-z0-9]|$)') THEN 'custom:asia' END AS rule FROM nation JOIN region ON r_regionkey = n_regionkey""")
def excluded(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", C.excluded_unit(F.col("n_name"), F.col("r_name"), F.lit(""), ["music", "asia"]).alias("rule"))


@catalog("block_detect", f"""SELECT page_id, CASE WHEN len(list_filter({_IN(V.WAF_MARKERS)}, lambda m: contains(lower(html), m))) > 0 THEN 'waf_challenge' END IS NOT NULL AS blocked FROM pages""")
def block_detect(spark, d):
    return pages(spark, d).select("page_id", C.block_reason(F.lit(403), F.col("html"), F.lit("")).isNotNull().alias("blocked"))


@catalog("fetch_failures", f"""SELECT p_partkey, CASE WHEN {_any("lower(p_name)", V.BLOCKED_MARKERS)} THEN 'blocked' WHEN {_any("lower(p_name)", V.RETRYABLE_MARKERS)} THEN 'retryable' ELSE 'terminal' END AS kind, {_any("lower(p_name)", V.LOG_RETRYABLE)} AND NOT {_any("lower(p_name)", V.LOG_NOT_RETRYABLE)} AS resumes FROM part""")
def fetch_failures(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", C.fetch_failure(name).alias("kind"), C.log_is_retryable(name).alias("resumes"))


@catalog("core_units", "SELECT n_name, regexp_matches(lower(n_name), 'college|school|department|academy|faculty|xueyuan|yuanxi') AND NOT regexp_matches(lower(n_name), 'research|institute|lab|center|platform') AS core FROM nation")
def core_units(spark, d):
    return table(spark, d, "nation").select("n_name", C.is_core_unit(F.col("n_name")).alias("core"))


@catalog("page_text")
def page_text(spark, d):
    """A page's whole text, natively split from its markup by a table function."""
    return pages(spark, d).select("page_id", H.html_to_text("html").alias("text"))


@catalog("page_cache_lookup", f"""SELECT page_id, arg_min(other, [CASE WHEN o_url = url THEN 0 ELSE 1 END, other]) AS hit FROM (SELECT page_id, url FROM pages) p JOIN (SELECT page_id AS other, url AS o_url, {_NORM} AS final FROM pages) o ON o_url = url OR final = url GROUP BY 1""")
def cache_lookup(spark, d):
    """The cached fetch of a URL: by what was asked before what it ended at, then the least id."""
    p = pages(spark, d).select("page_id", "url")
    cache = pages(spark, d).select(F.col("page_id").alias("other"), F.col("url").alias("o_url"), U.normalise_url(F.col("url")).alias("final"))
    keyed = cache.select("other", F.explode(F.array(F.struct(F.lit(0).alias("rung"), F.col("o_url").alias("key")), F.struct(F.lit(1).alias("rung"), F.col("final").alias("key")))).alias("k")).select("other", "k.rung", F.col("k.key").alias("url"))
    return p.join(keyed, "url").groupBy("page_id").agg(F.min_by("other", F.struct("rung", "other")).alias("hit"))
