"""Decisions of a crawl as set operations: what to fetch, what to skip and why, what to keep of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import classify as C
from quarrylight.functions import profiles as R
from quarrylight.functions import urls as U
from quarrylight.functions.text import contains_any, text_of
from quarrylight.operators.ladder import ranked

# Paths where staff and unit lists usually are, and sections that hold no person.
FACULTY_PATHS = "/szdw/szll.htm /szdw.htm /szdw/ /szll.htm /szll/ /rcpy/szdw.htm /sz/szdw.htm /teacher/ /teachers/ /faculty/ /people/ /szrc.htm /szdw/jsdw.htm /szdw/qzjs.htm /szdw/index.htm /yjdw/szdw.htm /jszy/ /rydw/".split()
UNIT_PATHS = "/zuzhijigou.html /jgsz.htm /jgsz/ /jgsz/jxkyjg.htm /yxsz.htm /yxsz/ /zzjg.htm /zzjg/ /jxjg.htm /jxjg/ /xysz.htm /xysz/".split()
NO_PERSON_SECTIONS = "/gywm/ /djgz/ /rcpy/ /pxfz/ /kxyj/ /download/ /about/ /intro/ /history/ /leader/ /lxdh/ /index".split()
DETAIL_HINTS = ["/info/", "/profile", "/detail", "/show", "/mentor", "/teacher/", "/people/", "/faculty/"]
UNIT_STRONG = "/jgsz /yxsz /zzjg /jxjg /xysz /xybm /jxkydw _yjjg jgsz yxsz zzjg xybm jxkydw yjjg".split()
UNIT_MEDIUM = "college school department academy /xy/ /yx/ xueyuan yuanxi".split()
UNIT_WEAK = "/xygk /xxgk /about /overview /intro /history /leader /news /notice".split()
TERMINAL_HOSTS = r"(^|\.)(jaccount\.sjtu\.edu\.cn|weixin\.qq\.com)$"


def fetch_gate(wanted: DataFrame, start_host: str, max_depth: int, visited: DataFrame, crawled: DataFrame) -> DataFrame:
    """``wanted`` (url, depth) with ``skip``: the first reason not to fetch, or NULL.

    ``visited`` and ``crawled`` are tables (url) of this run's and earlier runs' pages.
    """
    root = U.site_root(F.lit(start_host))
    seen = visited.select("url").distinct().withColumn("seen", F.lit(True))
    done = crawled.select("url").distinct().withColumn("done", F.lit(True))
    rows = wanted.withColumn("url", U.normalise_url(F.col("url"))).join(seen, "url", "left").join(done, "url", "left")
    invalid = ~F.col("url").rlike(r"^https?://[^/\x00-\x20<>]+[^\x00-\x20<>]*$")
    reason = (
        F.when(invalid, "invalid_url").when(F.col("depth") > max_depth, "depth").when(U.site_root(U.host_of(F.col("url"))) != root, "external")
        .when(F.col("seen"), "visited").when(F.col("done"), "already_crawled")
    )
    return rows.select(*wanted.columns, reason.alias("skip"))


def node_gate(nodes: DataFrame, max_depth: int) -> DataFrame:
    """``nodes`` (id, url, kind, status, depth) with the status and error a look before fetching gives.

    Noise first, then depth, where a profile may lie one level deeper, then a page that another
    node is fetching or has fetched.
    """
    url = F.col("url")
    first = F.min(F.when(F.col("status").isin("done", "in_progress"), F.col("id"))).over(Window.partitionBy("url"))
    noise = contains_any(url, ["/login", "tplloginaccount", "signin"]) | U.is_noise(url)
    detail, deep = F.col("kind") == "detail_url", F.col("depth") > max_depth
    error = (
        F.when(noise, "noise_or_login_candidate").when(detail & (F.col("depth") > max_depth + 1), "detail_depth_excess").when(detail & deep & ~R.is_profile_detail(url), "profile_depth_gate")
        .when(~detail & deep, "depth").when(F.coalesce(F.col("peer") != F.col("id"), F.lit(False)), "duplicate_url")
    )
    looked = nodes.withColumn("peer", first).withColumn("error", error)
    return looked.withColumn("status", F.when(F.col("error").isNotNull(), "skipped").otherwise(F.col("status"))).drop("peer")


def redirect_reason(asked: Column, got: Column, detail: bool) -> Column:
    """Why the page that a request ended at isn't the one that was asked for, or NULL."""
    same = lambda u: F.concat_ws("|", U.host_of(u), F.rtrim(F.regexp_replace(F.lower(U.path_of(u)), r"/(?:index|default)\.(?:html?|shtml|php|jsp|aspx?)$", "/"), F.lit("/")), U.part(u, 4))
    home = lambda u: F.regexp_replace(F.lower(U.path_of(u)), r"/(?:index|default)\.(?:html?|shtml|php|jsp|aspx?)$", "/").isin("", "/")
    none = F.lit(None).cast("string")
    assessed = C.assess_candidate(got, none, none, F.lit(None).cast("array<string>"))
    section = F.regexp_replace(F.lower(U.path_of(asked)), r"(/[^/]*\.[^/]*|/)$", "")
    path = F.lower(U.path_of(got))
    within = (section == "") | (path == section) | path.startswith(F.concat(section, F.lit("/")))
    fits = R.is_profile_detail(got) if detail else U.is_faculty_page(got)
    return (
        F.when((text_of(asked) == "") | (text_of(got) == ""), none)
        .when(~F.lower(U.part(got, 1)).isin("http", "https", ""), F.concat(F.lit("redirect_to_"), F.lower(U.part(got, 1)), F.lit("_url")))
        .when(U.host_of(got).rlike(TERMINAL_HOSTS), "redirect_to_login_or_app")
        .when(same(asked) == same(got), none)
        .when(home(got) & ~home(asked), "redirect_to_home")
        .when(F.lit(not detail) & (assessed["hard_reject"] | (assessed["page_type"] == "noise_or_login")), "redirect_to_noise")
        .when(within | fits, none)
        .otherwise("redirect_left_section")
    )


def merged_tasks(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Task upserts in order of ``seq`` folded by key: the longest snapshot with its hash, the highest
    attempt, the last priority; pending never takes a task back.

    Columns: keys, page_hash, snapshot, status, attempt, priority, last_error, seq.
    """
    longest = F.struct(F.length("snapshot").alias("n"), (-F.col("seq")).alias("first"))
    stands = F.when(F.col("status") != "pending", F.col("seq"))
    return tasks.groupBy(*keys).agg(
        F.max_by(F.struct("page_hash", "snapshot"), longest).alias("page"), F.coalesce(F.max_by("status", stands), F.lit("pending")).alias("status"),
        F.max("attempt").alias("attempt"), F.max_by("priority", "seq").alias("priority"), F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("seq"))).alias("last_error"),
    ).select(*keys, "page.page_hash", "page.snapshot", "status", "attempt", "priority", "last_error")


def off_domain_cleanup(tasks: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks whose URLs are under edu.cn, and the failures of those tasks or of none."""
    kept = tasks.where(U.is_under_edu_cn(F.col("source_url")) & (F.col("page_url").isNull() | U.is_under_edu_cn(F.col("page_url"))))
    gone = tasks.join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("task_id"))
    return kept, failures.join(gone, "task_id", "left_anti")


def path_probes(units: DataFrame, pages: DataFrame, paths: list[str] = FACULTY_PATHS) -> DataFrame:
    """(unit, url) of the first usual path of each unit (unit, url) that was captured with text (url, n_chars)."""
    root = F.concat(U.part(F.col("url"), 1), F.lit("://"), U.host_of(F.col("url")))
    tried = units.select("unit", root.alias("root"), F.posexplode(F.array(*map(F.lit, paths))).alias("pos", "path")).select("unit", "pos", U.normalise_url(F.concat("root", "path")).alias("url"))
    there = pages.where("n_chars > 200").select(U.normalise_url(F.col("url")).alias("url")).distinct()
    return tried.join(there, "url").groupBy("unit").agg(F.min_by("url", "pos").alias("url"))


def unit_page_score(link: Column, start_host: Column) -> Column:
    """How much a link looks like the list of units."""
    host, path = U.host_of(link), F.lower(U.path_of(link))
    point = lambda hit, n: F.when(hit, n).otherwise(0)
    return (
        point((host != "") & (host != start_host), 2) - point(host.rlike("^(xxgk|news|www2)"), 3) + point(contains_any(link, UNIT_STRONG), 8) + point(contains_any(link, UNIT_MEDIUM), 3)
        - point(contains_any(link, UNIT_WEAK), 4) - point(host.rlike("^faculty[.-]"), 10) + point(U.slashes(path) <= 3, 1)
    )


def rank_unit_pages(links: DataFrame, by: str, start_host: Column) -> DataFrame:
    score = unit_page_score(F.col("link"), start_host)
    return ranked(links.select(by, "link").distinct(), [by], [score.desc(), F.desc(F.length("link")), F.lower("link"), F.col("link")])


def detail_links(links: DataFrame) -> DataFrame:
    """Profile links of pages, ranked: (page_url, url, score, rank) from (page_url, url, anchor_text).

    Same host, not retired, not noise, not a file or a list, in the page's section or shaped like a
    profile; scored by depth, section, shape and a person's name for an anchor; under 3 is dropped.
    """
    url, low = F.col("url"), F.lower("url")
    section = F.regexp_replace(F.lower(U.path_of(F.col("page_url"))), r"(\.[^/.]*|/)$", "")
    near = (section != "") & F.lower(U.path_of(url)).startswith(F.concat(section, F.lit("/")))
    hinted, person = contains_any(url, DETAIL_HINTS), F.col("anchor_text").rlike(r"^[一-鿿·]{2,6}$|^[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}$")
    shaped, noisy = R.is_profile_detail(url), contains_any(url, NO_PERSON_SECTIONS)
    bad = U.is_pagination(url) | contains_any(url, ["ltx", "retired", "emeritus", "tuixiu", "rongxiu"]) | U.is_noise(url) | noisy | low.rlike(r"\.(pdf|docx?|xlsx?|pptx?|zip|rar)$")
    kept = links.where((url != F.col("page_url")) & (U.host_of(url) == U.host_of(F.col("page_url"))) & ~bad & (near | shaped | hinted) & (shaped | person))
    point = lambda hit, n: F.when(hit, n).otherwise(0)
    score = F.greatest(F.lit(0), U.slashes(U.path_of(url)) - 1) + point(near, 4) + point(hinted, 4) + point(shaped, 4) + point(person, 3) + point(low.rlike("/szdw/|/team/|/staff/|/jsdw/"), 2)
    scored = kept.withColumn("score", score.cast("int")).where("score >= 3").groupBy("page_url", "url").agg(F.max("score").alias("score"))
    return ranked(scored, ["page_url"], [F.desc("score"), F.length("url"), F.desc("url")])


def best_link_record(signals: DataFrame) -> DataFrame:
    """Of all mentions of a URL the richest record: (url, record) from (url, anchor_text, title, research, seq)."""
    score = 1 + 2 * (text_of(F.col("title")) != "").cast("int") + 3 * (text_of(F.col("research")) != "").cast("int") + F.length("anchor_text").between(1, 6).cast("int")
    return signals.groupBy("url").agg(F.max_by(F.struct("anchor_text", "title", "research"), F.struct(score.alias("s"), (-F.col("seq")).alias("first"))).alias("record"))


def unit_pool(units: DataFrame, by: str) -> DataFrame:
    """Core units of each ``by`` if it has any, else the rest that are no divisions, else all."""
    core, division = C.is_core_unit(F.col("kind")), F.col("name").rlike("学部$|(?i)division")
    tier = F.when(core & ~division, 0).when(~division, 1).otherwise(2)
    best = F.min("tier").over(Window.partitionBy(by))
    return units.withColumn("tier", tier).withColumn("best", best).where("tier = best").drop("tier", "best")


def resume_decisions(runs: DataFrame) -> DataFrame:
    """``skip`` for runs that are completed with people and have nothing left to retry or recover.

    Columns: status, professors, retryable, recoverable.
    """
    return runs.withColumn("skip", (F.col("status") == "completed") & (F.col("professors") > 0) & (F.col("retryable") == 0) & (F.col("recoverable") == 0))
