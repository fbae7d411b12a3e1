"""URL filters: rules first, then trust and distrust spread over the host link graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.store import Scratch, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path of absolute and scheme-relative links.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+(?:/[^?#"'\s<>]*)?)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits the host or a domain above it and begins the path, as a struct."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    none = F.lit(None).cast("struct<name:string,verdict:string>")
    return none if found is None else found.otherwise(none)


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst, path) of links to other hosts, whether these have pages or not; an empty path is ``/``."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("link"))
    path = F.regexp_extract("link", r"(?s)^[^/]*(.*)$", 1)
    parts = links.select("src", F.translate(F.substring_index("link", "/", 1), UPPER, LOWER).alias("dst"), F.when(path == "", "/").otherwise(path).alias("path"))
    return parts.where("src <> '' and src <> dst").distinct()


def spread(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-5) -> DataFrame:
    """Personalised PageRank of trust along the links and of distrust against them.

    ``hosts`` has (host, trusted, blocked) seeds between 0 and 1. Returns (host, trust, distrust),
    scaled so that a seed of 1 without links keeps 1 - damping. A host's trust goes out in equal
    shares over its links, its distrust in equal shares over the links to it. Rounds go on until all
    hosts together change by less than ``tolerance`` of the seeds' sum; a round changes at most
    ``damping`` of what the one before did, so they end. Each round's table is written to the shared
    folder. A round sums up what flows to a host on the map side first, and hosts of very many links
    are for the skew join of adaptive execution.
    """
    spark = hosts.sparkSession
    out = edges.groupBy("src").agg((1 / F.count("*")).alias("wt"))
    into = edges.groupBy("dst").agg((1 / F.count("*")).alias("wd"))
    zero = F.lit(0.0)
    forth = edges.join(out, "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), "wt", zero.alias("wd"))
    back = edges.join(into, "dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), zero.alias("wt"), "wd")
    scratch = Scratch(spark)
    flows = scratch.save(forth.unionByName(back), "flows")
    start = hosts.select("host", ((1 - damping) * F.col("trusted")).alias("t0"), ((1 - damping) * F.col("blocked")).alias("d0"))
    state = start.select("host", "t0", "d0", F.col("t0").alias("trust"), F.col("d0").alias("distrust"), zero.alias("change"))
    if flows.isEmpty():  # every round would leave the seeds as they are
        return state.select("host", "trust", "distrust")
    seeds = state.agg(F.sum(F.col("t0") + F.col("d0"))).first()[0] or 0.0
    changed = seeds
    while changed > tolerance * seeds:
        moved = flows.join(state.select(F.col("host").alias("at"), "trust", "distrust"), "at").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.col("trust") * F.col("wt")).alias("it"), F.sum(F.col("distrust") * F.col("wd")).alias("id")
        )
        trust, distrust = F.col("t0") + damping * F.coalesce("it", zero), F.col("d0") + damping * F.coalesce("id", zero)
        change = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        state = scratch.save(state.join(moved, "host", "left").select("host", "t0", "d0", trust.alias("trust"), distrust.alias("distrust"), change.alias("change")), "ranks")
        changed = state.agg(F.sum("change")).first()[0]
    scratch.free("flows")
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES, damping: float = 0.85, margin: float = 0.5) -> DataFrame:
    """Per page: id_col, host, path, rule, verdict.

    A rule's verdict stands. Other pages get their host's: ``block`` if its distrust exceeds its
    trust by more than ``margin`` * (1 - damping), as if rules blocked more than that share of an
    unlinked host's pages; else ``allow``. Seeds are the shares of a host's pages that rules allow
    and block; of a host that is linked but has no pages, the shares of its linked URLs. A null url, or one without ``://``, has empty host and path, fits no rule and is
    allowed. Null html has no links. Null ids are kept, repeated rows each give their row, an empty
    table gives none; other columns are ignored.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    placed = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    shares = [share("allow").alias("trusted"), share("block").alias("blocked")]
    crawled = saved(placed.where("host <> ''").groupBy("host").agg(*shares), "seeds")
    links = saved(host_links(pages, url_col, html_col), "links")
    linked = links.select(F.col("dst").alias("host"), "path").distinct().join(crawled, "host", "left_anti")
    seeds = linked.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).groupBy("host").agg(*shares)
    ranks = spread(saved(crawled.unionByName(seeds), "hosts"), saved(links.select("src", "dst").distinct(), "edges"), damping)
    bad = ranks.where(F.col("distrust") - F.col("trust") > margin * (1 - damping)).select("host", F.lit("block").alias("spread"))
    judged = placed.join(bad, "host", "left")
    return judged.select(id_col, "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", "spread", F.lit("allow")).alias("verdict"))
