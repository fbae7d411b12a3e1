"""JSON that models return, metadata maps, section names and anchors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import vocabulary as V
from quarrylight.functions.text import contains_any, let, text_of

LINK_KEYS = ["links", "org_unit_pages", "faculty_links", "urls"]
#: What a rich profile page speaks of.
PROFILE_SECTIONS = ["研究方向", "教育经历", "工作经历", "个人简介", "代表性论文", "research interests", "education", "publications"]


def json_object(text: Column) -> Column:
    """The JSON object or list in a text, as written: the whole text, a fenced block, or what its outer braces hold."""
    whole = F.btrim(text_of(text))
    fenced = F.regexp_extract(whole, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    valid = lambda t: F.when((t != "") & F.get_json_object(t, "$").isNotNull() & t.rlike(r"^\s*[\[{]"), t)
    return F.coalesce(valid(whole), valid(F.btrim(fenced)), valid(braced))


def json_links(text: Column) -> Column:
    """The URLs of a JSON answer: a list's, else those under the first of the link keys that holds a list; items are strings or have ``url``."""
    def items(raw: Column) -> Column:
        each = lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(x, "$.url")).otherwise(x)
        return F.when(raw.rlike(r"^\s*\["), F.transform(F.from_json(raw, "array<string>"), each))

    def find(body: Column) -> Column:
        keyed = [items(F.get_json_object(body, f"$.{k}")) for k in LINK_KEYS]
        return F.coalesce(items(body), *keyed, F.array().cast("array<string>"))

    return F.filter(F.transform(let(json_object(text), find), lambda x: F.btrim(x)), lambda x: x != "")


def merged_metadata(current: Column, incoming: Column) -> Column:
    """Two maps of string lists: NULL lists are skipped, lists join without repeats, single values are replaced."""
    kept = F.map_filter(incoming, lambda k, v: v.isNotNull())
    return F.map_zip_with(current, kept, lambda k, a, b: F.when(b.isNull(), a).when(a.isNull() | (F.size(b) <= 1) & (F.size(a) <= 1), b).otherwise(F.array_union(a, b)))


def section_prefix(path: Column) -> Column:
    """The folder a page leads: its path without a page extension, else its parent, else itself."""
    low = F.lower(F.btrim(text_of(path)))
    led = F.regexp_extract(low, r"^(.*/[^/]+)\.(?:htm|html|shtml)$", 1)
    bare = F.regexp_extract(low, r"^([^/]+)\.(?:htm|html|shtml)$", 1)
    parent = F.regexp_extract(low, r"^(.+)/[^/]*$", 1)
    return F.when(led != "", led).when(bare != "", F.concat(F.lit("/"), bare)).when(parent != "", parent).otherwise(low)


def anchor_name(text: Column) -> Column:
    """An anchor's text without title words, for matching names."""
    low = F.lower(F.btrim(text_of(text)))
    words = sorted({w.lower() for _, ws in V.TITLES for w in ws}, key=lambda w: (-len(w), w))
    for w in words:
        low = F.replace(low, F.lit(w), F.lit(" "))
    return F.btrim(F.regexp_replace(low, r"(?U)\s+", " "))


def is_section_name(name: Column) -> Column:
    """Whether a unit's name is that of a department within a school; teaching centres and ``院系`` aren't."""
    compact = F.regexp_replace(text_of(name), r"(?U)\s+", "")
    centre = contains_any(name, next(words for kind, words in V.EXCLUDED_UNITS if kind == "teaching_experiment_center"))
    return ~centre & F.endswith(compact, F.lit("系")) & (compact != "院系")


def source_prefix(path: Column) -> Column:
    return F.substring(F.sha1(F.lower(path)), 1, 16)


def is_rich_profile(text: Column, url: Column, detail: Column, is_profile_url: Column) -> Column:
    """Whether a failed page looks like a full profile, so that it is worth another try."""
    titles = [w for _, ws in V.TITLES for w in ws]
    return detail & (F.length(F.btrim(text_of(text))) >= 160) & (text_of(url) != "") & is_profile_url & contains_any(text, PROFILE_SECTIONS) & contains_any(text, titles)


def retired_or_postdoc(text: Column) -> Column:
    return contains_any(text, [*V.RETIRED, "博士后", "postdoc"])


def pagination_links(links: Column, current: Column, seen: Column) -> Column:
    """Of a page's links, those on its own host that look like further pages of it and weren't seen, in order, each once."""
    host = lambda u: F.lower(F.parse_url(u, F.lit("HOST")))
    return F.filter(F.array_distinct(links), lambda u: (u != current) & ~F.array_contains(seen, u) & (host(u) == host(current)) & u.rlike(V.PAGINATION))


def name_links(text: Column) -> Column:
    """(name, url) of markdown links whose text is short enough to be a name."""
    found = F.regexp_extract_all(text_of(text), F.lit(r"\[([^\]\n]{1,40}\]\([^)\s]+)\)"), F.lit(1))
    parts = F.transform(found, lambda m: F.struct(F.btrim(F.substring_index(m, "](", 1)).alias("name"), F.btrim(F.substring_index(m, "](", -1)).alias("url")))
    return F.filter(parts, lambda p: (p["name"] != "") & (p["url"] != ""))


def compact_payload(fields: dict[str, Column], limit: int) -> Column:
    """A JSON object of texts, each cut in its middle to about ``limit`` characters."""
    cut = lambda c: F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit // 2), F.lit(" ... "), F.right(c, F.lit(limit // 2)))).otherwise(c)
    return F.to_json(F.struct(*[cut(text_of(c)).alias(k) for k, c in fields.items()]))
