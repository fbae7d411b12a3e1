"""Table functions over captured pages: links with structural signals, form pagination, plain text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrylight.sources.tables import spread

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTEXT = ("nav", "menu", "tab", "tree", "list", "ul", "ol")
SKIPPED = {"script", "style", "head"}
BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ul", "ol", "table", "footer", "header", "nav"}


def absolute(href: str, base: str) -> str:
    """An absolute http(s) URL without fragment; empty for anything else or with control or angle characters."""
    if not href or re.search(r"[\x00-\x1f<>]", href):
        return ""
    try:
        url = urldefrag(urljoin(base, href.strip()))[0]
        parsed = urlparse(url)
    except ValueError:
        return ""
    return url if parsed.scheme in ("http", "https") and parsed.netloc else ""


class Links(HTMLParser):
    """Anchors in order, each with the heading before it and up to four navigation elements around it."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict] = []
        self.open: list[str] = []
        self.anchor: dict | None = None
        self.heading: list[str] | None = None
        self.last_heading = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        label = (values.get("class", "").split() or [values.get("id", "").strip()])[0].lower()
        if tag in HEADINGS:
            self.heading = []
        if tag == "a" and values.get("href", "").strip():
            near = [e for e in reversed(self.open) if any(w in e for w in CONTEXT)][:4]
            self.anchor = {"href": values["href"].strip(), "heading": self.last_heading, "context": near or ["a"], "text": [], "order": len(self.found) + 1}
        self.open.append(f"{tag}.{label}" if label else tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.anchor:
            self.found.append(self.anchor)
            self.anchor = None
        if tag in HEADINGS and self.heading is not None:
            self.last_heading, self.heading = " ".join("".join(self.heading).split()), None
        if self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.anchor:
            self.anchor["text"].append(data)
        if self.heading is not None:
            self.heading.append(data)


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per distinct link of a page: id, url, anchor_text, heading_text, context, link_order.

    Of a link's repeats the first counts; its anchor text is the longest among them.
    """
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, url, html in part.itertuples(index=False):
                parser = Links()
                parser.feed(html or "")
                seen: dict[str, list] = {}
                for a in parser.found:
                    target, text = absolute(a["href"], url or ""), " ".join("".join(a["text"]).split())
                    if not target:
                        continue
                    if target in seen:
                        seen[target][2] = max(seen[target][2], text, key=len)
                    else:
                        seen[target] = [key, target, text, a["heading"], a["context"], a["order"]]
                rows += seen.values()
            yield pd.DataFrame(rows, columns=["id", "url", "anchor_text", "heading_text", "context", "link_order"])

    cut = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return cut.mapInPandas(run, f"id {id_type}, url string, anchor_text string, heading_text string, context array<string>, link_order int")


def hrefs(html: Column) -> Column:
    """The href values of a page's anchors, in order, natively."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"<a [^>]*?href=\"([^\"]*)\""), F.lit(1))


# How scripted anchors set a form's page field and send it, the field that jumps to any page, and
# the URL parameters that say which page this is.
_FORM = r"(?:document\.)?(?:forms(?:\.|\[\s*['\"]))?([A-Za-z_]\w*)(?:['\"]\s*\])?"
ASSIGN = _FORM + r"\.([A-Za-z_]\w*)\.value\s*=\s*['\"]?(\d+)"
SUBMIT = _FORM + r"\.submit\("
GOTO = r"(?i)^(\w*?)GOPAGE$"
PAGE_KEYS = "pagenum|page|p|pn|fromwennowpage"


def form_pagination(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each other page that a form of a captured page can be sent for.

    Columns: id, form, field, page_index, total_pages, synthetic_url. The pages that scripted anchors
    assign are summed up per form and field; where an input jumps to any page of that field, all up
    to the largest count. The first page and the current one (marked in the text, else named by the
    URL, else the first) are left out. Pages are dealt out evenly before they are read.
    """
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))

    def attribute(tag: str, name: str) -> Column:
        """Values in double quotes, then those in single ones; a script may hold the other kind."""
        quoted = lambda q: F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*?\b{name}\s*=\s*{q}([^{q}]+){q}"), F.lit(1))
        return F.transform(F.concat(quoted('"'), quoted("'")), lambda v: F.regexp_replace(F.regexp_replace(v, "&#39;|&apos;", "'"), "&quot;|&#34;", '"'))

    marked = F.nullif(F.regexp_extract(html, r"(?is)<span\b[^>]*this-page[^>]*>\s*(\d+)\s*<", 1), F.lit(""))
    named = F.nullif(F.regexp_extract(url, rf"(?i)[?&](?:{PAGE_KEYS})=0*([1-9]\d*)(?:[&#]|$)", 1), F.lit(""))
    read = spread(pages.select(*dict.fromkeys([id_col, url_col, html_col]))).select(
        F.col(id_col).alias("id"), F.regexp_replace(url, "#.*$", "").alias("base"), F.coalesce(marked, named, F.lit("1")).cast("int").alias("here"),
        attribute("input", "name").alias("inputs"), F.explode(attribute("a", "href")).alias("script"),
    )
    part = lambda k: F.regexp_extract("script", ASSIGN, k)
    sent = F.regexp_extract("script", SUBMIT, 1)
    set_to = read.select("id", "base", "here", "inputs", part(1).alias("form"), part(2).alias("field"), part(3).try_cast("int").alias("page"), sent.alias("sent")).where("page > 0 and (sent = '' or sent = form)")
    jumps = F.exists("inputs", lambda n: n.rlike(GOTO) & F.lower(F.col("field")).startswith(F.lower(F.regexp_extract(n, GOTO, 1))))
    forms = set_to.withColumn("jumps", jumps).groupBy("id", "base", "here", "form", "field").agg(F.max("page").alias("total_pages"), F.collect_set("page").alias("set"), F.bool_or("jumps").alias("jumps"))
    listed = forms.withColumn("page_index", F.explode(F.when(F.col("jumps"), F.sequence(F.lit(1), "total_pages")).otherwise(F.col("set")))).where("page_index > 1 and page_index <> here")
    synthetic = F.concat("base", F.when(F.contains("base", F.lit("?")), "&").otherwise("?"), F.lit("form="), "form", F.lit("&field="), "field", F.lit("&to="), F.col("page_index").cast("string"))
    return listed.select("id", "form", "field", "page_index", "total_pages", synthetic.alias("synthetic_url"))


class PlainText(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in SKIPPED
        if tag in BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in SKIPPED and self.skip > 0
        if tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(" ".join(data.split()) if data.strip() else " ")


def plain_text(html: str) -> str:
    parser = PlainText()
    parser.feed(html or "")
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    """A page's text without scripts and styles, a line for each block."""
    return pages.map(plain_text, na_action="ignore")
