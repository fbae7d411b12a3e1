"""Main text of web pages: the best contiguous region by word and tag scores."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.labelled_pages import PAGES

# Element names of the HTML standard, by what they do to text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
NEVER = frozenset("head script style noscript template iframe object svg math canvas audio video button select option textarea input label fieldset dialog nav footer aside menu search title xmp noframes".split())
#: Parts of class names count whole and by so many letters at their start.
STEM = 6
HOME = frozenset("html body main article".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|([^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[a-z]+")
#: Class names that say what an element has or is about, not what it is.
MODIFIER = re.compile(r"(?:with|without|has|have|no|not|tag|category|cat)[-_].*|.*[-_](?:enabled|disabled)")


class Piece(NamedTuple):
    """A run of text (``kind`` is its context) or a tag (``kind`` is ``tag``)."""

    kind: str
    text: str
    words: int
    breaks: bool  # a block begins before it


def _marked(name: str, attributes: str) -> bool:
    """Whether an element isn't part of an article whatever it holds, by its name or hiding."""
    if name in NEVER:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _name_parts(attributes: str) -> list[str]:
    """The words of an element's class, id and role, without those that say what it has or is about, and their stems."""
    out = []
    for key, value in ATTRIBUTE.findall(attributes or ""):
        if key.lower() in ("class", "id", "role"):
            words = [w for w in value.strip("\"'").lower().split() if not MODIFIER.fullmatch(w)]
            for part in (part for w in words for part in PART.findall(w)):
                out += [part, part[:STEM] + "*"] if len(part) > STEM else [part] if len(part) < STEM else [part, part + "*"]
    return out


def fit_names(pages: list[tuple[str, str]]) -> dict[str, float]:
    """Weights of class name parts from labelled pages: how often the text of the innermost element
    with a class is content (towards 1) or not (towards -1)."""
    inside: Counter = Counter()
    seen: Counter = Counter()
    for page, content in pages:
        lines, stack = set(content.split("\n")), []
        for token in TOKEN.finditer(page):
            name = (token[2] or token[5] or "").lower()
            if token[7] is not None:
                words = " ".join(html.unescape(token[7]).split())
                parts = next((p for _, p in reversed(stack) if p), [])
                for part in set(parts) if words else ():
                    seen[part] += 1
                    inside[part] += any(words in line for line in lines)
            elif name and (token[1] or token[4]):
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                del stack[len(stack) if at is None else at :]
            elif name and name not in VOID:
                stack.append((name, _name_parts(token[3] or token[6])))
    return {part: 2 * (inside[part] + 0.1) / (n + 0.2) - 1 for part, n in seen.items()}


@functools.cache
def name_weights() -> dict[str, float]:
    return fit_names(PAGES)


def _named(name: str, attributes: str, nested: bool) -> bool:
    """Whether the class, id or role of an element, or its being a form, hint that it isn't part of an article.

    Articles have classes of all kinds; only one within another (``nested``) can be a comment or the like.
    """
    if name == "form":
        return True
    if not attributes or name in ("html", "body", "main") or name == "article" and not nested:
        return False
    weights = name_weights()
    return min((weights.get(part, 0.0) for part in _name_parts(attributes)), default=0.0) < -0.5


class Held(NamedTuple):
    """What an element, or the page outside of all that are left out, holds."""

    words: int = 0
    paragraphs: int = 0
    titles: int = 0

    def plus(self, words: int = 0, tag: str = "") -> Held:
        return Held(self.words + words, self.paragraphs + (tag == "p"), self.titles + (tag == "h1"))

    def since(self, start: Held) -> Held:
        return Held(*(x - y for x, y in zip(self, start, strict=True)))


def _wrappers(named: dict[int, Held], shown: Held) -> set[int]:
    """The elements (by place) that hold the page's text although their names hint otherwise.

    That is: nothing is shown without them; or they hold paragraphs and more words than are shown,
    where no paragraph is shown, or where the page's only main heading is among them.
    """
    titled, most = any(h.titles for h in named.values()), max(h.words for h in named.values())
    out = set()
    for at, h in named.items():
        if not h.words or h.words <= shown.words:
            continue
        alone = not shown.words and h.words == most
        lost = not shown.paragraphs and (h.titles or not titled)
        if alone or h.paragraphs and (lost or h.titles and not shown.titles):
            out.add(at)
    return out


def pieces_of(page: str) -> list[Piece]:
    """Tags and runs of text in page order, each text with its context.

    Contexts: ``off`` (in an element that isn't part of an article), ``article`` (in article or
    main), ``link``, ``plain``, and on pages with an article or main element ``outside``. An element
    that is off only by a class, id or role, or as a form, is not if it wraps the page's text.
    """
    out, named, shown = _pieces(page, set())
    if named and (wrappers := _wrappers(named, shown)):
        out, _, _ = _pieces(page, wrappers)
    return out


def _pieces(page: str, wrappers: set[int]) -> tuple[list[Piece], dict[int, Held], Held]:
    """``pieces_of`` with the elements at ``wrappers`` on; and what each that is off by name, and the shown rest, holds."""
    out: list[Piece] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, off, off for good, place if off by name
    off = firm = home = link = articles = 0
    named: dict[int, Held] = {}  # from the element's start on, until it ends
    held: Counter = Counter()  # how many elements of a name are open: a stray closing tag needs no search
    seen, shown = Held(), Held()
    has_home = False
    breaks = True
    raw = ""
    texts: dict[int, list[str]] = {}  # the runs of each text, joined once at the end
    at, end = 0, len(page)
    closed = page.rfind(">")  # nothing after the last ">" is a tag, so no more is looked for
    while at < end:
        if raw:
            close = re.compile(rf"</{raw}[\s/>]", re.I).search(page, at)
            at, raw = (close.start() if close else end), ""
            continue
        place = at
        if at > closed:
            text, at = page[at:].partition("<!--")[0], end
        else:
            token = TOKEN.match(page, at)
            text, at = token[7], token.end()
        if text is not None:
            if not firm:
                n = len(text.split())
                seen, shown = seen.plus(n), shown if off else shown.plus(n)
            if out and out[-1].kind not in ("tag", "br") and not breaks:
                texts[len(out) - 1].append(text)
            else:
                kind = "off" if off else "article" if home else "link" if link else "plain"
                texts[len(out)] = [text]
                out.append(Piece(kind, "", 0, breaks))
                breaks = False
            continue
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue  # comments and declarations part nothing
        closing, attributes = bool(token[1] or token[4]), token[3] if token[2] else token[6]
        if name in BLOCK:
            breaks = True
        if closing:
            if held[name]:
                opened = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                for gone, was_off, was_firm, since in stack[opened:]:
                    held[gone] -= 1
                    off, firm, home, link, articles = off - was_off, firm - was_firm, home - (gone in ("article", "main")), link - (gone == "a"), articles - (gone == "article")
                    if since >= 0:
                        named[since] = seen.since(named[since])
                del stack[opened:]
        elif name in VOID:
            if name == "br":
                out.append(Piece("br", " ", 0, False))
                continue
        else:
            is_firm = _marked(name, attributes or "") or name == "header" and not home
            by_name = not is_firm and place not in wrappers and _named(name, attributes or "", articles > 0)
            is_off = is_firm or by_name
            if name in ("article", "main") and not is_off and off:
                # an unclosed menu or notice ends where the article begins
                stack = [(n, False, False, since) for n, _, _, since in stack]
                off = firm = 0
            if not (attributes or "").rstrip().endswith("/") or name in HOME:
                if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                    gone, was_off, was_firm, since = stack.pop()
                    held[gone] -= 1
                    off, firm = off - was_off, firm - was_firm
                    if since >= 0:
                        named[since] = seen.since(named[since])
                stack.append((name, is_off, is_firm, place if by_name else -1))
                held[name] += 1
                if by_name:
                    named[place] = seen
                off, firm, home, link, articles = off + is_off, firm + is_firm, home + (name in ("article", "main")), link + (name == "a"), articles + (name == "article")
                has_home |= name in ("article", "main") and not off
                if name in RAW:
                    raw = name
                if not firm:
                    seen, shown = seen.plus(0, name), shown if off else shown.plus(0, name)
        out.append(Piece("tag", name, 0, False))
    for *_, since in stack:
        if since >= 0:
            named[since] = seen.since(named[since])
    for k, runs in texts.items():
        out[k] = out[k]._replace(text="".join(runs))
    if has_home:
        out = [p._replace(kind="outside") if p.kind in ("plain", "link") else p for p in out]
    return [p if p.kind in ("tag", "br") else p._replace(words=len(p.text.split())) for p in out], named, shown


class Weights(NamedTuple):
    words: dict[str, float]
    tags: dict[str, float]


def fit_weights(pages: list[tuple[str, str]]) -> Weights:
    """Weights from labelled pages (html, main text): words score by how often their context is
    content, tags by minus the share of their occurrences outside of it."""
    inside: Counter = Counter()
    seen: Counter = Counter()
    for page, content in pages:
        lines = set(content.split("\n"))
        found = pieces_of(page)
        kept = [p.kind not in ("tag", "br") and bool(p.text.strip()) and any(" ".join(html.unescape(p.text).split()) in line for line in lines) and p.kind != "off" for p in found]
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        for k, p in enumerate(found):
            name, n = ("tag:" + p.text, 1) if p.kind in ("tag", "br") else (p.kind, p.words)
            seen[name] += n
            inside[name] += n * (kept[k] if p.kind not in ("tag", "br") else first <= k <= last)
    share = {name: (inside[name] + 0.5) / (n + 1) for name, n in seen.items()}
    words = {name: 2 * s - 1 for name, s in share.items() if not name.startswith("tag:")}
    tags = {name[4:]: -0.1 * (1 - s) for name, s in share.items() if name.startswith("tag:")}
    return Weights(words, tags)


@functools.cache
def default_weights() -> Weights:
    return fit_weights(PAGES)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of greatest sum, as a half-open range; empty if no score is positive.

    Of equal sums the longest that starts first wins, so nothing neutral at its ends is lost.
    """
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += score
        if total > best or total == best and best > 0 and start == best_at[0]:
            best, best_at = total, (start, k + 1)
    return best_at


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The main text of a page, one line per block; empty if there is none.

    The region is found by a linear scan over all tags and texts. What is within it is kept, but
    for elements that aren't part of an article. Character references are decoded, white space in
    a block becomes one space, and <br> counts as white space.
    """
    if not page:
        return ""
    weights = weights or default_weights()
    found = [p for p in pieces_of(page) if p.kind != "tag" or p.text]
    homely = any(p.kind == "article" for p in found)
    # notices within an article are left out without parting it
    inner = _inside(found) if homely else [False] * len(found)
    scores = [
        weights.tags.get(p.text, -0.05) if p.kind == "tag" else 0.0 if p.kind == "br" or p.kind == "off" and inner[k] else p.words * weights.words.get(p.kind, 0.0)
        for k, p in enumerate(found)
    ]
    first, last = best_region(scores)
    blocks: list[str] = []
    fresh = True
    for p in found[first:last]:
        if p.kind == "tag":
            fresh |= p.text in BLOCK
        elif p.kind == "br":
            if blocks:
                blocks[-1] += " "
        elif p.kind in ("article", "plain", "link"):
            if fresh or p.breaks or not blocks:
                blocks.append(p.text)
            else:
                blocks[-1] += p.text
            fresh = False
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def _inside(found: list[Piece]) -> list[bool]:
    """Whether a piece lies between the first and the last article text."""
    at = [k for k, p in enumerate(found) if p.kind == "article"]
    return [at[0] < k < at[-1] for k in range(len(found))]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id_col, url_col, text, n_chars (code points of the text).

    Null or empty html, and pages without main text, give the empty string. Null ids and urls are
    kept, repeated rows each give their row, an empty table gives none; other columns are ignored.
    Whole pages are read, whatever their length.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {id_type}, url {url_type}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
