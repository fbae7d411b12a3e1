"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field works on the rest: a candidate segment is a run of tokens
that scores as a whole, by features of its shape, its digits, its check sums and its neighbours, for
each kind. Dynamic programming over segment ends, with segments of bounded length, chooses boundaries
and kinds jointly; text outside has score zero. A candidate holds a token with a digit, an ``@`` or a
bracketed "at", or it follows a form of address, so only windows around these have to be read: the
best segmentation of a text is that of its windows side by side. Weights are fitted by maximum
likelihood on the sentences of ``labelled_spans.py``.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarrylight.llm.labelled_spans import KINDS, labelled

BASE = KINDS[:4]
#: Bounds of a segment: tokens and characters; a single token may be longer, and a feature reads no more of it.
MAX_TOKENS, MAX_CHARS = 16, 64
#: Tokens wholly within so many characters beside a segment are its neighbours.
NEAR = 24
#: What is read on both sides of a token that can start a candidate: a form of address, a neighbour and a segment fit.
WINDOW = 128

TOKEN = re.compile(r"\w+|[^\w\s]")
TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]")
#: Forms of address and name labels. Fixed values.
ADDRESS = "Mr Mrs Ms Dr Herr Frau Monsieur Madame Mme Señor Señora Sr Sra name Name".split()
ADDRESSED = re.compile(r"(?<!\w)(?:" + "|".join(ADDRESS) + r")(?!\w)")

# -- base spans --------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does, so the look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, found from the signs: each character is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the four patterns, each kind for itself, by start and then kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# -- candidate segments and their features -----------------------------------------------------------


@dataclass
class Lattice:
    """The tokens of a window and its candidates as (first token, end token, text).

    ``before`` and ``behind`` are the features of what stands left of a first and right of a last token.
    """

    tokens: list[tuple[int, int]]
    segments: list[tuple[int, int, str]]
    before: dict[int, list[str]]
    behind: dict[int, list[str]]

    def features(self, k: int) -> list[str]:
        i, j, span = self.segments[k]
        return inner(span) + self.before[i] + self.behind[j]


def shape(s: str) -> str:
    """Runs of digits, capitals and small letters as one sign each; other characters stay."""
    kind = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "9", s[:MAX_CHARS]))
    return re.sub(r"(9|A|a|\s)\1+", r"\1", kind)


def _bucket(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def _checks(s: str) -> Iterator[str]:
    """Whole-span tests of numbers."""
    digits = re.sub(r"[^0-9]", "", s)
    yield f"digits={_bucket(len(digits), (1, 3, 5, 7, 9, 12, 16, 17, 20))}"
    if 12 <= len(digits) <= 19:
        yield f"luhn={luhn(digits)}"
    packed = s.replace(" ", "")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", packed):
        number = "".join(str(int(c, 36)) for c in packed[4:] + packed[:4])
        yield f"mod97={int(number) % 97 == 1}"
    if m := re.fullmatch(r"([0-9]{1,4})([./-])([0-9]{1,2})\2([0-9]{1,4})", s):
        yield f"date={int(m[3]) <= 12 and max(len(m[1]), len(m[4])) == 4}"
    if re.fullmatch(r"[0-9a-fA-F:]+", s) and s.count(":") >= 2:
        yield f"colons={min(s.count(':'), 8)},{'::' in s}"
    if re.fullmatch(r"[0-9]+(?:\W{1,2}[0-9]+)*", s.lstrip("(")):
        yield "groups=" + ",".join(str(min(len(g), 7)) for g in re.findall(r"[0-9]+", s)[:6])


def inner(s: str) -> list[str]:
    """What is known of a segment as a whole, from its own text."""
    words = TOKEN.findall(s)
    out = ["bias", f"shape={shape(s)}", f"n={_bucket(len(words), (2, 3, 4, 6, 9, 13))}", f"size={_bucket(len(s), (4, 8, 12, 16, 20, 24, 32, 40, 48))}", *_checks(s)]
    if len(words) == 1:  # letters and digits in one token
        mixed = bool(re.search(r"[0-9]", s)) + 2 * bool(re.search(r"[a-z]", s)) + 4 * bool(re.search(r"[A-Z]", s)) + 8 * (len(s) >= 16)
        out.append(f"mixed={mixed},{not re.search(r'[^0-9a-fA-F]', s)}")
    if re.fullmatch(r"(?:[^\W\d_]|[. ])+", s):
        out.append(f"capital={sum(w[0].isupper() for w in words)},{sum(w != '.' for w in words)},{words[-1] == '.'}")
    return out + [f"in={w.lower()}" for w in set(words) if w.isalpha() and len(w) < 4] + ["in=@"] * ("@" in words)


def left_of(text: str, tokens: list[tuple[int, int]], i: int) -> list[str]:
    start, k, near = tokens[i][0], i - 1, []
    while k >= 0 and tokens[k][0] >= start - NEAR and "\n" not in text[tokens[k][1] : start]:
        near.append(text[slice(*tokens[k])].lower())
        k -= 1
    out = [f"left={near[0] if near else '^'}", f"left2={' '.join(near[1::-1]) if near else '^'}", f"joined={start > 0 and not text[start - 1].isspace()}"]
    return out + [f"near={w}" for w in set(near) if w.isalpha()]


def right_of(text: str, tokens: list[tuple[int, int]], j: int) -> list[str]:
    end = tokens[j - 1][1]
    after = text[slice(*tokens[j])].lower() if j < len(tokens) and tokens[j][1] <= end + NEAR else "$"
    return [f"right={after}", f"joins={end < len(text) and not text[end].isspace()}"]


def lattice(text: str, tokens: list[tuple[int, int]], taken: list[tuple[int, int, str]]) -> Lattice:
    """Candidates: bounded runs on one line, no white space beyond single spaces, clear of base spans."""
    words = [text[a:b] for a, b in tokens]
    starts = [bool(TRIGGER.search(w)) or bool(TRIGGER.match(text, a)) for w, (a, _) in zip(words, tokens, strict=True)]
    closed = [any(a < e and s < b for s, e, _ in taken) for a, b in tokens]
    ends = [w[-1].isalnum() or w[-1] == "_" for w in words]
    lat = Lattice(tokens, [], {}, {})
    for i, (a, _) in enumerate(tokens):
        if closed[i] or not (words[i][0].isalnum() or words[i] in "(+"):
            continue
        addressed = words[i][0].isupper() and any(w in ADDRESS for w in words[max(0, i - 3) : i])
        held = False
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            b = tokens[j - 1][1]
            if closed[j - 1] or j - i > 1 and (b - a > MAX_CHARS or text[tokens[j - 2][1] : tokens[j - 1][0]] not in ("", " ")):
                break
            held = held or starts[j - 1]
            if ends[j - 1] and (held or addressed and j - i <= 5):
                lat.segments.append((i, j, text[a : min(b, a + 4 * MAX_CHARS)]))
                if i not in lat.before:
                    lat.before[i] = left_of(text, tokens, i)
                if j not in lat.behind:
                    lat.behind[j] = right_of(text, tokens, j)
    return lat


def windows(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Stretches outside of which no candidate lies, merged where they meet."""
    begin = end = None
    for at in _seeds(text, taken):
        if begin is not None and at[0] - WINDOW <= end:
            end = max(end, at[1] + WINDOW)
            continue
        if begin is not None:
            yield max(0, begin), min(len(text), end)
        begin, end = at[0] - WINDOW, at[1] + WINDOW
    if begin is not None:
        yield max(0, begin), min(len(text), end)


WORD = re.compile(r"\w*")


def _seeds(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Tokens with a trigger outside of base spans, and forms of address, in order."""
    found, pos, covered = [], 0, 0
    cover = sorted((s, e) for s, e, _ in taken)
    while m := TRIGGER.search(text, pos):
        while covered < len(cover) and cover[covered][1] <= m.start():
            covered += 1
        if covered < len(cover) and cover[covered][0] <= m.start():
            pos = max(m.end(), cover[covered][1])
            continue
        start, end = m.start(), WORD.match(text, m.end()).end()
        while start > pos and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        found.append((start, end))
        pos = end
    found += [m.span() for m in ADDRESSED.finditer(text)]
    return iter(sorted(found))


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The tokens that lie wholly in a window; one that its edges cut is left out."""
    while 0 < start < end and _inside(text, start):
        start += 1
    while start < end < len(text) and _inside(text, end):
        end -= 1
    return [m.span() for m in TOKEN.finditer(text, start, end)]


def _inside(text: str, at: int) -> bool:
    return all(c.isalnum() or c == "_" for c in text[at - 1 : at + 1])


# -- the field ---------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of features by kind, and of a kind after another (0: outside)."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def __post_init__(self):
        self.of_span = functools.lru_cache(1 << 16)(lambda span: self.total(inner(span)))

    def __getstate__(self):
        return self.index, self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def total(self, names: list[str]) -> np.ndarray:
        return self.weights[[self.index[f] for f in names if f in self.index]].sum(0)

    def decode(self, lat: Lattice) -> list[tuple[int, int, str]]:
        """The best segmentation: boundaries and kinds at once."""
        if not lat.segments:
            return []
        n, kinds = len(lat.tokens), len(KINDS) + 1
        left = {i: self.total(names) for i, names in lat.before.items()}
        right = {j: self.total(names) for j, names in lat.behind.items()}
        ending = [[] for _ in range(n + 1)]
        for i, j, span in lat.segments:
            ending[j].append((i, span))
        best = np.full((n + 1, kinds), -np.inf)
        best[0, 0] = 0
        into, source = np.empty((n + 1, kinds)), np.empty((n + 1, kinds), int)  # by the kind that follows
        chosen = np.zeros((n + 1, kinds), int)  # where the best segment that ends here begins
        for j in range(n + 1):
            if j:
                best[j, 0] = into[j - 1, 0]
                if ending[j]:
                    begins = np.array([i for i, _ in ending[j]])
                    scores = into[begins, 1:] + np.stack([self.of_span(span) + left[i] for i, span in ending[j]])
                    best[j, 1:] = scores.max(0) + right[j]
                    chosen[j, 1:] = begins[scores.argmax(0)]
            step = best[j][:, None] + self.moves
            into[j], source[j] = step.max(0), step.argmax(0)
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i = chosen[j, y] if y else j - 1
            if y:
                out.append((lat.tokens[i][0], lat.tokens[j - 1][1], KINDS[y - 1]))
            j, y = i, source[i, y]
        return out[::-1]


def likelihood(lat: Lattice, scores: np.ndarray, moves: np.ndarray, gold: dict[tuple[int, int], int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the marked segmentation, and its derivatives by segment scores and moves.

    Sums are of plain products: the sentences are short, so these stay far within a double's range.
    """
    n, kinds = len(lat.tokens), len(KINDS) + 1
    ends, begins = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(lat.segments):
        ends[j].append(k)
        begins[i].append(k)
    gain, step = np.exp(scores), np.exp(moves)
    ahead, behind = np.zeros((n + 1, kinds)), np.ones((n + 1, kinds))
    ahead[0, 0] = 1
    into = np.zeros((n + 1, kinds))  # by the next segment's kind
    for j in range(n + 1):
        if j:
            ahead[j, 0] = into[j - 1, 0]
            for k in ends[j]:
                ahead[j, 1:] += into[lat.segments[k][0], 1:] * gain[k]
        into[j] = ahead[j] @ step
    for i in range(n - 1, -1, -1):
        out = np.zeros(kinds)
        out[0] = behind[i + 1, 0]
        for k in begins[i]:
            out[1:] += gain[k] * behind[lat.segments[k][1], 1:]
        behind[i] = step @ out
    whole = behind[0, 0]
    d_scores, d_moves = np.zeros_like(scores), np.zeros_like(moves)
    for i in range(n):
        out = np.zeros(kinds)
        out[0] = behind[i + 1, 0]
        for k in begins[i]:
            reached = gain[k] * behind[lat.segments[k][1], 1:]
            out[1:] += reached
            d_scores[k] -= into[i, 1:] * reached / whole
        d_moves -= step * np.outer(ahead[i], out) / whole
    value, at, last = 0.0, 0, 0
    number = {(i, j): k for k, (i, j, _) in enumerate(lat.segments)}
    stops = {i: (j, y) for (i, j), y in gold.items()}
    while at < n:
        j, y = stops.get(at, (at + 1, 0))
        value += moves[last, y]
        d_moves[last, y] += 1
        if y:
            value += scores[number[at, j], y - 1]
            d_scores[number[at, j], y - 1] += 1
        at, last = j, y
    return float(value - math.log(whole)), d_scores, d_moves


@functools.cache
def fitted(rounds: int = 40, least: int = 2, ridge: float = 0.02) -> Field:
    """Fit on the labelled sentences; features seen fewer than ``least`` times are left out."""
    made, count = [], {}
    for text, spans in labelled():
        base = base_spans(text)
        lat = lattice(text, tokens_of(text, 0, len(text)), base)
        first = {a: k for k, (a, _) in enumerate(lat.tokens)}
        last = {b: k + 1 for k, (_, b) in enumerate(lat.tokens)}
        known = {(i, j) for i, j, _ in lat.segments}
        held = [lat.features(k) for k in range(len(lat.segments))]
        gold = {(first[a], last[b]): KINDS.index(y) + 1 for a, b, y in spans if a in first and b in last and (first[a], last[b]) in known}
        made.append((lat, gold, held))
        for f in {f for names in held for f in names}:
            count[f] = count.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, c in count.items() if c >= least))}
    # the rows of the weights that each sentence's segments sum, one after the other, and where each begins
    rows = [[[index[f] for f in names if f in index] for names in held] for _, _, held in made]
    made = [(lat, gold, np.concatenate(r), np.cumsum([0, *map(len, r)])) for (lat, gold, _), r in zip(made, rows, strict=True) if r]
    field = Field(index, np.zeros((len(index), len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    sums = [np.zeros_like(field.weights), np.zeros_like(field.moves)]
    for _ in range(rounds):
        steps = [-ridge * field.weights, -ridge * field.moves]
        for lat, gold, used, cuts in made:
            _, d_scores, d_moves = likelihood(lat, np.add.reduceat(field.weights[used], cuts[:-1]), field.moves, gold)
            np.add.at(steps[0], used, np.repeat(d_scores, np.diff(cuts), 0))
            steps[1] += d_moves
        for value, step, total in zip((field.weights, field.moves), steps, sums, strict=True):
            total += step * step
            value += 0.5 * step / np.sqrt(total + 1e-6)
    return field


# -- texts and tables --------------------------------------------------------------------------------


def found_spans(text: str, field: Field) -> list[tuple[int, int, str, bool]]:
    """All spans by start, then kind: base ones, and those the field adds beside them."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    for start, end in windows(text, base):
        near = [s for s in base if s[0] < end and start < s[1]]
        out += [(*s, False) for s in field.decode(lattice(text, tokens_of(text, start, end), near))]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def span_finder(field: Field) -> Callable[[Column], Column]:
    @pandas_udf("array<struct<start:int,end:int,kind:string,base:boolean>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start", "end", "kind", "base"), s, strict=True)) for s in found_spans(t or "", field)])

    return spans


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """The rows with an array of spans (start, end in code points, kind, base).

    A null text is empty and has none. Each row is judged for itself, repeated ones alike; texts are
    read whole. A column of the input named as the result is replaced.
    """
    return docs.withColumn(into, span_finder(fitted())(F.col(f"`{text}`")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        upto = F.when(free, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), upto.alias("out"))

    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    spans = find_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
