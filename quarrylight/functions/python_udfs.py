"""What built-in functions can't express: fuzzy ratios, JSON repair, token budgets."""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from quarrylight.functions import vocabulary as V

# a latin token to its last character that isn't trimmed; letters whose lower case is of ASCII, but who aren't, part tokens
_LATIN, _CJK, _PART = re.compile(r"([a-z](?:[a-z0-9_+\-.]*[a-z0-9+\-]))[_.]*"), re.compile(V.CJK_RUN), re.compile("[\u0130\u212a]")


def term_counts_of(text: str, longest: int = 6) -> Counter:
    """The terms of one text, as ``tokenize`` gives them, and how often it has each."""
    runs = () if text.isascii() else _CJK.findall(text)
    counts = Counter(_LATIN.findall((text if text.isascii() else _PART.sub(" ", text)).lower()))
    for run in runs:
        n = len(run)
        if 2 <= n <= 12:
            counts[run] += 1
        counts.update(run[at : at + size] for size in range(2, min(longest, n) + 1) for at in range(n - size + 1))
    for word in V.STOP_TERMS:
        counts.pop(word, None)
    return counts


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, which is not an edit distance."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def repaired(text: str | None) -> str | None:
    """The JSON object in a text: as it is, else without fence, trailing commas and raw line ends, with
    missing closers added; NULL if there is none."""
    if not text or "{" not in text:
        return None
    raw = text[text.index("{") :]
    for cut in (raw, raw[: raw.rfind("}") + 1]):
        try:
            return json.dumps(json.loads(cut), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            pass
    out, closers, inside, escaped = [], [], False, False
    for c in raw:
        if inside:
            if c in "\n\r\t" and not escaped:
                out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
                continue
            escaped = c == "\\" and not escaped
            inside = not (c == '"' and (len(out) and out[-1] != "\\" or not out))
        elif c == '"':
            inside = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closers or closers[-1] != c:
                continue
            closers.pop()
        out.append(c)
        if not closers and not inside:
            break
    body = "".join(out) + ('"' if inside else "") + "".join(reversed(closers))
    try:
        return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", body)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


def chunks(text: str, budget: int) -> list[str]:
    """Paragraphs packed into chunks of at most ``budget`` white-space tokens; longer ones are cut."""
    out, held, room = [], [], budget
    for paragraph in (p for p in re.split(r"\n\s*\n", text) if p.strip()):
        words = paragraph.split()
        if len(words) <= room:
            held.append(paragraph.strip())
            room -= len(words)
            continue
        if held:
            out.append("\n\n".join(held))
            held, room = [], budget
        if len(words) <= budget:
            held, room = [paragraph.strip()], budget - len(words)
        else:
            out += [" ".join(words[k : k + budget]) for k in range(0, len(words), budget)]
    return out + (["\n\n".join(held)] if held else [])


def chunk_text(budget: int):
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t or "", budget))

    return run


@F.pandas_udf(StringType())
def repair_mojibake(texts: pd.Series) -> pd.Series:
    """UTF-8 Chinese text that was read as Latin-1, put right; other texts as they are."""

    def fix(text: str | None) -> str | None:
        if not text or not re.search("[À-ÿ]", text):
            return text
        try:
            fixed = text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return text
        return fixed if re.search("[一-鿿]", fixed) else text

    return texts.map(fix)
