"""Personal data, ranked search and fill-in-the-middle against plain forms of their definitions."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import fim, lexical, pii, queries
from quarrylight.llm.labelled_spans import KINDS, labelled

from .conftest import DATA

# -- personal data ---------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    """The patterns as they are written in the contract."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1234567890._%+-@() \né", max_size=60))
def test_base_spans_are_the_patterns_matches(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_hostile_texts_take_linear_time():
    for text in ("a@" * 200_000, "1" * 400_000, "1.1.1." * 100_000, "a" * 400_000 + "@", "+" * 200_000, "4 " * 200_000):
        pii.base_spans(text)
    assert pii.base_spans("x" * 300_000 + "@mail.example.com")[0][:2] == (0, 300_017)


def segmentations(lat):
    """All ways to part the tokens into candidates and outside tokens."""
    starts = collections.defaultdict(list)
    for k, (i, j, _) in enumerate(lat.segments):
        starts[i].append((j, k))

    def walk(at):
        if at == len(lat.tokens):
            yield []
            return
        for rest in walk(at + 1):
            yield [(None, 0), *rest]
        for j, k in starts[at]:
            for y in range(1, len(KINDS) + 1):
                for rest in walk(j):
                    yield [(k, y), *rest]

    return walk(0)


def value(parts, scores, moves):
    last, total = 0, 0.0
    for k, y in parts:
        total += moves[last, y] + (scores[k, y - 1] if y else 0)
        last = y
    return total


def test_decoding_and_likelihood_equal_enumeration():
    text = "tel 030 12x"
    lat = pii.lattice(text, pii.tokens_of(text, 0, len(text)), [])
    rng = np.random.default_rng(3)
    names = sorted({f for k in range(len(lat.segments)) for f in lat.features(k)})
    moves = rng.normal(size=(len(KINDS) + 1,) * 2)
    field = pii.Field({f: k for k, f in enumerate(names)}, rng.normal(size=(len(names), len(KINDS))), moves)
    scores = np.stack([field.total(lat.features(k)) for k in range(len(lat.segments))])
    every = [(value(p, scores, moves), p) for p in segmentations(lat)]
    top = max(every, key=lambda x: x[0])[1]
    want = [(lat.tokens[lat.segments[k][0]][0], lat.tokens[lat.segments[k][1] - 1][1], KINDS[y - 1]) for k, y in top if y]
    assert field.decode(lat) == want
    i, j, _ = lat.segments[0]
    gold = {(i, j): 4}
    marked = [(None, 0)] * i + [(0, 4)] + [(None, 0)] * (len(lat.tokens) - j)
    logs, d_scores, d_moves = pii.likelihood(lat, scores, moves, gold)
    whole = math.log(sum(math.exp(v) for v, _ in every))
    assert logs == pytest.approx(value(marked, scores, moves) - whole)
    step = 1e-5
    for at in ((0, 3), (len(scores) - 1, 0)):
        moved = scores.copy()
        moved[at] += step
        assert (pii.likelihood(lat, moved, moves, gold)[0] - logs) / step == pytest.approx(d_scores[at], abs=1e-3)
    moved = moves.copy()
    moved[0, 4] += step
    assert (pii.likelihood(lat, scores, moved, gold)[0] - logs) / step == pytest.approx(d_moves[0, 4], abs=1e-3)


def test_windows_give_what_the_whole_text_gives():
    field, rng = pii.fitted(), np.random.default_rng(5)
    lines = [t for t, _ in labelled(each=1, seed=21)]
    for _ in range(20):
        text = "".join(("lorem ipsum dolor sit amet " * int(rng.integers(0, 14))) + lines[int(k)] + rng.choice([" ", "\n"]) for k in rng.integers(0, len(lines), 5))
        base = pii.base_spans(text)
        whole = field.decode(pii.lattice(text, pii.tokens_of(text, 0, len(text)), base))
        assert [s[:3] for s in pii.found_spans(text, field) if not s[3]] == whole


HELD_OUT = """
Ring {phone:local} now
You may phone {phone:plain} or mail {email:at}
Telefon {phone:local} ab neun
Contact : {phone:pairs} ou {email:at}
my token = "{secret:hex}" leaked
api_key = '{secret:mixed}'
the IBAN is {account}
Konto {account:spaced} bitte
he was born on {birth}
geboren am {birth:dots}
Mr. {name} called
Mme {name} et Herr {name}
the card {card:dots} is lost
server {ip:six} is down
"""
CLEAN = ["Chapter 12 of 14, pages 100-120, was written in 1998.", "The build took 12:45 and 3.5 GB on version 2.4.1.", "Order 48213377 costs 1,299.00 in all.", "commit 3f2a9c4e5d6b7a8091a2b3c4d5e6f708192a3b4c broke it", "On 2021-03-04 we met 15 people at 9.", "5 + 7 = 12, and 3 * 4 = 12.", "Licensed under CC BY-NC 4.0.", "El 12/10/1992 fue lunes."]


def test_field_finds_held_out_spans_and_leaves_clean_text():
    field = pii.fitted()
    hit = missed = false = 0
    for text, spans in labelled(HELD_OUT, 10, 77):
        got = {s[:3] for s in pii.found_spans(text, field)}
        hit, missed, false = hit + len(got & set(spans)), missed + len(set(spans) - got), false + len(got - set(spans))
    assert hit >= 0.9 * (hit + missed) and hit >= 0.9 * (hit + false)
    assert [t for t in CLEAN if pii.found_spans(t, field)] == []


def test_op11_equals_plain_forms(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op11_personal_data"](spark, DATA).collect()}
    field = pii.fitted()
    for row in documents.collect():
        text, mine = row.text or "", got[row.doc_id]
        base = plain_base(text)
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert [mine[f"n_{k}"] for k in KINDS[:4]] == [sum(s[2] == k for s in base) for k in KINDS[:4]]
        assert mine.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        added = field.decode(pii.lattice(text, pii.tokens_of(text, 0, len(text)), base)) if len(text) < 3000 else [s[:3] for s in pii.found_spans(text, field) if not s[3]]
        assert mine.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))))
    assert len(got) == documents.count()


def test_personal_data_edges(spark, edges):
    rows = pii.find_spans(edges, into="spans").collect()
    assert len(rows) == edges.count() and all(r.spans == [] for r in rows)
    assert pii.find_spans(edges.limit(0)).count() == 0
    df = spark.createDataFrame([("é write ann@web.example.com, tel +1 (803) 555-5351!",), (None,)], "text string")
    out = pii.find_spans(df).select(pii.masked(df.text, pii.F.col("spans")).alias("m")).collect()
    assert [r.m for r in out] == ["é write [email], tel [phone]!", None]


# -- ranked search ---------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40).filter(lambda t: t.isprintable() or "\ud800" not in t))
def test_terms_are_the_patterns_matches(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in lexical.terms_of(text)] == TERM.findall(text.translate(LOW))


def plain_search(docs, asked, k):
    texts = [(key, TERM.findall((t or "").translate(LOW))) for key, t in docs]
    texts = [(key, t) for key, t in texts if t]
    n_docs, n_terms = len(texts), sum(len(t) for _, t in texts)
    df = collections.Counter(w for _, t in texts for w in set(t))
    out = []
    for item, text in asked:
        scored = []
        for key, t in texts:
            m, tf = 50 + 50 * len(t) * n_docs // n_terms, collections.Counter(t)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m)) for w in set(TERM.findall((text or "").translate(LOW))) if tf[w])
            scored += [(-s, key is not None, key or 0, key)] * (s > 0)
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("size, block", [(2_000_000, 128), (60, 4)])
def test_search_equals_brute_force_with_many_segments(spark, monkeypatch, size, block):
    """Small segments and blocks, so that thresholds, skipped blocks and pivots all come into play."""
    monkeypatch.setattr(lexical, "SEGMENT", size)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "QUERIES", 3)
    rng = np.random.default_rng(1)
    word = lambda: "w" + str(int(rng.zipf(1.3)) % 60)
    docs = [(int(k), " ".join(word() for _ in range(int(rng.integers(1, 40))))) for k in rng.permutation(300)]
    docs += [(5, docs[3][1]), (None, docs[4][1]), (900, None), (901, ""), (902, "... !"), (903, "w1 " * 70_000)]
    asked = [(k, " ".join(word() for _ in range(6))) for k in range(8)] + [(8, None), (9, "zzz unseen"), (1, "W3 w3 w4"), (None, "w1 w2")]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = lexical.search(index, spark.createDataFrame(asked, "item_id long, text string"), 10)
    rows = collections.Counter((r.item_id, r.rank, r.key, r.score) for r in got.collect())
    assert rows == collections.Counter(plain_search(docs, asked, 10))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300_000), min_size=1, max_size=400), st.integers(1, 70_000))
def test_blocks_round_trip(gaps, top):
    gaps = np.array(gaps)
    tfs = np.random.default_rng(top).integers(1, top + 1, len(gaps))
    first = np.arange(0, len(gaps), lexical.BLOCK)
    data, starts = lexical.compress(gaps, tfs, first)
    before = -1
    for b, at in enumerate(first):
        docs, counts = lexical.decompress(data.tobytes(), starts[b], starts[b + 1], before)
        assert docs.tolist() == (np.cumsum(gaps)[at : at + lexical.BLOCK] - 1).tolist() and counts.tolist() == tfs[at : at + lexical.BLOCK].tolist()
        before = docs[-1]


def test_blocks_below_the_threshold_stay_closed():
    docs = np.arange(4 * lexical.BLOCK)
    m = np.where(docs < lexical.BLOCK, 10, 1000)
    tops = np.array([lexical.impact(1, 10), *[lexical.impact(1, 1000)] * 3], "<u4")
    data, starts = lexical.compress(np.ones(len(docs), int), np.ones(len(docs), int), np.arange(0, len(docs), lexical.BLOCK))
    lasts = np.arange(1, 5) * lexical.BLOCK - 1
    postings = lexical.Postings(lasts.astype("<u4").tobytes(), tops.tobytes(), starts[:-1].astype("<u4").tobytes(), data.tobytes(), m)
    got = lexical.best([(7, postings)], docs, 5, int(7 * lexical.impact(1, 10)))
    assert [d for d, _ in got] == [0, 1, 2, 3, 4] and postings.closed.tolist() == [False, True, True, True]


def test_search_over_empty_tables(spark, edges):
    empty = edges.select("doc_id", "text").limit(0)
    index = lexical.build(empty)
    asked = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.search(index, asked).count() == 0
    assert lexical.search(lexical.build(edges), asked.limit(0)).count() == 0
    assert {r.key for r in lexical.search(lexical.build(edges), asked).collect()} == {4, 5}


# -- fill in the middle ----------------------------------------------------------------------------


def plain_fim(key, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_form(spark):
    texts = ["", None, "\n", "\n\n\n", "one", "a\nb\nc", "a\nb\nc\n", "x\x01y\x02z\n\x02\x01\n\x02d\x02e", "has <P> in it\nb", "<\nP>\n<S\n>", "é\n日本\n\x01", "l\n" * 50_000, "no end " * 20_000, "\r\n\r\n", "<\n<\n<M\n", "$0 \\1\n$\n"]
    rows = [(k, t) for k, t in enumerate(itertools.chain.from_iterable([texts] * 6))] + [(None, "a\nb"), (-3, "a\nb\n")]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        n, form, prefix, middle, output = plain_fim(r.doc_id, r.text)
        assert (r.n, r.form, r.output, r.restored) == (n, form, output, r.text or "")
        assert (r.prefix is None) == (form == "plain") and (form == "plain" or (len(r.prefix), len(r.middle)) == (prefix, middle))
    assert {r.form for r in got} == {"plain", "psm", "spm"} and len(got) == len(rows)


def test_fill_in_middle_edges(spark, edges):
    names = ["marked", "whole", "n", "prefix", "digest"]
    df = edges.select("doc_id", "text", *[pii.F.lit("x").alias(c) for c in names])
    out = fim.fill_in_middle(df, rate=50, unit=fim.WORDS)
    assert out.columns == ["doc_id", "text", "marked", "whole", "digest", "n", "form", "prefix", "middle", "suffix", "output", "restored"]
    assert all(r.restored == (r.text or "") and r.marked == "x" for r in out.collect())
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time

    from quarrylight.llm import store

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {str(f) for f in (lambda files: [files.apply(i).getName() for i in range(files.size())])(manager.getAllFiles().toList()) if str(f).startswith("shuffle_")}
    before, setting = held(), spark.conf.get(store.CLEANUP, "false")
    table, _ = store.save(spark.range(20000).selectExpr("id % 1000 AS k", "id").groupBy("k").sum("id"), "sums")
    until = time.time() + 10
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert table.count() == 1000 and spark.conf.get(store.CLEANUP, "false") == setting
