import collections
import functools
import hashlib
import math
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylight.llm import components, decontaminate, htmltext, langid, licenses, linededup, packing, queries, sharding, simhash, tokens, urlfilter, vptree
from quarrylight.llm.labelled_pages import PAGES
from quarrylight.llm.store import Scratch, work_dir

from .conftest import DATA


@functools.cache
def plain_tokenizer():
    """The contract's own: no setting of ours."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_paths_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 30)}


# -- line dedup ------------------------------------------------------------------------------------


def brute_shingles(line):
    """Eight characters from every one that isn't white space."""
    line = line.lower()
    return {line[at : at + 8] for at, c in enumerate(line) if c not in " \t\n\x0b\x0c\r"}


def brute_lines(rows):
    shingles = brute_shingles
    places = collections.defaultdict(list)
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                places[line].append((i, p))
    lines, sets, held = list(places), Sets(), collections.defaultdict(list)
    parts = [shingles(x) for x in lines]
    for k, s in enumerate(parts):
        for j, n in collections.Counter(j for x in s for j in held[x]).items():
            if n >= 0.8 * (len(s) + len(parts[j]) - n):
                sets.join(k, j)
        for x in s:
            held[x].append(k)
    classes = collections.defaultdict(list)
    for k, line in enumerate(lines):
        classes[sets.find(k)] += places[line]
    keep = {min(v) for v in classes.values()}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or (i, p) in keep) for i, t in rows if t is not None}


def test_line_dedup_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_finds_all_pairs_of_a_large_band_group(spark):
    common = " ".join(f"standing{k} phrase{k}" for k in range(14))
    lines = [f"{common} " + " ".join(f"own{n}x{k}" for k in range(8)) + f" end{n}{side}" for n in range(80) for side in "ab"]
    rows = list(enumerate(lines))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) and sum(t != "" for t in got.values()) == 80


def test_rare_shingles_keep_every_similar_pair(spark):
    rng = np.random.default_rng(5)
    sets = [sorted({int(v) for v in rng.zipf(1.3, 14) % 60}) for _ in range(120)]
    sets += [[*s[:-1], 100 + k] for k, s in enumerate(sets)]
    table = spark.createDataFrame(list(enumerate(sets)), "lh long, s array<long>")
    prefixes = linededup._prefixes(table.selectExpr("lh", "lh AS root", "s"), 0.8, Scratch(spark))
    met = {(r.a, r.b) for r in linededup._pairwise(linededup._keyed(prefixes), linededup._may_be_similar(0.8)).distinct().collect()}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = set(sets[a]), set(sets[b])
            assert len(x & y) < 0.8 * len(x | y) or (a, b) in met


@pytest.mark.parametrize("words", [(6, 15), (15, 60)])
def test_bands_find_pairs_at_the_threshold(spark, words):
    rng = np.random.default_rng(words[0])
    pairs = []
    for _ in range(6000):
        line = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(rng.integers(*words)))
        other, edits = line, rng.integers(1, 2 + len(line) // 30)
        for at in rng.integers(0, len(line), edits):
            other = other[:at] + "q" + other[at + 1 :]
        x, y = brute_shingles(line), brute_shingles(other)
        if 0.8 * len(x | y) <= len(x & y) < 0.88 * len(x | y):
            pairs.append((line, other))
    assert len(pairs) > 500
    lines = spark.createDataFrame([(k, x) for k, p in enumerate(pairs) for x in p], "id long, line string").selectExpr("id", "id AS row", "1 AS pos", "line")
    met = linededup._banded(lines).selectExpr("id", "lh", "explode(bands) AS band").groupBy("id", "band").agg(F.countDistinct("lh").alias("n")).where("n = 2").select("id").distinct().count()
    assert met >= 0.95 * len(pairs)


def test_line_dedup_bears_what_moves_later_characters(spark):
    """One letter more at the start or in the middle of a long run, or of a long word."""
    rng = np.random.default_rng(8)
    run = "".join(map(chr, rng.integers(97, 123, 300)))
    law = "bundesausbildungsförderungsgesetzänderungsverordnung gilt ab morgen"
    for a, b in ((run, "x" + run), (run, run[:150] + "q" + run[150:]), (law, "x" + law), ("thtrth" * 9 + "end of it", "x" + "thtrth" * 9 + "end of it")):
        got = linededup.dedup_lines(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).where("n_kept > 0").count()
        assert got == 1 and len(brute_shingles(a) & brute_shingles(b)) >= 0.8 * len(brute_shingles(a) | brute_shingles(b))


def test_line_dedup_edges(edges):
    out = linededup.dedup_lines(edges)
    assert out.columns == [*edges.columns, "n_lines", "n_kept"]
    got = {(r.doc_id, r.text is None): (r.n_lines, r.n_kept) for r in out.collect()}
    assert got[1, True] == (0, 0) and got[5, False] == (1, 0) and got[2, False] == (0, 0)
    assert linededup.dedup_lines(edges.limit(0)).count() == 0


def linked_roots(lines, shingles):
    sets, parts = Sets(), [shingles(x) for x in lines]
    for a in range(len(lines)):
        for b in range(a):
            if len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b]):
                sets.join(a, b)
    return {sets.find(k) for k in range(len(lines))}


def test_line_dedup_looks_at_every_character(spark):
    start, url = "東京都で今日は朝から強い雨が降って", "https://example.com/"
    kept = [f"see {url}a", f"see {url}b", f"{url}first/page", f"{url}other/way", "1234567890123", "1234567890129", "d41d8cd98f00b204e980", "d41d8cd98f00ffffffff", f"{start}電車が止まりました", f"{start}午後に晴れました", f"a {url}x y", f"b {url}x z"]
    lines = [*kept, "x" + "".join(chr(0x4E00 + k) for k in range(200)), "".join(chr(0x4E00 + k) for k in range(200)), f"{url}path/" + "segment/" * 3 + "".join(f"{k}-" for k in range(60)), f"{url}path/" + "segment/" * 3 + "".join(f"{k}-" for k in range(60)) + "Z"]
    got = {r.doc_id for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_kept > 0").collect()}
    assert set(range(10)) <= got == linked_roots(lines, brute_shingles) and len(got) < len(lines)


def test_line_dedup_compares_families_whose_rarest_shingles_are_common(spark):
    rng, families, seen = np.random.default_rng(11), [], collections.Counter()
    vocabulary = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(40)]
    while len(families) < 80:
        own = {int(k) for k in rng.choice(40, 10, replace=False)}
        twin = {*sorted(own)[1:], int(rng.choice(sorted(set(range(40)) - own)))}
        if all(len(x & y) <= 5 for pair in families for x in pair for y in (own, twin)):
            families.append((own, twin))
            seen.update([*own, *twin])
    assert min(seen.values()) > linededup.PAIRWISE
    common = " ".join(f"standing{k} phrase{k}" for k in range(8))
    lines = [" ".join(vocabulary[k] for k in sorted(x)) + f" {common}" for pair in families for x in pair]
    rows = list(enumerate(lines))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) and sum(t != "" for t in got.values()) == 80


@pytest.mark.parametrize("block", [4, 256])
def test_cells_keep_every_similar_pair(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    rng = np.random.default_rng(6)
    sets = [sorted({int(v) for v in rng.choice(30, rng.integers(2, 14), replace=False)}) for _ in range(150)]
    sets += [sorted({*s[1:], int(rng.integers(30))}) for s in sets]
    table = spark.createDataFrame(list(enumerate(sets)), "lh long, s array<long>")
    scratch = Scratch(spark)
    prefixes = linededup._prefixes(table.selectExpr("lh", "lh AS root", "s"), 0.8, scratch)
    pairs = linededup._keyed(prefixes)
    met = {(r.a, r.b) for r in linededup._in_cells(linededup._apart(pairs, scratch, "apart"), linededup._may_be_similar(0.8)).distinct().collect()}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = set(sets[a]), set(sets[b])
            assert len(x & y) < 0.8 * len(x | y) or (a, b) in met


# -- sharding --------------------------------------------------------------------------------------


def test_shards_round_trip_compact_and_conflict(spark, documents, edges):
    store = sharding.compacted(documents.repartition(8), work_dir(spark, "t"), target=1 << 20)
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, documents.collect()), key=str)
    _, shards = store.manifest()
    assert sum(s.rows for s in shards) == documents.count() and not store.merges(shards) and len(shards) < 32
    with pytest.raises(sharding.Conflict):
        store._commit(store.version() - 1, documents.schema, [])
    with pytest.raises(ValueError):
        store.append(documents.select("doc_id"))
    other = sharding.compacted(edges, work_dir(spark, "t"))
    assert other.read().count() == edges.count()
    assert sharding.compacted(edges.limit(0), work_dir(spark, "t")).read().count() == 0


def test_a_failed_merge_is_invisible(spark, documents):
    store = sharding.ShardStore(spark, work_dir(spark, "t"))
    store.append(documents.limit(10))
    store._write(documents)  # a job's files without a commit
    assert store.read().count() == 10
    store.vacuum()
    assert len(store._names("data")) == 2  # they may be another writer's
    store.vacuum(older=0)
    assert len(store._names("data")) == 1 and store.read().count() == 10


def test_two_writers_keep_each_others_rows(spark, documents):
    path = work_dir(spark, "t")
    one, two = sharding.ShardStore(spark, path), sharding.ShardStore(spark, path)
    one.append(documents.limit(10))
    commit, late = one._commit, []

    def overtaken(after, schema, shards):
        if not late:
            late.append(two.append(documents.limit(7)))
        return commit(after, schema, shards)

    one._commit = overtaken
    one.append(documents.limit(5))
    assert one.read().count() == 22 and one.version() == 3
    late.clear()
    for _ in range(3):
        two.append(documents.limit(2))
    one.compact()
    assert one.read().count() == 22 + 6 + 7 and len(one.manifest()[1]) < 7


# -- nearest neighbours ----------------------------------------------------------------------------


def test_nearest_is_exact_at_factor_one_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:160] = x[100]  # one common vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (404, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for factor, shard in ((1.0, 64), (1.0, 4096)):
        got = collections.defaultdict(list)
        for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=factor, shard_size=shard, block_size=8).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, round(r.score, 9)))
        for q in range(0, 300, 20):
            scores = sorted(((-float(x[q].astype(float) @ x[i].astype(float)), i) for i in range(300) if i != q), key=lambda s: (round(s[0], 9), s[1]))
            assert got[q] == [(i, round(-s, 9)) for s, i in scores[:20]]
        assert 404 not in got and set(got) == set(range(0, 300, 20))


def test_nearest_gives_many_ties_to_the_least_ids(spark):
    rows = [(i, [1.0, float(i) / 7, float(i * i % 31)]) for i in range(20, 420)] + [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "vec_id long, embedding array<double>, id string, shard string, dim int")
    for shard in (50, 4096):
        got = [(r.rank, r.vec_id, r.score) for r in vptree.nearest(df, F.col("vec_id") == 0, factor=1.0, shard_size=shard).orderBy("rank").collect()]
        assert got == [(k + 1, 20 + k, 1.0) for k in range(20)]
    assert vptree.nearest(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert vptree.nearest(df.limit(3), F.col("vec_id") == 20).count() == 2
    long = spark.createDataFrame([(k, [float(k)] * 5000) for k in range(1, 4)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vptree.nearest(long, F.col("vec_id") == 1).orderBy("rank").collect()] == [3, 2]


def test_recall(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids, m = np.array(list(x)), np.stack(list(x.values()))
    got = collections.defaultdict(set)
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = [len(got[q] & set(ids[np.argsort(-np.where(ids == q, -9, m @ x[q]))[:20]])) / 20 for q in got]
    assert np.mean(hits) >= 0.95


# -- URL filters -----------------------------------------------------------------------------------


def test_rules_and_spread(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "http://A.net/x?q#f", link("hub.example.com")), (2, "https://m.example.net/en/1", ""), (3, "http://example.com/de/", ""), (4, "http://x.org/fr/a", link("good.example.com")), (5, "nourl", ""), (6, None, None),
        (7, "http://linker.example.com/en/1", link("a.net", "b.net", "c.net")), (8, "http://b.net/", ""), (9, "http://c.net/", ""), (10, "http://good.example.com/en", ""), (11, "http://net", ""), (12, "http://notexample.net.com/", ""),
        (13, "http://x.com?u=http://a.net/", ""),
    ]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.net", "/x", "net/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.net/en/", "allow")
    assert (got[3].rule, got[4].rule) == ("example.com/de/", "org/fr/")
    assert (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("", "", None, "allow") and got[6].host == ""
    assert got[7].verdict == "block" and got[10].verdict == "allow"  # links to blocked hosts; linked by a trusted one
    assert got[11].rule is None and got[12].rule is None and (got[13].host, got[13].path) == ("x.com", "")


def test_links_to_uncrawled_hosts_count(spark):
    link = lambda *urls: "".join(f'<a href="{u}">' for u in urls)
    rows = [
        (1, "http://farm.example.com/en/1", link(*[f"http://Spam{k}.net" + "/x" * (k % 2) for k in range(30)])), (2, "http://calm.example.com/en/1", link("//other.info/", "http://other.info/2")),
        (3, "http://half.example.com/en/1", link("http://h.example.com/de/1", "http://h.example.com/en/2")), (4, "http://far.example.com/en/1", link(*[f"https://farm{k}.info/net/" for k in range(9)])),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    links = {(r.src, r.dst, r.path) for r in urlfilter.host_links(df).collect()}
    assert {("farm.example.com", "spam0.net", "/"), ("farm.example.com", "spam1.net", "/x"), ("calm.example.com", "other.info", "/2")} <= links and len(links) == 43
    assert {r.page_id: r.verdict for r in urlfilter.judge(df).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_spread_equals_power_iteration(spark):
    rng = np.random.default_rng(2)
    n = 12
    e = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (40, 2)) if a != b})
    seeds = [(str(k), float(k % 3 == 0), float(k % 4 == 1)) for k in range(n)]
    got = {int(r.host): (r.trust, r.distrust) for r in urlfilter.spread(spark.createDataFrame(seeds, "host string, trusted double, blocked double"), spark.createDataFrame([(str(a), str(b)) for a, b in e], "src string, dst string")).collect()}
    t0, d0 = np.array([s[1] for s in seeds]) * 0.15, np.array([s[2] for s in seeds]) * 0.15
    t, d = t0, d0
    out, into = collections.Counter(a for a, _ in e), collections.Counter(b for _, b in e)
    for _ in range(200):
        nt, nd = t0.copy(), d0.copy()
        for a, b in e:
            nt[b] += 0.85 * t[a] / out[a]
            nd[a] += 0.85 * d[b] / into[b]
        t, d = nt, nd
    assert all(np.allclose(got[k], (t[k], d[k]), atol=1e-4) for k in range(n))


def test_judging_linked_pages_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    hosts = [f"h{k}.example.org" for k in range(25)] + [f"s{k}.net" for k in range(6)] + [f"w{k}.com" for k in range(10)]
    rows = []
    for k in range(120):
        html = "".join(f"<a href='http://{hosts[rng.integers(41)].upper() if rng.random() < 0.1 else hosts[rng.integers(41)]}/{rng.choice(['en', 'fr', 'de'])}/{k % 3}'>x</a>" for _ in range(rng.integers(0, 6)))
        rows.append((None if k == 5 else k, None if k == 9 else f"https://{hosts[rng.integers(31)]}/{rng.choice(['en', 'fr', 'de'])}/p?q", None if k == 7 else html, "x", "y"))
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, host string, dst string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, urlfilter.judge(df).collect()), key=str)
    assert got == sorted(con.execute(queries.ORACLE_SQL["op4_url_filter"]).fetchall(), key=str)
    assert {r[-1] for r in got if r[3] is None} == {"allow", "block"}
    assert urlfilter.judge(df.limit(0)).count() == 0


# -- language ID -----------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def model(documents):
    return langid.fit(documents)


def test_expectation_equals_enumeration(model):
    one, number = model.only(model.languages[0]), {p: k for k, p in enumerate(model.vocabulary)}

    def cuts(word):
        for n in range(1, min(len(word), langid.MAX_PIECE) + 1):
            piece, p = word[:n], one.p[number[word[:n]], 0] if word[:n] in number else one.stray[0] if n == 1 else 0
            if p and n == len(word):
                yield p, [piece]
            elif p:
                yield from ((p * q, [piece, *rest]) for q, rest in cuts(word[n:]))

    for word in ("on", "thing", "über"):
        ways, want = list(cuts(langid.START + word)), np.zeros(len(model.vocabulary))
        for p, found in ways:
            for piece in found:
                if piece in number:
                    want[number[piece]] += 3 * p / sum(q for q, _ in ways)
        long = np.zeros(len(model.vocabulary) + 1)
        one._expect_long(word, 3.0, long)
        assert np.allclose(one.expect([word], np.array([3.0])), want) and np.allclose(long[:-1], want)
    assert np.isfinite(one.expect(["ab" * 500], np.array([1.0]))).all()


def test_forward_sums_all_segmentations(model):
    number = {p: k for k, p in enumerate(model.vocabulary)}

    def brute(word):
        word, alpha = langid.START + word, [np.ones(len(model.languages))]
        for e in range(1, len(word) + 1):
            total = 0
            for n in range(1, min(e, langid.MAX_PIECE) + 1):
                k = number.get(word[e - n : e])
                total = total + alpha[e - n] * (model.p[k] if k is not None else model.stray if n == 1 else 0)
            alpha.append(total)
        return np.log(alpha[-1])

    words = ["the", "éèêç", "x", "thinereationthereanother", "日本"]
    assert np.allclose(model.forward(words), [brute(w) for w in words])
    assert np.isfinite(model.forward(["ab" * 5000])).all() and np.allclose(model._long(["thing"], 5), model.forward(["thing"]))


def plain_language(rows, rounds=2):
    """The whole operator word by word: fit on the allowed fold, then score every text."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    mine = [(t, lang) for i, t, lang in rows if t is not None and lang not in (None, "und") and zlib.crc32(str(i).encode()) % 3 != 1]
    langs, number = sorted({lang for _, lang in mine}), {p: k for k, p in enumerate(langid.pieces())}
    longest, sp = max(map(len, number)), sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    counted = {lang: collections.Counter(w for t, x in mine if x == lang for w in words(t)) for lang in langs}

    def probabilities(weights):
        smooth = np.array(weights) + 0.05
        p = smooth / smooth.sum()
        return p, p.min() * 0.01

    def ways(word, p, stray, back=False):
        """Sums over segmentations up to each place, from the start or the end."""
        word, out = langid.START + word, [1.0]
        for e in range(1, len(word) + 1):
            total = 0.0
            for n in range(1, min(e, longest) + 1):
                piece = word[len(word) - e : len(word) - e + n] if back else word[e - n : e]
                total += out[e - n] * (p[number[piece]] if piece in number else stray if n == 1 else 0)
            out.append(total)
        return out

    model = {}
    for lang in langs:
        weights = np.zeros(len(number))
        for w, n in counted[lang].items():
            for piece in sp.encode(w, out_type=str):
                if piece in number:
                    weights[number[piece]] += n
        for _ in range(rounds):
            p, stray = probabilities(weights)
            weights = np.zeros(len(number))
            for w, n in counted[lang].items():
                ahead, behind, full = ways(w, p, stray), ways(w, p, stray, True), langid.START + w
                for e in range(1, len(full) + 1):
                    for k in range(1, min(e, longest) + 1):
                        if full[e - k : e] in number:
                            at = number[full[e - k : e]]
                            weights[at] += n * ahead[e - k] * p[at] * behind[len(full) - e] / ahead[-1]
        model[lang] = probabilities(weights)
    prior = {lang: math.log(sum(x == lang for _, x in mine) / len(mine)) for lang in langs}
    out = {}
    for i, t, _ in rows:
        logs = [prior[lang] + sum(math.log(ways(w, *model[lang])[-1]) for w in words(t)) for lang in langs]
        best = max(range(len(langs)), key=lambda k: logs[k])
        known = any(c.isalpha() for w in words(t) for c in w)
        out[i] = (langs[best], 1 / sum(math.exp(x - logs[best]) for x in logs)) if known else ("und", 0.0)
    return out


def test_language_of_few_documents_equals_the_plain_form(spark, documents):
    texts = documents.where("length(text) < 500").orderBy("doc_id").limit(36).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in texts] + [(10_001, None, "en"), (10_002, "internationalisation of the " + "x" * 70, "en"), (10_003, "42", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = plain_language(rows)
    assert {r.doc_id: r.lang_pred for r in got} == {i: x[0] for i, x in want.items()}
    assert all(r.score == pytest.approx(want[r.doc_id][1], abs=1e-6) for r in got) and max(map(len, langid.pieces())) > 12


def test_held_out_accuracy_and_folds(documents, model):
    rows = langid.identify(documents, model=model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(edges, spark):
    got = langid.identify(edges).collect()
    assert len(got) == edges.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {1, 2, 3}
    assert langid.identify(edges.limit(0)).count() == 0
    only_digits = spark.createDataFrame([(1, "12 34_", None)], "doc_id long, text string, lang string")
    assert langid.identify(only_digits).first().lang_pred == "und"
    assert langid.in_known_language(edges).columns == edges.columns


# -- packing ---------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_token_ids_are_the_vocabularys_own(text):
    assert tokens.token_ids(text).tolist() == plain_tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plans_hold_every_piece_once(counts):
    plan = packing.packing_plan(counts, 64)
    packed = collections.Counter()
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            packed[x] += n
    assert packed == collections.Counter(counts)


def test_packing_round_trip(documents):
    rows = packing.pack(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids = np.array([*plain_tokenizer().encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_special_tokens_are_the_tokenizers(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(df).collect()}
    assert got == {1: (5, zlib.crc32(np.array([64, 220, 50256, 275, 0], "<u4").tobytes())), 2: (2, zlib.crc32(np.array([50256, 0], "<u4").tobytes()))}


def test_packing_edges(edges):
    rows = packing.pack(edges).collect()
    assert sum(r.doc_id == 4 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 1
    assert {(r.doc_id, r.length) for r in rows if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert packing.pack(edges.limit(0)).count() == 0


# -- licenses --------------------------------------------------------------------------------------


def test_license_edits_and_edges(spark, edges):
    mit = licenses.TEMPLATES["MIT-notice"]
    words = mit.split()
    edited = " ".join(words[:20] + ["really"] + words[20:])
    filler = " ".join(f"w{k}" for k in range(900))
    rows = [(1, f"{filler} {mit.upper()} {filler}"), (2, f"{filler}\n{edited}\n{filler}"), (3, " ".join(words[:25])), (4, "Released under the MIT License."), (5, None), (6, ""), (7, "mit license")]
    known = licenses.templates(spark)
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert set(got) == {(1, "MIT-notice"), (2, "MIT-notice"), (4, "MIT")} and got[1, "MIT-notice"] == 1 and 0.8 <= got[2, "MIT-notice"] < 1
    assert licenses.scan(edges, known).count() == 0 and licenses.scan(edges.limit(0), known).count() == 0


# -- SimHash ---------------------------------------------------------------------------------------


def test_fingerprints_follow_the_definition():
    import xxhash

    for text in ("A  b\tC d", "é É x y z", "one", "", None, "a\xa0b c d", "w " * 70000 + "x y"):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_simhash_components_equal_brute_force(documents):
    rows = simhash.simhash_components(documents).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    sets, ids = Sets(), sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                sets.join(a, b)
    assert {r.doc_id: r.component_id for r in rows} == {i: sets.find(i) for i in ids}


def test_tiles_lose_no_link_and_stay_linear(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 40), dtype=np.uint64)
    values = np.unique(np.concatenate((base, (base[:, None] ^ flips).ravel(), (base[:, None] ^ flips ^ np.roll(flips, 1, 1)).ravel()))).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    links = simhash.near_links(df, 3, tile=64).collect()
    got, want, u = Sets(), Sets(), values.view(np.uint64)
    for r in links:
        got.join(r.a, r.b)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 3):
            want.join(int(values[i]), int(values[i + 1 + j]))
    assert all(got.find(int(v)) == want.find(int(v)) for v in values)
    x = np.arange(2000, dtype=np.uint64) % 8  # all within the radius of each other
    a, b = simhash.close_pairs(x, x, 3)
    assert len(a) <= 3 * 2 * len(x)


def test_simhash_edges(edges):
    got = simhash.simhash_components(edges).collect()
    assert len(got) == edges.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in got if r.doc_id == 5} == {4}
    kept = simhash.without_near_copies(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 4, 6, 7]
    assert simhash.simhash_components(edges.limit(0)).count() == 0


# -- HTML ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_labelled_pages(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<b>b</b>\n c</p>", "ab c"), ("<p>x<br>y</p><p>&lt;z&gt;&nbsp;&eacute;</p>", "x y\n<z> é"), (None, ""), ("", ""), ("<script>var a='</p>'</script>", ""), ("plain a < b", "plain a < b"),
        ("<nav>m e n u<article><p>unclosed menu before</p></article>", "unclosed menu before"),
        ("<article><header><h1>Head</h1></header><p>Body text.</p><section class='commentlist'><p>Nice!</p></section><aside>See also</aside><p>End.</p></article>", "Head\nBody text.\nEnd."),
        ("<div class='cookie-notice'>We use cookies to make everything better for you and more.</div><article><p>Short.</p></article><footer>x y z</footer>", "Short."),
        ("<article><p>one<p>two<ul><li>three<li>four</ul><table><tr><td>five<td>six</table></article>", "one\ntwo\nthree\nfour\nfive\nsix"),
        ("<p>start <!-- <p>no</p> --> end</p>", "start end"), ("<article><p>a</p>" + "<div class='ad'>" + "buy " * 300 + "</div><p>b</p></article>", "a\nb"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    ("start", "end"),
    [
        ("<article class='post tag-advertising category-notices'>", "</article>"), ("<article class='share social'>", "</article>"), ("<div class='layout with-sidebar'>", "</div>"), ("<div id='content' class='has-toc'>", "</div>"),
        ("<div class='entry-content share-enabled'>", "</div>"), ("<div class='widget'>", "</div>"), ("<form action='x'><div class='page-search'>", "</div></form>"), ("<form><div class='sidebar'><h3>About</h3><p>A few words.</p></div><div class='promo'>", "</div></form>"),
    ],
)
def test_main_text_of_pages_whose_wrappers_have_marks(start, end):
    body = "<h1>The head</h1><p>" + "one two three " * 9 + "</p><div class='ad'>buy now</div><p>" + "four five " * 9 + "</p>"
    text = htmltext.main_text(f"<body><nav>menu</nav>{start}{body}{end}<footer>foot</footer></body>")
    assert text == "\n".join(["The head", " ".join(["one two three"] * 9), " ".join(["four five"] * 9)])


def test_comments_and_small_forms_stay_out():
    body = "<h1>The head</h1><p>Short but whole text.</p>"
    comments = "<div class='comments'><h3>Comments</h3>" + "<p>I say this and that and more.</p>" * 20 + "</div>"
    assert htmltext.main_text(f"{body}{comments}<form><p>Your name please</p></form>") == "The head\nShort but whole text."
    assert htmltext.main_text(f"<article>{body}<article class='comment'><p>Well said.</p></article></article>") == "The head\nShort but whole text."


def test_html_rows(spark):
    rows = [(1, "u", "<p>" + "word " * 200000 + "</p>", "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract_main_text(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 999999] and htmltext.extract_main_text(df.limit(0)).count() == 0


# -- decontamination -------------------------------------------------------------------------------


def brute_contamination(docs, items):
    words = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        digest = hashlib.sha256(",".join(sorted(str(f) for f in found if f is not None)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len([f for f in found if f is not None]), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark, edges):
    long = " ".join(f"q{k}" for k in range(30))
    items = [(1, long), (2, "Ünï-cödé ☃"), (3, "solo"), (4, None), (5, "!!"), (6, "a b c d"), (10, long), (7, " ".join(["echo"] * 14))]
    docs = [(1, f"x {long.upper()} y"), (2, " ".join(f"q{k}" for k in range(12))), (3, "SOLO, ünï cödé ☃ and Ünï CÖDÉ"), (4, None), (5, ""), (6, "a, b; c d a b c d"), (7, "echo " * 40), (8, "w " * 3000 + long), (1, f"x {long.upper()} y"), (None, "solo")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=str) == brute_contamination(docs, items)
    got = decontaminate.contamination(edges, b).collect()
    assert len(got) == edges.count() and decontaminate.contamination(edges.limit(0), b).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(edges, b.limit(0)).collect())
    assert decontaminate.uncontaminated(edges, b).columns == edges.columns


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=30))
def test_best_region_is_the_greatest_run(scores):
    first, last = htmltext.best_region([float(x) for x in scores])
    assert sum(scores[first:last]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])


def test_the_scan_decides_where_nothing_else_marks_the_text(monkeypatch):
    body = "<div><p>Water runs down the old stone steps and gathers in a wide basin.</p><p>The keeper writes down every visitor and the hour.</p></div>"
    links = "<div>" + " ".join(f"<a href='/{w}'>{w}</a>" for w in ("home", "news", "maps", "archive")) + "</div>"
    want = "Water runs down the old stone steps and gathers in a wide basin.\nThe keeper writes down every visitor and the hour."
    assert htmltext.main_text(f"<body>{links}{body}{links}</body>") == want
    monkeypatch.setattr(htmltext, "best_region", lambda scores: (0, len(scores)))
    assert htmltext.main_text(f"<body>{links}{body}{links}</body>") != want


def test_labelled_pages_give_their_text():
    assert [page for page, text in PAGES if htmltext.main_text(page) != text] == []


@pytest.mark.parametrize("wrapper", ['<div class="content with-sidebar">', '<div class="post search-result">', '<div id="page-header-social-wrap">', '<div class="advertorial-layout">'])
def test_wrappers_of_all_names_keep_the_text(wrapper):
    body = "<h1>Wall</h1><p>Nobody remembers who built the wall, but the letters have been copied.</p><p>Water runs down the old stone steps.</p>"
    assert htmltext.main_text(f"<html><body>{wrapper}{body}</div></body></html>").startswith("Wall\nNobody")


@pytest.mark.parametrize("form", ["<a ", "</x ", "< ", "<a '", '<a "> ', "<!", "<!-- ", "<?", "<p>x ", "&amp; "])
def test_broken_tags_take_linear_time(form):
    """A page of a million characters without an end to its tags; a quadratic search would take hours."""
    for page in (form * (1_000_000 // len(form)), form * (1_000_000 // len(form)) + ">"):
        begin = time.perf_counter()
        htmltext.main_text(page)
        assert time.perf_counter() - begin < 60
    assert htmltext.main_text("<article><p>One two three.</p> <b four") == "One two three.\n<b four"


def test_extraction_keeps_to_its_columns_and_bears_hostile_pages(spark):
    deep = "<div>" * 20_000 + "<p>Deep words stay here in the page.</p>" + "</b>" * 2_000
    rows = [(1, "u", deep, "x", 7), (1, "u", deep, "x", 7), (None, None, None, None, None)]
    got = htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, id string, n_chars long")).collect()
    assert sorted(r.n_chars for r in got) == [0, 33, 33] and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
