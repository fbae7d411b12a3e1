"""Gram joins, ordered repairs, the kept index: against nested loops and plain sequences."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import grams, kept_index, ladder, ordered_repair
from quarrylight.operators.components import components

LETTERS = "ab c"


def test_containment_equals_a_nested_loop(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [(k, text(rng.randint(0, 30))) for k in range(60)] + [(90, None), (91, ""), (92, "  "), (93, "x  y"), (94, "é 日本 x")]
    cut = lambda t: t[(a := rng.randint(0, max(0, len(t) - 1))) : a + rng.randint(1, 14)]
    spans = [(k, cut(t or "zz")) for k, (_, t) in enumerate(texts * 3)] + [(500, None), (501, ""), (502, " "), (503, "  "), (504, "   "), (505, "本"), (506, "a b c"), (507, " a"), (508, "a "), (509, "dcba")]
    got = grams.contained(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(spans, "j int, s string"), "i", "t", "j", "s")
    want = {(i, j) for i, t in texts for j, s in spans if t is not None and s and s in t}
    rows = [(r.i, r.j) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert grams.contained(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame([], "j int, s string"), "i", "t", "j", "s").count() == 0


@pytest.mark.parametrize("threshold", [0.7, 0.75, 0.9])
def test_like_pairs_lose_none(spark, threshold):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 14))) for _ in range(40)]
    other = ["".join(c for c in w if rng.random() > 0.1) + rng.choice(["", "x", "ab"]) for w in base] + ["a", "ab", "aaaaaaa", "", "abababab"]
    other = [w for w in other if w]
    left, right = spark.createDataFrame([(w,) for w in base + ["aaaaaa", "b"]], "q string"), spark.createDataFrame([(w,) for w in other], "c string")
    got = {(r.q, r.c) for r in grams.like_pairs(left, right, "q", "c", threshold).collect()}
    want = {(a, b) for a in base + ["aaaaaa", "b"] for b in other if difflib.SequenceMatcher(None, a, b).ratio() >= threshold}
    assert want <= got


def test_fuzzy_match_takes_what_all_pairs_give(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    asked = [n[1:] for n in names[:20]] + [n + "zz" for n in names[20:40]] + [n[:2] + "q" + n[3:] for n in names[40:]] + ["", "?!"]
    t, c = spark.createDataFrame([(a,) for a in asked], "t string"), spark.createDataFrame([(n,) for n in names], "c string")
    fast = {(r.t, r.c, round(r.score, 9)) for r in ladder.best_fuzzy(t, c, "t", "c").collect()}
    every = ladder.best_fuzzy(t.withColumn("k", F.lit(1)), c.withColumn("k", F.lit(1)), "t", "c", on="k")
    assert fast == {(r.t, r.c, round(r.score, 9)) for r in every.collect()} and len(fast) > 40


def test_unique_match_by_key_alone(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], "l int, k string")
    right = spark.createDataFrame([(10, "a"), (10, "a"), (20, "b"), (21, "b"), (30, None)], "r int, k string")
    assert {tuple(r) for r in ladder.unique_match(left, right, "l", "r", on="k").collect()} == {(1, 10), (2, 10)}


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 300)] + [(5, k) for k in range(6, 60)] + [(7, 7), (None, 3), (900, 899), (899, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 301)} | {k: 5 for k in range(5, 60)} | {899: 899, 900: 899}


def plain_repair(people, units):
    """One merge after the other over everything, as the candidates' order asks."""
    rows, units, log = {p["id"]: dict(p) for p in people}, {i: {o for j, o in units if j == i} for i in {p["id"] for p in people}}, []
    fields = ["title", "email", "homepage", "bio"]
    while True:
        groups = {}
        for i, r in rows.items():
            for o in units[i]:
                groups.setdefault((1, f"{o}:{r['name']}"), set()).add(i)
            if r["homepage"]:
                groups.setdefault((0, r["homepage"]), set()).add(i)
        groups = sorted((k, sorted(v)) for k, v in groups.items() if len(v) > 1)
        if not groups:
            return rows, units, log
        (order, key), members = groups[0]
        keeper = max(members, key=lambda i: (sum(bool(rows[i][f]) for f in fields), -i))
        for victim in members:
            if victim != keeper:
                for f in fields:
                    rows[keeper][f] = rows[keeper][f] or rows[victim][f]
                units[keeper] |= units.pop(victim)
                log.append((key, victim, keeper))
                del rows[victim]


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_repair_equals_single_merges(spark, seed):
    rng = random.Random(seed)
    people = [{"id": k, "name": rng.choice("abcde") * 3, "homepage": f"https://h{rng.randint(0, 25)}.example.edu.cn/person/a" if rng.random() < 0.6 else None, "title": rng.choice([None, "教授"]), "email": rng.choice([None, "a@b.cn"]), "bio": None} for k in range(1, 45)]
    units = [(k, rng.randint(0, 14)) for k in range(1, 45) for _ in range(rng.randint(0, 2))]
    schema = "id long, name string, homepage string, title string, email string, bio string"
    df = spark.createDataFrame([tuple(p.values()) for p in people] + [(None, "aaa", None, None, None, None)], schema)
    whole, kept, log = ordered_repair.repair_in_order(df, spark.createDataFrame(units, "professor_id long, org_unit_id int"))
    rows, left, merges = plain_repair(people, units)
    assert {r.id: r.asDict() for r in whole.collect()} == rows
    assert {(r.professor_id, r.org_unit_id) for r in kept.collect()} == {(i, o) for i, os in left.items() for o in os}
    assert {(r.match_key, r.id, r.keeper_id) for r in log.collect()} == set(merges) and log.agg(F.max("round")).first()[0] > 2


def test_ordered_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, name string, homepage string")
    whole, kept, log = ordered_repair.repair_in_order(empty, spark.createDataFrame([], "professor_id long, org_unit_id int"))
    assert whole.count() == kept.count() == log.count() == 0


def test_kept_index_states(spark, tmp_path):
    index = kept_index.KeptIndex(spark, f"file://{tmp_path}/index")
    schema = "source string, key string, kind string, name string, text string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    held = lambda: {(r.source, r.key, r.term, r.tf) for r in index.postings().collect()}
    assert index.postings().count() == 0 and index.search(["alpha"]).count() == 0
    index.replace(rows(("u/1:x", "a", "p", "A", "alpha beta alpha"), ("u/1:x", None, "p", "N", "gamma"), ("v", "b", "p", "B", None), ("w", "c", "p", "C", "beta")), ["u/1:x", "v"])
    assert held() == {("u/1:x", "a", "alpha", 2), ("u/1:x", "a", "beta", 1)} and index.nodes().count() == 2
    index.replace(rows(("u/1:x", "a", "p", "A", "delta")), ["u/1:x", "gone"])
    assert held() == {("u/1:x", "a", "delta", 1)}
    files = [("v", "h1"), ("bad", "h2"), ("new", "h3")]

    def load(source):
        if source == "bad":
            return rows(("bad", "z", "p", "Z", "zeta")).withColumn("name", F.raise_error(F.lit("broken source")).cast("string")).select("key", "kind", "name", "text")
        return rows((source, "k", "p", "K", "kappa")).select("key", "kind", "name", "text")

    assert index.update(files, load) == {"v": "indexed", "bad": "failed", "new": "indexed"}
    assert held() == {("u/1:x", "a", "delta", 1), ("v", "k", "kappa", 1), ("new", "k", "kappa", 1)}
    assert index.update(files, load) == {"v": "unchanged", "bad": "failed", "new": "unchanged"}
    assert "broken" in index.ledger().where("source = 'bad'").first().message
    assert {(r.key, *r.matched) for r in index.search(["kappa", "delta"]).collect()} == {("a", "delta"), ("k", "kappa")}
    assert index.delete("u/1") == ["u/1:x"] and index.delete("u") == [] and len(held()) == 2
    assert index.update([("u/1:x", None)], load) == {"u/1:x": "indexed"}
    index.reset()
    assert held() == set() and index.ledger().count() == 0


def test_a_key_of_many_rows_makes_no_pairs(spark):
    left = [(k, [f"n:{k % 2}", f"b:{k % 5}", "", None]) for k in range(60)]
    right = [(None if k % 7 == 3 else k, [f"n:{k % 3}", f"b:{k % 4}", f"b:{k % 4}"]) for k in range(50)]
    got = ladder.any_key_match(spark.createDataFrame(left, "l int, lk array<string>"), spark.createDataFrame(right, "r int, rk array<string>"), "l", F.col("lk"), F.col("rk"), "r")
    want = {}
    for k, keys in left:
        met = [(key, r is not None, r or 0) for r, others in right for key in keys if key and key in others]
        key, there, r = min(met)
        want[k] = (key, r if there else None)
    assert {x.l: (x.key, x.r) for x in got.collect()} == want
    # one right row a key goes into the join
    assert got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].count("Aggregate") == 1
