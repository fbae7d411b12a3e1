"""Steps that grew faster than their input, against their plain forms."""

import numpy as np
from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import graph, nearest, routes, search
from quarrylight.plans import registry
from quarrylight.sources.tables import Scratch


def plain_cosines(rows, k):
    """All pairs, one after the other."""
    out = {}
    for q, a in rows:
        if q % 3:
            continue
        found = []
        for i, b in rows:
            if i != q:
                usable = a is not None and b is not None and len(a) == len(b) and None not in (*a, *b)
                score = None
                if usable:
                    dot = lambda x, y: sum((s * t for s, t in zip(x, y)), 0.0)
                    norm = dot(a, a) ** 0.5 * dot(b, b) ** 0.5
                    score = round(dot(a, b) / norm, 6) if norm else float("nan")
                order = (2,) if score is None else (0,) if score != score else (1, -score)
                found.append((order, i, score))
        out[q] = [(i, s) for _, i, s in sorted(found)[:k]]
    return out


def test_cosine_topk_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 4)).round(1).tolist()
    rows = [(i, base[int(rng.integers(12))]) for i in range(90)]
    rows += [(90, None), (91, [1.0, None, 2.0, 0.5]), (92, [0.0] * 4), (93, None), (94, [1.0, 2.0]), (96, [2.0, 1.0]), (99, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>")
    got = nearest.cosine_topk(df, F.col("vec_id") % 3 == 0, "vec_id", "e", 5, shard_size=20, block_size=7).orderBy("q_id", "rank").collect()
    want = [(q, n + 1, i, s) for q, found in sorted(plain_cosines(rows, 5).items()) for n, (i, s) in enumerate(found)]
    same = lambda r: tuple("nan" if x != x else x for x in r)
    assert [same((r.q_id, r.rank, r.vec_id, r.score)) for r in got] == [same(w) for w in want]


def test_cosine_topk_makes_no_pairs_in_the_plan(spark):
    plan = registry.queries()["cosine_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_repair_replay_reads_addresses_once(spark):
    """The log comes from written steps: no part of it normalises addresses again."""
    tasks = spark.createDataFrame([(1, "https://a.edu.cn/p/1", "list_page", "failed", 1, 0, None, None, None)], "id long, source_url string, task_kind string, status string, attempt int, priority int, last_error string, snapshot_record struct<name:string>, link_record struct<name:string>")
    nodes = spark.createDataFrame([("k", "detail_url", "https://a.edu.cn/p/1/", "failed", 1, 1.0, 1.0, None)], "node_key string, type string, url string, status string, attempt_count int, priority_score double, base_priority double, last_error string")
    log = routes.replay(tasks, nodes, F.lit(None).cast("long"))[3]
    assert sorted((r.table, r.action) for r in log.collect()) == [("node", "retarget"), ("task", "reopen")]
    assert "regexp_extract" not in log._jdf.queryExecution().optimizedPlan().toString()


def test_claim_loop_cuts_what_waits_by_ranges(spark, tmp_path):
    """More wait than are claimed at once: no plan takes the best of all in one task."""
    rows = [(i, float(i * 7 % 50), float(i % 3), i % 4, "pending", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, base_priority double, confidence double, depth int, status string, attempt_count int").repartition(4)
    scratch = Scratch(spark)
    for limit in (0, 1, 137, 399, 400, 500):
        got = graph._first_of(graph.claimable(df), limit, scratch)
        want = graph.claim_next(df, limit=limit)
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_terms_do_not_move(spark):
    """Texts move once; their terms are counted and ranked where they are."""
    df = registry.queries()["top_terms_per_doc"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan


def test_term_counts_equal_tokenize(spark):
    texts = ["C++ a.b. -x The the 12 a1 _-. K\u212a \u0130x", "量子计算 deep-learning 机器学习机器学习 is", None, "", "x..y ++ A_ zz-- 北京大学。北京"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = df.select("doc_id", F.explode(text.tokenize(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, search.term_counts(df, "doc_id", "text").collect())) == sorted(map(tuple, want.collect()))
