import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import vocabulary as V
from quarrylight.operators import graph as G
from quarrylight.operators import ladder as M
from quarrylight.operators import logs as L
from quarrylight.operators import merge as R
from quarrylight.operators import search as S
from quarrylight.operators import steward
from quarrylight.operators.profile import parse_profile
from quarrylight.plans import registry
from quarrylight.sources import manifest, sinks, tables

PERSON = "id long, name string, org_unit_name string, title string, research_areas string, email string, phone string, homepage string, external_link string, bio string, enrollment_pref string, publications string"


def person(id, name, org="甲", **k):
    return (id, name, org, *[k.get(f) for f in ("title", "research_areas", "email", "phone", "homepage", "external_link", "bio", "enrollment_pref", "publications")])


def test_ladder_stops_at_the_first_rung(spark):
    a = spark.createDataFrame([(1, "n", "e"), (2, None, "e"), (3, "", "x")], "a long, n string, e string")
    b = spark.createDataFrame([(7, "q", "e"), (8, "n", "z"), (9, "n", "e")], "b long, n string, e string")
    got = {r.a: (r.b, r.reason) for r in M.ladder_match(a, b, "a", "b", [("name", F.col("n"), F.col("n")), ("mail", F.col("e"), F.col("e"))]).collect()}
    assert got == {1: (8, "name"), 2: (7, "mail")}


def test_fuzzy_match_by_containment_and_ratio(spark):
    t = spark.createDataFrame([("计算机",), ("物理学 院",), ("zzz",)], "t string")
    c = spark.createDataFrame([("计算机学院",), ("物理学院",)], "c string")
    got = {r.t: r.c for r in M.best_fuzzy(t, c, "t", "c").collect()}
    assert got == {"计算机": "计算机学院", "物理学 院": "物理学院"}


def test_merge_policies_depend_on_the_unit(spark):
    rows = spark.createDataFrame([((person(1, "张三", title="讲师", email="a@b.cn")), (person(2, "张三", "乙", title="教授", email="c@d.cn", bio="x")))], f"e struct<{PERSON.replace(' long', ':bigint').replace(' string', ':string')}>, i struct<{PERSON.replace(' long', ':bigint').replace(' string', ':string')}>")
    same, other = (rows.select(*[c.alias(f) for f, c in R.merged_profile("e", "i", F.lit(b)).items()]).first() for b in (True, False))
    assert (same.email, same.title, same.org_unit_name, same.bio) == ("c@d.cn", "教授", "甲 / 乙", "x")
    assert (other.email, other.bio) == ("a@b.cn", "x")


@pytest.mark.parametrize(
    ("events", "end"), [(["pending", "failed", "pending"], "retry"), (["done", "pending"], "done"), (["pending", "in_progress", "retry"], "in_progress"), (["skipped", "retry", "done"], "done"), (["failed", "failed", "retry"], "retry")]
)
def test_status_folds(spark, events, end):
    rows = spark.createDataFrame([("k", s, n) for n, s in enumerate(events)], "k string, s string, n int")
    assert R.fold_status(rows, "k", "s", "n").first().status == end


def test_claim_order_backs_off(spark):
    nodes = spark.createDataFrame([(1, "pending", 80.0, 80.0, 1.0, 0, 0), (2, "retry", 80.0, 80.0, 1.0, 0, 2), (3, "retry", 99.0, 99.0, 1.0, 0, 3), (4, "done", 99.0, 99.0, 1.0, 0, 0)], "id long, status string, base_priority double, priority_score double, confidence double, depth int, attempt_count int")
    assert [r.id for r in G.claim_next(nodes, limit=9).collect()] == [1, 2]
    assert [r.id for r in G.claim_next(nodes, nodes.where("id = 1")).collect()] == [2]


def test_identity_repair_follows_chains(spark):
    people = spark.createDataFrame([person(1, "张三", homepage="http://a.cn/info/1/1.htm"), person(2, "1.张三", email="a@b.cn"), person(3, "张叁", homepage="http://a.cn/info/1/1.htm", bio="b"), person(4, "李四")], PERSON)
    aff = spark.createDataFrame([(1, 1, 9), (2, 2, 9), (3, 3, 8), (4, 4, 9)], "id long, professor_id long, org_unit_id long")
    merged, moved = R.repair_identities(people, aff)
    got = {r.id: r for r in merged.collect()}
    assert len(got) == 2 and {r.keeper_id for r in moved.collect()} == {3}
    assert (got[3].email, got[3].bio) == ("a@b.cn", "b")


def test_tfidf_and_boost(spark):
    docs = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha"), ("c", "人工智能")], "k string, t string")
    index = S.term_counts(docs, "k", "t")
    found = S.search(index, ["beta", "人工智能"], docs.agg(F.count("*").alias("n")), "k").collect()
    assert [(r.k, r.matched) for r in found] == [("c", ["人工智能"]), ("a", ["beta"])] and found[0].score > found[1].score
    scores = spark.createDataFrame([("p", "professor", 1.0), ("c1", "concept", 2.0)], "key string, kind string, score double")
    links = spark.createDataFrame([("p", "c1"), ("q", "c1")], "key string, concept string")
    assert {r.key: r.score for r in S.boosted(scores, links).collect()} == {"p": 2.6, "q": 1.6}


def test_recommendation(spark):
    fields = "key string, kind string, name string, university_key string, university_name string, org_keys array<string>, org_unit_name string, location string, title string, research_areas string, bio string, enrollment_pref string, publications string, email string, homepage string"
    row = lambda key, kind, name, org=None, **k: (key, kind, name, "u", "TestU", [org] if org else [], k.get("unit"), "北京", k.get("title"), k.get("research"), None, k.get("enrol"), None, k.get("email"), None)
    nodes = spark.createDataFrame([row("u", "university", "TestU"), row("o1", "org_unit", "计算机学院"), row("o2", "org_unit", "材料学院"), row("p1", "professor", "Ada", "o1", unit="计算机学院", title="教授", research="人工智能；机器学习", enrol="博士生导师", email="a@b"), row("p2", "professor", "Bob", "o2", unit="材料学院", title="副教授", research="量子材料", enrol="硕士生导师")], fields)
    docs = nodes.select("key", F.concat_ws(" ", "name", "org_unit_name", "title", "research_areas", "enrollment_pref", "location").alias("t"))
    index = S.term_counts(docs, "key", "t")
    out = S.recommend(nodes, index, spark.createDataFrame([], "key string, concept string"), "希望在北京读人工智能和机器学习方向的博士，博士生导师", spark)
    assert out["people"].first().name == "Ada" and out["people"].first().score > 0
    assert out["org_units"].first().org_key == "o1" and out["schools"].first().school_key == "u"


def test_profile_parser(spark):
    p = parse_profile(spark, "北京的人工智能博士，教授")
    assert p["degrees"] == ["博士"] and p["locations"] == ["北京"] and "教授" in p["titles"]


def test_log_metrics(spark):
    logs = spark.createDataFrame([("m", None, 1, 1, 0.5, t) for t in (1, 2, 3)] + [("m", "x", 1, 1, 0.5, 4), ("", None, 1, 1, 0.0, 9)], "model string, error string, input_tokens long, output_tokens long, cost double, use_time long")
    got = {(r.dimension, r.key): r for r in L.metrics_by(logs, "model").collect()}
    assert got["model", "m"].use_time_p50 == 2 and got["model", "m"].use_time_p90 == 4 and got["model", "m"].failed == 1
    assert got["overall", None]["count"] == 5 and len(got) == 2


def test_attempts_survive_bad_entries(spark):
    text = json.dumps([{"status": "failed", "msg": "503: busy {x"}, 7, {"status": "success", "msg": "ok"}])
    df = spark.createDataFrame([(text,), ("no json",), (None,)], "attempts string")
    assert [(r.reason, r.n) for r in L.top_failures(df).collect()] == [("503: busy", 1)]
    assert one_code(spark, "error 429 in 503: x") == "503"


def one_code(spark, text):
    return spark.createDataFrame([(text,)], "m string").select(L.http_code(F.col("m")).alias("c")).first().c


def test_claim_loop_equals_a_plain_loop(spark):
    from quarrylight.operators import graph as G

    links = [(a, b, float((a * 7 + b * 3) % 50), float(b % 10)) for a in range(60) for b in {(a * 3 + 1) % 97, (a * 5 + 2) % 97, (a + 40) % 97} if a % 7]
    seeds = [(k, 60.0, 1.0, 0, "pending", 0) for k in range(5)]
    schema = "id long, base_priority double, confidence double, depth int, status string, attempt_count int"
    got = G.claim_loop(spark.createDataFrame(seeds, schema), spark.createDataFrame(links, "src long, dst long, base_priority double, confidence double"), 4, 6, 3)
    assert {r.id: [r.base_priority, r.confidence, r.depth, r.status, r.attempt_count, r.round] for r in got.collect()} == plain_claims(seeds, links, 4, 6)
    whole = G.claim_loop(spark.createDataFrame(seeds, schema), spark.createDataFrame(links, "src long, dst long, base_priority double, confidence double"), 9, max_depth=3)
    end = {r.id: [r.base_priority, r.confidence, r.depth, r.status, r.attempt_count, r.round] for r in whole.collect()}
    assert end == plain_claims(seeds, links, 9, 99) and all(n[5] for n in end.values())
    empty = spark.createDataFrame([], schema)
    assert G.claim_loop(empty, spark.createDataFrame([], "src long, dst long, base_priority double, confidence double"), 4).count() == 0


def plain_claims(seeds, links, at_once, rounds):
    nodes, pages = {s[0]: [*s[1:], None] for s in seeds}, {x[0] for x in links}
    for k in range(1, rounds + 1):
        waiting = sorted((i for i, n in nodes.items() if n[3] in ("pending", "retry") and n[5] is None), key=lambda i: (-(nodes[i][0] - 5 * nodes[i][4]), -nodes[i][1], nodes[i][2], nodes[i][4], i))[:at_once]
        found = {}
        for i in waiting:
            nodes[i][3:] = ["done" if i in pages else "retry", nodes[i][4] + 1, k]
            if nodes[i][2] < 3:
                for _, b, p, c in (x for x in links if x[0] == i):
                    old = found.get(b, (p, c, nodes[i][2]))
                    found[b] = (max(p, old[0]), max(c, old[1]), min(nodes[i][2], old[2]))
        for b, (p, c, depth) in found.items():
            nodes.setdefault(b, [p, c, depth + 1, "pending", 0, None])
    return nodes


def test_steward_promotes_into_the_other_table(spark):
    t = steward_tables(spark)
    more = spark.createDataFrame([person(9, "钱七", bio="钱七，2019年当选中国科学院院士。", email="q@a.cn")], PERSON)
    t["professors"] = t["professors"].unionByName(more)
    before = t["academicians"].count()
    after, audits = steward.run(t, apply=True)
    assert 9 not in {r.id for r in after["professors"].collect()}
    assert after["academicians"].count() == before + 1 and "钱七" in {r.name for r in after["academicians"].collect()}
    assert audits.where("issue_type = 'academician_promotion'").first().action == "moved"


def test_steward_dry_run_changes_nothing(spark):
    t = steward_tables(spark)
    after, audits = steward.run(t, apply=False)
    assert after["professors"].count() == t["professors"].count()
    found = {(r.issue_type, r.entity_id) for r in audits.collect()}
    assert {("excluded_org_unit", 2), ("synthetic_profile", 4), ("duplicate_identity", 3), ("academician_duplicate", 5), ("research_backfill", 1)} <= found
    assert {r.action for r in audits.collect()} == {"report_only"}


def test_steward_applies(spark):
    after, audits = steward.run(steward_tables(spark), apply=True)
    assert {r.id for r in after["professors"].collect()} == {1}
    assert after["professors"].first().research_areas == "量子计算"
    assert {r.id for r in after["org_units"].collect()} == {1}
    assert "crawl_failure" in {r.reason for r in audits.where("issue_type = 'missing_field'").collect()}


def steward_tables(spark):
    people = [
        person(1, "张三", bio="主要从事量子计算研究。", email="z@a.cn"), person(3, "1. 张三"), person(4, "姓名：李四", bio="首页学院概况师资队伍人才培养"),
        person(5, "王五", email="w@a.cn"), person(6, "赵六", "音乐学院"),
    ]
    return {
        "org_units": spark.createDataFrame([(1, "甲", "http://a.cn", None), (2, "音乐学院", "http://m.cn", None)], "id long, name string, url string, kind string"),
        "professors": spark.createDataFrame(people, PERSON),
        "professor_affiliations": spark.createDataFrame([(i, i, 2 if i == 6 else 1, f"http://s.cn/{i}") for i in (1, 3, 4, 5, 6)], "id long, professor_id long, org_unit_id long, source_url string"),
        "academicians": spark.createDataFrame([(9, "王五", 1, "w@a.cn", None, None)], "id long, name string, org_unit_id long, email string, homepage string, external_link string"),
        "crawl_logs": spark.createDataFrame([(1, "http://s.cn/1", "failed", "timeout")], "id long, url string, status string, message string"),
        "crawl_extraction_failures": spark.createDataFrame([], "id long, org_unit_name string"),
    }


def test_key_rewrite_keeps_old_pairs(spark):
    rows = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 11, 6)], "id long, p long, o long")
    moved = spark.createDataFrame([(11, 10)], "old long, new long")
    assert {(r.id, r.p, r.o) for r in R.rewrite_keys(rows, "p", moved, ["p", "o"]).collect()} == {(1, 10, 5), (3, 10, 6)}


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {r.url: r.depth for r in G.crawl(spark.createDataFrame([("a",)], "url string"), links, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_manifests(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("# note\n类型,学校,网址\nuniversity,甲大学,http://a.cn/；http://b.cn\nuniversity,甲大学,x\n")
    rows = manifest.read_csv_manifest(spark, str(path))
    assert {r.url for r in rows.collect()} == {"http://a.cn/", "http://b.cn", "x"}
    assert [r.problem for r in manifest.manifest_problems(rows).collect()] == ["not an absolute url"]
    text = "version: 1\nuniversities:\n- name: 乙\n  url: http://c.cn\n  org_unit_listing_urls: ['http://c.cn/l']\n"
    assert manifest.read_yaml_manifest(spark, text).count() == 2
    with pytest.raises(ValueError):
        manifest.read_yaml_manifest(spark, "version: 2")


def test_resumes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("你好")
    (tmp_path / "b.bin").write_text("x")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in manifest.read_resumes(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "你好", "b.bin": None}


def test_tolerant_scan_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    schema = spark.createDataFrame([], "id long, name string, url string").schema
    assert tables.with_columns(df, schema).first().url is None
    assert tables.optional_table(spark, str(tmp_path / "none"), schema).count() == 0
    full = {n: tables.with_columns(df, spark.createDataFrame([], ", ".join(f"{c} {'long' if c.endswith('id') else 'string'}" for c in cols)).schema) for n, cols in sinks.PUBLIC_COLUMNS.items()}
    sinks.export_public(full, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "org_units")).columns == sinks.PUBLIC_COLUMNS["org_units"]
    full["professor_affiliations"] = full["professor_affiliations"].withColumn("professor_id", F.lit(5).cast("long"))
    with pytest.raises(ValueError, match="affiliation without professor"):
        sinks.export_public(full, str(tmp_path / "bad"))


def test_status_fold_composes_slices(spark, monkeypatch):
    rng = random.Random(3)
    pool = [*V.NODE_STATUS_RANK, None, "", "odd", "other"]
    rows = [(rng.choice("aaaabcd"), rng.choice(pool if n % 3 else pool[:3]), n) for n in range(900)] + [("none", None, 1), ("none", None, 2), ("blank", "", 1), ("odd", "odd", 1), ("odd", None, 2)]
    rows += [(f"k{a}{b}", s, n) for a, x in enumerate(pool) for b, y in enumerate(pool) for n, s in enumerate((x, y))]
    rank = V.NODE_STATUS_RANK

    def step(now, new):
        if not new or new == now or now == "done":
            return now
        if now in ("failed", "skipped") and new in ("pending", "retry"):
            return "retry"
        return new if rank.get(new, 0) >= rank.get(now, 0) else now

    want = {}
    for k, v, _ in sorted(rows, key=lambda r: r[2]):
        want[k] = step(want[k], v) if k in want else v
    df = spark.createDataFrame(rows, "k string, s string, n long").repartition(3)
    for bits in (2, 12):
        monkeypatch.setattr(R, "SLICE", bits)
        out = R.fold_status(df, "k", "s", "n")
        assert {r.k: r.status for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" in out._jdf.queryExecution().executedPlan().toString()


def test_identity_components_of_all_documents_equal_union_find(spark, tmp_path):
    rng = random.Random(4)
    spans = [f"passage number {k:02d} of the benchmark" for k in range(8)]
    docs = [(n, "a hot text") for n in range(100, 160)] + [(n, f"own {rng.randrange(25)} " + " ".join(rng.sample(spans, rng.choice([0, 0, 0, 1, 1, 2])))) for n in range(80)] + [(200, ""), (201, ""), (202, None), (203, "alone")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(spans), (50, spans[0]), (51, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    up = {i: i for i, _ in docs}

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, t in docs:
        for j, u in docs:
            if t and u and (t == u or any(s in t and s in u for s in spans)):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in registry.queries()["identity_components_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: find(i) for i, _ in docs}


def test_email_extract_returns_documents_with_several_addresses(spark, tmp_path):
    rows = [(1, "write to b@x.cn, a@x.cn or b@x.cn"), (2, "c@y.org"), (3, "none"), (4, None), (5, "a@b.cn c@d.cn e@f.cn g@h.cn")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.mail for r in registry.queries()["email_extract"](spark, str(tmp_path)).collect()}
    assert got == {1: "b@x.cn,a@x.cn", 2: "c@y.org", 5: "a@b.cn,c@d.cn,e@f.cn"}


def test_term_queries_keep_chinese_terms(spark, tmp_path):
    rows = [(n, "alpha 量子材料") for n in range(25)] + [(30, "人工智能 人工智能 beta")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    top = {r.term: r.tf for r in registry.queries()["top_terms_per_doc"](spark, str(tmp_path)).where("doc_id = 30").collect()}
    assert top["人工智能"] == 4  # twice, each time as a whole and as the longest of its n-grams
    assert {"alpha", "量子", "量子材料"} <= {r.term for r in registry.queries()["term_df_idf"](spark, str(tmp_path)).where("df = 25").collect()}
