"""Repairs, list pages, unit discovery and skills on small cases."""

from pyspark.sql import functions as F

from quarrylight.operators import routes as R

NODE = "node_key string, type string, url string, status string, attempt_count int, priority_score double, base_priority double, last_error string"


def state(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replay_decides_and_a_second_one_changes_nothing(spark):
    person = ("王伟",)
    tasks = spark.createDataFrame(
        [
            (1, "https://a.edu.cn/info/1/1", "list_page", "failed", 3, -90, None, person, None),
            (2, "https://a.edu.cn/info/1/2", "list_page", "failed", 3, 5, None, None, person),
            (3, "https://a.edu.cn/info/1/3", "list_page", "failed", 3, None, None, None, None),
            (4, "https://a.edu.cn/info/1/4", "list_page", "failed", 3, 0, None, person, None),
            (5, None, "list_page", "failed", 3, 0, None, None, None),
        ],
        "id int, source_url string, task_kind string, status string, attempt int, priority int, last_error string, snapshot_record struct<name:string>, link_record struct<name:string>",
    )
    nodes = spark.createDataFrame(
        [
            ("faculty_list_url:url:https://a.edu.cn/info/1/1", "faculty_list_url", "https://a.edu.cn/info/1/1", "failed", 2, 60.0, 85.0, "x"),
            ("pagination_url:url:https://a.edu.cn/info/1/1", "pagination_url", "https://a.edu.cn/info/1/1", "failed", 2, 60.0, 60.0, "x"),
            ("faculty_list_url:url:https://a.edu.cn/info/1/2", "faculty_list_url", "https://a.edu.cn/info/1/2", "failed", 2, 60.0, 60.0, None),
            ("detail_url:org:7:url:https://a.edu.cn/info/1/2", "detail_url", "https://a.edu.cn/elsewhere", "failed", 2, 99.0, 60.0, None),
            ("other", "org_unit", "https://a.edu.cn/x", "done", 0, 1.0, 1.0, None),
        ],
        NODE,
    )
    after, graph, records, log = R.replay(tasks, nodes, F.lit(7))
    assert {r.id: (r.status, r.attempt, r.priority, r.last_error) for r in after.collect()} == {
        1: ("done", 3, -90, "repair_replayed"), 2: ("pending", 0, -75, "repair_refetch_required"), 3: ("pending", 0, -75, "repair_refetch_required"), 4: ("done", 3, 0, "repair_replayed"), 5: ("pending", 0, -75, "repair_refetch_required"),
    }
    assert sorted(r.id for r in records.collect()) == [1, 2, 4]
    got = {r.node_key: (r.type, r.status, r.priority_score, r.last_error) for r in graph.collect()}
    key = "detail_url:org:7:url:https://a.edu.cn/info/1/"
    assert got[key + "1"] == ("detail_url", "done", 75.0, "repair_replayed") and got[key + "3"][1] == "pending" and got[key + "4"][1] == "done"
    assert got["pagination_url:url:https://a.edu.cn/info/1/1"] == ("pagination_url", "skipped", 60.0, f"repair_duplicate_of:{key}1")
    assert got[key + "2"] == ("detail_url", "pending", 99.0, "repair_refetch_required")
    assert got["faculty_list_url:url:https://a.edu.cn/info/1/2"][1:] == ("skipped", 60.0, f"repair_superseded_by:{key}2") and got["other"][1] == "done" and len(got) == 7
    assert sorted(r.action for r in log.where("`table` = 'node'").collect()) == ["create", "create", "duplicate", "retarget", "supersede", "take_over"]
    again, graph2, _, second = R.replay(spark.createDataFrame(after.collect(), after.schema), spark.createDataFrame(graph.collect(), graph.schema), F.lit(7))
    assert second.collect() == [] and state(again) == state(after) and state(graph2) == state(graph)


def test_list_pages_are_recorded_or_rescued(spark):
    rows = [
        ("a", "https://a.edu.cn/szdw/list.htm", "https://a.edu.cn/szdw/list.htm", "# 王伟\n职称：教授\n邮箱：w@a.edu.cn", "物理学院"),
        ("b", "https://a.edu.cn/szdw/list2.htm", None, "教师名录\n王伟 李明", " Unknown "),
        ("c", None, None, None, None), ("d", "https://a.com/szdw", "https://a.com/szdw", "x", "u"), ("e", "https://a.edu.cn/szdw/x.htm", "https://a.edu.cn/", "x", "u"),
    ]
    outcomes, records, counters = R.traverse_lists(spark.createDataFrame(rows, "node_key string, asked string, got string, text string, label string"))
    got = {r.node_key: (r.node_status, r.last_error, r.task_status, r.rescued) for r in outcomes.collect()}
    assert got == {"a": ("done", None, "done", True), "b": ("done", None, "done", False), "c": ("skipped", "missing_source_url", None, False), "d": ("skipped", "non_edu_cn_task_url", None, False), "e": ("skipped", "redirect:redirect_to_home", None, False)}
    assert [(r.node_key, r.name, r.title) for r in records.collect()] == [("a", "王伟", "教授")]
    assert {r.name: r.n for r in counters.collect()} == {"done": 2, "list_skipped": 2, "redirect_skipped": 1, "list_page_profile_rescued": 1, "list_save_suppressed": 1, "list_known_org_unit_processed": 1}


def test_unit_discovery_takes_the_first_tier_that_holds(spark):
    roots = spark.createDataFrame([(k, f"https://www.{k}.edu.cn/", f"www.{k}.edu.cn") for k in "abc"], "root string, link string, start_host string")
    first = spark.createDataFrame([("a", "https://www.a.edu.cn/about"), ("a", "https://www.a.edu.cn/yxsz.htm"), ("b", "https://other.edu.cn/yxsz.htm"), ("b", "https://faculty.b.edu.cn/x")], "root string, link string")
    second = spark.createDataFrame([("a", "https://www.a.edu.cn/z"), ("b", "https://x.b.edu.cn/colleges")], "root string, link string")
    got = [tuple(r) for r in R.discover_unit_pages(roots, [first, second]).orderBy("root").collect()]
    assert got == [("a", "https://www.a.edu.cn/yxsz.htm", 0, 1), ("b", "https://x.b.edu.cn/colleges", 1, 1), ("c", "https://www.c.edu.cn/", 2, 1)]


def test_proposed_units_are_checked_against_the_page(spark):
    pages = spark.createDataFrame([("https://a.edu.cn/jg/x.htm", "a.edu.cn", ["https://wl.a.edu.cn/", "https://a.edu.cn/jg/hx.htm"], "see sx.a.edu.cn")], "page string, start_host string, links array<string>, text string")
    said = [("物理", "https://wl.a.edu.cn"), ("化学", "hx.htm"), ("数学", "https://sx.a.edu.cn/home"), ("文学", "https://wx.a.edu.cn/"), ("", "hx.htm"), ("理学类", "hx.htm"), ("外", "https://b.com/"), ("网", "https://faculty.a.edu.cn/"), ("空", None)]
    df = spark.createDataFrame([("https://a.edu.cn/jg/x.htm", n, u, None) for n, u in said] + [("https://a.edu.cn/lost", "丢", "/x", None)], "page string, name string, url string, kind string")
    got = [r.state for r in R.checked_units(df, pages, F.col("name").endswith("类")).collect()]
    assert sorted(got) == sorted(["accepted", "accepted", "accepted", "not_on_page", "incomplete", "category", "off_site", "platform", "incomplete", "not_captured"])


def test_skills_by_front_matter(spark):
    long = "Choose official same-site faculty and org-unit links. " * 20
    files = [
        ("extract-links", f"---\napplies_to: DISCOVER_ORG_UNIT_PAGES,FIND_FACULTY_PAGES\nallowed_tools: extract_links\npriority: 5\ntoken_budget: 20\n---\n{long}"),
        ("save-professors", "---\npriority: 'x'\n---\nSave."), ("plain", "no front matter\n---\nmore"), ("open", "---\nname: never closed\n"), ("any", '---\r\nname: "first"\r\npriority: 1\r\nallowed_tools: b; a\r\n---\r\nbody\r\n'), ("none", None),
    ]
    skills = R.skills_of(spark.createDataFrame(files, "stem string, content string"))
    made = {r.name: r for r in skills.collect()}
    assert made["save-professors"].applies_to == ["EXTRACT_PROFESSORS"] and made["save-professors"].allowed_tools == ["save_professors"] and made["save-professors"].priority == 100
    assert made["first"].allowed_tools == ["b", "a"] and made["first"].body == "body" and made["plain"].applies_to == ["*"] and made["open"].body.startswith("---")
    states = spark.createDataFrame([("FIND_FACULTY_PAGES", ["extract_links"]), ("EXTRACT_PROFESSORS", ["save_professors", "a", "b"]), ("OTHER", [])], "state string, tools array<string>")
    got = {}
    for r in R.select_skills(skills, states).orderBy("state", "rank").collect():
        got.setdefault(r.state, []).append((r.name, r.rendered))
    assert [n for n, _ in got["FIND_FACULTY_PAGES"]] == ["extract-links", "none", "open", "plain"]
    assert got["FIND_FACULTY_PAGES"][0][1].endswith("\n[truncated by skill token_budget]") and "Allowed tools: extract_links" in got["FIND_FACULTY_PAGES"][0][1]
    assert [n for n, _ in got["EXTRACT_PROFESSORS"]] == ["first", "none", "open", "plain", "save-professors"] and [n for n, _ in got["OTHER"]] == ["none", "open", "plain"]


def test_newest_file(spark, tmp_path):
    import os

    from quarrylight.sources.tables import files_of, newest_first

    for name, at in (("a.db", 100), ("b.db", 300), ("c.db", 300), ("d.txt", 900)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (at, at))
    files = files_of(spark, f"file://{tmp_path}", "*.db").withColumn("kind", F.lit("backup"))
    assert [r.path.rsplit("/", 1)[-1] for r in newest_first(files, "kind").collect()] == ["c.db"]


def test_payloads_are_made_fit_for_saving(spark):
    from quarrylight.operators import payloads as N

    page = "# 王伟\n职称：教授\n邮箱：w@a.edu.cn\n[王 伟](https://a.edu.cn/p/ww) [王伟](/p)"
    tasks = [(k, k != 1, "物理学院", "https://wl.a.edu.cn/", f"https://a.edu.cn/{k}", page if k != 6 else None, None) for k in range(1, 8)] + [(8, True, None, None, None, None, None)]
    unit = {1: "物理学院", 2: "实验教学中心", 3: "光学系", 4: "化学学院", 6: None, 8: " "}
    people = [("王伟", None, " ", None, None, None), ("李明", "讲师", None, None, None, None)]
    given = [(k, u, None, "", people) for k, u in unit.items()] + [(5, "理物", None, None, None)]
    df = spark.createDataFrame(given, f"task_id int, org_unit_name string, org_unit_url string, source_url string, professors {N.from_page_type()}")
    t = spark.createDataFrame(tasks, "task_id int, detail boolean, org_unit_name string, org_unit_url string, source_url string, page_text string, page_url string")
    out, counters = N.normalised_payloads(df, t, spark.createDataFrame([("物理学院", "理物"), ("物理学院", "理物")], "canonical string, alias string"))
    got = {r.task_id: r for r in out.collect()}
    assert {k: (r.org_unit_name, r.org_unit_url, r.source_url, r.route) for k, r in got.items()} == {
        3: ("物理学院", "https://wl.a.edu.cn/", "https://a.edu.cn/3", "sub_department_rewritten"), 4: ("化学学院", "https://wl.a.edu.cn/", "https://a.edu.cn/4", "kept"),
        5: ("物理学院", "https://wl.a.edu.cn/", "https://a.edu.cn/5", "alias_rewritten"), 6: ("物理学院", "https://wl.a.edu.cn/", "https://a.edu.cn/6", "kept"),
        7: ("物理学院", "https://wl.a.edu.cn/", "https://a.edu.cn/7", "synthesized"), 8: ("Unknown", None, None, "kept"),
    }
    first, second = got[3].professors
    assert (first.title, first.email, first.homepage) == ("教授", "w@a.edu.cn", "https://a.edu.cn/p/ww") and (second.title, second.email, second.homepage) == ("讲师", None, None)
    assert got[5].professors == [] and got[7].professors[0].name == "王伟" and got[6].professors[0].title is None
    assert {r.route: r.n for r in counters.collect()} == {"list_suppressed": 1, "teaching_center_dropped": 1, "sub_department_rewritten": 1, "kept": 3, "alias_rewritten": 1, "synthesized": 1}


def test_list_pages_are_dealt_out_and_read_once(spark):
    k = F.col("id").cast("string")
    url = F.concat(F.lit("https://a.edu.cn/szdw/list"), k, F.lit(".htm"))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("# 王伟\n职称：教授\n邮箱：w"), k, F.lit("@a.edu.cn"))).otherwise("教师名录\n王伟 李明")
    fetched = spark.range(0, 400, 1, 1).select(k.alias("node_key"), url.alias("asked"), url.alias("got"), text.alias("text"), F.lit("u").alias("label"))
    parts = R.traverse_lists(fetched)
    assert parts[0].where("rescued").count() == 200 and parts[1].count() == 200
    # one task's rows were dealt to several, and no result reads the pages again
    assert len(parts[0].inputFiles()) > 1
    for df in parts:
        assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_skills_are_ranked_without_their_bodies(spark):
    named = [(f"s{k:02}", 1, "d", ["*"] if k % 3 else ["A", "B"], ["t"] if k % 4 == 0 else [], k % 5, None, f"body {k}") for k in range(40)]
    twice = [("s01", 1, "d", ["*"], [], 9, None, "later"), ("s07", 1, "d", ["*"], [], 2, None, "body 7")]
    skills = spark.createDataFrame(named + twice, "name string, version int, description string, applies_to array<string>, allowed_tools array<string>, priority int, token_budget int, body string")
    states = spark.createDataFrame([("A", ["t"]), ("B", []), ("C", [])], "state string, tools array<string>")
    chosen = R.select_skills(skills, states)
    got = {(r.state, r.rank): (r.name, r.rendered.rsplit("\n", 1)[1]) for r in chosen.collect()}
    want = {}
    for state, tools in (("A", ["t"]), ("B", []), ("C", [])):
        fits = sorted((s[5], s[0], s[7]) for s in named if (s[3] == ["*"] or state in s[3]) and set(s[4]) <= set(tools))
        want |= {(state, n + 1): x[1:] for n, x in enumerate(fits)}
    assert got == want and chosen.count() == len(want)
    # no ranking holds a body
    plan = chosen._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(n for n, line in enumerate(plan) if "row_number" in line)
    assert "body" not in plan[at] and "body" not in plan[at + 1]


def test_pages_with_forms_are_dealt_out(spark):
    from quarrylight.functions.html import form_pagination

    html = F.concat(F.lit('<a href="javascript:document.f.fNOW.value='), F.col("id").cast("string"), F.lit(';document.f.submit()">x</a>'))
    pages = spark.range(0, 60, 1, 1).select("id", F.lit("https://a.edu.cn/x.jsp").alias("url"), html.alias("html"))
    found = form_pagination(pages, "id")
    assert sorted((r.id, r.page_index) for r in found.collect()) == [(k, k) for k in range(2, 60)]
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
