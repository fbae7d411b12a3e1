from pyspark.sql import functions as F

from quarrylight.functions import profiles as R
from quarrylight.operators import crawl as K


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


def test_fetch_gate_gives_the_first_reason(spark):
    wanted = spark.createDataFrame([("javascript:x", 0), ("http://a.example.com/x", 9), ("http://b.org/", 0), ("http://a.example.com/v/", 0), ("http://a.example.com/c", 0), ("http://b.example.com/n", 0)], "url string, depth int")
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    got = [r.skip for r in K.fetch_gate(wanted, "www.example.com", 3, urls("http://a.example.com/v"), urls("http://a.example.com/c", "http://a.example.com/v")).orderBy("depth", "url").collect()]
    assert sorted(got, key=str) == sorted(["invalid_url", "depth", "external", "visited", "already_crawled", None], key=str)


def test_node_gate(spark):
    rows = [(1, "http://a.cn/news/1", "detail_url", "pending", 0), (2, "http://a.cn/info/1/2.htm", "detail_url", "pending", 4), (3, "http://a.cn/x", "detail_url", "pending", 4), (4, "http://a.cn/y", "detail_url", "pending", 9), (5, "http://a.cn/z", "detail_url", "done", 0), (6, "http://a.cn/z", "detail_url", "pending", 0)]
    got = {r.id: r.error for r in K.node_gate(spark.createDataFrame(rows, "id long, url string, kind string, status string, depth int"), 3).collect()}
    assert got == {1: "noise_or_login_candidate", 2: None, 3: "profile_depth_gate", 4: "detail_depth_excess", 5: None, 6: "duplicate_url"}


def test_redirects(spark):
    reason = lambda a, b, detail=True: one(spark, K.redirect_reason(F.col("a"), F.col("b"), detail), a=a, b=b)
    assert reason("http://a.cn/szdw/x.htm", "http://a.cn/") == "redirect_to_home"
    assert reason("http://a.cn/szdw/", "http://a.cn/szdw/index.htm") is None
    assert reason("http://a.cn/szdw/x.htm", "http://a.cn/szdw/x/y.htm") is None
    assert reason("http://a.cn/szdw/x.htm", "http://a.cn/zs/y.htm") == "redirect_left_section"
    assert reason("http://a.cn/szdw/", "http://a.cn/news/1.htm", False) == "redirect_to_noise"
    assert reason("http://a.cn/szdw/", "http://mp.weixin.qq.com/s") == "redirect_to_login_or_app"


def test_tasks_keep_the_longest_snapshot_and_never_fall_back(spark):
    rows = [("k", "h1", "long text", "retry", 1, 5, "e", 1), ("k", "h2", "x", "pending", 0, 7, None, 2)]
    got = K.merged_tasks(spark.createDataFrame(rows, "k string, page_hash string, snapshot string, status string, attempt int, priority int, last_error string, seq long"), ["k"]).first()
    assert (got.page_hash, got.status, got.attempt, got.priority, got.last_error) == ("h1", "retry", 1, 7, "e")


def test_cleanup_and_probes(spark):
    tasks = spark.createDataFrame([(1, "http://x.edu.cn/a", None), (2, "http://x.com/a", None), (3, "http://edu.cn.evil.com", None)], "id long, source_url string, page_url string")
    kept, failures = K.off_domain_cleanup(tasks, spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, task_id long"))
    assert [r.id for r in kept.collect()] == [1] and {r.id for r in failures.collect()} == {1, 3}
    units = spark.createDataFrame([("u", "http://cs.a.edu.cn/x")], "unit string, url string")
    pages = spark.createDataFrame([("http://cs.a.edu.cn/teacher/", 900), ("http://cs.a.edu.cn/szdw.htm", 300), ("http://cs.a.edu.cn/szdw/szll.htm", 10)], "url string, n_chars int")
    assert K.path_probes(units, pages).first().url == "http://cs.a.edu.cn/szdw.htm"


def test_detail_links_rank_profiles(spark):
    page = "http://a.cn/szdw/js.htm"
    rows = [(page, "http://a.cn/info/1/22.htm", "张三"), (page, "http://a.cn/szdw/js/lisi.htm", "李四"), (page, "http://a.cn/szdw/js/list_2.htm", "2"), (page, "http://b.cn/info/1/2.htm", "王五"), (page, "http://a.cn/download/x.pdf", "表")]
    got = [r.url for r in K.detail_links(spark.createDataFrame(rows, "page_url string, url string, anchor_text string")).orderBy("rank").collect()]
    assert set(got) == {"http://a.cn/info/1/22.htm", "http://a.cn/szdw/js/lisi.htm"}


def test_best_link_record(spark):
    rows = [("u", "a", None, None, 1), ("u", "张三", "教授", None, 2), ("u", "张三", "教授", None, 3)]
    got = K.best_link_record(spark.createDataFrame(rows, "url string, anchor_text string, title string, research string, seq long")).first()
    assert got.record.title == "教授"


def test_profile_gates(spark):
    gate = lambda text, url="http://a.cn/x": one(spark, R.page_gate(F.col("u"), F.col("t")), u=url, t=text)
    assert gate("# 关于公布2024年名单的通知\n正文") == "notice_issuance_title"
    assert gate("近日，我们") == "recent_school_news_opening"
    assert gate("一些文字", "http://a.cn/news/1") == "url_noise_token" and gate("a@b.cn", "http://a.cn/news/1") is None
    assert gate("新闻\n通知\n别的") == "text_noise_ratio" and gate("x", "http://a.cn/teacher/bsh/1.htm") == "postdoc_section"
    assert one(spark, R.is_postdoc(F.col("n"), F.lit(""), F.col("b"), F.lit("")), n="张赟", b="张赟博士后，研究光学")
    assert not one(spark, R.is_postdoc(F.col("n"), F.lit(""), F.col("b"), F.lit("")), n="张赟", b="张赟教授曾从事博士后研究")


def test_snapshot_records(spark):
    text = "# 张三\n职称：副教授\n电子邮箱：z@a.edu.cn\n研究方向：机器学习；视觉\n个人简介：张三，博士。"
    got = one(spark, R.snapshot_record(F.col("t"), F.lit("http://a.cn/info/1/2.htm")), t=text)
    assert (got.name, got.title, got.email, got.research_areas) == ("张三", "副教授", "z@a.edu.cn", "机器学习；视觉")
    assert one(spark, R.snapshot_record(F.col("t"), F.lit("")), t="办事指南\n内容") is None


def test_urls_of_profiles(spark):
    split = one(spark, R.split_homepage(F.lit("http://cs.a.edu.cn/info/1/2.htm"), F.col("h"), F.col("e")), h="http://x.github.io/me", e=None)
    assert (split.homepage, split.external_link) == ("http://cs.a.edu.cn/info/1/2.htm", "http://x.github.io/me")
    assert one(spark, R.url_on_page(F.col("u"), F.array(F.lit("http://a.cn/x/")), F.lit("")), u="http://a.cn/x")
    assert not one(spark, R.url_on_page(F.col("u"), F.array(F.lit("http://a.cn/x/")), F.lit("see b.cn")), u="http://c.cn/x")
    assert one(spark, R.is_profile_detail(F.col("u")), u="http://a.cn/teacher/zhangsan.htm") and not one(spark, R.is_profile_detail(F.col("u")), u="http://a.cn/teacher/list.htm")
