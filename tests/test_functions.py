import pytest
from pyspark.sql import functions as F

from quarrylight.functions import classify as C
from quarrylight.functions import html as H
from quarrylight.functions import people as P
from quarrylight.functions import python_udfs as X
from quarrylight.functions import text as T
from quarrylight.functions import urls as U


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("1. 张 三", "张三"), ("李​四（兼）", "李四"), ("Wang Wei (王 伟)", "Wang Wei"), ("  ·王五", "·王五"), (None, ""), ("王伟（男）", "王伟（男）")],
)
def test_names(spark, raw, clean):
    assert one(spark, P.normalise_name(F.col("x")), x=raw) == clean


@pytest.mark.parametrize(
    ("raw", "title"), [("副教授、博导", "副教授"), ("Associate Professor", "副教授"), ("教授", "教授"), ("Assistant  Professor", "教授"), ("Assistant Professor", "助理教授"), ("工程师", "工程师"), ("无", None), ("中国科学院院士", "院士")]
)
def test_titles(spark, raw, title):
    assert one(spark, P.normalise_title(F.col("x")), x=raw) == title


def test_title_quality_decides_merges(spark):
    assert one(spark, P.better_title(F.col("a"), F.col("b")), a="讲师", b="教授") == "教授"
    assert one(spark, P.better_title(F.col("a"), F.col("b")), a="教授", b="讲师") == "教授"
    assert one(spark, P.better_title(F.col("a"), F.col("b")), a=None, b="x") is None


def test_enrolment_and_research(spark):
    assert one(spark, P.infer_enrolment(F.col("x")), x="教授，博导、硕导") == "博士生导师；硕士生导师"
    assert one(spark, P.merge_enrolment(F.col("a"), F.col("b")), a="博士生导师/硕士生导师", b="博士生导师") == "博士生导师；硕士生导师"
    assert one(spark, P.normalise_research(F.col("x")), x="机器学习；邮箱：a@b.cn；机器学习；视觉") == "机器学习；视觉"
    assert one(spark, P.infer_research(F.col("x")), x="主要从事量子计算和光学等方面的研究。") == "量子计算；光学"
    assert one(spark, P.infer_research(F.col("x")), x="他喜欢旅行。") is None


def test_tokens_count_short_runs_twice(spark):
    tokens = one(spark, T.tokenize(F.col("x")), x="人工智能 AI-lab the 7")
    assert tokens.count("人工智能") == 2 and tokens.count("人工") == 1 and "ai-lab" in tokens and "the" not in tokens
    assert one(spark, T.tokenize(F.col("x")), x="好") == []


def test_concepts_and_keys(spark):
    assert one(spark, T.extract_concepts(F.col("x"), limit=3), x="机器学习；视觉，机器学习") [:2] == ["机器学习", "视觉"]
    assert one(spark, T.concept_key(F.col("x")), x=" 北京 ").startswith("concept:")


@pytest.mark.parametrize(
    ("raw", "url"),
    [("HTTP://WWW.A.edu.cn/X/#f", "http://www.a.edu.cn/X"), ("<http://a.cn/>", "http://a.cn"), ("[x](http://a.cn/b/)", "http://a.cn/b"), ("a/b/", "a/b"), (None, ""), ("http://a.cn/x?q=1#z", "http://a.cn/x?q=1")],
)
def test_urls(spark, raw, url):
    assert one(spark, U.normalise_url(F.col("x")), x=raw) == url


def test_site_roots(spark):
    root = U.site_root(U.host_of(F.col("x")))
    assert one(spark, root, x="http://cs.pku.edu.cn:80/") == "pku.edu.cn"
    assert one(spark, root, x="http://a.b.example.com/") == "example.com"
    assert one(spark, U.is_under_edu_cn(F.col("x")), x="http://edu.cn./")


def test_url_rules(spark):
    assert one(spark, U.is_noise(F.col("x")), x="http://a.cn/2023/05/x.htm")
    assert one(spark, U.is_noise(F.col("x")), x="http://a.cn/tzgg2/x.htm")
    assert not one(spark, U.is_noise(F.col("x")), x="http://a.cn/szdw/teacher.htm?u=news")
    assert one(spark, U.profile_homepage(F.col("x")), x="http://a.cn/szdw/list.htm") is None
    assert one(spark, U.profile_homepage(F.col("x")), x="http://a.cn/info/12/34.htm") == "http://a.cn/info/12/34.htm"
    assert one(spark, U.better_profile_url(F.col("a"), F.col("b")), a="http://a.cn/x", b="http://a.cn/info/1/2.htm") == "http://a.cn/info/1/2.htm"


def test_candidates(spark):
    col = C.assess_candidate(F.col("u"), F.col("a"), F.lit(""), F.array(F.lit("nav")))
    assert one(spark, col, u="http://a.cn/szdw/", a="师资队伍").page_type == "full_list"
    assert one(spark, col, u="http://a.cn/login", a="")["hard_reject"]
    assert one(spark, col, u="http://a.cn/js/", a="副教授").page_type == "category_list"
    assert one(spark, col, u="http://a.cn/news/1", a="新闻").page_type == "noise_or_login"


def test_excluded_units(spark):
    rule = lambda name, **k: one(spark, C.excluded_unit(F.col("n"), F.lit(""), F.lit(""), **k), n=name)
    assert rule("音乐学院") == "arts:音乐"
    assert rule("School of Music") == "arts:music"
    assert rule("Musicology Dept") is None
    assert rule("音乐学院", active=[]) is None
    assert rule("深圳校区", active=["深圳"]) == "custom:深圳"


def test_fetch_rules_disagree_on_challenges(spark):
    assert one(spark, C.fetch_failure(F.col("x")), x="WAF challenge") == "blocked"
    assert one(spark, C.log_is_retryable(F.col("x")), x="WAF challenge")
    assert one(spark, C.fetch_failure(F.col("x")), x=" ") is None


def test_form_pagination(spark):
    html = """<form name="fromWen"><input name="fromWenNOWPAGE"><input name="fromWenGOPAGE"><span class="this-page">1</span>
    <a href="javascript:document.fromWen.fromWenNOWPAGE.value=2;document.fromWen.submit()">2</a><a href="javascript:document.fromWen.fromWenNOWPAGE.value=19;document.fromWen.submit()">19</a></form>"""
    rows = [(1, "http://a.cn/x.jsp#top", html), (2, "http://a.cn/x.jsp?id=7", html.replace("fromWenGOPAGE", "q")), (3, "http://a.cn/x.jsp?page=2", html.replace("this-page", "")), (4, None, None), (5, "http://a.cn", html.replace("document.fromWen.submit", "document.other.submit"))]
    found = {}
    for r in H.form_pagination(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        found.setdefault(r.id, {})[r.page_index] = (r.total_pages, r.synthetic_url)
    assert sorted(found) == [1, 2, 3] and sorted(found[1]) == list(range(2, 20)) and sorted(found[2]) == [2, 19] and sorted(found[3]) == list(range(3, 20))
    assert found[1][2] == (19, "http://a.cn/x.jsp?form=fromWen&field=fromWenNOWPAGE&to=2") and found[2][19][1] == "http://a.cn/x.jsp?id=7&form=fromWen&field=fromWenNOWPAGE&to=19"


def test_form_pagination_by_subscript(spark):
    to = lambda k: f"""<a class="Next" href="javascript:document.forms['fromWen'].fromWenNOWPAGE.value={k};document.forms['fromWen'].submit();">{k}</a>"""
    head = """<form name="fromWen" method="post"><input type="hidden" name="fromWenNOWPAGE" value="1"><input type="hidden" name="actiontype" value=""><span class="this-page">1</span>"""
    jump = """<a href="javascript:document.forms['fromWen'].actiontype.value='NextPage';document.forms['fromWen'].submit()" class="Next">next</a><input type="button" name="fromWenFind" onclick="document.forms['fromWen'].fromWenNOWPAGE.value=document.forms['fromWen'].fromWenGOPAGE.value;"><input size="2" name="fromWenGOPAGE" value="">"""
    single = """<a href='javascript:document.forms["f"].p.value=3;document.forms["f"].submit()'>3</a><a href="document.forms[&#39;f&#39;].p.value=4">4</a>"""
    rows = [(1, "https://a.cn/x.jsp?id=2031", head + "".join(map(to, [2, 3, 4, 5, 6, 19])) + jump + "</form>"), (2, "https://a.cn/p.jsp?py=a", head + to(2) + to(3)), (3, "https://a.cn/q", single)]
    found = {}
    for r in H.form_pagination(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        found.setdefault((r.id, r.form, r.field), []).append(r.page_index)
    assert {k: sorted(v) for k, v in found.items()} == {(1, "fromWen", "fromWenNOWPAGE"): list(range(2, 20)), (2, "fromWen", "fromWenNOWPAGE"): [2, 3], (3, "f", "p"): [3, 4]}


def test_links_have_headings_and_context(spark):
    page = '<div class="nav"><h2>师资</h2><ul><li><a href="/a">甲</a></li></ul></div><h3>B</h3><p><a href="http://x.cn/b">乙</a><a href="/a">甲老师</a>'
    rows = H.page_links(spark.createDataFrame([(1, "http://s.cn/i", page)], "page_id long, url string, html string")).orderBy("link_order").collect()
    assert [(r.url, r.heading_text) for r in rows] == [("http://s.cn/a", "师资"), ("http://x.cn/b", "B")]
    assert rows[0].anchor_text == "甲老师" and "div.nav" in rows[0].context


def test_json_repair():
    assert X.repaired('x {"a": [1, 2,], "b": "c\nd"') == '{"a":[1,2],"b":"c\\nd"}'
    assert X.repaired('```json\n{"a": 1}\n```') == '{"a":1}'
    assert X.repaired("none") is None


def test_chunks():
    assert X.chunks("a b\n\nc d\n\ne", 4) == ["a b\n\nc d", "e"]
    assert X.chunks("a b c d e", 2) == ["a b", "c d", "e"]


@pytest.mark.parametrize(
    ("name", "text", "claims"),
    [("王五", "中国工程院院士", True), ("王五", "王五，2019年当选中国科学院院士。", True), ("王五", "师从李四院士，从事光学研究。", False), ("王五", "王五教授与李四院士团队合作。", False), ("王五", "教授", False), ("Wang Wu", "Wang Wu was elected academician in 2010.", True), ("Wang Wu", "His advisor is an academician.", False), ("王五", "与李四院士合作", False), (None, None, False),
     ("王五", "带领团队攻关，2019年当选中国工程院院士", True), ("李未", "李未，中国科学院院士，博士生导师。", True), ("李未", "李未院士是我国著名的计算机科学家。", True), ("Someone", "教授, 博导, 中国工程院院士", True),
     ("宫本一夫", "宮本一夫 博士，美国艺术与科学院院士（2018）。", True), ("王峰", "博士毕业于北京航空航天大学，导师为张彦仲院士。", False), ("雷文强", "与荷兰皇家科学院院士Maarten de Rijke教授等世界一流学者联袂作tutorial。", False),
     ("汤海波", "王华明院士领衔的重点领域创新团队骨干成员。", False), ("黄晶", "参与国家自然科学基金、院士工作站项目等科研项目。", False), ("范菊", "* [两院院士](https://a.edu.cn/jc_rc.html)\n# 师资名录", False),
     ("范菊", "* [两院院士](https://a.edu.cn/jc_rc.html)\n范菊，中国科学院院士，长期从事船舶与海洋工程研究。", True)],
)
def test_academician_claims(spark, name, text, claims):
    df = spark.createDataFrame([(name, text)], "n string, x string")
    assert df.select(P.claims_academician(F.col("n"), F.col("x"), F.lit(None).cast("string")).alias("r")).first().r is claims


@pytest.mark.parametrize(
    ("bio", "fields"),
    [("研究方向：机器学习；计算机视觉、图像处理。生于北京。", "机器学习；计算机视觉；图像处理"), ("在催化材料方面取得了重要研究成果。", "催化材料"), ("率先倡导环境和健康研究。", "环境和健康"), (None, None), ("在教学方面取得优异评价。", None), ("长期在学院方面开展招生工作。", None), ("主要从事量子计算研究，担任委员会顾问研究。", "量子计算"),
     ("李未院士在实用并发语言操作语义、形式理论序列和修正演算等方面取得了开创性研究成果。李未院士在我国率先倡导进行海量信息计算的理论与方法研究。", "实用并发语言操作语义；形式理论序列；修正演算；海量信息计算的理论与方法")],
)
def test_research_fields(spark, bio, fields):
    assert one(spark, P.infer_research(F.col("x")), x=bio) == fields


def test_mojibake(spark):
    broken = "北京".encode().decode("latin-1")
    assert one(spark, X.repair_mojibake("x"), x=broken) == "北京"
    assert one(spark, X.repair_mojibake("x"), x="café") == "café"
