"""Profile pages: gates before extraction, labelled fields, URLs that a page really names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import people as P
from quarrylight.functions import urls as U
from quarrylight.functions import vocabulary as V
from quarrylight.functions.text import contains_any, let, text_of

# Words and path parts that mark pages of no one person, and labels of fields.
POSTDOC_LABELS = ["博士后", "博后", "postdoctoral", "postdoc", "post-doc", "post doc"]
POSTDOC_STEMS = ["bsh", "boshihou", "postdoc", "postdoctoral", "post-doc", "post_doc"]
NOISE_URLS = ["/news", "/notice", "/tzgg", "/gonggao", "/announcement", "/policy", "/zcwj", "规章制度", "/renshi", "/rszc", "/hr", "/rczp", "/zhaopin", "/jobs", "/dangjian", "/party", "/xsgz", "/zsjy"]
NOISE_LINES = ["新闻", "通知", "公告", "招聘", "党建", "规章制度", "news", "notice", "announcement"]
SIGNALS = ["faculty", "teacher", "staff", "professor", "research", "email", "phone", "导师", "教师", "师资", "教授", "副教授"]
EVIDENCE = ["职称", "研究方向", "电子邮箱", "个人简介", "research interests", "email", "professor", "教授"]
OPENINGS = ["近日我院", "近日我校", "近日，"]
LABELS = {"title": "职称|职务", "research_areas": "研究方向|研究领域|研究兴趣", "phone": "联系电话|办公电话|电话", "homepage": "个人主页|主页", "enrollment_pref": "招生专业|招生方向|导师类别"}
PERSON_DIRECTORIES = "jiaoshiml|shizi|teacher|teachers|faculty|people"
NO_PERSON = "index|list|default|main|more|all|js|sys|ys|tutor|shidao|szdw|szll|zzjs|qzjs|bsh|fjs|jzg|ssds|bsds"


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(text), r"[\r\n]+"), lambda x: F.btrim(x)), lambda x: x != "")


def is_retired(*values: Column) -> Column:
    return contains_any(F.concat_ws("\n", *values), V.RETIRED)


def is_postdoc(name: Column, title: Column, bio: Column, url: Column) -> Column:
    """By title, by a section of the URL, or by a biography that opens so; later mentions don't count."""
    stems = F.exists(F.split(F.lower(U.path_of(url)), "/"), lambda s: F.regexp_replace(s, r"\.[^.]*$", "").isin(POSTDOC_STEMS))
    tail = F.regexp_replace(F.btrim(text_of(bio)), r"(?U)^\W*", "")
    rest = F.when(tail.startswith(F.btrim(text_of(name))), F.substring(tail, F.length(F.btrim(text_of(name))) + 1, 1 << 30)).otherwise(tail)
    named = (F.btrim(text_of(name)) != "") & tail.startswith(F.btrim(text_of(name))) & rest.rlike("^\\s*[，,、:：]?\\s*(?:师资|科研|专职|在站)?(?:博士后|博后)")
    return contains_any(title, POSTDOC_LABELS) | stems | named | text_of(bio).rlike(r"^\s*(?:师资|科研|专职|在站)?(?:博士后|博后)[，,。、\s]")


def page_gate(url: Column, text: Column) -> Column:
    """Why a page can't be a profile, or NULL: notices and news by their openings, then URLs without
    evidence, then a third of noise lines without a sign of staff."""

    return let(lines_of(text), lambda lines: _gate(url, text, lines))


def _gate(url: Column, text: Column, lines: Column) -> Column:
    def reason(low: Column) -> Column:
        head = F.transform(F.slice(lines, 1, 8), lambda x: F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s*", ""), r"(?U)\s+", ""))
        notice = F.exists(head, lambda x: x.rlike("^关于.{2,60}的(?:通知|公告|通报|公示)$"))
        news = F.exists(head, lambda x: F.substring(x, 1, 4).isin(OPENINGS[:2]) | x.startswith(OPENINGS[2]))
        mail = F.contains(low, F.lit("@"))
        evidence = F.size(F.filter(F.array(*map(F.lit, EVIDENCE)), lambda w: F.contains(low, w))) >= 2
        noisy = F.size(F.filter(lines, lambda x: contains_any(x, NOISE_LINES))) / F.greatest(F.size(lines), F.lit(1))
        signal = F.exists(F.array(*map(F.lit, SIGNALS)), lambda w: F.contains(low, w))
        stems = F.exists(F.split(F.lower(U.path_of(url)), "/"), lambda s: F.regexp_replace(s, r"\.[^.]*$", "").isin(POSTDOC_STEMS))
        return (
            F.when(stems, "postdoc_section").when(notice, "notice_issuance_title").when(news, "recent_school_news_opening")
            .when(contains_any(url, NOISE_URLS) & ~(mail | evidence), "url_noise_token").when((noisy >= 0.35) & ~(mail | signal), "text_noise_ratio")
        )

    return let(F.lower(text_of(text)), reason)


def labelled(text: Column, labels: str) -> Column:
    """The value after the first of some labels, on its line or the next; NULL without one."""
    found = F.regexp_extract(text_of(text), rf"(?m)(?:{labels})\s*[:：]\s*([^\r\n]*\S)", 1)
    return P.optional_text(found)


def snapshot_record(text: Column, url: Column) -> Column:
    """A profile from a page's text: the heading is the name, labels give the fields; NULL for a page
    that the gate stops, that has no name, or that says nothing about it."""

    def read(lines: Column) -> Column:
        return let(P.normalise_name(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"^#{1,6}\s*", "")), lambda head: by(lines, head))

    def by(lines: Column, head: Column) -> Column:
        # each part is bound to a name, as trees that repeat it are computed anew for every mention
        fields = {f: labelled(text, words) for f, words in LABELS.items()}
        fields["title"] = P.normalise_title(fields["title"])
        fields["email"] = F.nullif(F.array_join(P.emails(text), "; "), F.lit(""))
        fields["bio"] = P.optional_text(F.regexp_extract(text_of(text), r"(?s)(?:个人简介|简介)\s*[:：]?\s*(.+?)(?:\n\s*\n|$)", 1))
        person = (head != "") & (F.length(head) <= 40) & ~P.is_not_a_name(head) & _gate(url, text, lines).isNull()
        says = lambda f: F.coalesce(f["title"], f["email"], f["research_areas"], f["bio"]).isNotNull()
        record = let(F.struct(head.alias("name"), *[c.alias(f) for f, c in fields.items()]), lambda f: F.when(says(f), f))
        return F.when(person, record)

    return let(lines_of(text), read)


def is_profile_detail(url: Column) -> Column:
    """Whether a URL names one person's page: an article number, or a name under a directory of people."""
    path = F.lower(U.path_of(url))
    slug = F.regexp_extract(path, rf"/(?:{PERSON_DIRECTORIES})/(?:[^/]+/)*([a-z][a-z0-9_]*)(?:\.s?html?)?/?$", 1)
    return U.is_query_profile(url) | path.rlike(r"/info/[0-9]+/[0-9]+") | path.rlike("(?:faculty|teacher|teachers|professor|szdw)details?/") | ((slug != "") & ~slug.rlike(f"^(?:{NO_PERSON})$|(?:list|index)$"))


def url_on_page(url: Column, links: Column, text: Column) -> Column:
    """Whether a page names a URL: as a link, by host and path of one, or its host in the text."""
    same = F.exists(links, lambda x: (U.host_of(x) == U.host_of(url)) & (F.rtrim(U.path_of(x), F.lit("/")) == F.rtrim(U.path_of(url), F.lit("/"))))
    return F.array_contains(links, url) | same | ((U.host_of(url) != "") & F.contains(F.lower(text_of(text)), U.host_of(url)))


def split_homepage(source: Column, homepage: Column, link: Column) -> Column:
    """(homepage, external_link): what stays on the source's site and looks personal, and the rest."""
    root = U.site_root(U.host_of(source))
    outside = lambda u: (U.host_of(u) != "") & (U.site_root(U.host_of(u)) != root)
    home, other = U.normalise_url(homepage), U.normalise_url(link)
    own = F.coalesce(F.when(~outside(home), U.profile_homepage(home)), F.when(~outside(other), U.profile_homepage(other)))
    return F.struct(U.better_profile_url(own, U.profile_homepage(source)).alias("homepage"), F.coalesce(F.when(outside(home), home), F.when(outside(other), other)).alias("external_link"))
