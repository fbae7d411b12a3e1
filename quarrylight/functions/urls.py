"""URL parts, normal forms, tests and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import vocabulary as V
from quarrylight.functions.text import contains_any, let, text_of

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its question mark; the fragment is left out."""
    return F.regexp_extract(text_of(url), PARTS, n)


def clean_url(value: Column) -> Column:
    """Without quotes, angle brackets or a Markdown link around it."""
    text = F.btrim(F.btrim(F.btrim(text_of(value)), F.lit("\"'")))
    text = F.btrim(F.regexp_replace(F.regexp_replace(text, "^<", ""), ">$", ""))
    return let(text, lambda t: F.btrim(F.coalesce(F.nullif(F.regexp_extract(t, r"^\[.*?\]\((.*)\)$", 1), F.lit("")), t)))


def normalise_url(value: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the path's end."""

    def normal(url: Column) -> Column:
        scheme, host, path, query = (part(url, n) for n in (1, 2, 3, 4))
        full = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.rtrim(path, F.lit("/")), F.when(query == "?", "").otherwise(query))
        return F.when((scheme != "") & (host != ""), full).otherwise(F.rtrim(F.regexp_replace(url, "#.*$", ""), F.lit("/")))

    return let(clean_url(value), normal)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:.*@)?([^:]*)", 1))


def path_of(url: Column) -> Column:
    return part(url, 3)


def site_root(host: Column) -> Column:
    """The last two labels, three under the second-level domains of .cn."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    deep = (n >= 3) & host.rlike(r"\.(edu|ac|com|net|org|gov)\.cn\.?$")
    tail = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return F.when(deep, tail(3)).when(n >= 2, tail(2)).otherwise(host)


def is_under_edu_cn(url: Column) -> Column:
    host = F.rtrim(host_of(url), F.lit("."))
    return (host == "edu.cn") | host.endswith(".edu.cn")


def is_pagination(url: Column) -> Column:
    return text_of(url).rlike(V.PAGINATION)


def path_tokens(url: Column) -> Column:
    return F.filter(F.split(F.lower(path_of(url)), "[^a-z0-9]+"), lambda t: t != "")


def is_faculty_page(url: Column) -> Column:
    return contains_any(url, V.FACULTY_WORDS)


def is_noise(url: Column) -> Column:
    """News, notices, jobs, downloads and the like, and promotional paths outside of directories."""
    tokens = path_tokens(url)
    promotional = F.arrays_overlap(tokens, F.array(*map(F.lit, V.PROMOTIONAL))) & ~(contains_any(url, V.FACULTY_DIRECTORIES) & is_faculty_page(url))
    words = [w for w in V.NOISE_TOKENS if w not in V.PROMOTIONAL]
    stem = "^(" + "|".join(w for w in V.NOISE_STEMS) + ")[0-9]*$"
    noisy = F.exists(tokens, lambda t: t.isin(words) | t.rlike(stem))
    return promotional | noisy | contains_any(url, ["规章制度"]) | F.lower(path_of(url)).rlike(r"/20[0-9]{2}/[0-9]{2}(/[0-9]{2})?/")


def page_type(url: Column) -> Column:
    """The kind of page that a URL looks like; the first rule that fits."""
    host, path = host_of(url), F.lower(path_of(url))
    home = path.isin("/", "/index.htm", "/index.html", "")
    return (
        F.when(host.startswith("faculty.") | host.startswith("faculty-"), "faculty_platform")
        .when(host.startswith("www.") & home, "university_homepage")
        .when(~host.startswith("www.") & ~host.startswith("faculty") & home, "college_subdomain_homepage")
        .when(path.rlike("szdw|szll|teacher|faculty|szrc|jszy|szgk|rydw"), "likely_faculty_list")
        .when(path.rlike("xy|yxsz|xbyx|department|school|college|yuan"), "college_page")
        .when(path.rlike("xxgk|zzjg|jgsz|jxgl|about|news"), "admin_page")
        .when(F.contains(path, F.lit("/en/index.htm")), "individual_teacher_page")
        .when(F.contains(path, F.lit("page")) | F.contains(text_of(url), F.lit("PAGENUM")), "pagination")
        .otherwise("other")
    )


def slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def is_query_profile(url: Column) -> Column:
    query = F.lower(part(url, 4))
    return query.rlike(r"[?&]action=detailteam(&|$)") & query.rlike(r"[?&]uuinid=[^&]+")


def profile_url_quality(url: Column) -> Column:
    """How much a URL looks like one person's page."""
    return let(normalise_url(url), lambda normal: let(F.lower(path_of(normal)), lambda path: _profile_score(normal, path)))


def _profile_score(normal: Column, path: Column) -> Column:
    score = (
        F.when(is_query_profile(normal), 95).otherwise(0)
        + F.when(path.rlike("/info/|/profile|/detail|/show|/mentor"), 70).otherwise(0)
        + F.when(path.rlike(r"/info/[0-9]+/[0-9]+(\.s?html?)?$"), 30).otherwise(0)
        + F.when(path.rlike("/(teacher|teachers|faculty|people)/[^/]+"), 35).otherwise(0)
        + F.when(path.rlike(r"\.(htm|html|shtml)$"), 4).otherwise(0)
        + F.greatest(F.lit(0), slashes(path) - 2)
        - F.when(path.rlike("/szdw|/szll|/jsdw|/team|/staff|/directory"), 55).otherwise(0)
    )
    return F.when(normal == "", -999).when(path.isin("", "/"), -200).otherwise(score).cast("int")


def better_profile_url(current: Column, candidate: Column) -> Column:
    """The one of higher quality; of equals the deeper candidate, else the current one."""
    depth = lambda u: F.greatest(F.lit(0), slashes(path_of(u)) - 1)
    takes = let(profile_url_quality(candidate) - profile_url_quality(current), lambda gain: (gain > 0) | ((gain == 0) & (depth(candidate) > depth(current))))
    return F.when(F.coalesce(candidate, F.lit("")) == "", current).when(F.coalesce(current, F.lit("")) == "", candidate).when(takes, candidate).otherwise(current)


def profile_homepage(value: Column) -> Column:
    """The normal form of a homepage that can be one person's, else NULL."""
    return let(normalise_url(value), _if_personal)


def _if_personal(url: Column) -> Column:
    path = F.rtrim(F.lower(path_of(url)), F.lit("/"))
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    lists = "faculty teacher teachers staff directory team szdw jsdw szll jzg jsml list teamlist teacherlist facultylist tu-list".split()
    usable = (part(url, 1) != "") & (part(url, 2) != "") & (path != "") & (is_query_profile(url) | (~stem.isin(lists) & (profile_url_quality(url) >= 0)))
    return F.when(usable, url)


def org_url_quality(url: Column) -> Column:
    """How much a URL looks like a unit's own front page."""
    return let(normalise_url(url), lambda normal: let(F.rtrim(F.lower(path_of(normal)), F.lit("/")), lambda path: _unit_score(normal, path)))


def _unit_score(normal: Column, path: Column) -> Column:
    host = host_of(normal)
    depth = F.greatest(F.lit(0), slashes(path) - 1)
    score = (
        F.when((part(normal, 1) != "") & (part(normal, 2) != ""), 20).otherwise(0)
        + F.when((host != "") & ~host.startswith("www."), 6).otherwise(0)
        + F.when(path == "", 40).when(depth <= 0, 20).when(depth == 1, 8).otherwise(-5 * depth)
        - F.when(path.rlike("/info/|/szdw/|/jsdw/|/szll/|/qzjs/|/teacher/|/teachers/|/faculty/|/people/|tu-list|teacherlist|facultylist"), 45).otherwise(0)
        - F.when(path.rlike(r"\.(htm|html|shtml|jsp)$") & (depth >= 1), 8).otherwise(0)
    )
    return F.when(normal == "", -999).when(normal.startswith("about:org_unit:"), -500).otherwise(score).cast("int")


def urls_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_of(text), F.lit(r"(https?://[^\s\)\]\"'>]+)"), F.lit(1)))
