"""Rules that sort pages, units and fetch outcomes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import urls as U
from quarrylight.functions import vocabulary as V
from quarrylight.functions.text import contains_any, let, none_array, text_of


def assess_candidate(url: Column, anchor: Column, heading: Column, context: Column) -> Column:
    """page_type, score, uncertain and hard_reject of a link that may lead to a staff list.

    ``context`` is the array of the link's surrounding elements.
    """
    w = V.CANDIDATE_WEIGHTS
    signal = F.lower(F.concat_ws(" ", text_of(url), text_of(anchor), text_of(heading), F.array_join(F.coalesce(context, none_array()), " ")))
    tokens = U.path_tokens(url)
    overlap = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    roster = F.array_contains(tokens, "zzjs") & overlap(["szjs", "szdw", "jsdw", "faculty", "teacher", "teachers"]) & ~overlap(["djgz", "dqjs", "dangjian", "party"])
    generic = F.array_contains(tokens, "szjs") & ~roster
    rejected = contains_any(url, V.LOGIN_HINTS)
    full = contains_any(signal, V.FULL_LIST) | roster
    category, elite = contains_any(signal, V.CATEGORY_LIST), contains_any(signal, V.ELITE_LIST)
    noise_url = U.is_noise(url)
    noise = contains_any(signal, V.NOISE_WORDS) | noise_url
    page = U.is_faculty_page(url) & (roster | category | elite | ~generic)
    points = lambda hit, name: F.when(hit, w[name]).otherwise(0)
    score = (
        points(full, "full") + points(category, "category") + points(elite, "elite") + points(contains_any(signal, V.NAV_WORDS), "nav")
        + points(page, "url") + points(U.is_pagination(url), "pagination") + points(noise, "noise") + points(noise_url, "noise_url")
    )
    titled = contains_any(F.concat_ws(" ", text_of(anchor), text_of(heading)), V.CATEGORY_LIST)
    kind = (
        F.when(rejected | noise_url | (noise & (score <= 0)), "noise_or_login")
        .when(category & (~contains_any(signal, V.FULL_STRONG) | titled), "category_list")
        .when(full, "full_list")
        .when(elite, "elite_list")
        .otherwise("unknown")
    )
    unsure = F.when(kind.isin("full_list", "category_list", "elite_list"), score.between(3, 7)).otherwise((kind == "unknown") & (score >= 2))
    return F.struct(
        kind.alias("page_type"),
        F.when(rejected, -100).otherwise(score).cast("int").alias("score"),
        (~rejected & unsure).alias("uncertain"),
        rejected.alias("hard_reject"),
    )


def excluded_unit(name: Column, kind: Column, url: Column, active: list[str] | None = None) -> Column:
    """``category:keyword`` of the first rule that puts an org unit out of scope, or NULL.

    ASCII keywords match whole words, others anywhere. ``active`` limits the keywords and adds own
    ones, which count as category ``custom``; an empty list switches the rule off.
    """
    text = F.lower(F.concat_ws(" ", text_of(name), text_of(kind), U.host_of(url), F.coalesce(F.try_url_decode(U.path_of(url)), F.lit(""))))
    known = {w for _, words in V.EXCLUDED_UNITS for w in words}
    groups = [(c, [w for w in words if active is None or w in active]) for c, words in V.EXCLUDED_UNITS]
    groups.append(("custom", [w.lower() for w in active or [] if w.lower() not in known]))

    def hit(said: Column, word: str) -> Column:
        if word.isascii():
            return said.rlike(rf"(?<![a-z0-9])\Q{word}\E(?![a-z0-9])")
        return F.contains(said, F.lit(word))

    words_of = [(f"{c}:{w}", w) for c, words in groups for w in words]
    if not words_of:
        return F.lit(None).cast("string")
    # the first hit of an ordered array keeps the plan flat where a chain of WHENs would nest
    hits = let(text, lambda said: F.array(*[F.when(hit(said, w), F.lit(n)) for n, w in words_of], F.lit("")))
    return F.nullif(F.element_at(F.filter(hits, lambda x: x.isNotNull()), 1), F.lit(""))


def block_reason(status: Column, body: Column, action: Column) -> Column:
    """Why a response is a challenge page and not content, or NULL."""
    low = F.lower(text_of(body))
    hits = F.filter(F.array(*map(F.lit, V.WAF_MARKERS)), lambda m: F.contains(low, m))
    first = F.array_join(F.slice(hits, 1, 3), ",")
    header = F.lower(F.btrim(text_of(action)))
    return (
        F.when(header.isin("challenge", "captcha"), F.concat(F.lit("waf_header:"), header))
        .when(status.isin(202, 403, 405, 429, 503) & (F.size(hits) > 0), F.concat(F.lit("waf_challenge status="), status.cast("string"), F.lit(" markers="), first))
        .when((status == 200) & (F.size(hits) >= 3) & (F.length(text_of(body)) > 2000), F.concat(F.lit("waf_like_html status=200 markers="), first))
    )


def fetch_failure(reason: Column) -> Column:
    """blocked, retryable or terminal; NULL without a reason."""
    low = F.lower(F.btrim(text_of(reason)))
    return (
        F.when(low == "", F.lit(None).cast("string"))
        .when(low.isin(V.TERMINAL_REASONS), "terminal")
        .when(contains_any(low, V.BLOCKED_MARKERS), "blocked")
        .when(contains_any(low, V.RETRYABLE_MARKERS), "retryable")
        .otherwise("terminal")
    )


def log_is_retryable(message: Column) -> Column:
    """The resume rule, which takes challenge pages for retryable where ``fetch_failure`` doesn't."""
    return contains_any(message, V.LOG_RETRYABLE) & ~contains_any(message, V.LOG_NOT_RETRYABLE)


def is_core_unit(kind: Column) -> Column:
    low = F.lower(F.btrim(text_of(kind)))
    return low.rlike("college|school|department|academy|faculty|xueyuan|yuanxi") & ~low.rlike("research|institute|lab|center|platform")


def title_score(title: Column, enrolment: Column, degrees: list[str], titles: list[str]) -> Column:
    """How well a title and an enrolment offer meet the wishes."""
    degree = [F.contains(text_of(enrolment), F.lit(d)) for d in degrees if d in ("博士", "硕士")]
    wished = [F.contains(text_of(c), F.lit(t)) for t in titles for c in (title, enrolment)]
    best = F.lit(False)
    for hit in degree + wished:
        best = best | hit
    return F.when(best, 1.0).when(text_of(title).rlike("院士|教授|研究员"), 0.7).when(text_of(title) != "", 0.45).otherwise(0.2)
