"""The data-quality run: audits for every finding, changes only when they are to be applied."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import people as P
from quarrylight.functions import urls as U
from quarrylight.functions.classify import excluded_unit
from quarrylight.functions.text import text_of
from quarrylight.operators.ladder import ladder_match
from quarrylight.operators.merge import repair_identities
from quarrylight.operators.writes import moved_rows
from quarrylight.sources.tables import newest_first, saved, with_columns

AUDIT = ["entity_type", "entity_id", "issue_type", "field_name", "reason", "confidence", "action"]
#: What marks a profile that was made up from a page's navigation.
NAV_WORDS = ["首页", "学院概况", "师资队伍", "人才培养", "科学研究", "学生工作", "党建", "招生", "联系我们", "新闻"]
LABEL_NAME = r"^(?:教师姓名|姓名|导师姓名|教师)[:：]\s*(.+?)(?:[（(]?重复[)）]?)?$"


def audit(df: DataFrame, kind: str, issue: str, reason: Column, confidence: Column, apply: bool, field: Column | None = None, action: str = "applied") -> DataFrame:
    return df.select(
        F.lit(kind).alias("entity_type"), F.col("id").cast("long").alias("entity_id"), F.lit(issue).alias("issue_type"), (F.lit(None).cast("string") if field is None else field).alias("field_name"),
        reason.alias("reason"), confidence.cast("double").alias("confidence"), F.lit(action if apply else "report_only").alias("action"),
    )


def missing_reason(people: DataFrame, failed_urls: DataFrame, failed_units: DataFrame) -> DataFrame:
    """people with reason and confidence for their gaps.

    A homepage that was not read to the end comes first, then failures of the source or the unit,
    then a site that doesn't say, then nothing known. Failures are counted once per key.
    """
    by_url = failed_urls.groupBy(F.col("url").alias("source_url")).agg(F.count("*").alias("url_failures"))
    by_unit = failed_units.groupBy("org_unit_name").agg(F.count("*").alias("unit_failures"))
    joined = people.join(by_url, "source_url", "left").join(by_unit, "org_unit_name", "left")
    home = F.btrim(text_of(F.col("homepage"))) != ""
    gap = (F.btrim(text_of(F.col("research_areas"))) == "") | (F.btrim(text_of(F.col("bio"))) == "")
    failures = F.coalesce("url_failures", F.lit(0)) + F.coalesce("unit_failures", F.lit(0))
    known = home | (text_of(F.col("source_url")) != "")
    case = lambda a, b, c, d: F.when(home & gap, a).when(failures > 0, b).when(known, c).otherwise(d)
    return joined.withColumns({"failure_count": failures, "reason": case("homepage_profile_incomplete", "crawl_failure", "site_missing", "uncertain"), "confidence": case(0.95, 0.85, 0.75, 0.35)}).drop("url_failures", "unit_failures")


def checked_reason(reason: Column, confidence: Column, failures: Column, homepage: Column) -> tuple[Column, Column]:
    """A reviewer's reason and confidence, held against the evidence."""
    known = reason.isin("crawl_failure", "site_missing", "uncertain", "homepage_profile_incomplete")
    bounded = F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0)))
    contradicted = ((reason == "homepage_profile_incomplete") & (text_of(homepage) == "")) | ((reason == "site_missing") & (failures > 0)) | ((reason == "crawl_failure") & (failures <= 0))
    return F.when(~known | contradicted, "uncertain").otherwise(reason), F.when(contradicted, F.least(bounded, F.lit(0.45))).otherwise(bounded)


def missing_fields(people: DataFrame, fields: list[str]) -> DataFrame:
    """One row per person and field that says nothing."""
    gaps = F.array_compact(F.array(*[F.when(F.btrim(text_of(F.col(f))) == "", F.lit(f)) for f in fields]))
    return people.withColumn("field_name", F.explode(gaps))


def synthetic_profiles(people: DataFrame) -> DataFrame:
    """(id, clean_name) of profiles with a label for a name, a menu for a biography and nothing else."""
    bio = F.regexp_replace(text_of(F.col("bio")), r"(?U)\s+", "")
    hits = F.size(F.filter(F.array(*map(F.lit, NAV_WORDS)), lambda w: F.contains(bio, w)))
    sparse = reduce(lambda a, b: a & b, [F.btrim(text_of(F.col(f))) == "" for f in ("email", "phone", "research_areas", "external_link", "enrollment_pref", "publications")])
    named = people.withColumn("clean_name", F.btrim(F.regexp_extract(F.btrim(F.col("name")), LABEL_NAME, 1)))
    return named.where((F.col("clean_name") != "") & (F.length(bio) <= 220) & (hits >= 3) & sparse).select("id", "clean_name", "org_unit_name")


def academician_matches(people: DataFrame, academicians: DataFrame) -> DataFrame:
    """People who are in the academicians' table too: by unit and name, e-mail, or a shared page."""
    unit = lambda: F.nullif(F.concat_ws("|", P.normalise_name(F.col("name")), "org_unit_name"), F.lit("|"))
    home, link = U.normalise_url(F.col("homepage")), U.normalise_url(F.col("external_link"))
    return ladder_match(people, academicians, "id", "academician_id", [
        ("same_name_key_org_unit", F.when(text_of(F.col("org_unit_name")) != "", unit()), F.when(text_of(F.col("org_unit_name")) != "", unit())),
        ("email_exact", F.lower(F.btrim("email")), F.lower(F.btrim("email"))),
        ("profile_url_exact", home, home), ("profile_url_exact", home, link), ("profile_url_exact", link, home), ("profile_url_exact", link, link),
    ])


def promote(people: DataFrame, affiliations: DataFrame, academicians: DataFrame, promoted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People named in ``promoted`` (id) become academicians of their first unit: (people, affiliations, academicians) after.

    New rows get ids behind the academicians' own. One who is there by name and unit gains what they lack.
    """
    promoted = saved(promoted.distinct())
    unit = affiliations.groupBy(F.col("professor_id").alias("id")).agg(F.min("org_unit_id").alias("org_unit_id"))
    last = academicians.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    moving = people.join(promoted, "id", "left_semi").drop("org_unit_id").join(unit, "id", "left").withColumn("id", F.col("id") + last)
    moving = with_columns(moving, academicians.schema)
    _, more = moved_rows(moving, academicians, moving.select("id"), {"title": F.lit("院士")} if "title" in academicians.columns else None)
    return saved(people.join(promoted, "id", "left_anti")), affiliations.join(promoted.withColumnRenamed("id", "professor_id"), "professor_id", "left_anti"), saved(more)


def run(tables: dict[str, DataFrame], apply: bool) -> tuple[dict[str, DataFrame], DataFrame]:
    """The stages in order over org_units, professors, professor_affiliations, academicians, crawl_logs
    and crawl_extraction_failures: (tables after the run, audits).

    Each stage sees what the one before has left if changes are applied; a
    dry run changes nothing, so one row can be audited by several stages. Tables that change are
    written between the stages, so no stage runs the ones before it again.
    """
    t, audits = dict(tables), []
    units = t["org_units"].withColumn("why", excluded_unit(F.col("name"), F.col("kind"), F.col("url"))).where("why is not null")
    audits.append(audit(units, "org_unit", "excluded_org_unit", F.col("why"), F.lit(1.0), apply, action="deleted"))
    if apply:
        gone = units.select(F.col("id").alias("org_unit_id"))
        left = t["professor_affiliations"].join(gone, "org_unit_id", "left_anti")
        touched = t["professor_affiliations"].join(gone, "org_unit_id", "left_semi").select("professor_id").distinct()
        orphaned = touched.join(left, "professor_id", "left_anti").select(F.col("professor_id").alias("id"))
        t["org_units"] = t["org_units"].join(units.select("id"), "id", "left_anti")
        t["academicians"] = t["academicians"].join(gone, "org_unit_id", "left_anti")
        t["professor_affiliations"] = left
        t["professors"] = saved(t["professors"].join(orphaned, "id", "left_anti"))
    made_up = synthetic_profiles(t["professors"])
    audits.append(audit(made_up, "professor", "synthetic_profile", F.lit("synthetic_unlinked_profile"), F.lit(0.95), apply, action="deleted"))
    if apply:
        t["professors"] = saved(t["professors"].join(made_up.select("id"), "id", "left_anti"))
        t["professor_affiliations"] = t["professor_affiliations"].join(made_up.select(F.col("id").alias("professor_id")), "professor_id", "left_anti")
    merged, moved = repair_identities(t["professors"], t["professor_affiliations"])
    moved = saved(moved)
    victims = moved.where("id <> keeper_id")
    audits.append(audit(victims, "professor", "duplicate_identity", F.lit("same_identity"), F.lit(0.95), apply, action="merged"))
    if apply:
        renamed = t["professor_affiliations"].join(victims.select(F.col("id").alias("professor_id"), "keeper_id"), "professor_id", "left")
        t["professors"] = saved(merged.select(*t["professors"].columns))
        t["professor_affiliations"] = renamed.withColumn("professor_id", F.coalesce("keeper_id", "professor_id")).drop("keeper_id").dropDuplicates(["professor_id", "org_unit_id"])
    twins = academician_matches(t["professors"], t["academicians"].withColumnRenamed("id", "academician_id").join(t["org_units"].select(F.col("id").alias("org_unit_id"), F.col("name").alias("org_unit_name")), "org_unit_id", "left"))
    audits.append(audit(twins, "professor", "academician_duplicate", F.col("reason"), F.lit(1.0), apply, action="deleted"))
    if apply:
        t["professors"] = saved(t["professors"].join(twins.select("id"), "id", "left_anti"))
    # a native look for the two words comes before the Python check
    hinted = t["professors"].where(F.concat_ws(" ", "title", "bio").rlike("(?i)院士|academician"))
    promoted = hinted.where(P.claims_academician(F.col("name"), F.col("title"), F.col("bio")))
    audits.append(audit(promoted, "professor", "academician_promotion", F.lit("bio_academician"), F.lit(0.95), apply, action="moved"))
    if apply:
        t["professors"], t["professor_affiliations"], t["academicians"] = promote(t["professors"], t["professor_affiliations"], t["academicians"], promoted.select("id"))
    backfill = t["professors"].where(F.btrim(text_of(F.col("research_areas"))) == "").withColumn("found", P.infer_research(F.col("bio"))).where("found is not null")
    audits.append(audit(backfill, "professor", "research_backfill", F.lit("bio_inference"), F.lit(0.80), apply, F.lit("research_areas")))
    if apply:
        found = backfill.select("id", "found")
        t["professors"] = t["professors"].join(found, "id", "left").withColumn("research_areas", F.coalesce("found", "research_areas")).drop("found")
    source = t["professor_affiliations"].groupBy(F.col("professor_id").alias("id")).agg(F.min("source_url").alias("source_url"))
    reasons = missing_reason(t["professors"].drop("source_url").join(source, "id", "left"), t["crawl_logs"].where("status = 'failed'"), t["crawl_extraction_failures"])
    gaps = missing_fields(reasons, ["title", "research_areas", "email", "bio"])
    audits.append(audit(gaps, "professor", "missing_field", F.col("reason"), F.col("confidence"), apply, F.col("field_name"), action="recrawl"))
    return t, reduce(DataFrame.unionByName, audits)


def compared_with_newest(active: dict[str, DataFrame], backups: DataFrame, load: Callable[[str], dict[str, DataFrame]]) -> DataFrame:
    """(table, active, backup, gained) row counts of the live tables and of the newest backup (path, modified).

    Of equal times the last path counts; a table that the backup hasn't counts 0 there. Without any
    backup all of its counts are NULL.
    """
    newest = newest_first(backups.withColumn("all", F.lit(1)), "all").first()
    held = load(newest.path) if newest else {}
    parts = []
    for name, df in active.items():
        old = held[name].agg(F.count("*").alias("backup")) if name in held else None
        now = df.agg(F.count("*").alias("active")).withColumn("table", F.lit(name))
        parts.append(now.withColumn("backup", old.select("backup").scalar()) if old is not None else now.withColumn("backup", F.lit(0 if newest else None).cast("long")))
    return reduce(DataFrame.unionByName, parts).select("table", "active", "backup", (F.col("active") - F.col("backup")).alias("gained"))
