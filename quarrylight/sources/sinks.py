"""Public exports and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUBLIC_COLUMNS = {
    "university_meta": ["id", "name", "start_url", "location"],
    "org_units": ["id", "name", "url", "kind"],
    "professors": ["id", "name", "name_key", "org_unit_name", "title", "research_areas", "email", "phone", "homepage", "external_link", "bio", "enrollment_pref", "publications"],
    "academicians": ["id", "name", "name_key", "org_unit_id", "title", "research_areas", "email", "phone", "homepage", "external_link", "bio", "enrollment_pref", "publications", "source_url"],
    "professor_affiliations": ["id", "professor_id", "org_unit_id", "source_url"],
}


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has; NULL keys refer to nothing."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def export_public(tables: dict[str, DataFrame], path: str) -> None:
    """Write the public columns of the five tables once their keys hold; nothing is written if they don't."""
    out = {name: tables[name].select(*columns) for name, columns in PUBLIC_COLUMNS.items()}
    problems = {
        "affiliation without professor": orphans(out["professor_affiliations"], out["professors"], "professor_id", "id"),
        "affiliation without org unit": orphans(out["professor_affiliations"], out["org_units"], "org_unit_id", "id"),
        "academician without org unit": orphans(out["academicians"], out["org_units"], "org_unit_id", "id"),
    } | {f"repeated id in {name}": repeated_keys(df, "id") for name, df in out.items()}
    bad = [what for what, rows in problems.items() if not rows.isEmpty()]
    if bad:
        raise ValueError("; ".join(bad))
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_log_csv(logs: DataFrame, path: str, zone: str = "UTC") -> None:
    """Request logs as CSV in order of time, with a readable time beside the epoch seconds."""
    shown = F.when(F.col("time").isNull(), "").otherwise(F.date_format(F.from_utc_timestamp(F.timestamp_seconds("time"), zone), "yyyy-MM-dd'T'HH:mm:ss"))
    logs.withColumn("local_time", shown).orderBy("time").write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
