"""Entrance manifests as CSV or YAML, and resume files."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrylight.functions.urls import clean_url

#: Column headings in either language.
HEADINGS = {"record_type": ["record_type", "type", "类型"], "university": ["university", "name", "学校", "大学"], "url": ["url", "网址", "链接"], "org_unit": ["org_unit", "unit", "学院", "院系"], "location": ["location", "城市", "地点"]}
SCHEMA = "record_type string, university string, url string, org_unit string, location string"


def read_csv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entrances of a CSV file with # comments and headings in Chinese or English; URLs are split and cleaned."""
    raw = spark.read.csv(path, header=True, comment="#")
    low = {c.strip().lower(): c for c in raw.columns}
    pick = [F.coalesce(*[F.col(f"`{low[h]}`") for h in names if h in low], F.lit(None).cast("string")).alias(c) for c, names in HEADINGS.items()]
    rows = raw.select(*pick).where(F.col("university").isNotNull())
    return rows.withColumn("url", F.explode_outer(F.split("url", r"[，；;\s]+"))).withColumn("url", clean_url(F.col("url")))


def read_yaml_manifest(spark: SparkSession, text: str) -> DataFrame:
    """Entrances of a version 1 YAML manifest: a driver-side configuration, one row per URL."""
    import yaml

    data = yaml.safe_load(text)
    if not isinstance(data, dict) or data.get("version") != 1:
        raise ValueError("manifest version must be 1")
    rows = []
    for u in data.get("universities") or []:
        if not u.get("name") or not u.get("url"):
            raise ValueError("each university needs a name and a url")
        rows.append(("university", u["name"], u["url"], None, u.get("location")))
        units = u.get("org_units") or []
        for unit in units:
            rows += [("org_unit", u["name"], x, unit["name"], None) for x in unit.get("faculty_urls") or [unit.get("url")]]
        if not units:  # units named by hand replace the listing pages
            rows += [("org_listing", u["name"], x, None, None) for x in u.get("org_unit_listing_urls") or []]
    return spark.createDataFrame(rows, SCHEMA).withColumn("url", clean_url(F.col("url")))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(university, url, problem) for URLs that aren't absolute and entrances named twice."""
    bad = manifest.where(~F.coalesce(F.col("url").rlike("^https?://[^/]+"), F.lit(False))).select("university", "url", F.lit("not an absolute url").alias("problem"))
    keys = ["record_type", "university", "org_unit", "url"]
    twice = manifest.groupBy(*keys).count().where("count > 1").select("university", "url", F.lit("named twice").alias("problem"))
    return bad.unionByName(twice)


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        xml = file.read("word/document.xml").decode()
    paragraphs = ("".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", p)) for p in xml.split("</w:p>"))
    return "\n".join(p for p in paragraphs if p)


@F.pandas_udf(StringType())
def _text_of_file(path: pd.Series, content: pd.Series) -> pd.Series:
    def read(name: str, data: bytes) -> str | None:
        if name.lower().endswith((".txt", ".md", ".markdown")):
            return data.decode("utf-8", "replace")
        return _docx(data) if name.lower().endswith(".docx") else None

    return pd.Series([read(p, c) for p, c in zip(path, content, strict=True)])


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text, Markdown and DOCX files; text is NULL for other kinds."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", _text_of_file("path", "content").alias("text"))
