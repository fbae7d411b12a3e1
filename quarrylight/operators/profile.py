"""A wish in free text, parsed by word rules."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocabulary as V

# Words that stand for degrees and titles.
DEGREES = {"博士": ["博士", "读博", "phd"], "硕士": ["硕士", "研究生", "master"]}
WISHED_TITLES = ["院士", "教授", "副教授", "研究员", "博士生导师", "硕士生导师"]


def parse_profile(spark: SparkSession, raw: str) -> dict:
    """degrees, titles, locations, constraints and terms of one text: a single row."""
    low = raw.lower()
    degrees = [d for d, words in DEGREES.items() if any(w in low for w in words)]
    titles = [t for t in WISHED_TITLES if t in raw] + (["导师"] if "advisor" in low or "supervisor" in low else [])
    locations = [p for p in V.LOCATIONS if p in raw]
    constraints = [c for c, words in {"国际合作": ["留学", "出国", "海外", "国际"], "产业实践": ["就业", "产业", "工程", "实践"]}.items() if any(w in raw for w in words)]
    one = spark.createDataFrame([(" ".join([raw, *degrees, *titles, *locations]), raw)], "wish string, raw string")
    row = one.select(T.top_terms(F.col("wish"), 80).alias("top"), T.tokenize(F.col("raw")).alias("tokens"), T.top_terms(F.col("raw"), 24).alias("interests")).first()
    return {"degrees": degrees, "titles": list(dict.fromkeys(titles)), "locations": locations, "constraints": constraints, "top": row.top, "tokens": row.tokens, "interests": row.interests}
