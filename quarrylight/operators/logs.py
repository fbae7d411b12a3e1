"""Request-log metrics, retries, failure reasons and reports by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS = "array<struct<status:string,msg:string>>"


def is_success(error: Column) -> Column:
    return F.btrim(F.coalesce(error, F.lit(""))) == ""


def metrics() -> list[Column]:
    """Counts, failure rate, sums and nearest-rank percentiles of (error, input_tokens, output_tokens, cost, use_time)."""
    rank = lambda p, name: F.coalesce(F.expr(f"percentile_disc({p}) within group (order by use_time)").cast("long"), F.lit(0)).alias(name)
    failed = F.count_if(~is_success(F.col("error")))
    return [
        F.count("*").alias("count"), F.count_if(is_success(F.col("error"))).alias("success"), failed.alias("failed"),
        F.coalesce(F.round(failed / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0)).alias("failure_rate"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.round(F.sum("cost"), 4), F.lit(0.0)).alias("cost"), F.coalesce(F.round(F.avg("use_time"), 4), F.lit(0.0)).alias("use_time_avg"),
        rank(0.5, "use_time_p50"), rank(0.9, "use_time_p90"), rank(0.99, "use_time_p99"),
    ]


def metrics_by(logs: DataFrame, *dimensions: str) -> DataFrame:
    """The metrics over all logs and by each dimension, in one pass of grouping sets; empty keys are left out."""
    view = logs.select(*dimensions, "error", "input_tokens", "output_tokens", "cost", "use_time")
    sets = [[F.col(d)] for d in dimensions] + [[]]
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions], F.lit("overall"))
    key = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d)) for d in dimensions])
    grouped = view.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(which.alias("dimension"), key.alias("key"), *metrics())
    return grouped.drop(*dimensions).where("dimension = 'overall' or key <> ''")


def status_histogram(df: DataFrame, status: str, domain: list[str]) -> DataFrame:
    """Counts by status with a zero for each status of the domain that doesn't occur."""
    names = df.sparkSession.createDataFrame([(s,) for s in domain], f"{status} string")
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    return names.join(counts, status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def attempts_of(value: Column) -> Column:
    """The attempts of a JSON list, entry by entry, so one bad entry spoils no other."""
    items = F.from_json(value, "array<string>")
    each = F.transform(items, lambda x: F.from_json(x, "status string, msg string"))
    return F.filter(F.coalesce(each, F.array().cast(ATTEMPTS)), lambda x: x.isNotNull() & (x["msg"].isNotNull() | x["status"].isNotNull()))


def http_code(message: Column) -> Column:
    first = F.regexp_extract(message, r"\b(\d{3})\s*:\s*", 1)
    return F.nullif(F.when(first != "", first).otherwise(F.regexp_extract(message, r"\b(\d{3})\b", 1)), F.lit(""))


def reason_of(message: Column, longest: int = 140) -> Column:
    """What a message says before its payload or line end."""
    return F.substring(F.btrim(F.regexp_extract(message, r"^([^{\n]*)", 1)), 1, longest)


def top_failures(logs: DataFrame, limit: int = 15) -> DataFrame:
    """(reason, n) of the failed attempts' most frequent reasons."""
    tried = logs.select(F.explode(attempts_of(F.col("attempts"))).alias("a")).where("coalesce(a.status, '') <> 'success'")
    return tried.select(reason_of(F.col("a.msg")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(limit)


def latest_per_key(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The values of each key's last row, by one grouped maximum and no self-join."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v"))
    return last.select(key, "v.*")
