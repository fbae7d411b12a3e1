"""Streaming forms over the events table: each reads it as a stream to its end and returns what the sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylight.plans.base import Catalog, table
from quarrylight.sources.tables import shared_dir
from quarrylight.streaming import events as E
from quarrylight.streaming import jobs as J

catalog = Catalog()


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return E.with_event_time(raw)


def _finished(stream, mode: str, keep=lambda df: df):
    """Run a stream until what is there has been read; each batch replaces or joins the sink's folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch, number):
        keep(batch).write.mode("overwrite").parquet(f"{at}/out/{'all' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/*")


@catalog("stream_windowed_counts", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed(spark, d):
    done = _finished(E.windowed_counts(_stream(spark, d), "event_type", "1 day"), "complete")
    return done.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@catalog("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    done = _finished(E.sessions(_stream(spark, d), "user_id", "2 hours"), "complete")
    return done.select("user_id", F.unix_timestamp("start").alias("start"), "n")


@catalog("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def dedup(spark, d):
    """The first event of each user and type; a key that returns after the watermark counts once still."""
    first = E.first_of_each(_stream(spark, d), ["user_id", "event_type"]).select("user_id", "event_type")
    return _finished(first, "append").distinct()


@catalog("stream_status_fold", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def status_fold(spark, d):
    """The last status of each user, kept as an aggregate that every batch brings up to date."""
    last = _stream(spark, d).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))
    return _finished(last, "complete")


@catalog("stream_job_lives", """WITH e AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS job, epoch_ms(ts) AS t, event_id, CASE event_type WHEN 'view' THEN 'submit' WHEN 'signup' THEN 'assign' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'skip' END AS event FROM events),
opened AS (SELECT job, min([t, event_id]) AS o, min(t) + 10800000 AS deadline FROM e WHERE event = 'submit' GROUP BY 1),
mine AS (SELECT e.*, deadline FROM e JOIN opened USING (job) WHERE [t, event_id] > o AND event <> 'submit'),
closing AS (SELECT job, deadline, min([t, event_id]) FILTER (event IN ('complete', 'fail', 'skip') AND t <= deadline) AS f, min([t, event_id]) FILTER (event = 'complete' AND t > deadline) AS again,
  min([t, event_id]) FILTER (t > deadline) AS passed FROM mine GROUP BY 1, 2),
named AS (SELECT opened.job, opened.deadline, f, again, passed, (SELECT any_value(event) FROM mine WHERE mine.job = opened.job AND [t, event_id] = f) AS how FROM opened LEFT JOIN closing USING (job)),
hits AS (SELECT job, count(*) AS n FROM mine JOIN named USING (job) WHERE event = 'assign' AND t <= mine.deadline AND (f IS NULL OR [t, event_id] < f) GROUP BY 1),
fin AS (SELECT *, deadline <= (SELECT max(t) FROM e) - 3600000 OR passed IS NOT NULL AS over, job IN (SELECT job FROM hits) AS held FROM named)
SELECT job, CASE WHEN how = 'complete' THEN 'completed' WHEN how = 'skip' THEN 'skipped' WHEN how = 'fail' THEN 'failed' WHEN again IS NOT NULL THEN 'completed' WHEN over THEN 'failed' WHEN held THEN 'assigned' ELSE 'pending' END AS status,
  CASE WHEN how = 'fail' THEN 'failed' WHEN how IS NULL AND again IS NULL AND over THEN 'timeout' END AS message,
  how IS NULL AND again IS NOT NULL AS late, CAST(1 + CASE WHEN held THEN 1 ELSE 0 END + CASE WHEN how IS NOT NULL THEN 1 WHEN again IS NOT NULL THEN 2 WHEN over THEN 1 ELSE 0 END AS BIGINT) AS changes FROM fin""")
def job_lives(spark, d):
    """Each user's day is a job of three hours: views ask, signups take, purchases complete, errors fail, clicks skip."""
    said = F.create_map(*map(F.lit, ["view", "submit", "signup", "assign", "purchase", "complete", "error", "fail", "click", "skip"]))
    job = F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    stream = _stream(spark, d).select(job.alias("job"), "user_id", "ts", F.col("event_id").alias("number"), said[F.col("event_type")].alias("event"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    try:
        done = _finished(J.job_changes(stream, 3 * 3600, owner="user_id"), "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = done.groupBy("job").agg(F.max_by(F.struct("status", "message", "late"), "change").alias("r"), F.max("change").alias("changes"))
    return last.select("job", "r.*", "changes")
