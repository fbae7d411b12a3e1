"""Log metrics, status reports, latest-per-key and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import logs as L
from quarrylight.plans.base import Catalog, table

catalog = Catalog()


def request_log(spark, d):
    """Events as a request log: the type is the model, the user the API key, refunds are failures."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("model"), (F.col("user_id") % 7).cast("string").alias("api_key"), F.when(F.col("value") > 90, F.concat(F.lit("503: busy "), k.cast("string"))).alias("error"),
        k.alias("input_tokens"), (k * 2).alias("output_tokens"), F.col("value").alias("cost"), F.round(F.col("value") * 10).cast("long").alias("use_time"),
    )


_LOG = """(SELECT event_id AS id, event_type AS model, CAST(user_id % 7 AS VARCHAR) AS api_key,
  CASE WHEN value > 90 THEN '503: busy ' || CAST(k AS VARCHAR) END AS error, k AS input_tokens, k * 2 AS output_tokens, value AS cost, CAST(round(value * 10) AS BIGINT) AS use_time
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


@catalog("log_metrics_grouping_sets", f"""
WITH g AS (SELECT model, api_key, grouping(model) AS gm, grouping(api_key) AS ga, count(*) AS count, count(*) FILTER (trim(coalesce(error, '')) = '') AS success, count(*) FILTER (trim(coalesce(error, '')) <> '') AS failed,
  sum(input_tokens) AS it, sum(output_tokens) AS ot, sum(cost) AS c, avg(use_time) AS a, quantile_disc(use_time, 0.5) AS p50, quantile_disc(use_time, 0.9) AS p90, quantile_disc(use_time, 0.99) AS p99
  FROM {_LOG} GROUP BY GROUPING SETS ((model), (api_key), ()))
SELECT CASE WHEN gm = 0 THEN 'model' WHEN ga = 0 THEN 'api_key' ELSE 'overall' END AS dimension, CASE WHEN gm = 0 THEN model WHEN ga = 0 THEN api_key END AS key, count, success, failed,
  round(failed / count, 6) AS failure_rate, CAST(it AS BIGINT) AS input_tokens, CAST(ot AS BIGINT) AS output_tokens, round(c, 4) AS cost, round(a, 4) AS use_time_avg, CAST(p50 AS BIGINT) AS use_time_p50, CAST(p90 AS BIGINT) AS use_time_p90, CAST(p99 AS BIGINT) AS use_time_p99 FROM g
""")
def log_metrics(spark, d):
    return L.metrics_by(request_log(spark, d), "model", "api_key")


@catalog("top_failure_reasons", f"SELECT substr(trim(regexp_extract(error, '^([^{{\\n]*)', 1)), 1, 140) AS reason, count(*) AS n FROM {_LOG} WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 15")
def top_failure_reasons(spark, d):
    logs = request_log(spark, d).where("error is not null")
    return L.top_failures(logs.select(F.to_json(F.array(F.struct(F.lit("failed").alias("status"), F.col("error").alias("msg")))).alias("attempts")))


@catalog("http_code_histogram", f"SELECT regexp_extract(error, '([0-9]{{3}}): ', 1) AS code, count(*) AS n FROM {_LOG} WHERE error IS NOT NULL GROUP BY 1")
def http_codes(spark, d):
    return request_log(spark, d).where("error is not null").groupBy(L.http_code(F.col("error")).alias("code")).agg(F.count("*").alias("n"))


@catalog("status_histogram_zero_filled", """SELECT o_orderstatus, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) AS t(o_orderstatus) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) USING (o_orderstatus)""")
def status_histogram(spark, d):
    return L.status_histogram(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@catalog("left_join_distinct_counts", """SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def left_join_counts(spark, d):
    """Each level is counted by itself first, so no join multiplies rows before it is counted."""
    nations = table(spark, d, "nation")
    per = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("c"))
    by_region = nations.join(per, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.countDistinct("n_nationkey").alias("nations"), F.sum("c").alias("customers"))
    joined = table(spark, d, "region").join(by_region, "r_regionkey", "left")
    return joined.groupBy("r_name").agg(F.coalesce(F.sum("nations"), F.lit(0)).alias("nations"), F.coalesce(F.sum("customers"), F.lit(0)).alias("customers"))


@catalog("having_nonzero", "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(s_suppkey) > 3")
def having_nonzero(spark, d):
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("s_suppkey").alias("k"))
    return table(spark, d, "nation").join(counts, "n_nationkey").groupBy("n_name").agg(F.sum("k").alias("suppliers")).where("suppliers > 3")


@catalog("conditional_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS waiting FROM orders GROUP BY 1")
def conditional_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("waiting"))


@catalog("correlated_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def correlated_counts(spark, d):
    """A count per parent without a correlated subquery: aggregate, then left join."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@catalog("zero_child_parents", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def zero_child(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@catalog("filtered_group_top", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def filtered_group_top(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(3)


@catalog("time_range", "SELECT CAST(floor(min(epoch(ts))) AS BIGINT) AS first, CAST(floor(max(epoch(ts))) AS BIGINT) AS last, count(*) AS n FROM events")
def time_range(spark, d):
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"))


@catalog("attempt_distribution", "SELECT n AS attempts, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def attempt_distribution(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("attempts"))
    return per.groupBy("attempts").agg(F.count("*").alias("orders"))


@catalog("fallback_rate", """SELECT count(*) FILTER (n > 1) AS retried, count(*) FILTER (n > 1 AND o_orderstatus = 'F') AS rescued, round(count(*) FILTER (n > 1) / count(*), 6) AS rate
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey""")
def fallback_rate(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(per, "o_orderkey")
    retried = F.count_if(F.col("n") > 1)
    return joined.agg(retried.alias("retried"), F.count_if((F.col("n") > 1) & (F.col("o_orderstatus") == "F")).alias("rescued"), F.round(retried / F.count("*"), 6).alias("rate"))


@catalog("latest_status_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_status(spark, d):
    return L.latest_per_key(table(spark, d, "events"), "user_id", "event_id", "event_type", "value")


@catalog("retryable_failures", """SELECT DISTINCT key FROM (SELECT user_id AS key FROM (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY 1) WHERE v > 50
UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def retryable_failures(spark, d):
    """Keys whose last event failed, and keys that another table holds back."""
    last = L.latest_per_key(table(spark, d, "events"), "user_id", "event_id", "value").where("value > 50").select(F.col("user_id").alias("key"))
    return last.union(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")).distinct()


@catalog("set_intersection", "SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@catalog("set_difference", "SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, d):
    heavy = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key")).join(heavy, "key", "left_anti")


@catalog("crawled_existence", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS crawled FROM orders")
def crawled_existence(spark, d):
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "orders").select("o_orderkey").join(seen, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("crawled"))


@catalog("all_of_existence", "SELECT o_orderkey, bool_and(l_returnflag = 'N') AS all_open FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def all_of(spark, d):
    each = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.every(F.col("l_returnflag") == "N").alias("all_open"))
    return table(spark, d, "orders").select("o_orderkey").join(each, "o_orderkey")


@catalog("peer_in_flight", """SELECT o_orderkey, peer FROM (SELECT o_orderkey, o_custkey FROM orders) a JOIN (SELECT o_custkey, min(o_orderkey) AS peer FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1) b USING (o_custkey) WHERE peer <> o_orderkey""")
def peer_in_flight(spark, d):
    orders = table(spark, d, "orders")
    peers = orders.where(F.col("o_orderstatus").isin("F", "P")).groupBy("o_custkey").agg(F.min("o_orderkey").alias("peer"))
    return orders.select("o_orderkey", "o_custkey").join(peers, "o_custkey").where("peer <> o_orderkey").select("o_orderkey", "peer")


@catalog("epoch_to_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS local_time FROM events")
def epoch_to_text(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("local_time"))


@catalog("safe_casts", "SELECT c_custkey, coalesce(TRY_CAST(substr(c_name, 10) AS BIGINT), 0) AS n, coalesce(TRY_CAST(c_mktsegment AS DOUBLE), 0.0) AS x FROM customer")
def safe_casts(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.expr("try_cast(substr(c_name, 10) as bigint)"), F.lit(0)).alias("n"), F.coalesce(F.expr("try_cast(c_mktsegment as double)"), F.lit(0.0)).alias("x"))


@catalog("running_mean", "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def running_mean(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@catalog("roster_overlap", "SELECT l_suppkey, count(*) AS accepted, round((count(*) - count(*) FILTER (l_returnflag = 'R')) / count(*), 6) AS overlap, count(*) >= 10 AND (count(*) - count(*) FILTER (l_returnflag = 'R')) / count(*) >= 0.8 AS overlaps FROM lineitem GROUP BY 1")
def roster_overlap(spark, d):
    ratio = (F.count("*") - F.count_if(F.col("l_returnflag") == "R")) / F.count("*")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("accepted"), F.round(ratio, 6).alias("overlap"), ((F.count("*") >= 10) & (ratio >= 0.8)).alias("overlaps"))


@catalog("run_verdict", """SELECT c_custkey, CASE WHEN coalesce(p, 0) > 0 THEN 'failed' WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'completed' END AS verdict
FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) USING (c_custkey)""")
def run_verdict(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    verdict = F.when(F.col("p") > 0, "failed").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("completed")
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", verdict.alias("verdict"))
