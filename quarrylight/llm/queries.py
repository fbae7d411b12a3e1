"""The thin queries over whole tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.licenses import scan, templates

    return scan(table(spark, sf_dir, "documents"), templates(spark))


def _license_sql() -> str:
    from quarrylight.llm.licenses import TEMPLATES

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(TEMPLATES.items()))
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH known AS (SELECT license, {words} AS words FROM (VALUES {known}) AS t(license, text)),
wanted AS (SELECT DISTINCT license, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT license, words, unnest(range(1, len(words) - 3)) AS i FROM known)),
docs AS (SELECT doc_id, {words} AS words FROM documents),
has AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)),
totals AS (SELECT license, count(*) AS n_shingles FROM wanted GROUP BY 1),
shared AS (SELECT doc_id, license, count(*) AS n_shared FROM has JOIN wanted USING (s) GROUP BY 1, 2)
SELECT doc_id, license, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment FROM shared JOIN totals USING (license) WHERE n_shared >= 0.8 * n_shingles
"""


ORACLE_SQL["op7_licenses"] = _license_sql()


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.htmltext import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op10_decontaminate"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
spots AS (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(words[i:i + 12], ' ') AS w, len(words[i:i + 12]) AS n FROM spots),
sizes AS (SELECT DISTINCT n FROM windows),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
runs AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM pos, sizes WHERE i + n - 1 <= len(words)),
occ AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN windows USING (w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarrylight.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", F.md5("text").alias("text_md5"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarrylight.llm.sharding import compacted
    from quarrylight.llm.store import work_dir

    store = compacted(table(spark, sf_dir, "documents"), work_dir(spark, "shards"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


ORACLE_SQL["op2_sharding"] = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarrylight.llm.vptree import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL["op3_nearest"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.urlfilter import judge

    return judge(table(spark, sf_dir, "pages"))


def _spread_sql(rounds: int = 80) -> str:
    """All links count, also those to hosts without pages; ``rounds`` leave a millionth of the seeds undistributed."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rule = """CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule"""
    shares = "avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0 ELSE 0.0 END)::DOUBLE AS trusted, avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1.0 ELSE 0.0 END)::DOUBLE AS blocked"
    return f"""
WITH RECURSIVE placed AS (SELECT page_id, html, {low.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, {rule} FROM placed),
crawled AS (SELECT host, {shares} FROM ruled WHERE host <> '' GROUP BY 1),
raw AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#"''\\s<>]+(?:/[^?#"''\\s<>]*)?)', 1)) AS link FROM placed WHERE host <> ''),
parts AS (SELECT DISTINCT src, {low.format("split_part(link, '/', 1)")} AS host, CASE WHEN link LIKE '%/%' THEN regexp_extract(link, '^[^/]*(.*)$', 1) ELSE '/' END AS path FROM raw),
links AS (SELECT DISTINCT src, host AS dst FROM parts WHERE src <> host),
linked AS (SELECT *, {rule} FROM (SELECT DISTINCT host, path FROM parts WHERE src <> host AND host NOT IN (SELECT host FROM crawled))),
hosts AS (SELECT * FROM crawled UNION ALL SELECT host, {shares} FROM linked GROUP BY 1),
flows AS (
  SELECT src AS src_host, dst AS too, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS wt, 0.0::DOUBLE AS wd FROM links
  UNION ALL SELECT dst, src, 0.0::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) FROM links),
ranks AS (
  SELECT 0 AS k, host, 0.15::DOUBLE * trusted AS trust, 0.15::DOUBLE * blocked AS distrust FROM hosts
  UNION ALL
  SELECT moved.k + 1, hosts.host, 0.15::DOUBLE * trusted + 0.85::DOUBLE * coalesce(it[hosts.host], 0), 0.15::DOUBLE * blocked + 0.85::DOUBLE * coalesce(id[hosts.host], 0)
  FROM hosts, (SELECT k, map(list(too), list(it)) AS it, map(list(too), list(id)) AS id FROM (
    SELECT k, coalesce(too, '') AS too, sum(trust * wt) AS it, sum(distrust * wd) AS id FROM ranks LEFT JOIN flows ON src_host = host WHERE k < {rounds} GROUP BY 1, 2) GROUP BY 1) AS moved),
bad AS (SELECT host FROM ranks WHERE k = {rounds} AND distrust - trust > 0.5::DOUBLE * (1 - 0.85::DOUBLE))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


ORACLE_SQL["op4_url_filter"] = _spread_sql()


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.fim import digests

    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN [0, 1, 2, 3]] AS r FROM units),
cut AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts
"""


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.pii import digests

    return digests(table(spark, sf_dir, "documents"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.lexical import build, search

    found = search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("key", "doc_id")


ORACLE_SQL["op12_ranked_search"] = r"""
WITH terms AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT d, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM terms WHERE len(t) > 0),
corpus AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM docs) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
wanted AS (SELECT q, item_id, unnest(t) AS term FROM asked),
weighted AS (SELECT q, item_id, term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM wanted JOIN df USING (term), corpus),
scored AS (
  SELECT q, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM weighted JOIN tf USING (term) JOIN docs USING (d), corpus GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
