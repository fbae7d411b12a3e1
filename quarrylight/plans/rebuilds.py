"""Tables that are kept and changed step by step: the search index, identities, repairs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.kept_index import KeptIndex
from quarrylight.plans.base import Catalog, table
from quarrylight.plans.texts import _EDGE, _STOP, QUERY
from quarrylight.sources.tables import saved, shared_dir

catalog = Catalog()

_TERMS = rf"""SELECT state, doc_id, trim(lower(x), '{_EDGE}') AS term FROM (SELECT state, doc_id, unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_+\-.]{{1,}}')) AS x FROM held)"""
_HELD = f"""held AS (SELECT s AS state, doc_id, CASE WHEN s > 1 AND source = 'src0' THEN lang || ' ' || text ELSE text END AS text FROM documents, (VALUES (1), (2), (3)) AS t(s) WHERE s < 3 OR source <> 'src1'),
tok AS ({_TERMS}), tf AS (SELECT state, doc_id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 AND term NOT IN ({_STOP}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1, 2, 3)"""


def _kept(spark, d, look):
    """What ``look`` sees of an index of all documents by source: as it is built, after the hot source was replaced, after another was deleted."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("key"), F.lit("document").alias("kind"), F.col("lang").alias("name"), "text")
    index = KeptIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    sources = [r.source for r in docs.select("source").distinct().collect()]
    index.replace(docs, sources)
    seen = [saved(look(index).withColumn("state", F.lit(1)))]
    index.replace(docs.where("source = 'src0'").withColumn("text", F.concat_ws(" ", "name", "text")), ["src0"])
    seen.append(saved(look(index).withColumn("state", F.lit(2))))
    index.delete("src1")
    seen.append(look(index).withColumn("state", F.lit(3)))
    return reduce(DataFrame.unionByName, seen)


@catalog("kept_index_terms", f"""WITH {_HELD} SELECT state, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY 1, 2 HAVING count(*) >= 10""")
def kept_index_terms(spark, d):
    """Every state of the kept index equals one that is built anew."""
    return _kept(spark, d, lambda i: i.terms().where("df >= 10"))


@catalog("kept_index_search", f"""WITH {_HELD}, hit AS (SELECT *, count(*) OVER (PARTITION BY state, term) AS df FROM tf WHERE term IN ({", ".join(f"'{q}'" for q in QUERY)})), n AS (SELECT state, count(*) AS n FROM held GROUP BY 1),
s AS (SELECT state, CAST(doc_id AS VARCHAR) AS key, round(sum(tf * (ln((n + 1) / (df + 1)) + 1)), 6) AS score, string_agg(term, ' ' ORDER BY term) AS matched FROM hit JOIN n USING (state) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY score DESC, key) AS r FROM s) SELECT state, key, score, matched FROM r WHERE r <= 300""")
def kept_index_search(spark, d):
    return _kept(spark, d, lambda i: i.search(QUERY).withColumn("matched", F.array_join("matched", " ")))


_PEOPLE = """base AS (SELECT c_custkey AS id, translate(CAST(c_custkey // 6 AS VARCHAR), '0123456789', 'abcdefghij') AS name, c_custkey % 4 AS org,
  CASE WHEN c_custkey % 5 <> 0 THEN 'https://h' || c_custkey // 2 || '.example.edu.cn/person/a' END AS page, c_mktsegment = 'BUILDING' AS t, c_acctbal > 2000 AS m, c_nationkey < 10 AS b FROM customer)"""


@catalog("ordered_repair", f"""WITH RECURSIVE {_PEOPLE},
st AS (SELECT 0 AS k, id, id AS root, page, NULL::BIGINT AS was FROM base
UNION ALL
SELECT n.k, n.id, n.root, n.page, n.was FROM (
  WITH r AS (SELECT k, root, any_value(st.page) AS page, arg_min(name, CASE WHEN id = root THEN 0 ELSE 1 END) AS name, bool_or(t)::INT + bool_or(m)::INT + bool_or(b)::INT + (any_value(st.page) IS NOT NULL)::INT AS filled FROM st JOIN base USING (id) GROUP BY 1, 2),
  keyed AS (SELECT root, 0 AS o, page AS key FROM r WHERE page IS NOT NULL UNION ALL SELECT DISTINCT st.root, 1, base.org || ':' || r.name FROM st JOIN base USING (id) JOIN r ON r.root = st.root),
  first AS (SELECT o, key FROM keyed GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 1),
  members AS (SELECT r.* FROM keyed JOIN first USING (o, key) JOIN r USING (root)),
  kept AS (SELECT arg_max(root, [filled, -root]) AS keeper FROM members),
  paged AS (SELECT keeper, arg_min(page, CASE WHEN root = keeper THEN -1 ELSE root END) FILTER (page IS NOT NULL) AS page FROM members, kept GROUP BY 1)
  SELECT st.k + 1 AS k, st.id, CASE WHEN members.root IS NULL THEN st.root ELSE keeper END AS root, CASE WHEN members.root IS NULL THEN st.page ELSE paged.page END AS page, st.root AS was
  FROM st CROSS JOIN paged LEFT JOIN members ON members.root = st.root) AS n)
SELECT id, root AS keeper_id, page AS homepage, CAST(count(*) OVER (PARTITION BY root) AS BIGINT) AS n FROM st WHERE k = (SELECT max(k) FROM st)""")
def ordered_repair(spark, d):
    """All customers as profiles whose candidates chain; every profile with the one it ended in."""
    from quarrylight.operators.ordered_repair import repair_in_order

    c = table(spark, d, "customer").withColumn("id", F.col("c_custkey"))
    block = F.floor(F.col("id") / 6).cast("string")
    said = lambda on, what: F.when(on, F.lit(what))
    page = F.concat(F.lit("https://h"), F.floor(F.col("id") / 2).cast("string"), F.lit(".example.edu.cn/person/a"))
    people = c.select(
        "id", F.translate(block, "0123456789", "abcdefghij").alias("name"), F.when(F.col("id") % 5 != 0, page).alias("homepage"),
        said(F.col("c_mktsegment") == "BUILDING", "教授").alias("title"), said(F.col("c_acctbal") > 2000, "a@b.cn").alias("email"), said(F.col("c_nationkey") < 10, "bio").alias("bio"),
    )
    units = c.select(F.col("id").alias("professor_id"), (F.col("id") % 4).alias("org_unit_id"))
    whole, _, log = repair_in_order(people, units)
    # a merged profile's keeper may be merged later: follow the log to its end
    final = people.select("id", F.col("id").alias("keeper_id"))
    for step in range(1, (log.agg(F.max("round")).first()[0] or 0) + 1):
        one = log.where(F.col("round") == step).select(F.col("id").alias("keeper_id"), F.col("keeper_id").alias("next"))
        final = final.join(one, "keeper_id", "left").select("id", F.coalesce("next", "keeper_id").alias("keeper_id"))
    sizes = final.groupBy("keeper_id").agg(F.count("*").alias("n"))
    return final.join(sizes, "keeper_id").join(whole.select(F.col("id").alias("keeper_id"), "homepage"), "keeper_id").select("id", "keeper_id", "homepage", "n")
