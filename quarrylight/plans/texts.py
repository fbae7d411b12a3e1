"""Search, terms, hashes and text rules over documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import people as P
from quarrylight.functions import text as T
from quarrylight.functions import vocabulary as V
from quarrylight.functions.python_udfs import chunk_text
from quarrylight.operators import nearest as N
from quarrylight.operators import search as S
from quarrylight.operators.batches import greedy_batches
from quarrylight.operators.grams import contained
from quarrylight.operators.ladder import ranked
from quarrylight.plans.base import Catalog, table
from quarrylight.sources.tables import spread

catalog = Catalog()
_STOP = ", ".join(f"'{w}'" for w in V.STOP_TERMS)
_EDGE = V.TERM_EDGE.replace("'", "''")
_TOK = rf"""tok AS (SELECT doc_id, trim(lower(x), '{_EDGE}') AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_+\-.]{{1,}}')) AS x FROM documents)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 AND term NOT IN ({_STOP}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1, 2)"""
QUERY = ["then", "heth", "heoron", "the", "thinging", "ontion", "ciónosta"]


def _index(spark, d):
    return S.term_counts(table(spark, d, "documents"), "doc_id", "text")


@catalog("tfidf_search", f"""WITH {_TOK}, hit AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM tf WHERE term IN ({", ".join(f"'{q}'" for q in QUERY)}))
SELECT doc_id, round(sum(tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 6) AS score, string_agg(term, ' ' ORDER BY term) AS matched FROM hit GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 300""")
def tfidf_search(spark, d):
    found = S.search(_index(spark, d), QUERY, table(spark, d, "documents").agg(F.count("*").alias("n")), "doc_id")
    return found.withColumn("matched", F.array_join("matched", " "))


@catalog("top_terms_per_doc", f"""WITH {_TOK}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, length(term) DESC, term) AS rank FROM tf) SELECT doc_id, term, tf, rank FROM r WHERE rank <= 5""")
def top_terms(spark, d):
    r = ranked(_index(spark, d), ["doc_id"], [F.desc("tf"), F.desc(F.length("term")), F.col("term")])
    return r.where("rank <= 5").select("doc_id", "term", "tf", F.col("rank").cast("long").alias("rank"))


@catalog("term_df_idf", f"""WITH {_TOK} SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM tf GROUP BY 1 HAVING count(*) >= 20""")
def term_idf(spark, d):
    total = table(spark, d, "documents").agg(F.count("*").alias("n")).select("n").scalar()
    df = _index(spark, d).groupBy("term").agg(F.count("*").alias("df")).where("df >= 20")
    return df.select("term", "df", F.round(S.idf(total, F.col("df")), 6).alias("idf"))


@catalog("concept_key_hash", f"SELECT p_partkey, 'concept:' || substr(sha1(trim(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), '{_EDGE}')), 1, 16) AS key FROM part")
def concept_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.concept_key(F.col("p_name")).alias("key"))


@catalog("page_hash", "SELECT page_id, sha1(url || '|' || html) AS hash, substr(sha1(lower(url)), 1, 16) AS prefix FROM pages")
def page_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha1(F.concat_ws("|", "url", "html")).alias("hash"), F.substring(F.sha1(F.lower("url")), 1, 16).alias("prefix"))


@catalog("concept_edges", f"""SELECT p_partkey, trim(lower(w), '{_EDGE}') AS concept, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(trim(lower(w), '{_EDGE}')) BETWEEN 2 AND 32 AND trim(lower(w), '{_EDGE}') NOT IN ({_STOP}) AND NOT regexp_full_match(trim(lower(w), '{_EDGE}'), '[0-9]+') GROUP BY 1, 2""")
def concept_edges(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.explode(F.transform(F.split("p_name", " "), T.normalise_term)).alias("concept"))
    return words.where(T.is_concept(F.col("concept"))).groupBy("p_partkey", "concept").agg(F.count("*").alias("n"))


@catalog("email_extract", r"SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}'))[1:1], ',') AS mail FROM documents WHERE regexp_matches(text, '(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}') AND len(list_distinct(regexp_extract_all(text, '(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}'))) = 1")
def email_extract(spark, d):
    found = table(spark, d, "documents").select("doc_id", P.emails(F.col("text"), 3).alias("m")).where(F.size("m") > 0)
    return found.select("doc_id", F.array_join("m", ",").alias("mail"))


@catalog("line_dedupe_compact", r"""SELECT doc_id, string_agg(substr(l, 1, 500), chr(10) ORDER BY p) AS compact FROM (SELECT doc_id, l, min(p) AS p FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents) WHERE l <> '' GROUP BY 1, 2) GROUP BY 1""")
def line_compact(spark, d):
    return table(spark, d, "documents").select("doc_id", T.compact_lines(F.col("text")).alias("compact")).where("compact <> ''")


@catalog("noise_line_ratio", r"""SELECT doc_id, count(*) AS lines, round(count(*) FILTER (length(l) < 12) / count(*), 6) AS ratio FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE l <> '' GROUP BY 1""")
def noise_ratio(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    sized = table(spark, d, "documents").select("doc_id", lines.alias("l")).where(F.size("l") > 0)
    return sized.select("doc_id", F.size("l").cast("long").alias("lines"), F.round(F.size(F.filter("l", lambda x: F.length(x) < 12)) / F.size("l"), 6).alias("ratio"))


@catalog("evidence_span_check", "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text) WHERE benchmark.text <> ''")
def evidence_spans(spark, d):
    """Whole passages in documents, each looked up by its rarest pair of words."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("span"))
    return contained(table(spark, d, "documents"), items, "doc_id", "text", "item_id", "span")


@catalog("duplicate_groups", "SELECT md5(text) AS key, min(doc_id) AS keeper, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")


@catalog("keeper_election", """SELECT md5(text) AS key, arg_max(doc_id, [CASE WHEN source = 'src0' THEN 1 ELSE 0 END, -doc_id]) AS keeper_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def keeper_election(spark, d):
    score = F.struct(F.when(F.col("source") == "src0", 1).otherwise(0), -F.col("doc_id"))
    return table(spark, d, "documents").groupBy(F.md5("text").alias("key")).agg(F.max_by("doc_id", score).alias("keeper_id"), F.count("*").alias("n")).where("n > 1").select("key", "keeper_id")


@catalog("profile_completeness", "SELECT doc_id, (CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(lang, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(source, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN toxic IS NOT NULL THEN 1 ELSE 0 END + 0) / 6 AS completeness FROM documents LEFT JOIN labels USING (doc_id)")
def completeness(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    c = P.completeness(research_areas=F.col("text"), bio=F.col("lang"), enrollment_pref=F.col("source"), publications=F.col("quality"), email=F.col("toxic"), homepage=F.lit(None).cast("string"))
    return joined.select("doc_id", c.alias("completeness"))


@catalog("evidence_score", "SELECT doc_id, CAST(CASE WHEN trim(coalesce(text, '')) <> '' THEN 5 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN toxic IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN coalesce(toxic, 0) = 1 THEN 3 ELSE 0 END AS INTEGER) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def evidence(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", P.evidence_score({"bio": F.col("text"), "email": F.col("quality"), "homepage": F.col("toxic")}, F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int").alias("score"))


@catalog("missing_field_audit", """SELECT doc_id, field_name, CASE WHEN source = 'src0' THEN 'crawl_failure' ELSE 'site_missing' END AS reason FROM (
SELECT doc_id, source, unnest(list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END], lambda x: x IS NOT NULL)) AS field_name FROM documents LEFT JOIN labels USING (doc_id))""")
def missing_audit(spark, d):
    from quarrylight.operators.steward import missing_fields

    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reason = F.when(F.col("source") == "src0", "crawl_failure").otherwise("site_missing")
    return missing_fields(joined, ["quality", "toxic", "text"]).select("doc_id", "field_name", reason.alias("reason"))


@catalog("nullish_columns", "SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) IN ('', 'null', 'none', 'n/a', 'na', 'nan', '--', '-', 'unknown') THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def nullish(spark, d):
    return table(spark, d, "customer").select("c_custkey", P.nullish_to_null(F.col("c_mktsegment")).alias("segment"))


@catalog("title_normalise", """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN '教授' WHEN contains(lower(p_type), 'promo') THEN '讲师' END AS title FROM part""")
def titles(spark, d):
    """Part types as titles in English, through the rule table."""
    low = F.lower("p_type")
    said = F.when(F.contains(low, F.lit("economy")), "Full Professor").when(F.contains(low, F.lit("promo")), "senior lecturer").otherwise("none")
    return table(spark, d, "part").select("p_partkey", P.normalise_title(said).alias("title"))


@catalog("org_name_merge", "SELECT n_name, string_agg(r, ' / ' ORDER BY p) AS merged FROM (SELECT n_name, r, min(p) AS p FROM (SELECT n_name, unnest([n_name, r_name, n_name]) AS r, unnest([1, 2, 3]) AS p FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY 1, 2) GROUP BY 1")
def org_names(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", P.merge_org_names(F.col("n_name"), F.concat_ws(" / ", "r_name", "n_name")).alias("merged"))


@catalog("chunk_messages", r"""WITH m AS (SELECT conv_id, turn, trim(p, E' \t\n\r') AS p, list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '') AS w FROM (SELECT conv_id, turn, text AS p FROM conversations))
SELECT conv_id, turn, 0 AS chunk, p AS text FROM m WHERE len(w) BETWEEN 1 AND 64
UNION ALL SELECT conv_id, turn, k::INT, array_to_string(w[64 * k + 1:64 * k + 64], ' ') FROM (SELECT *, unnest(range(0, (len(w) + 63) // 64)) AS k FROM m WHERE len(w) > 64)""")
def chunk_messages(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(chunk_text(64)("text")).alias("chunk", "text"))


@catalog("row_batches", """WITH RECURSIVE r AS (SELECT conv_id, turn, greatest(1, len(string_split(trim(text), ' '))) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
b AS (SELECT conv_id, turn, k, n AS used, 0 AS batch FROM r WHERE k = 1 UNION ALL SELECT r.conv_id, r.turn, r.k, CASE WHEN used + r.n > 100 THEN r.n ELSE used + r.n END, batch + CASE WHEN used + r.n > 100 THEN 1 ELSE 0 END FROM b JOIN r ON r.conv_id = b.conv_id AND r.k = b.k + 1)
SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch FROM b""")
def row_batches(spark, d):
    """Turns of a conversation in batches of at most 100 words; a turn that would overflow begins the next."""
    words = F.greatest(F.lit(1), F.size(F.split(F.trim("text"), " ")))
    return greedy_batches(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", words, 100).select("conv_id", "turn", "batch")


@catalog("document_batches", """WITH RECURSIVE r AS (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
b AS (SELECT source, doc_id, k, n AS used, 0 AS batch FROM r WHERE k = 1 UNION ALL SELECT r.source, r.doc_id, r.k, CASE WHEN used + r.n > 8000 THEN r.n ELSE used + r.n END, batch + CASE WHEN used + r.n > 8000 THEN 1 ELSE 0 END FROM b JOIN r ON r.source = b.source AND r.k = b.k + 1)
SELECT source, doc_id, CAST(batch AS BIGINT) AS batch FROM b""")
def document_batches(spark, d):
    """Each source's documents in batches of at most 8000 characters, one source with a third of all rows."""
    return greedy_batches(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), 8000).select("source", "doc_id", "batch")


@catalog("keep_last_within_budget", """WITH f AS (SELECT conv_id, max(turn) AS top FROM conversations WHERE length(text) <= 400 GROUP BY 1)
SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations JOIN f USING (conv_id) WHERE turn <= top) WHERE used <= 400""")
def keep_last(spark, d):
    """The last turns within 400 characters; later turns that alone are over the budget are passed over."""
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    top = turns.where("n <= 400").groupBy("conv_id").agg(F.max("turn").alias("top"))
    used = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.join(top, "conv_id").where("turn <= top").withColumn("used", used).where("used <= 400").select("conv_id", "turn")


@catalog("signal_lines", rf"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(text, '\r\n|\r|\n')), '\s+', ' ', 'g')) AS line, unnest(range(len(regexp_split_to_array(text, '\r\n|\r|\n')))) AS p FROM documents),
u AS (SELECT doc_id, arg_min(line, p) AS line, lower(line) AS key, min(p) AS p FROM l WHERE line <> '' GROUP BY doc_id, lower(line)),
m AS (SELECT *, contains(key, '@') OR regexp_matches(key, '{"|".join(V.COMPACT_SIGNALS)}') AS s, regexp_matches(key, '{"|".join(V.COMPACT_NOISE)}') AND length(line) <= 160 AS z FROM u),
n AS (SELECT *, s OR coalesce(lag(s) OVER w, false) OR coalesce(lead(s) OVER w, false) AS near FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
c AS (SELECT doc_id, string_agg(rtrim(substr(line, 1, 500)), chr(10) ORDER BY p) AS page FROM n WHERE near OR NOT z GROUP BY 1)
SELECT doc_id, md5(page) AS page_md5, CASE WHEN length(page) <= 1200 THEN page ELSE rtrim(page[1:600], E' \n\t') || E'\n\n...[truncated]...\n\n' || ltrim(page[-600:], E' \n\t') END AS excerpt FROM c""")
def signal_lines(spark, d):
    """Whole documents compacted to their signal lines, and that cut in the middle to a budget."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    # exploded, as a filter on a column is moved below it and would compact every page again
    page = docs.select("doc_id", F.explode(F.array(T.signal_lines(F.col("text")))).alias("page")).where("page <> ''")
    return page.select("doc_id", F.md5("page").alias("page_md5"), T.truncate_middle(F.col("page"), 1200).alias("excerpt"))


@catalog("message_building", """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt, count(*) AS turns FROM conversations GROUP BY 1""")
def messages(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["t"]), "\n").alias("prompt"), F.count("*").alias("turns"))


@catalog("cosine_topk", """WITH q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id, round(list_cosine_similarity(q.e, CAST(embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings ON vec_id <> q_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT q_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def cosine_topk(spark, d):
    """A stated query set against all vectors, in cells of bounded size."""
    return N.cosine_topk(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5)
