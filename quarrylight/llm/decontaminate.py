"""Benchmark decontamination: a prefix-filtered join of benchmark windows with whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.store import saved

#: Words are runs of digits, letters A-Z and characters beyond ASCII.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 3
AT_WORDS = r"(?=([^ ]+(?: [^ ]+){0,2}))[^ ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Broadcast the benchmark's shingles up to this many; beyond it they are shuffled.
BROADCAST_SHINGLES = 500_000
BROADCAST_ROWS = 2_000_000


def spaced(text: Column) -> Column:
    """The words of a text, case kept, with one space between them."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), NO_WORD, " "))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, item, n): each run of ``width`` words of an item, or all words of a shorter one."""
    words = items.select(F.col(id_col).alias("item"), F.split(ascii_lower(spaced(F.col(text_col))), " ").alias("words")).where("words[0] <> ''")
    runs = words.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))).alias("at"))
    window = F.slice("words", F.col("at"), width)
    return runs.select(F.concat_ws(" ", window).alias("window"), "item", F.size(window).alias("n")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, n, size, offset, shingle, cover) for every shingle of a window.

    ``cover`` marks the shingles that together hold each word of the window.
    """
    size = F.least(F.lit(SHINGLE), F.col("n"))
    words = F.split("window", " ")
    at = windows.select("window", "n").distinct().withColumn("size", size).withColumn("words", words)
    at = at.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    shingle = F.concat_ws(" ", F.slice("words", F.col("offset") + 1, F.col("size")))
    cover = (F.col("offset") % SHINGLE == 0) | (F.col("offset") == F.col("n") - F.col("size"))
    return at.select("window", "n", "size", "offset", shingle.alias("shingle"), cover.alias("cover"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``judged`` without the row hash: id_col, n_words, n_hit, n_items, items_sha256, contaminated."""
    return judged(docs, items, id_col, **options).select(id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    gone = saved(judged(docs, items, id_col, text_col, **options).where("contaminated").select("row").distinct(), "contaminated")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    keyed = docs.withColumn(text_col, F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text")))
    left = keyed.join(few, keyed[text_col]["row"] == few["row"], "left_anti")
    return left.withColumn(text_col, F.col(f"{text_col}.text")).select(*docs.columns)


def judged(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    share: int = 20,
) -> DataFrame:
    """Per document: id_col, row (hash of id and text), n_words, n_hit, n_items, items_sha256, contaminated.

    Words: A-Z lower-cased runs of digits, a-z and characters beyond ASCII. A window is ``width``
    consecutive words of an item; an item of fewer words, but not none, is one window. A document
    word inside any occurrence of a window is hit; a document is contaminated if it has hits and
    ``share`` * n_hit >= n_words. n_items counts the items with an occurring window; items_sha256
    hashes their ids, sorted as strings and joined by commas (the empty string if there are none).

    Prefix filter: containment of a whole window needs each of its word shingles, so its rarest
    shingle over all documents (then the first) is a sufficient prefix. Only that one is joined;
    positions before the text or beyond its length are dropped, and what is left is verified word
    by word through the shingles that cover the window.

    Null text has no words: zeros, no items, not contaminated. A null id keeps its row. Repeated
    rows each give their row; rows that share an id but not the text are judged apart. Items with
    null text or a null id count as windows of words, but a null id is not in the digest. Empty
    tables give no rows, or rows without hits. Other columns are ignored.
    """
    windows = saved(item_windows(items, item_col, item_text_col, width), "windows")
    shingles = saved(window_shingles(windows), "shingles")
    known = shingles.select("shingle", "size").distinct()
    small = shingles.count() <= BROADCAST_SHINGLES
    fits = F.broadcast if small else (lambda df: df)
    sizes = sorted(r[0] for r in known.select("size").distinct().collect()) or [SHINGLE]  # at most three

    # One row at position 0 for each document, and one for each of its words that starts a known shingle.
    arrays = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.regexp_extract_all(spaced(F.col(text_col)), F.lit(AT_WORDS), F.lit(1)).alias("starts")
    )
    places = arrays.select("id", "row", F.size("starts").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.col("starts"))).alias("pos", "raw"))
    if sizes == [SHINGLE]:
        places = places.withColumn("size", F.lit(SHINGLE))
    else:
        cut = F.array(*[F.struct(F.lit(s).alias("size"), F.substring_index("raw", " ", s).alias("raw")) for s in sizes])
        places = places.select("id", "row", "n_words", "pos", F.explode(F.when(F.col("pos") > 0, cut).otherwise(F.slice(cut, 1, 1))).alias("s")).select("id", "row", "n_words", "pos", "s.raw", "s.size")
    # Full lower-casing is fast and never tells equal shingles apart; the exact one follows on the few that are left.
    loose = known.select(F.lower("shingle").alias("key"), "size").distinct().withColumn("known", F.lit(True))
    found = places.join(fits(loose), (F.lower("raw") == F.col("key")) & (places["size"] == loose["size"]), "left").where("pos = 0 or known")
    found = found.select("id", "row", "n_words", "pos", ascii_lower(F.col("raw")).alias("shingle"))
    found = saved(found, "places")

    starts = found.where("pos > 0").select("row", "n_words", F.col("pos").alias("at"), "shingle").distinct()
    rarity = starts.groupBy("shingle").agg(F.count("*").alias("seen"))
    prefix = shingles.join(rarity, "shingle", "left").groupBy("window", "n").agg(
        F.min_by(F.struct("shingle", "offset"), F.struct(F.coalesce("seen", F.lit(0)), "offset")).alias("p")
    ).select("window", "n", "p.*")
    candidates = starts.join(fits(prefix), "shingle").select("row", "window", "n", (F.col("at") - F.col("offset")).alias("start"), "n_words")
    candidates = candidates.where("start >= 1 and start + n - 1 <= n_words")
    needs = shingles.where("cover").select("window", F.col("offset").alias("o"), F.col("shingle").alias("need"))
    totals = needs.groupBy("window").agg(F.count("*").alias("total"))
    wanted = candidates.join(fits(needs.join(totals, "window")), "window").select("row", "window", "n", "start", "total", (F.col("start") + F.col("o")).alias("at"), F.col("need").alias("shingle"))
    whole = wanted.join(starts.select("row", "at", "shingle"), ["row", "at", "shingle"]).groupBy("row", "window", "n", "start", "total").agg(F.count("*").alias("got")).where("got = total")
    whole = saved(whole.select("row", "window", "n", "start"), "occurrences")

    before = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    hit = whole.select("row", "start", "n").distinct().select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    owners = whole.select("row", "window").distinct().join(fits(windows.select("window", "item")), "window")
    named = owners.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    rows = found.where("pos = 0").select("id", "row", F.col("n_words").cast("long").alias("n_words"))
    joined = rows.join(hit.join(named, "row"), "row", "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        F.col("id").alias(id_col),
        "row",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_col), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
