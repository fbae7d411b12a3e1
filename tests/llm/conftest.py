import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
EXTRA = ["id", "row", "fp", "root", "node", "lh", "pos", "line", "class", "c0", "size", "key", "host", "shard", "a", "b", "words", "n_words"]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def edges(spark):
    """Null, empty, blank, repeated, tied and very long texts, null ids, columns with clashing names."""
    long = "alpha beta gamma " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"), (None, "a null id here"), (6, long), (7, "Ünïcödé ☃ 日本語 text\nnext line"), (4, "other text of the same id")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(EXTRA)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))
    return df.cache()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con
