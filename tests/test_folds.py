"""Batches, job lives and page compaction against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import batches
from quarrylight.streaming import jobs


def plain_batches(sizes, budget):
    out, used, batch = [], None, 0
    for n in sizes:
        if used is not None and used + n > budget:
            used, batch = n, batch + 1
        else:
            used = (used or 0) + n
        out.append(batch)
    return out


def test_steps_of_runs_compose():
    rng = np.random.default_rng(0)
    for _ in range(300):
        budget, sizes = int(rng.integers(1, 30)), rng.integers(0, rng.integers(1, 40), int(rng.integers(1, 30)))
        cuts = [0, *sorted(rng.integers(0, len(sizes) + 1, 3).tolist()), len(sizes)]
        runs = [sizes[a:b] for a, b in itertools.pairwise(cuts) if b > a]
        steps, got, size, batch = [batches.step_of(r, budget) for r in runs], [], None, 0
        for run, step in zip(runs, steps, strict=True):
            got += batches.labels(run, budget, size, batch).tolist()
            size, more = step(size)
            batch += more
        assert got == plain_batches(sizes.tolist(), budget)
        whole = steps[0]
        for step in steps[1:]:
            whole = whole.then(step)
        for start in (None, *range(budget + 2)):
            size, batch = start, 0
            for step in steps:
                size, more = step(size)
                batch += more
            assert whole(start) == (size, batch)


def test_batches_of_hot_keys_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(batches, "RUN", 3)
    monkeypatch.setattr(batches, "GROUP", 2)
    rng = random.Random(4)
    rows = [(k, at, rng.choice([0, 1, 3, 9, 25])) for k, n in [("hot", 400), ("b", 3), ("c", 20), (None, 30)] for at in range(n)] + [("d", 0, None)]
    df = spark.createDataFrame(rows, "key string, at int, n int").repartition(5)
    got = {(r.key, r.at): r.batch for r in batches.greedy_batches(df, "key", "at", F.col("n"), 20).collect()}
    for key in ("hot", "b", "c", "d", None):
        mine = [n or 0 for k, _, n in rows if k == key]
        assert [got[key, at] for at in range(len(mine))] == plain_batches(mine, 20)
    assert batches.greedy_batches(df.limit(0), "key", "at", F.col("n"), 20).count() == 0


def test_changes_of_a_job():
    assert jobs.after(None, None, "submit") == ("pending", None, False) and jobs.after(None, None, "complete") is None
    assert jobs.after("failed", "timeout", "complete") == ("completed", None, True)
    assert jobs.after("failed", "failed", "complete") is None and jobs.after("completed", None, "fail") is None
    assert jobs.after("assigned", None, "timeout") == ("failed", "timeout", False) and jobs.after("pending", None, "submit") is None


def test_late_completion_over_micro_batches(spark, tmp_path):
    """The limit fires between files; a later file revives one job, and another comes after it was forgotten."""
    seconds = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    files = [
        [("a", 0, 1, "submit"), ("b", 1, 2, "submit"), ("c", 2, 3, "submit"), ("c", 3, 4, "complete"), ("e", 4, 5, "submit")],
        [("clock", 600, 6, "submit")],
        [("a", 700, 7, "complete"), ("b", 701, 8, "fail"), ("clock", 701, 9, "skip")],
        [("clock2", 9000, 10, "submit")],
        [("e", 9100, 11, "complete")],
    ]
    for k, rows in enumerate(files):
        one = spark.createDataFrame([(j, seconds(t), n, e) for j, t, n, e in rows], "job string, ts string, number long, event string")
        one.select("job", F.col("ts").cast("timestamp").alias("ts"), "number", "event").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
        out = jobs.job_changes(stream, 180, 3600).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    lives = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("job", "change").collect():
        lives.setdefault(r.job, []).append((r.status, r.message, r.late))
    assert lives["a"] == [("pending", None, False), ("failed", "timeout", False), ("completed", None, True)]
    assert lives["b"] == [("pending", None, False), ("failed", "timeout", False)]
    assert lives["c"] == [("pending", None, False), ("completed", None, False)]
    assert lives["clock"] == [("pending", None, False), ("skipped", None, False)]
    assert lives["e"] == [("pending", None, False), ("failed", "timeout", False)]


def test_signal_lines(spark):
    page = "新闻 通知\r\nProfessor Ada, email: ada@example.edu\n新闻  通知\nprofessor ada, Email: ada@example.edu\n电话: 123456\n"
    texts = [page, None, "", " \n\t", "intro\nnews of today\nplain\ncopyright us\nend", "news " * 40, "x" * 700]
    want = ["新闻 通知\nProfessor Ada, email: ada@example.edu\n电话: 123456", "", "", "", "intro\nplain\nend", ("news " * 40).strip(), "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.s for r in df.select("i", T.signal_lines(F.col("t")).alias("s")).orderBy("i").collect()] == want
    long = spark.createDataFrame([("\n".join(f"line {k % 20_000}" for k in range(60_000)),)], "t string")
    assert long.select(F.size(T.distinct_lines(F.col("t"))).alias("n")).first().n == 20_000


@pytest.mark.parametrize("most, want", [(0, ""), (4, "ab\n\n...[truncated]...\n\nij"), (10, "abcdefghij")])
def test_truncate_middle(spark, most, want):
    assert spark.createDataFrame([("abcdefghij",)], "t string").select(T.truncate_middle(F.col("t"), most).alias("m")).first().m == want
