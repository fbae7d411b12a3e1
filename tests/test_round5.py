"""Steps of the last findings, against their plain forms."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrylight.functions import python_udfs, text
from quarrylight.operators import kept_index, ordered_repair
from quarrylight.plans import registry
from quarrylight.streaming import jobs


def test_term_counts_of_equal_tokenize(spark):
    rng = random.Random(5)
    texts = ["C++ a.b. -x The the 12 a1 _-. K\u212a \u0130x x\u212ay A\u0130b", "量子计算 deep-learning 机器学习机器学习 is 大学", None, "", "x..y ++ A_ zz-- 北京大学。北京"]
    texts += ["".join(rng.choice("aBz0_.+- ,é\u212a\u0130学大北京 ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    terms = df.select("i", F.explode(text.tokenize(F.col("t"))).alias("term")).groupBy("i", "term").count()
    got = {(i, term, n) for i, t in enumerate(texts) for term, n in python_udfs.term_counts_of(t or "").items()}
    assert got == {tuple(r) for r in terms.collect()}


def test_kept_index_holds_blocks(spark, tmp_path):
    """A row of the index holds many keys of a term, and the blocks' own counts agree with their postings."""
    index = kept_index.KeptIndex(spark, f"file://{tmp_path}/index")
    rows = [(f"s{k % 2}", str(k), "d", None, " ".join(["alpha"] * (k % 3) + ["beta", f"w{k}"])) for k in range(60)]
    rows += [("s0", "2", "d", None, "older"), ("s1", "none", "d", None, None)]
    index.replace(spark.createDataFrame(rows, "source string, key string, kind string, name string, text string").coalesce(1), ["s0", "s1"])
    want = {(s, k, term, t.split().count(term)) for s, k, _, _, t in [*rows[:2], *rows[3:61]] for term in t.split()}
    assert {(r.source, r.key, r.term, r.tf) for r in index.postings().collect()} == want
    plain = index.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    assert sorted(index.terms().collect()) == sorted(plain.collect())
    assert spark.read.parquet(f"{tmp_path}/index/postings").where("term = 'beta'").count() < 60
    assert index.nodes().count() == 61


def test_posting_blocks_by_the_held_limit(monkeypatch):
    """However often what is held is written, the postings are the same."""
    import pyarrow as pa

    rows = [(f"s{k % 3}", f"k{k}", " ".join(f"t{j}" for j in range(2, k % 7 + 2)) + " t2x") for k in range(40)] + [("s0", "e", ""), ("s0", "n", None)]
    batch = pa.RecordBatch.from_pylist([{"source": s, "key": k, "text": t} for s, k, t in rows])
    want = {(s, k, w, 1) for s, k, t in rows for w in (t or "").split()}
    for held in (1, 7, 10_000):
        monkeypatch.setattr(kept_index, "HELD", held)
        blocks = [r for b in kept_index.posting_blocks(iter([batch])) for r in b.to_pylist()]
        got = [(r["source"], k, r["term"], n) for r in blocks for k, n in zip(r["keys"], r["tfs"], strict=True)]
        assert len(got) == len(want) and set(got) == want
        assert all(r["n"] == len(r["keys"]) and r["total"] == sum(r["tfs"]) for r in blocks)


class Store:
    """What a processor sees of its state, counting the round trips."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.now


def fed(owner_of, batches, limit, keep):
    """The changes of (job, at, number, event) rows in batches of a stream, and the round trips; each batch comes after a watermark."""
    life, stores, seen = jobs.JobLives(limit, keep), {}, []
    for watermark, rows in batches:
        for owner in {owner_of(r[0]): 0 for r in rows}:
            store = stores.setdefault(owner, Store())
            store.now = watermark
            life.init(store)
            mine = [Row(job=j, at=t, number=n, event=e) for j, t, n, e in rows if owner_of(j) == owner]
            seen += life.handleInputRows((owner,), iter(mine), store)
        for owner, store in stores.items():
            life.init(store)
            for at in sorted(t for t in store.timers if t <= watermark):
                info = Store()
                info.now, store.now = at, watermark
                seen += life.handleExpiredTimer((owner,), store, info)
                store.timers.discard(at)
    return sorted((r.job, r.change, r.status, r.message or "", r.late) for r in seen), sum(s.calls for s in stores.values()), stores


def test_jobs_of_an_owner_share_a_row_of_state():
    """Whether jobs have a state each or share an owner's, they live the same lives; one row takes fewer round trips."""
    rng = random.Random(8)
    for _ in range(20):
        rows = sorted((rng.randint(0, 3000), k, f"{rng.randint(0, 2)}@{rng.randint(0, 9)}", rng.choice(["submit", "submit", "assign", "complete", "fail", "skip"])) for k in range(300))
        cuts, batches, top = sorted(rng.sample(range(300), 5)), [], 0
        for a, b in zip([0, *cuts], [*cuts, 300], strict=True):
            batches.append((top, [(j, t, k, e) for t, k, j, e in rows[a:b]]))
            top = max([top, *(t for t, *_ in rows[a:b])]) if b > a else top
        batches.append((top, []))
        apart, many, _ = fed(lambda job: job, batches, 90, 400)
        shared, few, stores = fed(lambda job: job[0], batches, 90, 400)
        assert shared == apart and few < many / 2
        # what is over is forgotten
        assert all(life[3] + 400 >= top for s in stores.values() if s.value for life in s.value[1])


def test_a_long_gap_times_out_before_it_forgets():
    """The watermark passes both of a job's times between two rows of its owner."""
    got, _, stores = fed(lambda job: job[0], [(0, [("a1", 0, 1, "submit")]), (10_000, [("a2", 10_000, 2, "submit")])], 10, 100)
    assert got == [("a1", 1, "pending", "", False), ("a1", 2, "failed", "timeout", False), ("a2", 1, "pending", "", False)]
    assert [life[0] for life in stores["a"].value[1]] == ["a2"]


def test_ordered_repair_deals_profiles_out_before_it_normalises_them(spark, monkeypatch):
    """However few bytes the profiles have, more than one task normalises them."""
    plans = {}

    class Watched(ordered_repair.Scratch):
        def save(self, df, name):
            plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
            return super().save(df, name)

    monkeypatch.setattr(ordered_repair, "Scratch", Watched)
    people = spark.createDataFrame([(1, "Ada", "https://h.example.edu.cn/person/a"), (2, "Bob", None)], "id long, name string, homepage string").coalesce(1)
    whole, _, _ = ordered_repair.repair_in_order(people, spark.createDataFrame([(1, 1)], "professor_id long, org_unit_id int"))
    assert whole.count() == 2
    heavy, dealt = plans["start"].index("regexp"), plans["start"].index("Repartition")
    assert heavy < dealt  # the plan is read from its end


def test_signal_lines_compacts_a_page_once(spark):
    """No filter repeats the work, and pages are dealt out before it."""
    plan = registry.queries()["signal_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 1 and plan.index("array_join") < plan.index("Repartition")
