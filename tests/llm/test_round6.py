"""Large band groups of line dedup meet by sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import linededup
from quarrylight.llm.store import Scratch

from .test_operators import brute_lines


@pytest.mark.parametrize("block", [40, 256])
def test_sketches_keep_every_similar_pair(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    rng, sets = np.random.default_rng(3), []
    for size in (1, 4, 9, 30, 100, 400, 3000):
        for _ in range(8):
            own = rng.integers(-(1 << 31), 1 << 31, size).tolist()
            sets += [own, [*own[: -max(1, size // 10)], *rng.integers(-(1 << 31), 1 << 31, size // 10).tolist()], [*own, *rng.integers(-(1 << 31), 1 << 31, size // 4).tolist()]]
    sets = [sorted(set(s)) for s in sets]
    table = spark.createDataFrame(list(enumerate(sets)), "lh long, s array<int>")
    rows = linededup._sketches(table).select("*", F.lit(1).alias("key"), F.col("lh").alias("root"), F.lit(len(sets)).cast("long").alias("n"))
    met = {(r.a, r.b) for r in linededup._in_cells(rows, linededup._may_share_enough(0.8)).distinct().collect()}
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    similar = {(a, b) for a, b in pairs if (n := len({*sets[a]} & {*sets[b]})) >= 0.8 * (len(sets[a]) + len(sets[b]) - n) and n}
    assert len(similar) > 50 and similar <= met and len(met) < len(pairs) / 4


def test_large_band_groups_need_no_shingle_cells(spark, monkeypatch):
    """A group of some hundred lines used to be grouped anew by its shingles, at many times the work."""

    def unneeded(*_):
        raise AssertionError("grouped anew by shingles")

    monkeypatch.setattr(linededup, "_exact_pairs", unneeded)
    common = " ".join(f"standing{k} phrase{k}" for k in range(14))
    lines = [f"{common} " + " ".join(f"own{n}x{k}" for k in range(8)) + f" end{n}{side}" for n in range(80) for side in "ab"]
    rows = list(enumerate(lines))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) and sum(t != "" for t in got.values()) == 80


def test_groups_beyond_the_bound_still_meet_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(linededup, "GROUP", 20)
    common = " ".join(f"standing{k} phrase{k}" for k in range(14))
    lines = [f"{common} " + " ".join(f"own{n}x{k}" for k in range(8)) + f" end{n}{side}" for n in range(30) for side in "ab"]
    rows = list(enumerate(lines))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_blank_lines_are_told_by_white_space_of_any_kind(spark):
    texts = ["", " ", "\t\x0b\f\r ", " \ta", " ", "　", "a"]
    table = spark.createDataFrame([(t,) for t in texts], "line string").select(linededup._blank(F.col("line")).alias("b"), F.col("line").rlike(r"\S").alias("s"))
    assert all(r.b != r.s for r in table.collect())
