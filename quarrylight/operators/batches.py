"""Greedy batches of ordered rows under a budget: a fold that starts anew where the next row would overflow.

What a run of rows does to a batch that is open when the run begins is a function of that batch's
size: from where it overflows first, everything follows. The function is piecewise constant, but for
sizes that don't overflow at all, to which the run's total is added. Functions of consecutive runs
compose, so runs are folded apart, composed upwards, and the sizes at their starts handed down again;
no key's rows ever meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.tables import saved

#: Rows of a run, and runs of a group, as bits.
RUN, GROUP = 12, 10


@dataclass
class Step:
    """What a run does: pieces ``lows[i] < size <= lows[i + 1]`` with the size at its end and the batches begun.

    The first piece may shift (its end is added to the size). ``fresh`` is for no open batch.
    """

    lows: list[int]
    ends: list[int]
    begun: list[int]
    shifts: bool
    fresh: tuple[int, int]

    def __call__(self, size: int | None) -> tuple[int, int]:
        if size is None:
            return self.fresh
        i = int(np.searchsorted(self.lows, size)) - 1
        return self.ends[i] + (size if self.shifts and i == 0 else 0), self.begun[i]

    def then(self, other: Step) -> Step:
        first, lows, ends, begun, shifts = 0, [], [], [], False
        if self.shifts:
            first, by = 1, self.ends[0]
            top = self.lows[1] if len(self.lows) > 1 else np.inf
            for i, low in enumerate(other.lows):
                high = other.lows[i + 1] if i + 1 < len(other.lows) else np.inf
                if low - by < top and high - by > self.lows[0]:
                    shift = other.shifts and i == 0
                    lows.append(max(low - by, self.lows[0]))
                    ends.append(other.ends[i] + (by if shift else 0))
                    begun.append(other.begun[i])
                    shifts = shifts or shift
        for low, end, n in list(zip(self.lows, self.ends, self.begun, strict=True))[first:]:
            after, more = other(end)
            lows.append(low)
            ends.append(after)
            begun.append(n + more)
        end, n = self.fresh
        after, more = other(end)
        return Step(lows, ends, begun, shifts, (after, n + more)).merged()

    def merged(self) -> Step:
        """Neighbouring pieces that do the same become one."""
        keep = [i for i in range(len(self.lows)) if i == 0 or (i == 1 and self.shifts) or (self.ends[i], self.begun[i]) != (self.ends[i - 1], self.begun[i - 1])]
        return Step([self.lows[i] for i in keep], [self.ends[i] for i in keep], [self.begun[i] for i in keep], self.shifts, self.fresh)


def step_of(sizes: np.ndarray, budget: int) -> Step:
    """The function of a run, from its last row backwards."""
    n, total = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    following = np.searchsorted(total, total[:-1] + budget, side="right") - 1  # the row that overflows a batch begun here
    following = np.maximum(following, np.arange(n) + 1)
    end, begun = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n - 1, -1, -1):
        j = following[k]
        end[k], begun[k] = (total[n] - total[k], 1) if j >= n else (end[j], begun[j] + 1)
    reach = int(np.searchsorted(total, budget, side="right")) - 1  # rows that fit after an empty open batch
    lows, ends, starts = [], [], []
    if reach == n:
        lows, ends, starts = [-1], [int(total[n])], [0]
    for k in range(min(reach, n - 1), -1, -1):
        low = max(budget - int(total[k + 1]), -1)
        if not lows or low > lows[-1] or low == -1:
            if lows and low == lows[-1]:
                lows.pop(), ends.pop(), starts.pop()
            lows.append(low)
            ends.append(int(end[k]))
            starts.append(int(begun[k]))
        else:  # of rows that overflow at the same size the first counts
            ends[-1], starts[-1] = int(end[k]), int(begun[k])
    return Step(lows, ends, starts, reach == n, (int(end[0]), int(begun[0]) - 1)).merged()


def labels(sizes: np.ndarray, budget: int, size: int | None, batch: int) -> np.ndarray:
    """The batch of each row of a run that begins with an open batch of ``size``."""
    out = np.empty(len(sizes), np.int64)
    for k, n in enumerate(sizes.tolist()):
        if size is not None and size + n > budget:
            size, batch = n, batch + 1
        else:
            size = (size or 0) + n
        out[k] = batch
    return out


STEP = "lows array<long>, ends array<long>, begun array<long>, shifts boolean, fresh_end long, fresh_begun long"


def _row(s: Step) -> dict:
    return {"lows": s.lows, "ends": s.ends, "begun": s.begun, "shifts": s.shifts, "fresh_end": s.fresh[0], "fresh_begun": s.fresh[1]}


def _step(row) -> Step:
    return Step([int(x) for x in row.lows], [int(x) for x in row.ends], [int(x) for x in row.begun], bool(row.shifts), (int(row.fresh_end), int(row.fresh_begun)))


def greedy_batches(rows: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """``rows`` with the number of their batch within ``key``, from 0, in ``order``.

    A row joins the open batch unless that would bring it over the budget; a row larger than the
    budget is a batch of its own. Sizes are whole numbers of 0 or more, a null counts as 0. Null keys
    are a key of their own, null orders come first; rows equal in both may swap.
    """
    placed = rows.withColumn("_size", F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)))
    inorder = placed.repartitionByRange(F.col(key), F.col(order), F.col("_size")).sortWithinPartitions(key, order, "_size").withColumn("_at", F.monotonically_increasing_id())
    inorder = saved(inorder.withColumn("_run", F.shiftright("_at", RUN)))

    def keyed(out: list, columns: list[str]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=columns)
        return frame.assign(_key=pd.Series([None if pd.isna(k) else k for k in frame["_key"]], dtype=object))

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        """Of the keys at the run's ends only: others lie within it."""
        group, out = group.sort_values("_at"), []
        for name, mine in group.groupby("_key", sort=False, dropna=False):
            if mine.index[0] == group.index[0] or mine.index[-1] == group.index[-1]:
                out.append({"_key": name, "_run": group["_run"].iloc[0], **_row(step_of(mine["_size"].to_numpy(), budget))})
        return keyed(out, ["_key", "_run", *_row(Step([], [], [], False, (0, 0)))])

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_step(r) for r in group.sort_values("_run").itertuples()]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.then(part)
        one = {"_key": group["_key"].iloc[0], "_run": group["_group"].iloc[0], **_row(whole)}
        return keyed([one], list(one))

    def handed(group: pd.DataFrame) -> pd.DataFrame:
        """The open size and batch at the start of each part, from those of the whole."""
        group, out = group.sort_values("_run"), []
        size, batch = group["_open"].iloc[0], int(group["_batch"].iloc[0])
        size = None if pd.isna(size) else int(size)
        for row in group.itertuples(index=False):
            out.append((row[0], row[1], size, batch))
            size, more = _step(row)(size)
            batch += more
        return keyed(out, ["_key", "_run", "_open", "_batch"]).astype({"_open": "Int64"})

    def labelled(group: pd.DataFrame) -> pd.DataFrame:
        group, parts = group.sort_values("_at"), []
        for _, mine in group.groupby("_key", sort=False, dropna=False):
            size, batch = mine["_open"].iloc[0], mine["_batch"].iloc[0]
            parts.append(labels(mine["_size"].to_numpy(), budget, None if pd.isna(size) else int(size), 0 if pd.isna(batch) else int(batch)))
        return pd.DataFrame({"_at": group["_at"], "batch": np.concatenate(parts)})

    narrow = inorder.select(F.col(key).cast("string").alias("_key"), "_run", "_at", "_size")
    ends = saved(narrow.groupBy("_run").applyInPandas(steps, f"_key string, _run long, {STEP}"))
    grouped = ends.withColumn("_group", F.shiftright("_run", GROUP))
    groups = saved(grouped.groupBy("_key", "_group").applyInPandas(composed, f"_key string, _run long, {STEP}"))
    entry = f"_key string, _run long, _open long, _batch long"
    start = groups.withColumns({"_open": F.lit(None).cast("long"), "_batch": F.lit(0).cast("long")})
    of_groups = start.groupBy("_key").applyInPandas(handed, entry).select(F.col("_key").alias("k"), F.col("_run").alias("g"), "_open", "_batch")
    fine = grouped.join(of_groups, grouped["_key"].eqNullSafe(F.col("k")) & (F.col("_group") == F.col("g"))).select("_key", "_run", *[c.split()[0] for c in STEP.split(", ")], "_open", "_batch", "_group")
    of_runs = fine.groupBy("_key", "_group").applyInPandas(handed, entry).select(F.col("_key").alias("k"), F.col("_run").alias("r"), "_open", "_batch")
    met = narrow.join(of_runs, narrow["_key"].eqNullSafe(F.col("k")) & (F.col("_run") == F.col("r")), "left").drop("k", "r")
    done = met.groupBy("_run").applyInPandas(labelled, "_at long, batch long")
    return inorder.join(done, "_at").select(*[F.col(f"`{c}`") for c in rows.columns], "batch")
