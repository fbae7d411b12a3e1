"""The nearest rows of a query set by cosine, all pairs: cells of queries and rows meet as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.ladder import ranked

#: Places of a score, and how near to a half in the last place a product of matrices can't be told from it.
PLACES, SLACK = 6, 1e-3
MISSING, NAN = -4e6, 4e6


def _vectors(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's vector; an empty one for a null, or for one that holds a null."""
    if column.null_count or any(c.flatten().null_count for c in column.chunks):
        return [np.zeros(0) if v is None or any(x is None for x in v) else np.array(v, dtype=np.float64) for v in column.to_pylist()]
    out = []
    for c in column.chunks:
        ends = np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))
        out += np.split(c.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products in order of the components, as SQL adds them."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total = total + a[:, k] * b[:, k]
    return total


def best_of(query_ids: np.ndarray, queries: list[np.ndarray], ids: np.ndarray, rows: list[np.ndarray], k: int, tile: tuple[int, int] = (256, 8192)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine) that hold each query's ``k`` best other rows by rounded cosine, then id; NaN with a mask for none.

    Products of matrices choose; what they can't tell from the next rounded value is kept as well. The
    cosines of the chosen are then summed in order. Vectors of different lengths have no cosine.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], [rows[i] for i in order]
    out = []
    for at in range(0, len(query_ids), tile[0]):
        asked, asked_ids = queries[at : at + tile[0]], query_ids[at : at + tile[0]]
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for start in range(0, len(ids), tile[1]):
            kept.append(_tile(asked, asked_ids, rows[start : start + tile[1]], ids[start : start + tile[1]], k, start))
        q, p, low, high = (np.concatenate(x) for x in zip(*kept, strict=True))
        # the k best of all tiles by their lower values, and all that may be better than the last of them
        sort = np.lexsort((p, -low, q))
        q, p, low, high = q[sort], p[sort], low[sort], high[sort]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        last = np.minimum(first + k, np.searchsorted(q, q, side="right")) - 1
        use = (place < k) | ((high > low) & (high >= low[last]))
        q, p = q[use], p[use]
        exact = np.full(len(q), np.nan)
        none = np.ones(len(q), bool)
        sizes = np.array([len(asked[a]) if len(asked[a]) == len(rows[b]) else 0 for a, b in zip(q, p, strict=True)], dtype=np.int64)
        for size in set(sizes.tolist()) - {0}:
            here = np.flatnonzero(sizes == size)
            a, b = np.stack([asked[i] for i in q[here]]), np.stack([rows[i] for i in p[here]])
            with np.errstate(all="ignore"):
                exact[here] = _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))
            none[here] = False
        out.append((asked_ids[q], ids[p], np.ma.MaskedArray(exact, none)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.ma.MaskedArray(np.zeros(0))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.ma.concatenate([o[2] for o in out])


def _tile(asked: list, asked_ids: np.ndarray, rows: list, ids: np.ndarray, k: int, start: int) -> tuple:
    """(query, position, lower, upper rounded cosine in units of the last place) of a tile's best."""
    low = np.full((len(asked), len(ids)), MISSING)
    doubt_q, doubt_p = [], []
    a_sizes, b_sizes = np.array([len(v) for v in asked]), np.array([len(v) for v in rows])
    for size in set(a_sizes.tolist()) & set(b_sizes.tolist()) - {0}:
        qi, pi = np.flatnonzero(a_sizes == size), np.flatnonzero(b_sizes == size)
        a, b = np.stack([asked[i] for i in qi]), np.stack([rows[i] for i in pi])
        with np.errstate(all="ignore"):
            a, b = a / np.sqrt((a * a).sum(axis=1))[:, None], b / np.sqrt((b * b).sum(axis=1))[:, None]
            units = (a @ b.T) * 10.0**PLACES
            units += 0.5
            near = np.floor(units)
            gap = units - near
            unsure = (gap < SLACK) | (gap > 1 - SLACK)
        near[np.isnan(units)] = NAN
        dq, dp = np.nonzero(unsure)
        # a rounded value of the one below, where it is in doubt
        near[dq, dp] -= gap[dq, dp] < SLACK
        doubt_q.append(qi[dq])
        doubt_p.append(pi[dp])
        low[np.ix_(qi, pi)] = near
    # a row is no match of its own id
    left, right = np.searchsorted(ids, asked_ids), np.searchsorted(ids, asked_ids, side="right")
    for r in np.flatnonzero(left < right):
        low[r, left[r] : right[r]] = -np.inf
    width = len(ids)
    key = low * width - np.arange(width)
    if width > k:
        best = np.argpartition(key, width - k, axis=1)[:, width - k :]
    else:
        best = np.broadcast_to(np.arange(width), low.shape)
    q, p = np.repeat(np.arange(len(asked)), best.shape[1]), best.ravel()
    worst = np.take_along_axis(low, best, axis=1).min(axis=1)
    dq, dp = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (doubt_q, doubt_p))
    close = low[dq, dp] + 1 >= worst[dq]
    doubtful = np.zeros(low.shape, bool)
    doubtful[dq, dp] = True
    extra = close & ~np.isin(dq * width + dp, q * width + p)
    q, p = np.concatenate((q, dq[extra])), np.concatenate((p, dp[extra]))
    lower = low[q, p]
    valid = lower > -np.inf
    q, p, lower = q[valid], p[valid], lower[valid]
    return q, p + start, lower, lower + doubtful[q, p]


def cosine_topk(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int, shard_size: int = 32_768, block_size: int = 4_096) -> DataFrame:
    """(q_id, id_col, score, rank): each query row's ``k`` nearest other rows by cosine to six places, ties to the less id.

    Every query meets every row, in cells of about ``shard_size`` rows and ``block_size`` queries, so
    a task's memory is bounded; the pairs are the product of both, by nature. Rows without a cosine
    come last, with a null score.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null")
    total, asking = v.agg(F.count("*"), F.count_if("asks")).first()
    # a table of few bytes still fills two tasks a core
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asking // block_size))
    shards = max(1, -(-total // shard_size), min(-(-tasks // blocks), total // 1024))
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = v.select("id", "v", F.lit(False).alias("asks"), part(shards, 3).alias("shard"), every(blocks).alias("block"))
    asked = v.where("asks").select("id", "v", "asks", every(shards).alias("shard"), part(blocks, 7).alias("block"))

    def cell(key: tuple, group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        ids, rows = group["id"].to_numpy(), _vectors(group["v"])
        q, p = np.flatnonzero(asks), np.flatnonzero(~asks)
        q_ids, found, score = best_of(ids[q], [rows[i] for i in q], ids[p], [rows[i] for i in p], k)
        return pa.table({"q_id": pa.array(q_ids, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score.data, pa.float64(), mask=np.ma.getmaskarray(score), from_pandas=False)})

    cells = held.unionByName(asked).repartition(shards * blocks, "shard", "block")
    found = cells.groupBy("shard", "block").applyInArrow(cell, "q_id long, id long, score double")
    r = ranked(found.withColumn("score", F.round("score", PLACES)), ["q_id"], [F.desc("score"), F.col("id")])
    return r.where(F.col("rank") <= k).select("q_id", F.col("id").alias(id_col), "score", F.col("rank").cast("long").alias("rank"))
