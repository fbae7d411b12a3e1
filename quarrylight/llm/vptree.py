"""Nearest neighbours by inner product: a vantage-point tree per shard, searched by query blocks."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.store import saved

#: Scores of matrix products may differ from exact ones by so much of the product of norms.
ROUNDING = 1e-11


class VpTree:
    """Vectors of one shard; the largest inner product becomes the least distance.

    A coordinate is added so that all vectors have the shard's largest norm M; the query gets a zero
    there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the triangle inequality holds. Equal vectors
    are one point with the least ``keep`` of their ids, for no more of them can be among the best.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, leaf: int = 128):
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
        ids, vectors = ids[first], vectors[first]  # of rows that share an id, the least vector
        points, of = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        starts = np.searchsorted(of.ravel()[order], np.arange(len(points) + 1))
        self.ids = [ids[order[a : min(b, a + keep)]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.x = points
        norms = np.einsum("ij,ij->i", self.x, self.x)
        self.m2 = float(norms.max()) if len(norms) else 0.0
        self.extra = np.sqrt(np.maximum(0, self.m2 - norms))
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, float, int, int]] = []  # vantage point, radius, inside and outside node
        self.leaves: list[tuple[int, int]] = []
        self.root = self._build(0, len(points), leaf)
        self.ids = [self.ids[k] for k in self.order]
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(rank))
        self.nodes = [(int(rank[v]), r, i, o) for v, r, i, o in self.nodes]
        self.x, self.extra = self.x[self.order], self.extra[self.order]

    def _build(self, start: int, end: int, leaf: int) -> int:
        """Nodes are numbered from 0, leaves from -1 downwards."""
        part = self.order[start:end]
        if len(part) > leaf:
            vantage = int(part[np.argmax(self._between(part, int(part[0])))])
            away = self._between(part, vantage)
            radius = float(np.median(away))
            inside = away <= radius
            if 0 < inside.sum() < len(part):
                self.order[start:end] = np.concatenate((part[inside], part[~inside]))
                middle = start + int(inside.sum())
                at = len(self.nodes)
                self.nodes.append((vantage, radius, 0, 0))
                self.nodes[at] = (vantage, radius, self._build(start, middle, leaf), self._build(middle, end, leaf))
                return at
        self.leaves.append((start, end))
        return -len(self.leaves)

    def _between(self, part: np.ndarray, to: int) -> np.ndarray:
        inner = self.x[part] @ self.x[to] + self.extra[part] * self.extra[to]
        return np.sqrt(np.maximum(0, 2 * self.m2 - 2 * inner))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best here, without its own id; ties go to the smaller id."""
        self.q, self.q2, self.k = queries, np.einsum("ij,ij->i", queries, queries), min(k + 1, max(1, len(self.x)))
        self.slack = ROUNDING * np.sqrt(self.q2 * self.m2)
        self.best = np.full((len(queries), self.k), -np.inf)
        # per visited leaf: query rows, places and scores that may still be among the best
        self.met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(self.x):
            self._visit(self.root, np.arange(len(queries)), factor)
        rows, places, scores = (np.concatenate(x) for x in zip(*self.met, strict=True))
        kept = scores >= self.best[rows, 0] - self.slack[rows]
        rows, places = rows[kept], places[kept]
        order = np.argsort(rows, kind="stable")
        bounds = np.searchsorted(rows[order], np.arange(len(queries) + 1))
        out_rows, ids, out_scores = [], [], []
        for r in range(len(queries)):
            at = places[order[bounds[r] : bounds[r + 1]]]
            exact = (self.x[at] * queries[r]).sum(axis=1)
            each = [self.ids[a] for a in at]
            found = np.concatenate(each) if each else np.zeros(0, np.int64)
            score = np.repeat(exact, [len(e) for e in each])
            other = found != query_ids[r]
            found, score = found[other], score[other]
            top = np.lexsort((found, -score))[:k]
            out_rows.append(np.full(len(top), r))
            ids.append(found[top])
            out_scores.append(score[top])
        return np.concatenate(out_rows), np.concatenate(ids), np.concatenate(out_scores)

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """The distance of the worst candidate kept so far."""
        return np.sqrt(np.maximum(0, self.q2[rows] + self.m2 - 2 * self.best[rows, 0]))

    def _visit(self, node: int, rows: np.ndarray, factor: float) -> None:
        if not len(rows):
            return
        if node < 0:
            start, end = self.leaves[-node - 1]
            scores = self.q[rows] @ self.x[start:end].T
            # the k + 1 best scores so far, the worst first; what ties with it stays among the met
            self.best[rows] = np.sort(np.partition(np.concatenate((self.best[rows], scores), axis=1), -self.k, axis=1)[:, -self.k :], axis=1)
            r, p = np.nonzero(scores >= (self.best[rows, 0] - self.slack[rows])[:, None])
            self.met.append((rows[r], start + p, scores[r, p]))
            return
        vantage, radius, inside, outside = self.nodes[node]
        away = np.sqrt(np.maximum(0, self.q2[rows] + self.m2 - 2 * (self.q[rows] @ self.x[vantage])))
        near = away <= radius
        self._visit(inside, rows[near], factor)
        self._visit(outside, rows[~near], factor)
        # the other side can't be nearer than the gap to the sphere; 1e-6 covers the rounding of distances
        gap = np.abs(away - radius)
        far = gap <= factor * self._reach(rows) + 1e-6 * (1 + np.sqrt(self.q2[rows] + self.m2))
        self._visit(outside, rows[near & far], factor)
        self._visit(inside, rows[~near & far], factor)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, factor: float = 0.5, shard_size: int = 8192, block_size: int = 2048
) -> DataFrame:
    """Each query row's k nearest other rows by inner product: query_id, rank, id_col, score.

    Every usable row is indexed in one of the shards of about ``shard_size`` rows; every query
    meets every shard's tree, in blocks of about ``block_size`` queries. The triangle inequality
    prunes a subtree when its gap exceeds ``factor`` times the reach of the candidates; factor 1 is
    exact search, a smaller one prunes more and may miss neighbours. Scores are inner products of
    the original vectors in double precision; ties go to the smaller id, and within what is searched
    all that tie with the last are compared by id. A visit ships one tree and one block, both of
    bounded size.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id; vectors of another length are apart. Of rows that share an id, the one with the
    least vector takes part. With no more than k candidates, all are returned; an empty table gives
    no rows. Other columns are ignored.
    """
    usable = vectors.where(_usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    total, asking = usable.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-total // shard_size)), max(1, -(-asking // block_size))
    keyed = usable.select("id", "v", "dim", "asks", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))

    def index(key: tuple, group: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        tree = pickle.dumps(VpTree(group["id"].to_numpy(), _matrix(group["v"], dim), k + 1))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "tree": pa.array([tree], pa.binary())})

    def block(key: tuple, group: pa.Table) -> pa.Table:
        dim, number = (x.as_py() for x in key)
        ids, v = group["id"].to_numpy(), _matrix(group["v"], dim)
        order = np.lexsort((*v.T[::-1], ids))
        order = order[np.append(True, np.diff(ids[order]) != 0)]
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([number], pa.int32()), "asked": pa.array([_packed(ids=ids[order], v=v[order])], pa.binary())})

    trees = saved(keyed.groupBy("dim", "shard").applyInArrow(index, "dim int, shard int, tree binary"), "shards")
    asked = keyed.where("asks").groupBy("dim", "block").applyInArrow(block, "dim int, block int, asked binary")
    visits = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, ["dim", "shard"]).select("dim", "shard", "tree", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, tree = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                here = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                if here != built:  # one shard's visits follow each other after the join
                    tree, built = pickle.loads(batch.column(2)[r].as_py()), here
                with np.load(io.BytesIO(batch.column(3)[r].as_py())) as got:
                    queries, q = got["ids"], got["v"]
                rows, ids, scores = tree.search(queries, q, k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(queries[rows]), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

    found = visits.mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
