"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

The index is a Parquet table with a row for each term of a segment; a segment is a run of documents
with bounded numbers of documents and postings. A term's postings are cut into blocks of ``BLOCK``;
beside each compressed block stand its last document and its largest impact. A query over a segment
ends at once if the sum of its lists' maxima stays below the worst of the best ``k`` scores so far.
Else shallow moves, which read block ends and block maxima only, give every document the sum of the
maxima of the blocks that would hold it; lists of a single block are open from the start and count
by what they hold. Documents whose sum reaches the threshold are the pivots. They are scored from the
largest sum downwards, the threshold rises with them, and only blocks that hold one are ever
decompressed. Thresholds from a share of the segments are the starting ones of all others. Nothing
is approximated: what reaches the threshold is scored exactly.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.store import BROADCAST_BYTES, saved

BLOCK = 128
#: Postings and documents of a segment; they bound the memory of the task that builds or searches it.
SEGMENT, DOCUMENTS = 2_000_000, 16_384
#: Queries that one task answers over one segment.
QUERIES = 256
#: One of so many segments sets the first thresholds.
SEED_SHARE = 16
#: Rows of an Arrow batch of the index.
BATCH = 20_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes: A-Z become a-z, what parts terms becomes a space, and everything beyond ASCII stays.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("lasts", pa.binary()), ("tops", pa.binary()), ("starts", pa.binary()), ("payload", pa.binary())])
INDEX_DDL = "segment long, term binary, df long, lasts binary, tops binary, starts binary, payload binary"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def impact(tf, m):
    """The part of a score that depends on the document alone."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _slices(data: np.ndarray, width: int, bounds: np.ndarray) -> pa.Array:
    """A binary column whose values are consecutive pieces of ``data``."""
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def compress(gaps: np.ndarray, tfs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all blocks, which begin at postings ``first``, and where each starts.

    A block is a byte with two widths, its gaps in that many bytes each, then its counts (no bytes if
    all are one).
    """
    size = np.diff(np.append(first, len(gaps)))
    width = lambda top: np.where(top < 256, 1, np.where(top < 65536, 2, 4))
    wide = width(np.maximum.reduceat(gaps, first))
    most = np.maximum.reduceat(tfs, first)
    deep = np.where(most == 1, 0, width(most))
    starts = np.concatenate(([0], np.cumsum(1 + size * (wide + deep))))
    out = np.zeros(starts[-1], np.uint8)
    out[starts[:-1]] = wide | deep << 4
    block = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(gaps)) - first[block]
    for values, widths, base in ((gaps, wide, starts[:-1] + 1), (tfs, deep, starts[:-1] + 1 + size * wide)):
        for w in (1, 2, 4):
            chosen = np.flatnonzero(widths[block] == w)
            place = base[block[chosen]] + at[chosen] * w
            for byte in range(w):
                out[place + byte] = (values[chosen] >> 8 * byte) & 255
    return out, starts


def decompress(payload: bytes, start: int, end: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of the block at ``start`` to ``end``; ``before`` is the last document ahead of it."""
    wide, deep = payload[start] & 15, payload[start] >> 4
    n = (end - start - 1) // (wide + deep)
    gaps = np.frombuffer(payload, f"<u{wide}", n, start + 1)
    tfs = np.frombuffer(payload, f"<u{deep}", n, start + 1 + n * wide).astype(np.int64) if deep else np.ones(n, np.int64)
    return np.cumsum(gaps, dtype=np.int64) + before, tfs


class Segment:
    """The postings of some documents, until they are written."""

    def __init__(self):
        self.vocabulary = defaultdict(itertools.count().__next__)
        self.ids, self.tfs, self.keys, self.lengths, self.size = [], [], [], [], 0

    def add(self, key: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        self.ids.append(np.fromiter(map(self.vocabulary.__getitem__, counts), np.int64, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.keys.append(key)
        self.lengths.append(len(words))
        self.size += len(counts)

    def batches(self, number: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """A row with the documents (term null), then the terms in order."""
        lengths = np.array(self.lengths, np.int64)
        keys = b"".join((-(1 << 63) if k is None else k).to_bytes(8, "little", signed=True) for k in self.keys)
        m = 50 + (50 * lengths * n_docs) // n_terms
        yield pa.RecordBatch.from_pydict({"segment": [number], "term": [None], "df": [len(lengths)], "lasts": [m.astype("<u8").tobytes()], "tops": [b""], "starts": [b""], "payload": [keys]}, schema=INDEX)
        terms = sorted(self.vocabulary)
        rank = np.empty(len(terms), np.int64)
        rank[np.fromiter((self.vocabulary[t] for t in terms), np.int64, len(terms))] = np.arange(len(terms))
        doc = np.repeat(np.arange(len(lengths)), [len(x) for x in self.ids])
        order = np.argsort(rank[np.concatenate(self.ids)] * len(lengths) + doc)
        term, doc, tf = rank[np.concatenate(self.ids)][order], doc[order], np.concatenate(self.tfs)[order]
        begins = np.append(np.searchsorted(term, np.arange(len(terms))), len(term))
        df = np.diff(begins)
        at = np.arange(len(term)) - begins[term]
        first = np.flatnonzero(at % BLOCK == 0)
        gaps = np.where(at == 0, doc + 1, doc - np.concatenate(([0], doc[:-1])))
        data, starts = compress(gaps, tf, first)
        tops = np.maximum.reduceat(impact(tf, m[doc]), first).astype("<u4")
        lasts = doc[np.append(first[1:], len(doc)) - 1].astype("<u4")
        blocks = np.concatenate(([0], np.cumsum(-(-df // BLOCK))))
        owner = np.repeat(np.arange(len(terms)), np.diff(blocks))
        relative = (starts[:-1] - starts[blocks[owner]]).astype("<u4")
        columns = [pa.array(np.full(len(terms), number)), pa.array(terms, pa.binary()), pa.array(df)]
        columns += [_slices(x, 4, blocks) for x in (lasts, tops, relative)] + [_slices(data, 1, starts[blocks])]
        table = pa.Table.from_arrays(columns, schema=INDEX)
        yield from table.to_batches(max_chunksize=BATCH)


@dataclass
class Index:
    """A written index with the corpus figures it was made with."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index all texts. Two passes over the table: the corpus figures, then the postings.

    A null text has no terms, nor has one without a letter, digit or character beyond ASCII; neither
    takes part. Rows of one key are documents of their own. An empty table gives an empty index.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    n = F.regexp_count("text", F.lit(TERM))
    figures = rows.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = figures.docs, figures.terms

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, segment = itertools.count(TaskContext.get().partitionId() << 32), Segment()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := terms_of(t.as_py() or ""):
                    segment.add(k, words)
                    if segment.size >= SEGMENT or len(segment.keys) >= DOCUMENTS:
                        yield from segment.batches(next(number), n_docs, n_terms)
                        segment = Segment()
        if segment.size:
            yield from segment.batches(next(number), n_docs, n_terms)

    return Index(saved(rows.mapInArrow(write, INDEX_DDL), "postings"), n_docs, n_terms)


class Postings:
    """One list of a segment: block ends and maxima in the open, blocks decompressed when asked for."""

    def __init__(self, lasts: bytes, tops: bytes, starts: bytes, payload: bytes, m: np.ndarray):
        self.lasts = np.frombuffer(lasts, "<u4").astype(np.int64)
        self.tops = np.frombuffer(tops, "<u4").astype(np.int64)
        self.starts = np.append(np.frombuffer(starts, "<u4"), len(payload)).astype(np.int64)
        self.payload, self.m, self.top = payload, m, int(self.tops.max())
        self.closed, self.impacts = np.ones(len(self.lasts), bool), None
        self.single = self.block(0) if len(self.lasts) == 1 else None

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts."""
        self.closed[b] = False
        docs, tfs = decompress(self.payload, int(self.starts[b]), int(self.starts[b + 1]), int(self.lasts[b - 1]) if b else -1)
        return docs, impact(tfs, self.m[docs])

    def bounds(self) -> np.ndarray:
        """Up to the last document, the maximum of the block in which each would be."""
        return np.repeat(self.tops, np.diff(self.lasts, prepend=-1))

    def exact(self, docs: np.ndarray) -> np.ndarray:
        """Impacts of documents; the blocks that would hold them are opened."""
        if self.impacts is None:
            self.impacts = np.zeros(len(self.m), np.int32)
        if self.closed.any():
            wanted = np.zeros(len(self.lasts) + 1, bool)
            wanted[np.searchsorted(self.lasts, docs)] = True
            for b in np.flatnonzero(wanted[:-1] & self.closed).tolist():
                held, values = self.block(b)
                self.impacts[held] = values
        return self.impacts[docs]


def best(lists: list[tuple[int, Postings]], keys: np.ndarray, k: int, floor: int = 0) -> list[tuple[int, int]]:
    """Ordinals and scores of the ``k`` best documents of a segment, of those that reach ``floor``.

    Equal scores go by key. ``lists`` are pairs of weight and postings; scores are above zero.
    """
    lists, need = [x for x in lists if x[0] > 0], max(floor, 1)
    if sum(w * p.top for w, p in lists) < need:
        return []
    sure = np.zeros(len(keys), np.int64)
    for w, p in lists:
        if p.single:
            sure[p.single[0]] += w * p.single[1]
    several = [(w, p) for w, p in lists if not p.single]
    upper = sure.copy()
    for w, p in several:
        upper[: p.lasts[-1] + 1] += w * p.bounds()
    pivots = np.flatnonzero(upper >= need)
    pivots = pivots[np.argsort(-upper[pivots], kind="stable")]
    found, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, BLOCK
    while at < len(pivots) and upper[pivots[at]] >= need:
        docs = pivots[at : at + step]
        docs = docs[upper[docs] >= need]
        total = sure[docs]
        for w, p in several:
            total = total + w * p.exact(docs).astype(np.int64)
        kept = total >= need
        found, scores = np.concatenate((found, docs[kept])), np.concatenate((scores, total[kept]))
        top = np.lexsort((keys[found], -scores))[:k]
        found, scores = found[top], scores[top]
        if len(found) == k:
            need = max(need, int(scores[-1]))
        at, step = at + step, 4 * step
    return list(zip(found.tolist(), scores.tolist(), strict=True))


FOUND_DDL = "query long, key long, score long"


def _searched(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """All queries of a block over one segment."""
        base = group[group.term.isna()].iloc[0]
        keys, m = np.frombuffer(base.payload, "<i8"), np.frombuffer(base.lasts, "<u8").astype(np.int64)
        floors, lists = {x["query"]: x["value"] for x in base["queries"]}, defaultdict(list)
        for row in group[group.term.notna()].itertuples():
            postings = Postings(row.lasts, row.tops, row.starts, row.payload, m)
            for x in row.queries:
                lists[x["query"]].append((x["value"], postings))
        out = [(q, int(keys[d]), s) for q, mine in lists.items() for d, s in best(mine, keys, k, floors[q])]
        frame = pd.DataFrame(out, columns=["query", "key", "score"])
        return frame.astype({"query": "int64", "key": "int64", "score": "int64"})

    return run


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], width: int) -> DataFrame:
    """Join with a side that is broadcast only if its counted rows are light enough."""
    return left.join(F.broadcast(right) if right.count() * width <= BROADCAST_BYTES else right, on)


def folded(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0)


def search(index: Index, queries: DataFrame, k: int = 50, key: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of every query: its columns, rank, key (the document's) and score.

    Only scores above zero count; equal scores go by ascending key, a null key first. Each row of
    ``queries`` is a query, repeated ones too; one without terms, or with a null text, finds nothing.
    """
    spark = queries.sparkSession
    # ids of our own, kept by writing them once
    asked = saved(queries.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text")).withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    wanted = saved(asked.select("query", block, F.explode(F.array_distinct(folded(F.col("text")))).alias("term")).withColumn("term", F.col("term").cast("binary")), "wanted")
    hits = saved(_joined(index.postings.where("term is not null"), wanted.select("term").distinct(), "term", 64), "hits")
    n = float(2 * index.n_docs + 2)
    weight = F.floor(1000 * F.log(F.lit(n) / (2 * F.sum("df") + 1).cast("double")))
    weights = hits.groupBy("term").agg(weight.alias("value"))
    asks = saved(wanted.join(weights, "term").groupBy("block", "term").agg(F.collect_list(F.struct("query", "value")).alias("queries")), "asks")
    bases = index.postings.where("term is null")
    starting = wanted.select("query", "block").distinct()

    def round_over(which: Column, floors: DataFrame) -> DataFrame:
        """Search the segments ``which`` names, each query from its floor."""
        lead = floors.groupBy("block").agg(F.collect_list(F.struct("query", "value")).alias("queries"))
        rows = _joined(hits.where(which), asks, "term", 64 + 16 * QUERIES)
        # every block meets every segment: its documents come with the block's queries
        heads = bases.where(which).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(lead, "block")
        both = rows.unionByName(heads.select(*rows.columns))
        return saved(both.groupBy("segment", "block").applyInPandas(_searched(k), FOUND_DDL), "found")

    early = F.pmod(F.xxhash64("segment"), F.lit(SEED_SHARE)) == 0
    nothing = F.lit(0).cast("long")
    found = round_over(early, starting.withColumn("value", nothing))
    # the k-th best of some documents is a threshold for all
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    kth = found.withColumn("place", order).where(F.col("place") <= k).where(F.col("place") == k).select("query", F.col("score").alias("reached"))
    floors = starting.join(kth, "query", "left").withColumn("value", F.coalesce("reached", nothing)).drop("reached")
    found = found.unionByName(round_over(~early, floors))
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    real = F.when(F.col("key") != -(1 << 63), F.col("key"))
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item"), "query").select(F.col("item").alias(key), "rank", real.alias("key"), "score")
