"""SimHash fingerprints and exact linking of near copies by tiled comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.components import connected_components
from quarrylight.llm.store import saved

SPACE = b" \t\n\x0b\x0c\r"
UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCKS, BLOCK_BITS = 4, 16
BROADCAST_ROWS = 2_000_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode().translate(UPPER_TO_LOWER).split()
    # bytes.split() parts at exactly the six ASCII white-space bytes of the contract
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # a long text's bits are counted in pieces
        part = hashes[at : at + 65536]
        set_bits += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint's bits as a signed long. Null text: no words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def _cell(fp: Column) -> Column:
    """The population counts of the four 16-bit blocks, five bits each."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, BLOCK_BITS * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(BLOCKS)]
    return sum((F.shiftleft(c, 5 * k) for k, c in enumerate(counts[1:], 1)), counts[0])


def _steps(radius: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite block-count differences within the radius, and no difference."""
    within = [d for d in itertools.product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, d)) <= radius]
    return [d for d in within if d >= (0,) * BLOCKS]


def _span(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each touched node below n to its component's least node: a spanning forest of stars."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            moved = np.flatnonzero(root != np.arange(n))
            return moved, root[moved]


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of unsigned fingerprints that join what all pairs within the radius join.

    Compares every pair by exclusive or and bit count, block by block. Where a block has more links
    than fingerprints, only a spanning forest of it is kept, so the output stays linear in the tiles.
    """
    both = np.concatenate((x, y))
    left, right = [], []
    for at in range(0, len(x), rows):
        i, j = np.nonzero(np.bitwise_count(x[at : at + rows, None] ^ y[None, :]) <= radius)
        i, j = i + at, j + len(x)
        if len(i) > len(y):
            i, j = _span(i, j, len(both))
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if len(i) > len(both):
        i, j = _span(i, j, len(both))
    return both[i], both[j]


def near_links(fps: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits.

    Fingerprints are tiled by the population counts of their four 16-bit blocks. Two fingerprints
    within the radius have block counts that differ by at most the radius in sum, so tile pairs
    further apart are skipped and the rest is compared exactly. A crowded cell is split into tiles
    of about ``tile`` fingerprints; the cell counts that steer this are at most 17^4 rows.
    """
    cells = fps.select("fp", _cell(F.col("fp")).alias("cell"))
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = (
        cells.join(F.broadcast(parts), "cell")
        .withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = saved(tiles, "tiles")
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{k}") for k, v in enumerate(d)], F.lit(sum(v << (5 * k) for k, v in enumerate(d))).alias("step")) for d in _steps(radius)])
    left = tiles.withColumn("d", F.explode(steps))
    count = [F.shiftright(F.col("cell"), 5 * k).bitwiseAND(31) + F.col(f"d.d{k}") for k in range(BLOCKS)]
    left = left.where(" and ".join("true" for _ in count)).where(
        F.forall(F.array(*count), lambda c: c.between(0, BLOCK_BITS))
    ).select("cell", "part", "fps", (F.col("cell") + F.col("d.step")).alias("to"))
    right = tiles.select(F.col("cell").alias("to"), F.col("part").alias("to_part"), F.col("fps").alias("to_fps"))
    pairs = left.join(right, "to").where("cell <> to or part <= to_part").select("fps", "to_fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(k).values.to_numpy().view(np.uint64) for k in (0, 1)]
            offsets = [batch.column(k).offsets.to_numpy() for k in (0, 1)]
            out = [close_pairs(*(values[k][offsets[k][r] : offsets[k][r + 1]] for k in (0, 1)), radius) for r in range(batch.num_rows)]
            a, b = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
            apart = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint every row and label it with the least id that near-copy links reach.

    Returns (id_col, fingerprint as 16 hex digits, component_id), one row per input row. Words are
    split at ASCII white space after lower-casing A-Z; shingles of ``width`` words count with their
    repeats; a text of fewer words is one shingle; a text that is null or has no word gets
    fingerprint zero, which links like any other. Repeated rows and equal fingerprints share a
    component. A null id keeps its row and is no component's least id unless it is the only one.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    fps = saved(fingerprints(docs, id_col, text_col, width), "fingerprints")
    placed = _rooted(fps, radius)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root, least): the component of each distinct fingerprint, and its least ``id``."""
    distinct = saved(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = connected_components(near_links(distinct.select("fp"), radius))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, one for each component: that of least id, then text hash.

    Of rows that repeat id and text, one stays. The rows to go are broadcast while they are few.
    """
    keyed = docs.withColumn(text_col, F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text")))
    named = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row")).alias("key"), F.col(text_col).alias("text"))
    fps = saved(fingerprints(named, "key", "text", width), "fingerprints")
    placed = _rooted(fps, radius)
    least = placed.groupBy("root").agg(F.min("least").alias("kept"))
    by_fp = placed.join(least, "root").select("fp", "kept")
    gone = saved(fps.join(by_fp, "fp").where("not id <=> kept").select("id.row").distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    left = keyed.join(few, keyed[text_col]["row"] == few["row"], "left_anti")
    left = left.withColumn(text_col, F.col(f"{text_col}.text")).select(*docs.columns)
    again = fps.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return left if again.isEmpty() else left.dropDuplicates([id_col, text_col])
