"""Packing documents into fixed-size token sequences by a linear grouping scheme."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.store import saved
from quarrylight.llm.tokens import token_ids

#: A run: the lengths side by side in a sequence, and how many sequences look so.
Run = tuple[tuple[int, ...], int]


def _groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, dealt into groups of equal cardinality: [(length, count)] each."""
    total = sum(counts.values())
    target = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = target
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = target
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return [g for g in out if g]


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for g in np.argsort(-sizes):
        size, value = int(sizes[g]), values[g]
        if value <= 0:
            continue
        for at in range(size, capacity + 1, size):
            to = min(at + size, capacity + 1)
            with_it = best[at - size : to - size] + value
            better = with_it > best[at:to] + 1e-12
            best[at:to][better] = with_it[better]
            last[at:to][better] = g
    config, room = np.zeros(len(sizes)), capacity
    while last[room] >= 0:
        config[last[room]] += 1
        room -= int(sizes[last[room]])
    return best[capacity], config


def configurations(sizes: np.ndarray, demands: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """The linear programme over configurations of few sizes, by column generation."""
    basis = np.diag((capacity // sizes).astype(float))
    amounts = demands / np.diag(basis)
    for _ in range(40 * len(sizes) + 100):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, config = _best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, config)
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(np.argmin(ratios))
        step = max(0.0, ratios[leaving])
        amounts = np.maximum(0, amounts - step * direction)
        amounts[leaving] = step
        basis[:, leaving] = config
    return [(basis[:, k], amounts[k]) for k in range(len(sizes))]


def _take(stock: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The next n lengths of a group, as runs, off its stock (kept last first)."""
    out = []
    while n:
        length, count = stock.pop()
        used = min(n, count)
        if used < count:
            stock.append((length, count - used))
        out.append((length, used))
        n -= used
    return out


def _side_by_side(slots: list[list[tuple[int, int]]]) -> list[Run]:
    """Slots of equally many lengths, cut where any of them changes length."""
    ends = [np.cumsum([count for _, count in slot]) for slot in slots]
    cuts = np.unique(np.concatenate(ends))
    runs, start = [], 0
    for cut in cuts.tolist():
        runs.append((tuple(slot[int(np.searchsorted(end, start, side="right"))][0] for slot, end in zip(slots, ends, strict=True)), cut - start))
        start = cut
    return runs


def best_fit(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing of lengths into the runs' free room and, where none fits, new sequences.

    Works on counts: whole runs of like sequences take one document each at a time.
    """
    by_room: dict[int, list[Run]] = {}
    for lengths, n in runs:
        by_room.setdefault(capacity - sum(lengths), []).append((lengths, n))
    rooms = sorted(by_room)

    def put(room: int, run: Run) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(run)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, ((length,) * each, left // each))
                if left % each:
                    put(capacity - left % each * length, ((length,) * (left % each), 1))
                break
            room = rooms[at]
            lengths, n = by_room[room].pop()
            # as many of this length as fit, for they would go there one after the other
            each = min(room // length, max(1, left // n))
            used = min(n, left // each)
            if used < n:
                by_room[room].append((lengths, n - used))
            if not by_room[room]:
                del by_room[room]
                del rooms[at]
            put(room - each * length, (lengths + (length,) * each, used))
            left -= used * each
    return [run for runs in by_room.values() for run in runs]


def packing_plan(counts: dict[int, int], capacity: int = 2048, shares: tuple[float, ...] = (0.3, 0.125, 0.5), groups: int = 64) -> list[Run]:
    """How to fill sequences of ``capacity`` from ``counts`` (length -> pieces), in few sequences.

    Linear grouping, tried with each of ``shares`` of the capacity as the bound between small and
    large lengths; the plan with the fewest sequences wins, and none is tried after one that meets
    the bound by total length. Works on the histogram alone, so its cost depends on the capacity
    and not on the number of documents.
    """
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best: list[Run] | None = None
    for share in shares:
        plan = linear_grouping(counts, capacity, int(share * capacity), groups)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        if sum(n for _, n in best) <= least:
            break
    return best or []


def linear_grouping(counts: dict[int, int], capacity: int, small: int, groups: int) -> list[Run]:
    """Lengths over ``small`` fall into ``groups`` groups of equal cardinality and count as the
    longest of their group; the linear programme over configurations of these few sizes is solved
    and rounded down; actual lengths take the places of the rounded ones; what the rounding left,
    and then the small lengths, go in by best fit.
    """
    full = counts.get(capacity, 0)
    large = {n: c for n, c in counts.items() if small < n < capacity}
    runs: list[Run] = [((capacity,), full)] if full else []
    rest = {n: c for n, c in counts.items() if n <= small}
    if large:
        grouped = _groups(large, groups)
        sizes = np.array([g[0][0] for g in grouped])
        demands = np.array([sum(c for _, c in g) for g in grouped])
        kinds, of = np.unique(sizes, return_inverse=True)  # neighbours can round up to the same size
        stocks: list[list[tuple[int, int]]] = [[] for _ in kinds]
        for g, k in zip(reversed(grouped), of[::-1], strict=True):
            stocks[k] += g[::-1]
        wanted = np.bincount(of, demands).astype(np.int64)
        for config, amount in configurations(kinds, wanted.astype(float), capacity):
            n = int(amount + 1e-6)
            held = [sum(c for _, c in stock) for stock in stocks]
            n = min([n, *(held[k] // int(config[k]) for k in np.flatnonzero(config))])
            if n > 0:
                runs += _side_by_side([_take(stocks[k], n) for k in np.flatnonzero(config) for _ in range(int(config[k]))])
        for stock in stocks:
            for length, count in stock:
                rest[length] = rest.get(length, 0) + count
    return best_fit(runs, rest, capacity)


def pieces_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text; only texts over the capacity are cut."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at, k = 0, 0
                to = len(ids) % capacity or capacity
                while at < len(ids):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
                    at, to, k = to, to + capacity, k + 1
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def _places(plan: list[Run]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): where pieces go by their rank in the length."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((n, sequence, offset))
            offset += length
        sequence += n
    out = {}
    for length, found in slots.items():
        table = np.array(found, np.int64)
        table[:, 0] = np.cumsum(table[:, 0]) - table[:, 0]
        out[length] = table
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all texts into as few sequences of ``capacity`` tokens as the plan finds.

    Returns per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset. A text's ids
    end with ``end_id``; null and empty texts are that id alone. Only the histogram of lengths, at
    most ``capacity`` rows, comes to the driver, and the plan that goes back is bounded by the
    capacity too. Pieces find their places by their rank within their length; the ranks are counted
    in salted buckets, so a length that a third of all pieces has is no one task's work. Repeated
    rows and ids are packed as often as they occur; null ids are kept; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = saved(pieces_of(docs, id_col, text_col, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(packing_plan(counts, capacity))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(offsets, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, table = np.flatnonzero(length == n), places[int(n)]
                slot = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
                sequence[rows] = table[slot, 1] + rank[rows] - table[slot, 0]
                offset[rows] = table[slot, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = pieces.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
