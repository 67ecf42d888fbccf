"""Best-fit packing by minimum bin slack, on the histogram of piece lengths.

Each bin is seeded with the longest piece left; a subset-sum dynamic programme over the lengths left, held as
the bits of one integer, finds the fullest combination that fits beside it, and the combination is removed. Pieces of one
length are alike, so the combination is taken as many times as the counts allow before the next one is sought. What
the driver sees are at most `capacity` counts, however many documents there are. Every piece then finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallforge.llm.common import cut, pieces
from recallforge.llm.tokenize import encoder

CAPACITY, END = 1024, 2


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths (with repeats, never more than counts has) whose sum is the largest that is at most room."""
    full, seen = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, copies taken together, sums reachable before
    for length in sorted((k for k in counts if k <= room and counts[k] > 0), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not seen >> room & 1:
            take = min(take, left)
            steps.append((length, take, seen))
            seen |= (seen << length * take) & full
            left -= take
            take *= 2
        if seen >> room & 1:
            break
    at, out = seen.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        bin_ = [top, *fullest(rest, capacity - top)]
        need = {k: bin_.count(k) for k in bin_}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((bin_, times))
    return out


def slots(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each place in each kind of bin: the ranks [low, high) of its length that go there, first bin and offset."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for bin_, times in bins:
        at = 0
        for k in bin_:
            low = used.get(k, 0)
            rows.append((k, low, low + times, first, at))
            used[k] = low + times
            at += k
        first += times
    return pd.DataFrame(rows, columns=["length", "low", "high", "first", "at"]).sort_values(["length", "low"], ignore_index=True)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every document's ids and the end id, cut into pieces: a document of more than capacity ids has a shorter first piece and full ones after it."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
        with encoder(path, True) as enc:
            for b in pieces(batches, size=4 << 20):
                out = []
                for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()])):
                    ids += tail
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    at = 0
                    for k in range(-(-n // capacity)):
                        to = first + k * capacity
                        out.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), task, int(ranks[to - at])))
                        ranks[to - at] += 1
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return body.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs.

    A null or empty text is the end id alone. Repeated rows are packed as often as they stand there; a null doc_id
    is kept. Only doc_id and text are read. Pieces of equal length are ranked by input partition and place, so the same files give the same
    result. An empty table gives an empty table.
    """
    held = cut(cut_pieces(docs, path, capacity, end), "pieces")
    # Rank of a piece among those of its length: its rank in its own task, plus what the tasks before it have.
    per_task = held.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    counts = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    place = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = place.value
        span = int(p["high"].max()) + 1 if len(p) else 1
        edge = p["length"].to_numpy(np.int64) * span + p["low"].to_numpy(np.int64)
        low, first, at = (p[c].to_numpy(np.int64) for c in ("low", "first", "at"))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(edge, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first[i] + rank - low[i]), pa.array(at[i])], [*b.schema.names[:5], "sequence_id", "offset"])

    # The bases grow with the number of tasks, so they are shuffled, by (task, length), and never broadcast.
    ranked = held.join(base.select("task", "length", "base").hint("shuffle_hash"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
