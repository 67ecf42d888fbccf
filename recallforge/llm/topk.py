"""Exact top-k by inner product: norm-sorted candidates, partial sums in an SVD basis, Cauchy-Schwarz bounds.

Candidates are sorted by descending length, written once, and read in waves: first the longest few thousand, then ever larger parts. Queries go in
groups of bounded size, broadcast to every wave with the score that each must reach, its k-th best so far. A wave whose greatest length
cannot bring any query of the group that far ends the group's search. Inside a task the thresholds tighten from slice to slice: a query skips a slice by the
product of lengths; the inner product over the first HEAD coordinates of the rotated vectors, plus the product of the
lengths of the rest, bounds the score from above; the pairs whose bound reaches the threshold get their exact score, in integers. A
task returns at most k rows a query. Candidates are shuffled once, by the sort, and never copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallforge.llm import vectors
from recallforge.llm.common import cut, hash_below, scratch

K, SCALE, EVERY = 5, 256, 50
#: Rows of a block (a partition of the sorted table), bytes of the queries of a group, rotated coordinates, rows for the rotation, candidates taken at once.
BLOCK, GROUP, HEAD, SAMPLE, SLICE = 8192, 16 << 20, 24, 4096, 1024
_EXACT = float(1 << 53)
#: Stands for a null vec_id, behind every other in ties.
NO_ID = (1 << 63) - 1


def integers(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, the vector floor(scale * x) as doubles, and its length, of each row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, np.floor(scale * v)) for i, v in enumerate(vectors.rows(b.column("embedding"))) if v is not None]
            got = [(i, v) for i, v in got if np.isfinite(v).all()]
            yield pa.record_batch({"vec_id": b.column("vec_id").take(pa.array([i for i, _ in got], pa.int64())), "v": pa.array([v.astype("<f8").tobytes() for _, v in got], pa.binary()), "length": pa.array([float(np.linalg.norm(v)) for _, v in got], pa.float64())})

    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary, length double")


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where every partial sum is below 2^53, else in Python integers cut to 64 bits."""
    if np.linalg.norm(x, axis=-1).max(initial=0) * np.linalg.norm(y, axis=-1).max(initial=0) < _EXACT / 4:
        return (x * y).sum(-1).astype(np.int64)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(p) * int(q) for p, q in zip(a, b)))) for a, b in zip(x, y)], np.int64)


def _best(query: np.ndarray, score: np.ndarray, tie: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of each query, by query and descending score; ties to the smaller id, then to the smaller row."""
    order = np.lexsort((row, tie, ~score, query))  # ~score falls as score grows, over all 64 bits
    q = query[order]
    first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]


def _below(worst: np.ndarray) -> np.ndarray:
    """A threshold that every score of at least `worst` reaches, though it is a float."""
    got = worst.astype(float)
    return np.where(worst == -(1 << 63), -np.inf, got - 0.5 - 1e-15 * np.abs(got))


class Group:
    """Queries of a bounded number: numbers, integer vectors, rotated vectors and the score that each must reach."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, v: np.ndarray, floor: np.ndarray, basis: np.ndarray, k: int):
        self.row, self.ids, self.v, self.floor, self.basis, self.k = row, ids, v, floor, basis, k
        self.length = np.linalg.norm(v, axis=1)
        turned = v @ basis
        self.head, self.rest = turned[:, :HEAD], np.linalg.norm(turned[:, HEAD:], axis=1)

    def reaching(self, length: float) -> np.ndarray:
        """Which queries a candidate of this length may still bring to their threshold."""
        return np.flatnonzero(~(self.length * length * (1 + 1e-9) + 1 < self.floor))  # what is no number passes

    def only(self, some: np.ndarray) -> Group:
        return Group(self.row[some], self.ids[some], self.v[some], self.floor[some], self.basis, self.k)


class Best:
    """The k best candidates so far of each query of a group, in one task."""

    def __init__(self, group: Group):
        self.group, self.floor = group, group.floor.copy()
        self.query = self.score = self.tie = self.row = np.zeros(0, np.int64)

    def add(self, c: np.ndarray, row: np.ndarray, tie: np.ndarray) -> None:
        """Candidates c (integer vectors, any order) with their numbers and ids."""
        g, k = self.group, self.group.k
        length = np.linalg.norm(c, axis=1)
        able = np.flatnonzero(~(g.length * length.max(initial=0) * (1 + 1e-9) + 1 < self.floor))
        turned = c @ g.basis
        head, rest = turned[:, :HEAD], np.linalg.norm(turned[:, HEAD:], axis=1)
        for at in range(0, len(able), 256):
            s = able[at : at + 256]
            bound = g.head[s] @ head.T + np.outer(g.rest[s], rest) + 1e-9 * np.outer(g.length[s], length) + 1
            i, j = np.nonzero(~(bound < self.floor[s, None]) & (g.row[s, None] != row[None]))
            if not len(i):
                continue
            if len(i) > 0.02 * bound.size and g.length[s].max() * length.max() < _EXACT / 4:
                score = np.rint(g.v[s] @ c.T).astype(np.int64)[i, j]  # every sum is below 2^53, so exact
            else:
                score = np.concatenate([exact(g.v[s[i[a : a + 65536]]], c[j[a : a + 65536]]) for a in range(0, len(i), 65536)])
            i = s[i]
            good = score >= self.floor[i]
            i, j, score = i[good], j[good], score[good]
            keep = _best(i, score, tie[j], row[j], k)
            i, j, score = i[keep], j[keep], score[keep]
            both = [np.concatenate(x) for x in ((self.query, i), (self.score, score), (self.tie, tie[j]), (self.row, row[j]))]
            keep = _best(*both, k)
            self.query, self.score, self.tie, self.row = (x[keep] for x in both)
            full = np.bincount(self.query, minlength=len(self.floor))[s] == k
            worst = self.score[np.searchsorted(self.query, s[full], side="right") - 1]
            self.floor[s[full]] = np.maximum(self.floor[s[full]], _below(worst))

    def batch(self) -> pa.RecordBatch:
        columns = {"q_row": self.group.row[self.query], "query_id": self.group.ids[self.query], "row": self.row, "score": self.score, "tie": self.tie}
        return pa.record_batch({name: pa.array(x, pa.int64()) for name, x in columns.items()})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "tie", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(wave: DataFrame, group: Group) -> DataFrame:
    """At most k rows (q_row, query_id, row, score, tie) of a wave for each query of the group."""
    held, width = wave.sparkSession.sparkContext.broadcast(group), len(group.basis)  # bounded by GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                c = vectors.stacked(b.column("v").to_pylist())
                best.add(np.pad(c, ((0, 0), (0, width - c.shape[1]))), b.column("row").to_numpy(), b.column("tie").to_numpy())
        yield best.batch()

    return _ranked(wave.select("row", "tie", "v").mapInArrow(run, FOUND), group.k).drop("rank")


FOUND = "q_row long, query_id long, row long, score long, tie long"


def top(table: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by `every`, its k best among all other rows.

    Vectors that are null or hold null or non-finite components take no part. Vectors of different length are multiplied as if the shorter one
    ended in zeros. Ties go to the smaller vec_id, null last. A repeated row is a candidate for its double, and both are queries. A score
    beyond 64 bits is cut to their range. An empty table gives an empty table.
    """
    spark = table.sparkSession
    rows = integers(table, scale).withColumn("tie", F.coalesce("vec_id", F.lit(NO_ID))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows, "integers")
    stats = rows.agg(F.count("*"), F.max(F.octet_length("v")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not stats[0] or not stats[1] or not stats[2]:
        return spark.createDataFrame([], out)
    total, width = stats[0], stats[1] // 8
    # The rotation only makes bounds tighter, so a bounded sample of vectors is enough for it.
    some = rows.where(hash_below(F.lit(SAMPLE / total), "row")).select("v").collect()
    x = vectors.stacked([bytes(r.v) for r in some]) if some else np.zeros((0, width))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    basis = np.linalg.svd(x / max(1.0, np.abs(x).max(initial=0)), full_matrices=True)[2].T if len(x) else np.eye(width)

    # Blocks by descending length: the ends of the ranges come from Spark's range partitioning. Wave w holds the blocks from 8^(w-1) to 8^w - 1.
    blocks = -(-total // BLOCK)
    wave = F.ceil(F.log(8.0, F.spark_partition_id() + 1.0) - 1e-9).cast("int")
    path = scratch(spark, "sorted")
    spread = rows.repartitionByRange(blocks, F.desc("length"), "row").withColumn("wave", wave)
    spread.sortWithinPartitions("wave", F.desc("length")).write.partitionBy("wave").parquet(path)
    sorted_ = spark.read.schema("vec_id long, v binary, length double, tie long, row long, wave int").parquet(path)
    longest = {r.wave: r.m for r in sorted_.groupBy("wave").agg(F.max("length").alias("m")).collect()}  # a row for each power of 8
    # Queries in groups whose vectors hold about GROUP bytes.
    groups = max(1, -(-stats[2] * width * 8 // GROUP))
    asked = scratch(spark, "queries")
    rows.where(F.col("vec_id") % every == 0).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).write.partitionBy("part").parquet(asked)
    asked = spark.read.schema("vec_id long, v binary, length double, tie long, row long, part int").parquet(asked)

    path = scratch(spark, "found")
    for part in range(groups):
        q = asked.where(F.col("part") == part).select("row", "vec_id", "v").toArrow()  # a group
        if not q.num_rows:
            continue
        v = vectors.stacked(q.column("v").to_pylist())
        group = Group(q.column("row").to_numpy(), q.column("vec_id").to_numpy(), np.pad(v, ((0, 0), (0, width - v.shape[1]))), np.full(q.num_rows, -np.inf), basis, k)
        place = np.argsort(group.row)
        query = score = np.zeros(0, np.int64)
        for w in sorted(longest):
            now = group.reaching(longest[w])
            if not len(now):
                break  # and no shorter vector can
            here = f"{path}/found-{part}-{w}"
            _search(sorted_.where(F.col("wave") == w), group.only(now)).write.parquet(here)
            got = spark.read.schema(FOUND).parquet(here).select("q_row", "score").toArrow()  # at most k rows a query of the group
            query = np.concatenate((query, place[np.searchsorted(group.row[place], got.column("q_row").to_numpy())]))
            score = np.concatenate((score, got.column("score").to_numpy()))
            keep = _best(query, score, np.zeros(len(query), np.int64), np.arange(len(query)), k)
            query, score = query[keep], score[keep]
            full = np.flatnonzero(np.bincount(query, minlength=len(group.floor)) == k)
            group.floor[full] = _below(score[np.searchsorted(query, full, side="right") - 1])
    best = _ranked(spark.read.schema(FOUND).parquet(f"{path}/found-*"), k)
    return best.select("query_id", F.col("rank").cast("int"), F.nullif(F.col("tie"), F.lit(NO_ID)).alias("vec_id"), "score")
