"""Embedding near-duplicates: Euclidean p-stable hashing of normalised vectors, then exact cosines inside the buckets.

On the unit sphere cosine c is the distance sqrt(2 - 2c), so a cosine threshold is a radius. A hash is floor((g.v + b) / W) with
a Gaussian g; K of them make the key of a table, and vectors that share a key in any of the tables are candidates. K grows with the logarithm of
the number of vectors, so that a vector meets about CROWD unrelated ones (cosine 0) in a bucket, and the number of tables is what finds a pair exactly
at the threshold with probability RECALL; closer pairs are found more surely.

Candidates never travel as pairs. A bucket's vectors meet in one task and are compared as a block, by one matrix product; a bucket of more than
BLOCK vectors is dealt into blocks, and every two blocks meet in a task of their own. A pair counts only in the first table whose key it shares,
which a task finds from the vectors alone, so what leaves it are sums of links and a spanning forest: a row or two for each vector, however many pairs there are.
Equal vectors are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.llm import vectors
from recallforge.llm.common import cut, hot_keys, join_hot
from recallforge.llm.components import components, forest

THRESHOLD, W, RECALL, CROWD, BLOCK, SEED = 0.9, 2.0, 0.98, 1024, 2048, 11
#: A product of unit vectors is that near to their cosine; nearer to the threshold the cosine is taken by itself.
NEAR = 1e-9


def meets(distance: float, width: float = W) -> float:
    """Probability that one p-stable hash is equal for two vectors at this distance."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(hashes of a key, tables) for n vectors."""
    near, far = meets(math.sqrt(2 - 2 * threshold)), meets(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n / CROWD, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def packed(v: np.ndarray) -> bytes:
    """A vector without the zeros at its end: as floats after the mark f where they hold it exactly, else as doubles after d."""
    v = np.trim_zeros(v, "b") + 0.0
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return b"f" + short.tobytes() if (short == v).all() else b"d" + v.astype("<f8").tobytes()


def unpacked(raw: list[bytes], width: int) -> np.ndarray:
    """Such vectors as doubles, one below the other; shorter ones end in zeros."""
    out = np.zeros((len(raw), width))
    for row, x in zip(out, raw):
        got = np.frombuffer(x, "<f4" if x[:1] == b"f" else "<f8", offset=1)
        row[: len(got)] = got
    return out


def nodes(table: DataFrame) -> DataFrame:
    """vec_id, the packed vector (null if it links with nothing) and two hashes of the vector, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if v is None or not v.any() else packed(v) for v in vectors.rows(b.column("embedding"))]
            yield pa.record_batch({"vec_id": b.column("vec_id"), "v": pa.array(out, pa.binary())})

    got = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary")
    return got.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(SEED), "v")).alias("k2"))


class Hashes:
    """The hash functions of all tables, from the seed: small enough to travel with a task."""

    def __init__(self, k: int, tables: int, width: int):
        r = np.random.default_rng(SEED)
        self.k, self.tables, self.width = k, tables, width
        self.plane = r.normal(size=(width, k * tables))
        self.shift = r.uniform(0, W, k * tables)
        self.mixer = (r.integers(1, 1 << 62, k, np.int64) * 2 + 1).astype(np.uint64)

    def unit(self, raw: list[bytes]) -> np.ndarray:
        """The vectors, none of them zero, brought to length 1."""
        v = unpacked(raw, self.width)
        v = v / np.abs(v).max(1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def keys(self, v: np.ndarray) -> np.ndarray:
        """The key of each vector in each table."""
        cell = np.floor((v @ self.plane + self.shift) / W).astype(np.int64).astype(np.uint64).reshape(len(v), self.tables, self.k)
        key = cell @ self.mixer
        return (((key ^ (key >> np.uint64(31))) + np.arange(self.tables, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    both = np.concatenate((x, y))
    top = np.abs(both).max(1, keepdims=True)
    both = np.where((top > 1e100) | (top < 1e-100), both / top, both)
    x, y = both[: len(x)], both[len(x) :]
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def compare(hashes: Hashes, table: int, inside: bool, raw: list[bytes], side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows whose cosine is at least threshold and that share no key of a table before `table`: all pairs, or only those of both sides."""
    v = hashes.unit(raw)
    left, right = (np.arange(len(v)),) * 2 if inside else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    keys = None
    for at in range(0, len(left), 256):
        mine = left[at : at + 256]
        cos = v[mine] @ v[right].T
        i, j = np.nonzero(cos >= threshold - NEAR)
        unsure = cos[i, j] < threshold + NEAR
        i, j = mine[i], right[j]
        if inside:
            i, j, unsure = (x[i < j] for x in (i, j, unsure))
        if not len(i):
            continue
        if keys is None:
            keys = np.concatenate([hashes.keys(v[k : k + 1024]) for k in range(0, len(v), 1024)])[:, :table]
        keep = np.ones(len(i), bool)
        for k in range(0, len(i) if table else 0, 8192):
            keep[k : k + 8192] = ~(keys[i[k : k + 8192]] == keys[j[k : k + 8192]]).any(1)
        ask = np.flatnonzero(keep & unsure)
        for k in range(0, len(ask), 8192):
            some = ask[k : k + 8192]
            keep[some] = exact(unpacked([raw[x] for x in i[some]], hashes.width), unpacked([raw[x] for x in j[some]], hashes.width)) >= threshold
        yield i[keep], j[keep]


def linked(classes: DataFrame, n: int, width: int, threshold: float = THRESHOLD) -> DataFrame:
    """(node, linked, root) rows: links found in one bucket or block for a node of classes (node, v, n), and the smallest node they tie it to.

    A node's links are the sum over its rows; a class counts as often as it has rows.
    """
    hashes = Hashes(*shape(n, threshold), width)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                key = hashes.keys(hashes.unit(b.column("v").to_pylist()))
                yield pa.record_batch({"node": pa.array(np.repeat(b.column("node").to_numpy(), hashes.tables)), "key": pa.array(key.reshape(-1)), "table": pa.array(np.tile(np.arange(hashes.tables, dtype=np.int32), len(key)))})

    hashed = cut(classes.select("node", "v").mapInArrow(send, "node long, key long, table int"), "keys")
    # A key that only one vector has goes before the vectors are fetched.
    sizes = cut(hashed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = join_hot(hashed, shared, ["key"], hot_keys(sizes, "key", n * hashes.tables))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("node", "key", "table", mine.alias("mine"), other.alias("other"))
    met = met.select("node", "key", "table", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    dealt = met.join(classes.select("node", "v", "n"), "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last unit seen, which may go on in the next batch

        def done(rows: pa.RecordBatch, edges: list[int]) -> pa.RecordBatch:
            node, count = rows.column("node").to_numpy(), rows.column("n").to_numpy()
            table, low, high, side = (rows.column(c).to_numpy() for c in ("table", "low", "high", "side"))
            raw = rows.column("v").to_pylist()
            out = [], [], []
            for a, b in zip(edges, edges[1:]):
                links, tree = np.zeros(b - a), []
                for i, j in compare(hashes, int(table[a]), bool(low[a] == high[a]), raw[a:b], side[a:b], threshold):
                    links += np.bincount(i, count[a:b][j], b - a) + np.bincount(j, count[a:b][i], b - a)
                    tree.append(forest(i, j))
                if tree:
                    at, root = np.flatnonzero(links), np.arange(b - a)
                    moved, to = forest(*(np.concatenate(x) for x in zip(*tree)))
                    root[moved] = to
                    out[0].append(node[a:b][at]), out[1].append(links[at].astype(np.int64)), out[2].append(node[a:b][root[at]])
            return pa.record_batch({k: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for k, x in zip(("node", "linked", "root"), out)})

        for b in batches:
            whole = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0] if held else b
            names = [whole.column(c).to_numpy() for c in ("key", "low", "high")]
            edges = [0, *(np.flatnonzero(sum(x[1:] != x[:-1] for x in names)) + 1).tolist()] if whole.num_rows else [0]
            yield done(whole, edges)
            held = [whole.slice(edges[-1])]
        if held and held[0].num_rows:
            yield done(held[0], [0, held[0].num_rows])

    return dealt.select("node", "key", "table", "low", "high", "side", "v", "n").mapInArrow(run, "node long, linked long, root long")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of table (columns vec_id and embedding are read).

    Null, empty and zero vectors and those with a null or non-finite component link with nothing: 0 links, a component of their own,
    kept. Vectors of different length are compared as if the shorter one ended in zeros. Rows of equal vectors link with each other; a repeated row counts
    as often as it stands there. A component's id is its smallest non-null vec_id; a null vec_id is kept only if there is none. An empty
    table gives an empty table.
    """
    rows = cut(nodes(table), "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.min("vec_id").alias("smallest"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    size = F.octet_length("v") - 1
    width = F.when(F.substring("v", 1, 1) == F.lit(b"f"), size / 4).otherwise(size / 8)
    n, total, width = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(width), F.lit(1))).first()
    found = cut(linked(classes, n, int(width), threshold), "links")
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "node")
    ends = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    part = classes.select("node", "k1", "k2", "smallest", "n").join(ends, "node", "left").join(groups, "node", "left")
    part = cut(part.withColumn("component", F.coalesce("component", "node")), "grouped")
    least = part.groupBy("component").agg(F.min("smallest").alias("least"), F.count("*").alias("nodes"))
    whole = join_hot(part, least.select("component", "least"), ["component"], hot_keys(least, "component", n, "nodes"))
    done = whole.select("k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), "least")
    alone = rows.where("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_hot(rows.where("k1 IS NOT NULL").select("k1", "k2", "vec_id"), done, ["k1", "k2"], hot_keys(classes, "k1", total))
    out = out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("least").alias("component_id")).union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
