"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal, scored as sparse dot products.

Features of a text: its words and word pairs, and the shapes of its words (letters and digits collapsed to one mark,
a repeated word to another) as 1-, 2- and 3-grams, all hashed into BUCKETS slots. A feature's value is its share of
the text's features, times GAIN. Words, spans and hashes are found for a whole batch at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from recallforge.llm.common import hash_below, pieces, remainder, texts, wider

BUCKETS, GAIN = 1 << 18, 24.0
#: A text of more bytes is gone through in parts: finding its features takes about 40 bytes for each of its own.
LONG = 1 << 20
#: At most about so many labelled rows of each class are learned from (a random sample by hash beyond it).
SAMPLE = 2000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.002, 0.1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
#: Shapes of which a run counts once.
_RUN = np.zeros(256, bool)
_RUN[[ord("a"), ord("A"), ord("0")]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MULT
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    inverse = pow(int(_POWER), -1, 1 << 64)
    up, down = np.full(n, _POWER, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(data)], out=total[1:])
    return _mix((total[ends] - total[starts]) * powers[1][starts])


def grams(lines: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, the slots of all texts, in order, and the text that each belongs to."""
    data = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    powers = _powers(len(data) + 1)
    word = _span_hash(data, starts, ends, powers)
    shape = _SHAPE[data]
    kept = np.concatenate(([True], shape[1:] != shape[:-1])) | ~_RUN[shape]
    kept[starts] = True
    before = np.concatenate(([0], np.cumsum(kept)))
    form = _span_hash(shape[kept], before[starts], before[ends], powers)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    same = np.concatenate(([False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])))
    form = np.where(same, np.uint64(12345), form)
    for salt, h, n in ((1, word, 1), (2, word, 2), (3, form, 1), (4, form, 2), (5, form, 3)):
        if len(h) < n:
            continue
        last = len(h) - n + 1
        mixed = np.full(last, np.uint64(salt), np.uint64)
        for k in range(n):
            mixed = _mix(mixed * _MULT + h[k : k + last])
        inside = owner[:last] == owner[n - 1 :]
        yield (mixed[inside] >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), owner[:last][inside]


def _parts(line: bytes, size: int) -> Iterator[tuple[bytes, int, int]]:
    """A long text in parts of about `size` bytes that end at white space, each with the word before and the two words after it: (bytes, words before, own words)."""
    at = 0
    while at < len(line):
        to = at + size
        while to < len(line) and not _SPACE[line[to]]:
            to += 1
        own, step = line[at:to], 4096  # the outermost word found on either side may be cut, unless the text ends there
        while len(before := line[max(0, at - step) : at].split()) < 2 and step < at:
            step *= 4
        step = 4096
        while len(after := line[to : to + step].split()) < 3 and to + step < len(line):
            step *= 4
        before = before[-1:]
        yield b" ".join([*before, own, *after[:2]]), len(before), len(own.split())
        at = to


def all_grams(lines: list[bytes], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams() of the texts; one of more than `size` bytes (LONG) is gone through in parts, with the same features as in one."""
    size = size or LONG
    short = [x if len(x) <= size else b"" for x in lines]
    yield from grams(short)
    for i, line in enumerate(lines):
        if len(line) > size:
            for part, before, own in _parts(line, size):
                for slots, _ in grams([part]):
                    mine = slots[before : before + own]
                    yield mine, np.full(len(mine), i)


def features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of all texts, one text after the other, and the number of slots of each text."""
    got = list(all_grams(lines))
    if not got:
        return np.zeros(0, np.int64), np.zeros(len(lines), np.int64)
    slots, who = (np.concatenate(x) for x in zip(*got))
    return slots[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(lines))


def scores(lines: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text; weights has the bias last."""
    total, sizes = np.zeros(len(lines)), np.zeros(len(lines))
    for slots, who in all_grams(lines):
        total += np.bincount(who, weights=weights[slots], minlength=len(lines))
        sizes += np.bincount(who, minlength=len(lines))
    z = weights[-1] + GAIN * total / np.maximum(sizes, 1)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], weight: dict[int, float]) -> np.ndarray:
    """FTRL-proximal over (slots, values, label) in the given order, EPOCHS times; returns weights with the bias last."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    w = np.zeros(BUCKETS + 1)

    def solve(i):
        return np.where(np.abs(z[i]) <= L1, 0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for slots, values, label in rows:
            at = np.append(slots.astype(np.int64), BUCKETS)
            x = np.append(values.astype(float), 1.0)
            now = solve(at)
            p = 1 / (1 + np.exp(-np.clip(now @ x, -35, 35)))
            g = (p - label) * x * weight[label]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * now
            n[at] += g * g
    everywhere = np.arange(BUCKETS + 1)
    w[:] = solve(everywhere)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from labelled documents whose crc32 remainder modulo 3 is not 1.

    Up to about `sample` rows of each class take part, chosen by a hash of the id. Rows without an id, and rows
    with a label other than 0 and 1, take no part. An id with several labels counts as its smallest. The learning runs in one
    task over the bounded sample, so the driver holds only the weights. Without labelled rows all weights are zero.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    count = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, sample / max(1, count.get(1, 0))).otherwise(sample / max(1, count.get(0, 0)))
    chosen = marked.where(hash_below(share, "doc_id"))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The sample has about 2 * sample rows, whatever the input: the one broadcast here is bounded by that parameter.
    joined = body.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, size=1 << 20):
            slots, sizes = features(texts(b.column("text")))
            at, out = 0, []
            for size in sizes.tolist():
                i, c = np.unique(slots[at : at + size], return_counts=True)
                at += size
                out.append((i.astype("<i4").tobytes(), (GAIN * c / max(size, 1)).astype("<f4").tobytes()))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "quality": b.column("quality"), "slots": pa.array([x[0] for x in out], pa.binary()), "counts": pa.array([x[1] for x in out], pa.binary())})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [r for f in frames for r in f.itertuples(index=False)]
        if not got:
            return
        got.sort(key=lambda r: (((r.doc_id + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1), r.slots, r.counts, r.quality))
        seen = {c: sum(r.quality == c for r in got) for c in (0, 1)}
        # Both classes weigh as in the whole table, the more thinly sampled one 1.
        weight = {c: min(1.0, count.get(c, 0) / max(1, seen[c]) * min(seen[k] / max(1, count.get(k, 0)) for k in (0, 1) if seen[k])) for c in (0, 1)}
        w = train([(np.frombuffer(r.slots, "<i4"), np.frombuffer(r.counts, "<f4"), r.quality) for r in got], weight)
        yield pd.DataFrame({"w": [w.astype("<f4").tobytes()]})

    sparse = joined.mapInArrow(rows, "doc_id long, quality int, slots binary, counts binary")
    got = sparse.repartition(1).mapInPandas(learn, "w binary").first()
    return np.frombuffer(got[0], "<f4").astype(float) if got else np.zeros(BUCKETS + 1)


def classify(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """docs with the probability of quality 1 added as a double column."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB, whatever the input
    schema = wider(docs, **{column: DoubleType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, size=1 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(texts(b.column("text")), held.value.astype(float)))], [*b.schema.names, column])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, scored on its whole text.

    A null or empty text is scored by the bias alone. A null doc_id counts as the empty text for the fold. Repeated
    rows come back repeated; columns other than doc_id and text are neither read nor inputs. An empty table
    gives an empty table; with no label to learn from every score is 0.5.
    """
    weights = fit(docs, labels)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = body.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, size=1 << 20):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(scores(texts(b.column("text")), held.value.astype(float)))})

    scored = body.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
