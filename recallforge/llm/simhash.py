"""SimHash fingerprints and near-duplicate groups found by the pigeonring principle.

Two 64-bit fingerprints are linked at RADIUS or fewer differing bits. The bits are laid out as a ring of
SEGMENTS segments. If the total difference is at most RADIUS, some segment starts a chain in which the first l
segments together differ in at most l * RADIUS / SEGMENTS bits, for every l (pigeonring, strong form). With five
segments and radius 4 the first segment agrees exactly, the first two differ in at most one bit, the first three
in at most two, and so on. The budgets of the first two segments, of three when there are very many fingerprints, are the join key (26
bits with 14 spellings of the second segment on the probing side, or 39 bits with 274), the longer ones prune what the key lets through,
and only then the full Hamming distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.llm.common import LOWER, cut, hot_keys, join_hot, pieces, texts
from recallforge.llm.components import components

RADIUS, SHINGLE = 4, 4
#: A row sent to meet others costs about as much as so many comparisons.
SHUFFLE = 20
#: (lowest bit, number of bits) of each segment of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    n, votes = len(first), np.zeros(64, np.int64)
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        h = np.array([digest(line[a:b], 42) for a, b in zip(first[at : at + (1 << 16)], stops[at : at + (1 << 16)])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(x) for x in texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "fp": pa.array(fp)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _segment(fp, i: int):
    low, bits = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def spellings(start: int, prefix: int) -> list[tuple[int, ...]]:
    """Differences of segments start + 1 to start + prefix - 1 that the first `prefix` budgets of a chain allow, one mask for each segment."""
    out: list[tuple[tuple[int, ...], int]] = [((), 0)]
    for length in range(2, prefix + 1):
        width = SEGMENTS[(start + length - 1) % len(SEGMENTS)][1]
        most = length * RADIUS // len(SEGMENTS)
        out = [((*masks, mask), used + n) for masks, used in out for n in range(most - used + 1) for mask in _masks(width, n)]
    return [masks for masks, _ in out]


def _masks(width: int, n: int) -> list[int]:
    """The words of `width` bits with n bits set."""
    return [sum(1 << b for b in some) for some in combinations(range(width), n)]


def prefix(n: int) -> int:
    """How many segments of a chain make the key for n fingerprints: what is cheaper, more probes or more fingerprints met by each.

    A key of p segments has about 13 p bits, and the chains' spellings are the probes of a fingerprint. A probe costs as much as SHUFFLE comparisons. Both give the same pairs.
    """
    probes = {p: sum(len(spellings(i, p)) for i in range(len(SEGMENTS))) for p in (2, 3)}
    return min(probes, key=lambda p: probes[p] * (SHUFFLE + n / 2 ** (13 * p)))


def links(fps: DataFrame, radius: int = RADIUS, segments: int = 2) -> DataFrame:
    """Pairs a < b of the distinct values in column fp that differ in at most `radius` bits (at most 4); `segments` of a chain (2 or 3) make the key."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the ring is laid out for a radius of 0 to 4")
    n = len(SEGMENTS)

    def key(i: int):
        out = F.lit(i).cast("long")
        for k in range(segments):
            out = F.shiftleft(out, 13) + _segment(F.col("fp"), i + k)
        return out

    def spelled(i: int):
        packed = [sum(mask << 13 * (segments - 2 - k) for k, mask in enumerate(masks)) for masks in spellings(i, segments)]
        return F.transform(F.lit(packed).cast("array<long>"), lambda mask: key(i).bitwiseXOR(mask))

    # The index holds a fingerprint once for each first segment; the probing side once for each spelling of the others. A fingerprint becomes many
    # rows here, so the fingerprints are dealt out anew first: an aggregate of few bytes may have left them in few tasks.
    dealt = fps.repartition(fps.sparkSession.sparkContext.defaultParallelism * 4, "fp")
    index = dealt.select(F.col("fp").alias("b"), F.explode(F.array(*(key(i) for i in range(n)))).alias("key"))
    probe = dealt.select(F.col("fp").alias("a"), F.explode(F.concat(*map(spelled, range(n)))).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftrightunsigned("key", 13 * segments)
    chain = F.lit(False)
    for i in range(n):
        total, holds = F.lit(0), start == i
        for length in range(1, n):
            total = total + F.bit_count(_segment(differ, i + length - 1))
            holds = holds & (total <= length * RADIUS // n)
        chain = chain | holds
    found = probe.join(index, "key").where((F.col("a") < F.col("b")) & chain & (F.bit_count(differ) <= radius))
    return found.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs (columns doc_id and text are read, others ignored).

    A null, empty or blank text has fingerprint zero and is linked like any other. A null doc_id keeps its row; a
    component's id is its smallest non-null doc_id, null if there is none. Repeated rows come back repeated. An empty
    table gives an empty table. Equal fingerprints are one node, so exact copies make no pairs. A fingerprint or component
    with a large share of the rows is joined by a broadcast of its one row.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")), "nodes")
    total, distinct = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    groups = components(links(nodes.select("fp"), radius, prefix(distinct)), "fp")  # only nodes that have a link
    part = cut(nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "grouped")
    least = part.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count("*").alias("nodes"))
    moved = join_hot(part, least.select("component", "component_id"), ["component"], hot_keys(least, "component", distinct, "nodes")).select("fp", "component_id")
    out = join_hot(rows, moved, ["fp"], hot_keys(nodes, "fp", total))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
