"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words, by weight, but at most CAP times its own words; what is cut off goes to
the others by weight. A source whose target is r times its words gives every document floor(r) certain copies. The rest,
R words, comes from one more copy of some documents: a fixed-size sample with unequal probabilities. The inclusion
probability of a document is min(1, k * x), where x falls slowly with the class of its length, and k is such
that the expected words are R. With a uniform random number u from a hash of the document and
inclusion probability p, documents are ranked by (u / (1 - u)) / (p / (1 - p)) and taken in this order as long as they
fit into R words; those of the next few whose sizes fill the gap best close the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallforge.llm.common import WORD, cut, free_name, hot_keys, join_hot

WEIGHTS, CAP, SEED = (1, 2, 3), 3, 20240229
#: x halves when the length grows 2^TEMPER-fold; ranks are first laid out in so many slices of each source.
TEMPER, SLICES = 8, 16384
#: The last BACK documents that fit and the SPARE behind them are those among which the fullest end of the sample is sought. Their
#: sizes are counted in units of a GRAIN-th of the gap that they fill (of one word, in a gap of up to GRAIN words).
BACK, SPARE, GRAIN = 8, 64, 1 << 20


def numbered(sources: DataFrame) -> DataFrame:
    """sources with a column nth: each one's place by code point, from 0, null last. Sorted in ranges and numbered from the ranges' sizes."""
    order = F.asc_nulls_last("source")
    spread = cut(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    first = spread.groupBy("part").agg(F.count("*").alias("n_")).select("part", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return spread.withColumn("nth", nth).join(first, "part").withColumn("nth", F.col("nth") + F.col("first")).drop("part", "first")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, size in words) with the target words of each.

    A source gets its weight times one level, but at most cap times its size. Each pass over the sources raises the level by what is cut off,
    until none more is cut off; a source that is cut off stays so, as the level only rises.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    held = cut(numbered(sources).withColumn("weight", weight).drop("nth"), "weights")
    room = cap * F.col("size")
    total, level, over = held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], 0.0, None
    while True:
        above = F.col("weight") * F.lit(level) > room
        free, taken, n = held.agg(F.sum(F.when(~above, F.col("weight"))), F.coalesce(F.sum(F.when(above, room)), F.lit(0)), F.count(F.when(above, 1))).first()
        if n == over or not free:
            return held.withColumn("target", F.when(above, room).otherwise(F.col("weight") * F.lit(level)).cast("double")).drop("weight")
        level, over = (total - taken) / free, n


def scale(classes: list[tuple[int, float]], room: float) -> float:
    """k such that the sum over (length class, words) of words * min(1, k * x) is room."""
    rows = sorted(classes)  # x falls with the class, so the first ones reach 1 first
    x = lambda c: 2.0 ** (-c / TEMPER)
    certain = 0.0
    for i, (c, words) in enumerate(rows):
        rest = sum(x(d) * w for d, w in rows[i:])
        k = (room - certain) / rest if rest else math.inf
        if k * x(c) <= 1:
            return max(k, 0.0)
        certain += words
    return math.inf


def close(f: pd.DataFrame) -> pd.DataFrame:
    """The rows of one source's last slices that are taken: in rank order as long as they fit, but the last BACK of these and the next SPARE as their sizes best fill the gap."""
    f = f.sort_values(["q", "u", "h", "doc_id", "row"], ignore_index=True)
    sizes = f["size"].to_numpy(np.int64)
    room = float(f["room"].iloc[0]) - float(f["below"].iloc[0])
    fits = int(np.searchsorted(np.cumsum(sizes), room, side="right"))
    first = max(0, fits - BACK)
    gap = max(0, int(round(room - sizes[:first].sum())))
    unit = max(1, -(-gap // GRAIN))
    gap, some = round(gap / unit), np.rint(sizes[first : fits + SPARE] / unit).astype(np.int64).tolist()
    reach, steps, limit = 1, [], (1 << (2 * gap + 1)) - 1
    for n in some:
        steps.append(reach)
        reach |= (reach << n) & limit if n <= 2 * gap else 0
    low = (reach & ((1 << (gap + 1)) - 1)).bit_length() - 1
    above = reach >> (gap + 1)
    high = gap + 1 + (above & -above).bit_length() - 1 if above else 0
    at, chosen = high if above and high - gap < gap - low else low, []
    for i in range(len(steps) - 1, -1, -1):
        if not steps[i] >> at & 1:
            chosen.append(first + i)
            at -= some[i]
    return f.iloc[[*range(first), *chosen]][["row"]]


def copies(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row key, doc_id, source, size, source_size, target and the copies that the mix takes, for every row of docs.

    Size counts the words of the whole text (null: 0). Rows repeated in docs are documents of their own; a null source is a
    source, the last one. Documents without words are never taken. An empty table gives an empty table. The draw depends on doc_id,
    text and source alone, so reruns agree. row: a column that numbers the rows, if docs has one.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source))  # never null, so that sources are joined by it
    body = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text", F.lit(SEED)).alias("h"))
    held = cut(body.withColumn("level", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")), "sizes")
    # A row for each source, with the words of its length classes, 64 at most. Sources may be as many as hosts, so none of this reaches the driver.
    classes = held.groupBy("key", "level").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = classes.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("size"), F.sum("n").alias("n"), F.collect_list(F.struct("level", "words")).alias("classes"))
    aimed = with_targets(sources)

    def calibrate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for target, n, some in zip(f["target"], f["size"], f["classes"]):
                whole = min(CAP, math.floor(target / n + 1e-12)) if n else 0
                room = max(0.0, target - whole * n) if whole < CAP else 0.0
                out.append((whole, room, min(scale([(c["level"], float(c["words"])) for c in some], room), 1e300) if room else 0.0))
            yield f[["key", "size", "n", "target"]].rename(columns={"size": "source_size"}).assign(**{c: [o[i] for o in out] for i, c in enumerate(("whole", "room", "k"))})

    plan = cut(aimed.select("key", "size", "n", "target", "classes").mapInPandas(calibrate, "key string, source_size long, n long, target double, whole int, room double, k double"), "plan")
    hot = hot_keys(plan, "key", plan.agg(F.sum("n")).first()[0] or 0)

    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "h", "source", F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    p = F.least(F.lit(1.0), F.col("k") * F.pow(F.lit(2.0), -F.col("level") / TEMPER))
    q = F.when(F.col("p") >= 1, 0.0).otherwise(F.col("u") / (1 - F.col("u")) * ((1 - F.col("p")) / F.col("p")))
    joined = join_hot(held, plan.drop("n"), ["key"], hot)
    drawn = joined.withColumn("u", u).withColumn("p", p).withColumn("q", F.when((F.col("room") > 0) & (F.col("size") > 0), q))
    drawn = cut(drawn.withColumn("slice", F.floor(SLICES * (F.col("q") / (1 + F.col("q")))).cast("int")).drop("p", "level", "source"), "drawn")
    # The slice of each source in which its words pass `room`: what lies well below is taken whole, and only
    # this one and the next ones on either side (until they hold BACK and SPARE documents) are sorted. Sampling is calibrated to q = 1, where a slice holds about 1 / SLICES of the source.
    ranked = drawn.where("q IS NOT NULL")
    by_slice = Window.partitionBy("key").orderBy("slice")
    sums = ranked.groupBy("key", "slice").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("room").alias("room"))
    sums = cut(sums.withColumn("upto", F.sum("words").over(by_slice)), "slices")
    edge = sums.where("upto > room").groupBy("key").agg(F.min("slice").alias("last"))
    around = sums.join(edge, "key")
    after = around.where("slice >= last").withColumn("spare", F.sum("n").over(by_slice) - F.col("n")).where(F.col("spare") < SPARE)
    back = around.where("slice < last").withColumn("spare", F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("slice"))) - F.col("n")).where(F.col("spare") < BACK)
    span = after.select("key", "slice", "upto", "words").union(back.select("key", "slice", "upto", "words"))
    span = span.groupBy("key").agg(F.min("slice").alias("last"), F.max("slice").alias("end"), F.min(F.col("upto") - F.col("words")).alias("below"))
    span = cut(plan.select("key").join(span, "key", "left"), "span")
    with_edge = join_hot(drawn, span, ["key"], hot)
    near = with_edge.where("slice BETWEEN last AND end").select("row", "key", "size", "room", "below", "q", "u", "h", "doc_id")
    inside = cut(near.groupBy("key").applyInPandas(close, "row long"), "inside").withColumn("in", F.lit(1))
    picked = with_edge.join(inside, "row", "left")
    extra = F.when(F.col("q").isNull(), 0).when(F.col("last").isNull() | (F.col("slice") < F.col("last")), 1).otherwise(F.coalesce("in", F.lit(0)))
    return picked.select("row", "doc_id", "size", "source_size", "target", (F.col("whole") + extra).cast("int").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for every row of docs; see copies()."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    row, times, nth = (free_name(docs, n) for n in ("_row", "_times", "_nth"))
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = copies(numbered, row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    return numbered.join(taken, row).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
