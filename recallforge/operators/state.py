"""State from an operation log: last write wins, tombstones, versions, supersession, numbered rows and whole log lines."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(log: DataFrame, *identity: str, seq: str = "seq") -> DataFrame:
    """The latest row of each identity. One aggregate with map-side combine: no sort, and a hot identity is one row for each task."""
    newest = log.groupBy(*identity).agg(F.max_by(F.struct(*log.columns), seq).alias("r"))
    return newest.select("r.*")


def live(log: DataFrame, *identity: str, seq: str = "seq", deleted: Column | None = None) -> DataFrame:
    """Latest rows that are no tombstones."""
    gone = F.col("op") == "delete" if deleted is None else deleted
    return last_write(log, *identity, seq=seq).where(~F.coalesce(gone, F.lit(False)))


def versions(log: DataFrame, *identity: str, seq: str = "seq") -> DataFrame:
    """Identity, version (writes since the last delete), created (first of these) and updated (seq of the last one), if it is live."""
    ends = log.where("op = 'delete'").groupBy(*identity).agg(F.max(seq).alias("end_"))
    writes = log.where("op <> 'delete'").join(ends, list(identity), "left").where(F.col("end_").isNull() | (F.col(seq) > F.col("end_")))
    return writes.groupBy(*identity).agg(F.count("*").alias("version"), F.min(seq).alias("created"), F.max(seq).alias("updated"))


def superseded(writes: DataFrame, tenant: str = "tenant_id", key: str = "id", seq: str = "seq", names: str = "supersedes") -> DataFrame:
    """tenant, key and superseded_by of memories that a later write names and that were not written again after it.

    The mark comes from the latest naming write and stays when the superseding memory is deleted.
    """
    named = writes.select(F.col(tenant), F.explode(names).alias(key), F.struct(F.col(seq).alias("at"), F.col(key).alias("by")).alias("m"))
    marks = named.groupBy(tenant, key).agg(F.max("m").alias("m"))
    own = writes.groupBy(tenant, key).agg(F.max(seq).alias("own"))
    return marks.join(own, [tenant, key]).where("m.at >= own").select(tenant, key, F.col("m.by").alias("superseded_by"))


@contextmanager
def numbered(df: DataFrame, *order, start: int = 0, column: str = "seq") -> Iterator[DataFrame]:
    """df with a column that numbers its rows from start on, in the given order. Rows are sorted in ranges and numbered from the ranges' sizes, a row for each range.

    The sorted rows are kept on disk inside the `with`: a second sort would draw other ranges, whose sizes are not those that were counted.
    """
    placed = df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    try:
        part = F.shiftright("at_", 33)
        sizes = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
        first, before = start, []
        for k, n in sizes:
            before += [F.lit(k), F.lit(first).cast("long")]
            first += n
        offset = F.create_map(*before)[part] if before else F.lit(0).cast("long")
        yield placed.withColumn(column, offset + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).drop("at_")
    finally:
        placed.unpersist()


def first_gap(numbers: DataFrame, column: str = "seq") -> int:
    """The smallest number from 0 on that is not there."""
    there = numbers.select(F.col(column).cast("long").alias("n")).distinct()
    ends = there.select((F.col("n") + 1).alias("n")).union(numbers.sparkSession.range(1).select(F.col("id").alias("n"))).join(there, "n", "left_anti")
    return ends.agg(F.min("n")).first()[0]


def checked_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """seq and body of the log lines "<seq>\t<crc32 hex>\t<json>" that are whole: the checksum, which covers number and body, matches and the body is JSON."""
    parts = F.split(F.col(text), "\t", 3)
    found = lines.select(F.try_to_number(F.get(parts, F.lit(0)), F.lit("9" * 18)).cast("long").alias("seq"), F.get(parts, F.lit(1)).alias("crc"), F.get(parts, F.lit(2)).alias("body"), F.concat_ws("\t", F.get(parts, F.lit(0)), F.get(parts, F.lit(2))).alias("covered"))
    right = F.lpad(F.lower(F.hex(F.crc32(F.encode("covered", "UTF-8")))), 8, "0") == F.lower("crc")
    return found.where(F.col("seq").isNotNull() & right & F.try_parse_json("body").isNotNull()).select("seq", "body")


def plain_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """lines with body and bad, for logs without numbers: "<crc32 hex>\\t<json>", or bare JSON of an old log. Blank lines are left out."""
    tagged = F.col(text).rlike("^[0-9a-fA-F]{8}\t")
    body = F.when(tagged, F.substring(F.col(text), F.lit(10), F.length(text))).otherwise(F.col(text))
    wrong = tagged & (F.lpad(F.lower(F.hex(F.crc32(F.encode("body", "UTF-8")))), 8, "0") != F.lower(F.substring(text, 1, 8)))
    return lines.where(F.trim(text) != "").withColumn("body", body).withColumn("bad", wrong | F.try_parse_json("body").isNull())


def prune_edges(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Edges both of whose ends exist among items (tenant_id, kind, id)."""
    for side in ("from", "to"):
        ends = items.select("tenant_id", F.col("kind").alias(f"{side}_kind"), F.col("id").alias(f"{side}_id"))
        edges = edges.join(ends, ["tenant_id", f"{side}_kind", f"{side}_id"], "left_semi")
    return edges
