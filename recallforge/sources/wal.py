"""Checksummed line logs: writing, reading, and recovery of the valid prefix.

A line is "<seq>\\t<crc32 hex>\\t<json>". Its number says where it belongs, so neither the names nor the sizes of files matter, nor how Spark cuts them. The
valid prefix are the lines before the first number that is missing, or whose line is torn, does not match its checksum or holds no JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.functions.text import checksum
from recallforge.operators.state import checked_lines, first_gap, numbered, plain_lines


class Damaged(ValueError):
    """A log holds lines behind its valid prefix; repair() comes before the next write."""


def lines(bodies: DataFrame, body: str = "body", seq: str = "seq") -> DataFrame:
    """Log lines of numbered JSON bodies."""
    number = F.col(seq).cast("string")
    return bodies.select(F.concat_ws("\t", number, checksum(F.concat_ws("\t", number, F.col(body))), F.col(body)).alias("value"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write(bodies: DataFrame, path: str, order: str, body: str = "body") -> None:
    """Append the bodies in order, numbered behind the lines that are there. A damaged log is refused."""
    spark, start = bodies.sparkSession, 0
    if _exists(spark, path):
        raw = spark.read.text(path).where(F.trim("value") != "")
        start = recover(spark, path).count()
        if start != raw.count():
            raise Damaged(path)
    with numbered(bodies.select(order, body), order, start=start, column="number_") as rows:
        lines(rows, body, "number_").write.mode("append").text(path)


def recover(spark: SparkSession, path: str) -> DataFrame:
    """(pos, body) of the valid prefix; pos numbers the lines from 0. A line that stands there twice counts once."""
    whole = checked_lines(spark.read.text(path))
    end = first_gap(whole)
    return whole.where(F.col("seq") < end).dropDuplicates(["seq"]).select(F.col("seq").alias("pos"), "body")


def repair(spark: SparkSession, path: str, to: str) -> int:
    """Write the valid prefix of a damaged log as a new one; the number of its lines."""
    kept = recover(spark, path)
    lines(kept, "body", "pos").write.text(to)
    return kept.count()


def recover_file(spark: SparkSession, path: str) -> DataFrame:
    """(pos, body) of the valid prefix of one log file without numbers, "<crc32 hex>\\t<json>" or bare JSON a line. The file is one row, as such logs are compacted at a few MB."""
    every = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    checked = plain_lines(every)
    first = checked.where("bad").agg(F.min("pos")).first()[0]
    return (checked if first is None else checked.where(F.col("pos") < first)).select(F.col("pos").cast("long"), "body")
