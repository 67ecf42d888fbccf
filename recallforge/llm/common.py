"""Helpers shared by the operators: shared scratch tables, Arrow text access and row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: ASCII lower-casing of A-Z only, as every word rule of the operators asks.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Word rule [^\x20\x09-\x0D]+ as a Java pattern; bytes.split() follows the same rule.
WORD = "[^\\x20\\x09-\\x0D]+"


@cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="recallforge-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = _own_dir(spark.sparkContext.applicationId)
    return got.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor repeats only what follows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table that cut() wrote for df."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: A key is hot when it holds more than one in HOT_SHARE of all rows (and more than HOT_ROWS), so there are fewer than HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 500, 500


def hot_keys(counted: DataFrame, key: str, total: int, n: str = "n") -> list:
    """The keys of counted (key, n) that hold a large share of about `total` rows: fewer than HOT_SHARE of them, whatever the input."""
    if total <= HOT_ROWS:  # none can
        return []
    return [r[0] for r in counted.where(F.col(n) > max(HOT_ROWS, total // HOT_SHARE)).select(key).collect()]


def join_hot(rows: DataFrame, one: DataFrame, on: list[str], hot: list) -> DataFrame:
    """rows.join(one, on), where one has each key once and `hot` lists keys (values of on[0]) that hold many rows.

    The rows of hot keys meet a broadcast of the few rows of `one` for them, so they stay where they are; the others are shuffled. Rows with a null key are dropped.
    """
    if not hot:
        return rows.join(one, on)
    is_hot = F.col(on[0]).isin(hot)
    return rows.where(~is_hot).join(one, on).union(rows.where(is_hot).join(F.broadcast(one.where(is_hot)), on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def turn_of(*cols):
    """A repeatable number from 0 to less than 1 for each row, by its hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(7), *cols), 11) / F.lit(float(1 << 53))


def hash_below(share, *cols):
    """Keep a row when its hash falls into the first `share` of the range: a repeatable sample."""
    return turn_of(*cols) < share


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose text holds about `size` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), np.float64))
        part = (np.cumsum(lengths) // size).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def wider(df: DataFrame, **kinds: DataType) -> StructType:
    """The schema of df with columns added."""
    return StructType([*df.schema.fields, *(StructField(k, t) for k, t in kinds.items())])
