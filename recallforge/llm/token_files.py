"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds frames, each of whole documents in ascending doc_id order, followed by one line feed. A frame is

    magic "RFT1", then unsigned 64-bit numbers: task, frame, documents, tokens, table entries, data bytes
    doc_id (signed 64-bit) and null mark (one byte) of each document, tokens of each document (unsigned 64-bit)
    the table: ids of the frame by descending frequency, then by id (unsigned 32-bit)
    control bytes: two bits for each token, lowest first, the number of bytes of its rank less one
    data bytes: the rank of each token, little-endian, without its zero upper bytes

all little-endian. The decoder looks up the four lengths of a control byte in a table. Files are written by Spark's text
sink and read by its binaryFile source, so any file system that Spark reaches will do, and a lost task is done again under
Spark's commit protocol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallforge.llm.common import cut, pieces, scratch
from recallforge.llm.tokenize import encoder

MAGIC, HEAD = b"RFT1", struct.Struct("<4s6Q")
END, FRAME_TOKENS, FRAMES_PER_FILE = 2, 1 << 20, 16
#: For each control byte, the lengths of its four ranks.
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1


def encode_frame(docs: list[int | None], ids: list[bytes], task: int = 0, frame: int = 0) -> bytes:
    """One frame; ids are little-endian unsigned 32-bit integers, a byte string for each document."""
    values = np.frombuffer(b"".join(ids), "<u4")
    if values.max(initial=0) < 1 << 20:  # as with any usual vocabulary: count in an array instead of sorting
        every = np.bincount(values)
        table = np.flatnonzero(every)
        counts, where = every[table], values
    else:
        table, where, counts = np.unique(values, return_inverse=True, return_counts=True)
    order = np.lexsort((table, -counts))
    rank = np.empty(int(where.max(initial=0)) + 1, np.uint32)
    rank[table[order] if where is values else order] = np.arange(len(table))
    ranks = rank[where]
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    sizes = np.array([len(x) // 4 for x in ids], "<u8")
    null = bytes(d is None for d in docs)
    head = HEAD.pack(MAGIC, task, frame, len(docs), len(values), len(table), len(data))
    return b"".join((head, np.array([d or 0 for d in docs], "<i8").tobytes(), null, sizes.tobytes(), table[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()))


def decode_frame(raw: memoryview, at: int = 0) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray, int]:
    """(task, frame, doc ids, sizes, token ids, place after the frame) of the frame that begins at `at`."""
    magic, task, frame, n, tokens, entries, size = HEAD.unpack_from(raw, at)
    if magic != MAGIC:
        raise ValueError("not a token frame")
    at += HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    docs, null, sizes, table = take("<i8", n), take("u1", n), take("<u8", n).astype(np.int64), take("<u4", entries)
    lengths = _LENGTHS[take("u1", -(-tokens // 4))].reshape(-1)[:tokens]
    data = take("u1", size)
    start = np.cumsum(lengths) - lengths
    rank = data[start].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths > k)
        rank[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return task, frame, [None if x else int(d) for d, x in zip(docs, null)], sizes, table[rank], at


def write(docs: DataFrame, folder: str, path: str, spaced: bool, end: int = END, frame_tokens: int = FRAME_TOKENS) -> None:
    """Write the ids and the end id of every row of docs, in ascending doc_id order (null first, then by a hash of the text), as token files.

    The rows are dealt out by ranges of (doc_id, hash of the text), so a doc_id that repeats does not gather in one task.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = body.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, frame, ids, names, size = TaskContext.get().partitionId(), 0, [], [], 0
        made = lambda: pa.record_batch({"frame": pa.array([encode_frame(names, ids, task, frame)], pa.binary())})
        with encoder(path, spaced) as enc:
            for b in pieces(batches, size=4 << 20):
                for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()])):
                    if ids and size + len(x) // 4 >= frame_tokens:
                        yield made()
                        frame, ids, names, size = frame + 1, [], [], 0
                    ids.append(x + tail)
                    names.append(doc)
                    size += len(x) // 4 + 1
        if ids:
            yield made()

    frames = keyed.mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", FRAMES_PER_FILE).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """task, frame, place, doc_id, n_tokens and ids_crc32 of every document in the files of a folder, decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw, at = memoryview(content.as_buffer()), 0
                while at < len(raw):
                    task, frame, docs, sizes, ids, at = decode_frame(raw, at)
                    at += 1  # the line feed
                    edges, body = [0, *np.cumsum(4 * sizes).tolist()], memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(body[i:j]) for i, j in zip(edges, edges[1:])]
                    n = len(docs)
                    yield pa.record_batch({"task": pa.array([task] * n, pa.int64()), "frame": pa.array([frame] * n, pa.int64()), "place": pa.array((np.cumsum(sizes) - sizes)), "doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())})

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "task long, frame long, place long, doc_id long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, path: str, spaced: bool = False, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of docs, from token files written and read back.

    A null or empty text is the end id alone; rows without an id come first; rows of the same id stand in the order of a hash of their text.
    Only doc_id and text are read. An empty table gives an empty table.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "tokens")
    write(docs, folder, path, spaced, end)
    got = cut(read(spark, folder), "decoded")
    # start: what the tasks before hold, what the frames of the task before hold, and the place in the frame.
    frames = got.groupBy("task", "frame").agg(F.sum("n_tokens").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = frames.withColumn("inside", earlier(Window.partitionBy("task").orderBy("frame")))
    tasks = frames.groupBy("task").agg(F.sum("n").alias("n")).withColumn("outside", earlier(Window.orderBy("task")))  # a row for each task
    base = inside.join(tasks.select("task", "outside"), "task").select("task", "frame", (F.col("inside") + F.col("outside")).alias("base"))
    return got.join(base, ["task", "frame"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
