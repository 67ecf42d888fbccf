"""Vector functions: cosine as a Column, and the feature-hash embedding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from recallforge.functions.text import let, tokens

DIM = 64


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for empty vectors, different lengths and zero vectors."""
    parts = F.struct(_dot(a, b).alias("dot"), (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))).alias("length"))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), let(parts, lambda p: F.when(p["length"] > 0, p["dot"] / p["length"])))


def cosine_to(a: Column, vector: list[float]) -> Column:
    """As cosine, against one vector, whose length is computed once."""
    fixed = [float(x) for x in vector]
    length = math.sqrt(sum(x * x for x in fixed))
    if not length:
        return F.lit(None).cast("double")
    parts = F.struct(_dot(a, literal(fixed)).alias("dot"), (F.sqrt(_dot(a, a)) * length).alias("length"))
    return F.when(F.size(a) == len(fixed), let(parts, lambda p: F.when(p["length"] > 0, p["dot"] / p["length"])))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def fnv(words: list[bytes]) -> np.ndarray:
    """FNV-1a, 64 bits, of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    h = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    left = len(words)
    for k in range(int(sizes.max(initial=0))):
        while sizes[order[left - 1]] <= k:
            left -= 1
        h[:left] = (h[:left] ^ data[starts[:left] + k]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def hash_slots(lists: pa.Array | list[list[str] | None], dim: int = DIM) -> np.ndarray:
    """Signed counts for each list of tokens: slot is the hash modulo dim, the sign its bit 32. Each distinct token is hashed once."""
    lists = lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    h = fnv([w.encode() for w in coded.dictionary.to_pylist()])
    at = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    slot = (h % np.uint64(dim)).astype(np.int64)
    sign = np.where(h >> np.uint64(32) & np.uint64(1), -1.0, 1.0)
    return np.bincount(row * dim + slot[at], weights=sign[at], minlength=len(lists) * dim).reshape(-1, dim).astype(np.int64)


def embed(text: str, dim: int = DIM) -> list[float]:
    """The embedding of one text on the driver, for queries."""
    import regex

    words = [t.lower() for t in regex.split(r"[^\p{Alphabetic}\p{N}]+", text) if t]
    v = hash_slots([words], dim)[0]
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).astype(float).tolist()


def with_hash_embedding(df: DataFrame, text: str = "text", dim: int = DIM, found: str | None = None) -> DataFrame:
    """df with `slots` (signed counts) and `embedding` (the slots at length 1, zeros without tokens) added.

    Tokens come from the JVM, or from the column `found`, which is dropped; the hash runs once for each distinct token of an Arrow batch, over whole arrays.
    """
    kept = df.drop(found) if found else df
    spread = kept.select("*", tokens(F.col(text)).alias("tokens_")) if found is None else df.select(*kept.columns, F.col(found).alias("tokens_"))
    schema = StructType([*kept.schema.fields, StructField("slots", ArrayType(LongType())), StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = hash_slots(b.column("tokens_"), dim)
            n = np.sqrt((v * v).sum(1, keepdims=True))
            unit = np.divide(v, n, out=np.zeros(v.shape), where=n > 0).astype(np.float32)
            ends = pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (v, unit)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], schema.names)

    return spread.mapInArrow(run, schema)
