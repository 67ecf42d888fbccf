"""Streaming: state views that follow an operation log, and event-time counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallforge.operators.state import last_write


def follow(log: DataFrame, target: str, checkpoint: str, identity: tuple[str, ...], seq: str = "seq") -> StreamingQuery:
    """Keep the last write of each identity at target, a folder of versions: version n + 1 is version n and batch n + 1 brought together.

    A batch that is done again overwrites its own version, so a restart after a lost driver changes nothing.
    """
    spark = log.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        newest = last_write(batch, *identity, seq=seq)
        if number:
            newest = last_write(spark.read.parquet(f"{target}/version={number - 1}").unionByName(newest), *identity, seq=seq)
        newest.write.mode("overwrite").parquet(f"{target}/version={number}")

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(log: DataFrame, time: str = "ts", key: str = "op", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Writes by window and key; rows later than the watermark are dropped."""
    return log.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def supersession(log: DataFrame) -> DataFrame:
    """(tenant_id, id, superseded_by) each time a write (tenant_id, id, seq, by) changes a memory's mark.

    `by` is the memory that supersedes id, null for a write of id itself, which clears the mark. Rows are keyed by (tenant_id, id) and applied in
    seq order within a batch; a row older than what was seen is left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, mark = state.get if state.exists else (-1, None)
        before, rows = mark, pd.concat(list(frames)).sort_values("seq")
        for r in rows.itertuples(index=False):
            if r.seq > seen:
                seen, mark = int(r.seq), None if pd.isna(r.by) else r.by
        state.update((seen, mark))
        if mark != before:
            yield pd.DataFrame({"tenant_id": [key[0]], "id": [key[1]], "superseded_by": [mark]})

    return log.groupBy("tenant_id", "id").applyInPandasWithState(step, "tenant_id string, id string, superseded_by string", "seen long, mark string", "update", "NoTimeout")
