"""Structured Streaming: completion marks, thresholds and stream progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from ..operators.merge import insert


def done_until_stream(marks: DataFrame) -> DataFrame:
    """marks (name, idx, done), a stream: for each name the largest index with
    all before it finished, whenever it moves. Not an event-time watermark. The
    state is the open indexes, and the largest one seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, counts, last, until = state.get if state.exists else ([], [], 0, 0)
        pending = dict(zip(ids, counts, strict=True))
        for rows in batches:
            for i, done in zip(rows["idx"], rows["done"], strict=True):
                last = max(last, int(i))
                pending[int(i)] = pending.get(int(i), 0) + (-1 if done else 1)
        pending = {i: n for i, n in pending.items() if n}
        begun = [i for i, n in pending.items() if n > 0]
        new = min(begun) - 1 if begun else last
        state.update((list(pending), list(pending.values()), last, max(until, new)))
        if new > until:
            yield pd.DataFrame({"name": [key[0]], "done_until": [new]})

    return marks.groupBy("name").applyInPandasWithState(step, "name string, done_until long", "ids array<long>, counts array<long>, last long, until long", "append", "NoTimeout")


def follow_threshold(values: DataFrame, percentile: float, publish: Callable[[int], None]):
    """A stream of values (size): publishes the percentile of all sizes so far, in
    classes of powers of two. Their counts, 64 at most, are the query's state, so
    a restart from its checkpoint goes on with them."""

    def batch(rows: DataFrame, _: int) -> None:
        seen = {r.bits: r["count"] for r in rows.collect()}
        total, upto = sum(seen.values()), 0
        for b in sorted(seen):
            upto += seen[b]
            if upto >= total * percentile:
                publish(1 << b)
                break

    size = F.greatest(F.col("size").cast("long"), F.lit(1))
    bits = F.when(size == 1, 0).otherwise(F.length(F.bin(size - 1)))  # 1 << bits is the class's largest size
    return values.groupBy(bits.alias("bits")).count().writeStream.outputMode("complete").foreachBatch(batch)


def stream_completion(messages: DataFrame) -> DataFrame:
    """messages (stream_id, stream_done, ...), a stream: rows and completion."""
    return messages.groupBy("stream_id").agg(F.count("*").alias("messages"), F.max("stream_done").alias("done"))


def handover(writes: DataFrame, path: str):
    """A stream of writes: each batch becomes a memtable (the last write of a key
    and version stays), which is handed over as a table of its own."""

    def batch(rows: DataFrame, number: int) -> None:
        insert(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")  # the same again after a restart

    return writes.writeStream.foreachBatch(batch)


def finish(writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a query over all that its source has now."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
