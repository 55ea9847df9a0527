"""Global order without a single task: numbers, running sums, neighbours, carries.

Rows are dealt into ranges of the whole order, as many as the session shuffles
into, so a hot leading key spans several. Each range is sorted and read once,
batch by batch; what has to pass from one range to the next is a row for each
range, which is broadcast. The ranges are written to a table first, because
Spark samples their bounds anew whenever it computes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize

Batches = Iterator[pa.RecordBatch]


def _sorted(df: DataFrame, order: list[Column], read: Callable[[Batches], Batches], adds: list[T.StructField], ranges: list[Column] | None = None) -> DataFrame:
    """Rows with _part (their range) and what ``read`` adds to a range in order.
    ``ranges``: what bounds are made of, if it is less than the order, for the
    driver gets a sample of it. It must not contradict the order."""
    ranged = df.repartitionByRange(*(ranges or order)).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    return materialize(ranged.mapInArrow(read, T.StructType([*ranged.schema.fields, *adds])), "ordered")


def _parts_before(ends: DataFrame, value: Column, name: str, backwards: bool = False) -> DataFrame:
    """``value`` over the rows of all ranges before (or behind) each one; ``ends`` has a row for each."""
    order = Window.orderBy(F.desc("_part") if backwards else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("_part", value.over(order).alias(name))


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str, inclusive: bool = False, ranges: list[Column] | None = None) -> DataFrame:
    """Sum of ``value`` (whole numbers) over the rows before (and with) each one."""

    def read(batches: Batches) -> Batches:
        total = 0
        for batch in batches:
            own = np.cumsum(batch.column("_value").to_numpy()) + total
            total = int(own[-1]) if len(own) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "_own"])

    rows = df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    placed = _sorted(rows, order, read, [T.StructField("_own", T.LongType())], ranges)
    totals = placed.groupBy("_part").agg(F.sum("_value").alias("_total"))
    before = _parts_before(totals, F.sum("_total"), "_before")
    out = placed.join(F.broadcast(before), "_part")  # a row for each range
    total = F.col("_own") + F.coalesce("_before", F.lit(0))
    return out.withColumn(name, total if inclusive else total - F.col("_value")).drop("_part", "_value", "_own", "_before")


def row_number(df: DataFrame, order: list[Column], name: str, ranges: list[Column] | None = None) -> DataFrame:
    """Number from 1 in the order."""
    return running_sum(df, order, F.lit(1), name, inclusive=True, ranges=ranges)


def neighbours(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Adds prev_<c> and next_<c> for each column."""

    def shown(batch: pa.RecordBatch, before: pa.RecordBatch | None, after: pa.RecordBatch | None) -> pa.RecordBatch:
        n, more = batch.num_rows, []
        for c in columns:
            column = batch.column(c)
            none = pa.nulls(1, column.type)
            more.append(pa.concat_arrays([before.column(c) if before else none, column.slice(0, n - 1)]))
            more.append(pa.concat_arrays([column.slice(1), after.column(c) if after else none]))
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[0], last[-1] = before is None, after is None
        return pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(first), pa.array(last)], [*batch.schema.names, *new, "_first", "_last"])

    def read(batches: Batches) -> Batches:
        before = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield shown(held, before, batch.slice(0, 1))
                before = held.slice(held.num_rows - 1)
            held = batch
        if held is not None:
            yield shown(held, before, None)

    new = [f"{side}_{c}" for c in columns for side in ("prev", "next")]
    adds = [T.StructField(f"{side}_{c}", df.schema[c].dataType) for c in columns for side in ("prev", "next")]
    placed = _sorted(df, order, read, [*adds, T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())])
    ends = placed.filter("_first or _last").groupBy("_part").agg(*[F.max_by(F.struct(*columns), f"_{x}").alias(f"_{x}_row") for x in ("first", "last")])
    before = _parts_before(ends, F.last("_last_row"), "_before")
    behind = _parts_before(ends, F.last("_first_row"), "_behind", backwards=True)
    out = placed.join(F.broadcast(before.join(behind, "_part")), "_part")  # a row for each range
    for side, at, row in (("prev", "_first", "_before"), ("next", "_last", "_behind")):
        out = out.withColumns({f"{side}_{c}": F.when(F.col(at), F.col(row)[c]).otherwise(F.col(f"{side}_{c}")) for c in columns})
    return out.drop("_part", "_first", "_last", "_before", "_behind")


def carry(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the last ``value`` that is not null at or before each row."""

    def read(batches: Batches) -> Batches:
        held, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("_value")
            both = pa.concat_arrays([pa.nulls(1, column.type) if held is None else held, column])
            at = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(1, len(both)), 0))
            out = both.take(pa.array(at))
            held = out.slice(len(out) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, out, pa.array(np.arange(n, n + len(out)))], [*batch.schema.names, "_own", "_at"])
            n += len(out)

    rows = df.withColumn("_value", value)
    kind = rows.schema["_value"].dataType
    placed = _sorted(rows, order, read, [T.StructField("_own", kind), T.StructField("_at", T.LongType())])
    every = placed.groupBy("_part").agg(F.max_by("_own", "_at").alias("_end"))
    before = _parts_before(every, F.last("_end", ignorenulls=True), "_before")
    out = placed.join(F.broadcast(before), "_part")
    return out.withColumn(name, F.coalesce("_own", "_before")).drop("_part", "_value", "_own", "_at", "_before")


def ordered_fold(df: DataFrame, by: str, order: list[Column], reads: list[str], make: Callable[[], Callable[..., tuple]], adds: dict[str, str]) -> DataFrame:
    """Adds the columns ``adds`` (long) that ``make()``, called once for each
    partition, gives for (by, *reads) of each row in order. A value of ``by`` is
    one ordered scan in one task, which keeps a state of fixed size."""

    def run(batches: Batches) -> Batches:
        step = make()
        for batch in batches:
            new = [step(*row) for row in zip(*[batch.column(c).to_pylist() for c in (by, *reads)], strict=True)]
            more = [pa.array([x[i] for x in new], pa.int64()) for i in range(len(adds))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *adds])

    schema = df.schema
    for name, kind in adds.items():
        schema = schema.add(name, kind)
    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


#: Bytes, as they are stored in files, whose rows one task of ``dealt`` gets; its
#: partitions at most; and what Spark estimates where it knows no size.
DEALT, MOST, UNKNOWN = 4 << 20, 20_000, 1 << 60


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt into as many partitions as its size asks for, so that what a
    task sorts does not grow with it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(least if size >= UNKNOWN else min(MOST, max(least, size // DEALT)), *by)


#: Key ranges that intervals are dealt into: one for PER_RANGE rows, but no fewer
#: than RANGES and no more than the SAMPLE of keys that their bounds come from.
RANGES, PER_RANGE, SAMPLE = 64, 512, 4096


def bounds(df: DataFrame, key: str, per_range: int = PER_RANGE) -> list:
    """Keys that cut a bounded sample of the distinct ones into even ranges."""
    ranges = min(SAMPLE, max(RANGES, df.count() // per_range))
    rows = df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(SAMPLE).collect()
    values = sorted(r[0] for r in rows)
    return sorted({values[len(values) * i // ranges] for i in range(1, ranges)} - {*values[:1]}) if values else []


def reached(at: list, column: str) -> Column:
    """How many bounds a key has reached: the number of its range, by halving, as
    there may be thousands."""
    if not at:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps(at)), "array<string>")  # folded to a literal
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(at).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(held, n + step - 1) <= F.col(column), n + step).otherwise(n))
