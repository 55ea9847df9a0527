"""Append buffers: framed records, their offsets, and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import row_number, running_sum

#: Bytes in front of a buffer and of each record.
PADDING, FRAME = 8, 4


def offsets(records: DataFrame) -> DataFrame:
    """records (seq, rec): adds the offset of each one."""
    size = (F.octet_length("rec") + FRAME).cast("long")
    return running_sum(records, [F.col("seq")], size, "_at").withColumn("offset", F.col("_at") + PADDING).drop("_at")


def slices(records: DataFrame) -> DataFrame:
    """Records that are not empty, with the offset of the one behind."""
    out = offsets(records).withColumn("next", F.col("offset") + FRAME + F.octet_length("rec"))
    return out.filter(F.octet_length("rec") > 0)


#: Characters of a record that bounds between ranges are made of.
BOUND = 256


def sort(records: DataFrame) -> DataFrame:
    """Adds the place of each record in sorted order; ties by seq."""
    return row_number(records, [F.col("rec"), F.col("seq")], "place", [F.substring("rec", 1, BOUND)])


def sort_between(records: DataFrame, start: int, end: int) -> DataFrame:
    """Sorts the records at offsets in [start, end) and leaves all others."""
    placed = offsets(records)
    inside = (F.col("offset") >= start) & (F.col("offset") < end)
    slots = row_number(placed.filter(inside), [F.col("seq")], "slot").select("slot", F.col("seq").alias("at"))
    moved = row_number(placed.filter(inside), [F.col("rec"), F.col("seq")], "slot", [F.substring("rec", 1, BOUND)]).select("slot", "rec")
    fixed = placed.filter(~inside).select(F.col("seq").alias("at"), "rec")
    return fixed.unionByName(slots.join(moved, "slot").select("at", "rec"))


def fitting(records: DataFrame, max_size: int) -> DataFrame:
    """The records that a buffer of max_size bytes takes, up to the first that it
    has no room for."""
    return offsets(records).filter(F.col("offset") + FRAME + F.octet_length("rec") <= max_size)


def for_each(records: DataFrame, f, name: str) -> DataFrame:
    """Adds what ``f`` (of a column) gives for every record that is not empty."""
    return records.filter(F.octet_length("rec") > 0).withColumn(name, f(F.col("rec")))


def sizes(records: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.octet_length("rec") + FRAME), F.lit(0)).cast("long")
    return records.agg((total + PADDING).alias("with_padding"), total.alias("without_padding"), (F.count("*") == 0).alias("empty"))
