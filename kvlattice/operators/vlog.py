"""Value separation: large values move to a value log and leave a pointer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs_sql import varint_size
from ..model import FIN_TXN, TXN, VALUE_POINTER, canonical
from .ordering import ordered_fold, running_sum

#: Bytes of a log file's header, of a checksum, of a pointer.
FILE_HEADER, CHECKSUM, POINTER = 20, 4, 12
#: The largest offset a pointer can hold.
MAX_OFFSET = (1 << 32) - 1


def header_size() -> Column:
    """Two meta bytes and three variable-length integers."""
    return F.lit(2) + varint_size(F.octet_length("user_key") + 8) + varint_size(F.octet_length("value")) + varint_size(F.col("expires_at"))


def record_size() -> Column:
    """Header, key with its 8-byte version, value, checksum."""
    return header_size() + F.octet_length("user_key") + 8 + F.octet_length("value") + CHECKSUM


def split_values(log: DataFrame, threshold: int) -> DataFrame:
    """Adds len and offset (in the file ``fid``) where the value moves to the
    value log; both are null where it stays in line. TXN and FIN bits are not
    written."""
    out = F.octet_length("value") >= threshold
    size = F.when(out, record_size()).otherwise(0)
    before = Window.partitionBy("fid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(size).over(before), F.lit(0)) + FILE_HEADER
    return log.withColumns(
        {
            "in_log": out,
            "len": F.when(out, size).cast("long"),
            "offset": F.when(out, offset).cast("long"),
            "meta": F.when(out, F.col("meta").bitwiseAND(F.lit(255 - TXN - FIN_TXN)).bitwiseOR(F.lit(VALUE_POINTER))).otherwise(F.col("meta")),
        }
    )


def rotate(log: DataFrame, file_size: int, threshold: int, max_entries: int = 1_000_000) -> DataFrame:
    """``rotate_requests`` with a request for each record."""
    return rotate_requests(log.withColumn("request", F.col("seq")), file_size, threshold, max_entries).drop("request")


def rotate_requests(log: DataFrame, file_size: int, threshold: int, max_entries: int = 1_000_000) -> DataFrame:
    """Adds new_fid and new_offset of the values that move to the value log, null
    where they stay in line. Each ``fid`` is a log of its own whose requests
    (``request``, in the order of ``seq``) are written whole: a new file starts
    behind the one that passes file_size or max_entries. Requests whose largest
    size passes MAX_OFFSET fail the run, as in the store's check before a write."""

    def make():
        log = request = None
        file = at = written = checked = asked = 0

        def validate() -> None:
            nonlocal checked, asked
            checked, asked = checked + asked, 0
            if checked > MAX_OFFSET:
                raise ValueError(f"a request of log {log} ends at {checked}, beyond {MAX_OFFSET}")
            if checked >= file_size:
                checked = 0

        def step(fid, req, size, asks):
            nonlocal log, request, file, at, written, checked, asked
            if fid != log:
                log, file, at, written, checked, asked = fid, 0, FILE_HEADER, 0, FILE_HEADER, 0
            elif req != request:
                validate()
                if at > file_size or written > max_entries:
                    file, at, written = file + 1, FILE_HEADER, 0
            request, asked = req, asked + asks
            if checked + asked > MAX_OFFSET:
                validate()
            if size is None:
                return None, None
            here, at, written = at, at + size, written + 1
            return file, here

        return step

    v = F.octet_length("value")
    rows = log.withColumns({"_size": F.when(v >= threshold, record_size()).cast("long"), "_asks": (F.octet_length("user_key") + v + 25).cast("long")})
    return ordered_fold(rows, "fid", [F.col("seq")], ["request", "_size", "_asks"], make, {"new_fid": "long", "new_offset": "long"}).drop("_size", "_asks")


def cut_tables(log: DataFrame, table_size: int) -> DataFrame:
    """Adds the output file of each entry of a table: a file ends behind the entry
    with which its keys and values pass 0.95 * table_size. What a block adds to
    them is not counted."""
    capacity = int(table_size * 0.95)

    def make():
        table, file, total = None, 0, 0

        def step(table_id, size):
            nonlocal table, file, total
            if table_id != table:
                table, file, total = table_id, 0, 0
            elif total > capacity:
                file, total = file + 1, 0
            total += size
            return (file,)

        return step

    rows = log.withColumn("_size", (F.octet_length("user_key") + F.octet_length("value")).cast("long"))
    return ordered_fold(rows, "table_id", [*canonical(), F.col("seq")], ["_size"], make, {"file": "long"}).drop("_size")


def read_pointers(pointers: DataFrame, values: DataFrame) -> DataFrame:
    """pointers (fid, offset, len) to their records; lengths must agree."""
    return pointers.join(values.withColumnRenamed("len", "_len"), ["fid", "offset"]).filter(F.col("len") == F.col("_len")).drop("_len")


def estimated_size(threshold: int) -> Column:
    """Bytes of an entry in the tree: key, and value or pointer with two metas."""
    v = F.octet_length("value")
    return F.octet_length("user_key") + F.when(v < threshold, v + 2).otherwise(POINTER + 2)


def encoded_value_size() -> Column:
    return F.octet_length("value") + 2 + varint_size(F.col("expires_at"))


def request_size() -> Column:
    """Largest header, key, value and checksum."""
    return F.sum(F.octet_length("user_key") + F.octet_length("value") + 25)


def validate_writes(log: DataFrame, file_size: int, limit: int = MAX_OFFSET) -> DataFrame:
    """A row for each ``request`` of each ``fid``: the offset at which it would
    end, by its largest size, and whether that is within the limit. Behind a
    request that reaches file_size the count starts anew, at 0; behind one over
    the limit it stays, as the store refuses the write there."""

    def make():
        log = at = None

        def step(fid, size):
            nonlocal log, at
            if fid != log:
                log, at = fid, FILE_HEADER
            end = at + size
            at = at if end > limit else 0 if end >= file_size else end
            return end, int(end <= limit)

        return step

    asked = log.groupBy("fid", "request").agg(request_size().cast("long").alias("size"))
    out = ordered_fold(asked, "fid", [F.col("request")], ["size"], make, {"end": "long", "valid": "long"})
    return out.withColumn("valid", F.col("valid") == 1)


def batches(log: DataFrame, max_bytes: int, max_count: int, threshold: int) -> DataFrame:
    """Adds the batch of each entry that a log file's rewrite puts back, in the
    order of ``seq``: an entry opens a new batch if with it the batch would have
    max_count entries or max_bytes (its size in the tree and its value's)."""

    def make():
        log = batch = count = total = None

        def step(fid, size):
            nonlocal log, batch, count, total
            if fid != log:
                log, batch, count, total = fid, 0, 0, 0
            elif count and (count + 1 >= max_count or total + size >= max_bytes):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + size
            return (batch,)

        return step

    rows = log.withColumn("_size", (estimated_size(threshold) + F.octet_length("value")).cast("long"))
    return ordered_fold(rows, "fid", [F.col("seq")], ["_size"], make, {"batch": "long"}).drop("_size")


#: Entries of a batch to begin with, as a rewrite puts them back.
FIRST_BATCH = 1024


def halved_batches(log: DataFrame, max_bytes: int, max_count: int, threshold: int) -> DataFrame:
    """fid, seq and batch: each file's entries in order, FIRST_BATCH to a batch. A
    batch of max_bytes or max_count or more is halved, as are all behind it; one
    entry that is too large fails the run. A task holds a batch at a time."""
    rows = log.select("fid", "seq", estimated_size(threshold).cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, number, held = None, FIRST_BATCH, 0, []
        out: list[tuple] = []

        def take(last: bool) -> None:
            nonlocal size, number, held
            while held and (last or len(held) >= size):
                part = held[:size]
                if sum(x[1] for x in part) >= max_bytes or len(part) >= max_count:
                    size //= 2
                    if not size:
                        raise ValueError(f"an entry of file {now} is too large for a batch")
                    continue
                out.extend((now, seq, number) for seq, _ in part)
                held, number = held[size:], number + 1

        for batch in batches:
            for fid, seq, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if fid != now:
                    take(True)
                    now, size, number = fid, FIRST_BATCH, 0
                held.append((seq, n))
                take(False)
            if out:
                yield _longs(out, ["fid", "seq", "batch"])
                out.clear()
        take(True)
        if out:
            yield _longs(out, ["fid", "seq", "batch"])

    return rows.repartition("fid").sortWithinPartitions("fid", "seq").mapInArrow(run, "fid long, seq long, batch long")


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def open_files(files: DataFrame) -> DataFrame:
    """files (fid, size): those that stay when a value log is opened. An empty one
    (its header only) goes, but for the newest, which is written next."""
    newest = files.agg(F.max("fid").alias("_max"))
    kept = files.join(F.broadcast(newest)).filter((F.col("size") > FILE_HEADER) | (F.col("fid") == F.col("_max")))  # one row
    return kept.withColumn("writable", F.col("fid") == F.col("_max")).drop("_max")


def with_checksum(log: DataFrame) -> DataFrame:
    """Adds the CRC-32 of each record's key and value."""
    return log.withColumn("crc", F.crc32(F.concat(F.col("user_key").cast("binary"), F.col("value").cast("binary"))))


def verify(records: DataFrame) -> DataFrame:
    """Adds whether a record (crc) still has its checksum."""
    return records.withColumn("intact", F.col("crc") == F.crc32(F.concat(F.col("user_key").cast("binary"), F.col("value").cast("binary"))))


def size_percentile(log: DataFrame, p: float) -> DataFrame:
    """The smallest value size that p of all values reach at most, exactly: the
    sizes are counted first, so the distinct sizes alone are ordered."""
    sizes = log.groupBy(F.octet_length("value").cast("long").alias("size")).agg(F.count("*").alias("n"))
    placed = running_sum(sizes, [F.col("size")], F.col("n"), "upto", inclusive=True)
    total = sizes.agg(F.sum("n").alias("total"))
    return placed.join(F.broadcast(total)).filter(F.col("upto") >= F.col("total") * p).agg(F.min("size").alias("threshold"))
