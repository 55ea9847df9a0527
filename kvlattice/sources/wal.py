"""Log files: a DataFrame reader and writer, and the Python data source ``kvwal``.

A file is named like 000001.vlog and starts with a 20-byte header (8 bytes key
id, 12 bytes base vector). Records follow until the first that is cut off or has
a wrong checksum. Files are read through Spark (``read_wal``) or Arrow's file
systems (``kvwal``), so any store will do; one file is one task's work, and
rotation bounds it. A writer's file gets its name when it is complete, so a task
that runs again leaves no half of one."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.codecs import decode_record, encode_record
from ..functions.codecs_sql import record_bytes, u64_big_endian

HEADER, ROWS = 20, 4096
NAME = re.compile(r"(\d{6,})\.vlog$")
SCHEMA = "fid long, offset long, len long, user_key binary, version long, value binary, meta int, user_meta int, expires_at long"
FIELDS = ["offset", "len", "user_key", "version", "value", "meta", "user_meta", "expires_at"]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class LogFileWriter:
    """One log file, which gets its name when it is closed. One that is set aside
    is opened again, at its end, by the next write (where the store appends)."""

    def __init__(self, folder: str, fid: int, key_id: int = 0, base: bytes = bytes(12)):
        self.store, at = _store(folder)
        self.store.create_dir(at, recursive=True)
        self.path, self.part = f"{at}/{fid:06d}.vlog", f"{at}/_{uuid.uuid4().hex}"
        self.out, self.size = self.store.open_output_stream(self.part), 0
        self.write(key_id.to_bytes(8, "big") + base)

    def write(self, data: bytes) -> int:
        """Appends, and returns where the data begin."""
        if self.out.closed:
            self.out = self.store.open_append_stream(self.part)
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def set_aside(self) -> None:
        self.out.close()

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)


class WalWriter:
    """Appends records to a local log file."""

    def __init__(self, folder: str, fid: int, key_id: int = 0, base: bytes = bytes(12)):
        self.path = os.path.join(folder, f"{fid:06d}.vlog")
        with open(self.path, "wb") as f:
            f.write(key_id.to_bytes(8, "big") + base)

    def append(self, key: bytes, version: int, value: bytes, **meta: int) -> int:
        with open(self.path, "ab") as f:
            at = f.tell()
            f.write(encode_record(key, version, value, **meta))
        return at


def write_wal(log: DataFrame, folder: str) -> DataFrame:
    """Writes each ``fid`` of a log, in the order of ``seq``, as a file; fid, seq,
    offset and len of its records. Records are encoded by Spark's functions."""
    rows = log.select("fid", "seq", record_bytes(F.col("user_key"), F.col("version"), F.col("value"), F.col("meta"), F.col("user_meta"), F.col("expires_at")).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            out = []
            for fid, seq, record in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if fid != now:
                    if file:
                        file.close()
                    now, file = fid, LogFileWriter(folder, fid)
                out.append((fid, seq, file.write(record), len(record)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["fid", "seq", "offset", "len"])
        if file:
            file.close()

    return rows.repartition("fid").sortWithinPartitions("fid", "seq").mapInArrow(run, "fid long, seq long, offset long, len long")


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """fid, size, content, key_id and base vector of the log files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vlog").load(folder)
    fid = F.regexp_extract("path", NAME.pattern, 1).cast("long")
    return files.select(fid.alias("fid"), F.col("length").alias("size"), "content", u64_big_endian(F.substring("content", 1, 8)).cast("long").alias("key_id"), F.substring("content", 9, 12).alias("base"))


def _records(fid: int, data: bytes, start: int) -> Iterator[tuple]:
    at = start
    while found := decode_record(data, at):
        r, size = found
        yield (fid, *(r[c] for c in FIELDS))
        at += size


def read_wal(spark: SparkSession, folder: str, start: int = HEADER) -> DataFrame:
    """The records of all files of a folder, each from an offset on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fid, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(_records(fid, data.as_py(), start))

    return log_files(spark, folder).select("fid", "content").mapInArrow(run, SCHEMA)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _TYPES, strict=True)], ["fid", *FIELDS])


def read_raw(files: DataFrame, pointers: DataFrame) -> DataFrame:
    """The bytes at each pointer (fid, offset, len), null beyond the end. A file
    meets all its pointers at once, so its bytes move once."""
    asked = pointers.groupBy("fid").agg(F.collect_list(F.struct("offset", "len")).alias("asked"))
    cut = F.transform("asked", lambda p: F.struct(p["offset"].alias("offset"), p["len"].alias("len"), _slice(F.col("content"), p, F.col("size")).alias("raw")))
    return files.join(asked, "fid").select("fid", F.explode(cut).alias("r")).select("fid", "r.*")


def _slice(content: Column, p: Column, size: Column) -> Column:
    return F.when(p["offset"] + p["len"] <= size, F.substring(content, (p["offset"] + 1).cast("int"), p["len"].cast("int")))


#: Bytes of log files that a task reads, one file after the other, and files that a task has open.
READ, OPEN = 16 << 20, 64


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, folder: str, start: int):
        self.folder, self.start = folder, start

    def partitions(self) -> list[_Files]:
        store, at = _store(self.folder)
        out, size = [], READ
        for x in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
            if m := NAME.search(x.path):
                if size + x.size > READ:
                    out, size = [*out, []], 0
                out[-1].append((int(m[1]), x.path))
                size += x.size
        return [_Files(x) for x in out]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)

        def records() -> Iterator[tuple]:
            for fid, path in partition.files:
                with store.open_input_stream(path) as f:
                    data = f.read()
                yield from _records(fid, data, self.start)

        yield from _batches(records())


class _Writer(DataSourceArrowWriter):
    """Rows of one ``fid`` belong into one partition, in their order."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files: dict[int, LogFileWriter] = {}
        open_: dict[int, LogFileWriter] = {}  # the one that was written last comes last
        for batch in batches:
            for fid, key, version, value, meta, user_meta, expires_at in zip(*[batch.column(c).to_pylist() for c in ("fid", *FIELDS[2:])], strict=True):
                if fid not in files:
                    files[fid] = LogFileWriter(self.folder, fid)
                open_[fid] = open_.pop(fid, files[fid])
                if len(open_) > OPEN:
                    open_.pop(next(iter(open_))).set_aside()
                files[fid].write(encode_record(key, version, value, meta, user_meta, expires_at))
        for file in files.values():
            file.close()
        return WriterCommitMessage()


class WalSource(DataSource):
    """Options: path, and offset (where to begin in each file)."""

    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("offset", HEADER)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])
