"""Sources: versioned logs from tables, and sorted tables on storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import KV_LOG, canonical
from .wal import _store


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: a key for each user, a version for each event."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("user_key"),
        (e + 1).alias("version"),
        F.col("props").alias("value"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 4).otherwise(0).alias("meta"),
        F.lit(0).alias("user_meta"),
        F.when(e % 7 == 0, e).otherwise(F.lit(0)).cast("long").alias("expires_at"),
        (F.floor(e / 1000) % 3).cast("int").alias("level"),
        F.floor(e / 1000).cast("long").alias("table_id"),
        F.floor(e / 500).cast("long").alias("fid"),
        e.alias("seq"),
    )


def file_name(table_id, suffix: str = "sst"):
    """Six digits at least, as in 000042.sst."""
    return F.concat(F.when(table_id < 1_000_000, F.lpad(table_id.cast("string"), 6, "0")).otherwise(table_id.cast("string")), F.lit(f".{suffix}"))


def parse_file_id(name, suffix: str = "sst"):
    """The id in a path like /a/000042.sst; null for any other name."""
    found = F.regexp_extract(name, rf"(?:^|/)(\d+)\.{suffix}$", 1)
    return F.when(found != "", found.cast("long"))


def write_table(df: DataFrame, path: str, rows_per_file: int = 0, compression: str = "zstd") -> None:
    """A sorted table: ranges of keys in files, each sorted by E, with Parquet's
    statistics and Bloom filters in place of an index and a filter block."""
    out = df.repartitionByRange(*canonical()).sortWithinPartitions(*canonical()).write
    out = out.option("compression", compression).option("parquet.bloom.filter.enabled#user_key", "true")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    out.mode("overwrite").parquet(path)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: So many picked tables are named in the scan itself; more are opened by tasks.
NAMED = 1000
#: Rows of a table that a writer holds at a time, and rows of a batch that is read.
HELD, READ = 1 << 17, 1 << 14
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _reachable(path: str) -> bool:
    """Whether Arrow's file systems reach a path; Spark's reach more."""
    try:
        _store(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _folder(at: str, level, table_id) -> str:
    level, table_id = (NO_VALUE if x is None else x for x in (level, table_id))
    return f"{at}/level={level}/table_id={table_id}"


def write_tables(log: DataFrame, path: str) -> None:
    """A folder for each table, so that a scan of some opens these only. A table
    is bounded in size, so a task may write it. Its file gets its name when it is
    complete, and the same name if a task runs again; other tables stay."""
    placed = log.repartition("level", "table_id").sortWithinPartitions("level", "table_id", *canonical())
    if not _reachable(path):
        placed.write.mode("append").partitionBy("level", "table_id").parquet(path)
        return
    name = f"part-{uuid.uuid4().hex}.parquet"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(path)
        now, held, size, out, part = None, [], 0, None, None

        def flush() -> None:
            nonlocal held, size, out, part
            if not held:
                return
            rows = pa.Table.from_batches(held)
            if out is None:
                folder = _folder(at, *now)
                store.create_dir(folder, recursive=True)
                part = f"{folder}/_{uuid.uuid4().hex}"
                out = pq.ParquetWriter(part, rows.schema, filesystem=store, store_schema=False)
            out.write_table(rows)
            held, size = [], 0

        def close() -> None:
            nonlocal out
            flush()
            if out is not None:
                out.close()
                store.move(part, f"{_folder(at, *now)}/{name}")
                out = None

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, cut = [batch.column("level"), batch.column("table_id")], np.zeros(n - 1, bool)
            for k in keys:
                x, there = k.fill_null(0).to_numpy(), k.is_valid().to_numpy(zero_copy_only=False)
                cut |= (x[1:] != x[:-1]) | (there[1:] != there[:-1])
            rows = batch.select([c for c in batch.schema.names if c not in ("level", "table_id")])
            starts = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
            for a, b in pairwise(starts):
                table = tuple(k[a].as_py() for k in keys)
                if table != now:
                    close()
                    now = table
                held.append(rows.slice(a, b - a))
                size += b - a
                if size >= HELD:
                    flush()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    store, at = _store(path)
    store.create_dir(at, recursive=True)
    placed.mapInArrow(run, "n long").count()


def read_tables(spark: SparkSession, path: str, schema, picked: DataFrame) -> DataFrame:
    """The rows of the picked tables (level, table_id), and no other file. Many
    tables are opened one after the other by the tasks that they are dealt to, so
    no folder but theirs is listed."""
    few = picked.select("level", "table_id").distinct().limit(NAMED + 1).collect()
    if len(few) > NAMED and _reachable(path):
        return _opened(path, schema, picked)
    tables = spark.read.schema(schema).parquet(path)
    if len(few) > NAMED:
        return tables.join(picked.select("level", "table_id").distinct(), ["level", "table_id"], "left_semi")
    named = [(F.col("level") == lv) & F.col("table_id").isin([r.table_id for r in few if r.level == lv]) for lv in sorted({r.level for r in few})]
    return tables.filter(reduce(Column.__or__, named)) if named else tables.limit(0)


def _opened(path: str, schema: T.StructType, picked: DataFrame) -> DataFrame:
    fields = [f for f in schema.fields if f.name not in ("level", "table_id")]
    out = T.StructType([*fields, *(f for f in schema.fields if f.name in ("level", "table_id"))])  # as Spark has them
    wanted = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(path)
        for batch in batches:
            for level, table_id in zip(batch.column("level").to_pylist(), batch.column("table_id").to_pylist(), strict=True):
                folder = fs.FileSelector(_folder(at, level, table_id), allow_not_found=True)
                for info in store.get_file_info(folder):
                    if info.is_file and not info.base_name.startswith(("_", ".")):
                        with pq.ParquetFile(info.path, filesystem=store) as file:
                            have = [f.name for f in fields if f.name in file.schema_arrow.names]
                            for rows in file.iter_batches(READ, columns=have):
                                own = {"level": level, "table_id": table_id}
                                yield pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) if f.name in have else pa.array([own.get(f.name)] * rows.num_rows, f.type) for f in wanted], wanted.names)

    # a row here is a table's work: the number is named and the key another than distinct's, so that partitions stay
    parts = int(picked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = picked.select("level", "table_id").distinct().repartition(parts, F.xxhash64("level", "table_id"))
    return dealt.mapInArrow(run, out).hint("merge")  # Spark takes the rows for as few as the tables, and would broadcast them


def open_in_memory(spark: SparkSession, rows: list[tuple], name: str, schema=KV_LOG) -> DataFrame:
    """A table of rows that a driver holds, under a name of this session."""
    df = spark.createDataFrame(rows, schema).orderBy(*canonical())
    df.createOrReplaceTempView(name)
    return df


def create_table(log: DataFrame, path: str, **options) -> DataFrame:
    """Writes a sorted table and opens it."""
    write_table(log, path, **options)
    return open_table(log.sparkSession, path)
