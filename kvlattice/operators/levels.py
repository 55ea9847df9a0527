"""Reads over levels of tables: pruned scans, and gets by key."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import bloom_hashes, passed
from ..sources.scratch import materialize
from ..sources.tables import read_tables
from .manifest import pick_tables
from .ordering import bounds, reached
from .reads import prefix_scan


def scan(spark: SparkSession, path: str, schema, manifest: DataFrame, prefix: str = "", since: int = 0) -> DataFrame:
    """The rows of a prefix from the tables that may have some, newer than a
    version, and from no other file."""
    return prefix_scan(read_tables(spark, path, schema, pick_tables(manifest, prefix, since)), prefix)


def sources(picked: DataFrame) -> DataFrame:
    """Adds the source that each picked table is read in: on level 0 its own,
    below all tables of a level, one after the other (-1)."""
    return picked.withColumn("source", F.when(F.col("level") == 0, F.col("table_id")).otherwise(F.lit(-1)))


def candidates(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """keys (user_key, ...) with the tables whose range holds the key: on level 0
    all of these, below at most one of a level. Keys are cut into ranges; a table
    is in each that it touches, so keys meet the tables near them only."""
    at = bounds(manifest, "smallest")
    tables = manifest.select("level", "table_id", "smallest", "biggest", F.explode(F.sequence(reached(at, "smallest"), reached(at, "biggest"))).alias("_range"))
    both = keys.withColumn("_range", reached(at, "user_key")).join(tables, "_range")
    return both.filter((F.col("user_key") >= F.col("smallest")) & (F.col("user_key") <= F.col("biggest"))).drop("_range", "smallest", "biggest")


#: Keys that a task holds while filters pass; pairs in a batch, at least.
KEYS, PAIRS = 1 << 16, 1 << 16


def may_hold(keys: DataFrame, manifest: DataFrame, filters: DataFrame) -> DataFrame:
    """keys (user_key, ...) with the tables that may hold them: the candidates whose
    filter, if there is one, does not rule the key out. A task holds the keys of a
    range, or a part of them, hashed once; the filters of the tables that touch the
    range pass one at a time. So a pair that a filter rules out is never a row."""
    keys = keys.filter("user_key is not null")
    at = bounds(keys, "user_key", KEYS)
    placed = keys.select(reached(at, "user_key").alias("_range"), F.struct(*keys.columns).alias("_row"))
    parts = placed.groupBy("_range").agg(F.ceil(F.count("*") / KEYS).cast("int").alias("_parts"))
    own = placed.join(F.broadcast(parts), "_range").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))  # a row for each range
    tables = manifest.select("level", "table_id", "smallest", "biggest").join(filters.select("table_id", "bloom"), "table_id", "left")
    near = tables.withColumn("_range", F.explode(F.sequence(reached(at, "smallest"), reached(at, "biggest"))))
    near = near.join(F.broadcast(parts), "_range").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    fields = [*keys.schema.fields, *(manifest.schema[c] for c in ("level", "table_id"))]
    both = own.withColumn("_kind", F.lit(0)).unionByName(near.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    both = both.select("_range", "_part", "_kind", "_row", "level", "table_id", F.col("smallest").cast("binary"), F.col("biggest").cast("binary"), "bloom")
    return both.repartition("_range", "_part").sortWithinPartitions("_range", "_part", "_kind").mapInArrow(_probed, T.StructType(fields))


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (range, part, keys before tables): keys and their tables."""
    now, held, rows, keys, hashes = None, [], None, [], None
    found, n = [], 0

    def batch_of() -> pa.RecordBatch:
        sizes = [len(places) for *_, places in found]
        level, table = (pa.array([f[i] for f in found], kinds[i]).take(pa.array(np.repeat(np.arange(len(found)), sizes))) for i in (0, 1))
        own = rows.take(pa.array(np.concatenate([places for *_, places in found])))
        return pa.RecordBatch.from_arrays([*own.flatten(), level, table], [*(f.name for f in own.type), "level", "table_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field(c).type for c in ("level", "table_id")]
        cells = np.stack([batch.column(c).to_numpy() for c in ("_range", "_part", "_kind")], 1)
        edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            cell, kind = tuple(cells[a, :2].tolist()), cells[a, 2]
            if cell != now:
                if found:
                    yield batch_of()
                now, held, rows, found, n = cell, [], None, [], 0
            some = batch.slice(a, b - a)
            if kind == 0:
                held.append(some.column("_row"))
                continue
            if rows is None and held:
                rows = pa.concat_arrays(held)
                keys = rows.field("user_key").cast(pa.binary()).to_pylist()
                order = sorted(range(len(keys)), key=keys.__getitem__)
                rows, keys = rows.take(pa.array(order)), [keys[i] for i in order]
                hashes = bloom_hashes(keys)
            if rows is None:
                continue
            for level, table, smallest, biggest, bloom in zip(*[some.column(c).to_pylist() for c in ("level", "table_id", "smallest", "biggest", "bloom")], strict=True):
                low, high = bisect_left(keys, smallest), bisect_right(keys, biggest)
                places = np.arange(low, high) if bloom is None else low + passed(bloom, hashes[low:high])
                if len(places):
                    found.append((level, table, places))
                    n += len(places)
                if n >= PAIRS:
                    yield batch_of()
                    found, n = [], 0
    if found:
        yield batch_of()


def get(spark: SparkSession, path: str, schema, manifest: DataFrame, filters: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (user_key, at): of each the newest version <= at over all levels.
    Tables come from the manifest and lose those whose filter rules the key out;
    what is left is read, and each key's newest version stays."""
    may = materialize(may_hold(materialize(asked, "asked"), manifest, filters), "candidates")
    rows = read_tables(spark, path, schema, may.select("level", "table_id"))
    rest = [c for c in rows.columns if c not in ("user_key", "level", "table_id")]
    found = rows.join(may, ["level", "table_id", "user_key"]).filter(F.col("version") <= F.col("at"))
    best = found.groupBy("user_key", "at").agg(F.max_by(F.struct("level", "table_id", *rest), F.struct("version", "seq")).alias("_row"))
    return best.select("user_key", "at", *[F.col(f"_row.{c}").alias(c) for c in ("level", "table_id", *rest)])
