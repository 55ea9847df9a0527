"""A store in a folder: levels of sorted tables, written, read, compacted, verified.

Rows are those of ``model.KV_LOG`` (level and table_id are given here). A write is
a table of level 0; a compaction puts all tables into one level below. A
manifest, written anew by each change, names the live tables, so readers of
an older one are not disturbed and files that no manifest names are no part of
the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codecs import table_filters
from .model import KV_LOG, MANIFEST
from .operators import gc, levels, manifest, merge, reads, vlog
from .sources.tables import read_tables, write_tables

#: Level 0 takes no more tables than this before a compaction.
STALL = 15


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.change, self.number = spark, path.rstrip("/"), 0, 0
        self.live = spark.createDataFrame([], MANIFEST)

    @classmethod
    def open(cls, spark: SparkSession, path: str, change: int) -> Store:
        """The store as its change number ``change`` left it."""
        out = cls(spark, path)
        out.change, out.live = change, spark.read.schema(MANIFEST).parquet(f"{out.path}/manifest-{change}")
        return out

    def _commit(self, live: DataFrame) -> None:
        path = f"{self.path}/manifest-{self.change + 1}"
        live.select(*self.live.columns).write.parquet(path)
        self.live, self.change = self.spark.read.schema(MANIFEST).parquet(path), self.change + 1

    def _add(self, rows: DataFrame, level: int, live: DataFrame) -> None:
        table = self.number = max(self.number, self.live.agg(F.max("table_id")).first()[0] or 0) + 1  # never used again
        placed = rows.withColumns({"level": F.lit(level), "table_id": F.lit(table).cast("long")}).select(*KV_LOG.names)
        write_tables(placed, self.path + "/tables")
        stats = manifest.table_stats(read_tables(self.spark, self.path + "/tables", KV_LOG, self.spark.createDataFrame([(level, table)], "level int, table_id long")))
        self._commit(live.unionByName(stats.select(*self.live.columns)))

    def write(self, writes: DataFrame) -> None:
        """A batch of writes: the last of each key and version, as a table of level 0."""
        if self.live.filter("level = 0").count() >= STALL:
            raise RuntimeError("level 0 is full: compact the store")
        self._add(merge.insert(writes), 0, self.live)

    def rows(self) -> DataFrame:
        """All rows; of equal keys and versions that of the newest table."""
        every = read_tables(self.spark, self.path + "/tables", KV_LOG, self.live)
        rest = [c for c in every.columns if c not in ("user_key", "version")]
        best = every.groupBy("user_key", "version").agg(F.max_by(F.struct(*rest), F.struct((-F.col("level")).alias("l"), "table_id")).alias("_r"))
        return best.select("user_key", "version", *[F.col(f"_r.{c}").alias(c) for c in rest])

    def get(self, asked: DataFrame) -> DataFrame:
        """asked (user_key, at): the newest version of each at that version."""
        filters = table_filters(read_tables(self.spark, self.path + "/tables", KV_LOG, self.live))
        return levels.get(self.spark, self.path + "/tables", KV_LOG, self.live, filters, asked)

    def scan(self, prefix: str = "", since: int = 0, reverse: bool = False) -> DataFrame:
        """Rows of a prefix newer than a version, in order, from the tables that may have some."""
        found = reads.since(levels.scan(self.spark, self.path + "/tables", KV_LOG, self.live, prefix, since), since)
        return reads.scan(found, reverse)

    def latest(self, now: int, at: int | None = None) -> DataFrame:
        return reads.latest_visible(self.rows(), now, at)

    def compact(self, keep: int, now: int) -> None:
        """One table, a level below, of what a full compaction keeps."""
        level = (self.live.agg(F.max("level")).first()[0] or 0) + 1
        self._add(gc.compact(self.rows(), keep, now), level, self.live.limit(0))

    def verify(self, checksums: DataFrame) -> DataFrame:
        """Rows whose checksum is not the one in checksums (user_key, version, crc)."""
        return vlog.verify(self.rows().join(checksums, ["user_key", "version"])).filter(~F.col("intact"))

    def checksums(self) -> DataFrame:
        return vlog.with_checksum(self.rows()).select("user_key", "version", "crc")
