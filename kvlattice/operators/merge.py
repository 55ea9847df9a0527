"""Ordered combinations of several sorted inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FIN_TXN, canonical, has


def concat(tables: list[DataFrame], reverse: bool = False) -> DataFrame:
    """Tables with separate key ranges, one after the other in the order E."""
    return reduce(DataFrame.unionByName, tables).orderBy(*canonical(reverse), "seq")


def merge(tables: list[DataFrame]) -> DataFrame:
    """One row for each (user_key, version): that of the first table which has
    it, and the last one written there. Versions of a key all stay. min_by keeps
    one candidate on the map side."""
    ranked = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    both, rest = reduce(DataFrame.unionByName, ranked), [c for c in tables[0].columns if c not in ("user_key", "version")]
    best = both.groupBy("user_key", "version").agg(F.min_by(F.struct(*rest, "_src"), F.struct(F.col("_src"), (-F.col("seq")).alias("_late"))).alias("_row"))
    return best.select("user_key", "version", *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_row._src").alias("src"))


def level_zero_get(log: DataFrame, key: str, at: int) -> DataFrame:
    """A point read over overlapping tables: the highest version <= at; of equal
    versions that of the newest table."""
    found = log.filter((F.col("user_key") == key) & (F.col("version") <= at))
    return found.orderBy(F.desc("version"), F.desc("table_id"), F.desc("seq")).limit(1)


def insert(writes: DataFrame) -> DataFrame:
    """What a memtable holds after its writes: of each (user_key, version) the
    last one. Ends of transactions go to the log only."""
    kept = writes.filter(~has(FIN_TXN))
    rest = [c for c in writes.columns if c not in ("user_key", "version")]
    last = kept.groupBy("user_key", "version").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_row"))
    return last.select("user_key", "version", *[F.col(f"_row.{c}").alias(c) for c in rest])


def memtable_stats(table: DataFrame) -> DataFrame:
    """Entries, bytes of keys and values, and the largest version."""
    size = F.octet_length("user_key") + 8 + F.octet_length("value")
    return table.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("mem_size"), F.max("version").alias("max_version"))
