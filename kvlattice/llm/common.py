"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize, shared_dir  # noqa: F401  the operators take them from here
from ..sources.scratch import fresh as scratch  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot from this share of the rows; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 500
#: Rows, and bytes, that an Arrow batch brings to Python at most.
BATCH_ROWS, BATCH_BYTES = "16384", str(2 << 20)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and bounds an Arrow batch."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        have = os.pathsep.join(x for x in (ROOT, have) if x)
    env["PYTHONPATH"] = have
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that have ended. It does so
    when the driver's garbage is collected, which may otherwise be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` with a column _key that orders them as the id does and that no
    two of them share. Where ids are unique the key is the id itself; else rows
    are numbered in the order of id (null first) and text."""
    ids = rows.groupBy(F.col(id_col).alias("_key")).count()
    if not ids.filter("count > 1 or _key is null").limit(1).count():
        return rows.withColumn("_key", F.col(id_col))
    ordered = rows.repartitionByRange(id_col, text_col).sortWithinPartitions(id_col, text_col)
    return materialize(ordered.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def unique_ids(rows: DataFrame, id_col: str) -> bool:
    """Whether ids are there and tell all rows apart."""
    ids = rows.groupBy(F.col(id_col).alias("_key")).count()
    return not ids.filter("count > 1 or _key is null").limit(1).count()


def only(docs: DataFrame, kept: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``kept.id``, all columns as they are."""
    return docs.join(kept.select(F.col("id").alias("_kept_id")), docs[id_col].eqNullSafe(F.col("_kept_id")), "left_semi")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII takes Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lookup(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``big`` joined to the one row of ``small`` for its keys.

    ``small[count]`` is the number of rows that the key has in ``big``. Keys with
    more than HOT_SHARE of all rows are fewer than 1 / HOT_SHARE by arithmetic,
    so they are broadcast; all others go through an ordinary join, where no
    task gets more than a small share. Both frames should be materialized."""
    total = small.agg(F.sum(count)).first()[0] or 0
    limit = max(2000, int(total * HOT_SHARE))
    hot = small.filter(F.col(count) > limit)
    if not hot.limit(1).count():
        return big.join(small, keys)
    cold = small.filter(F.col(count) <= limit)
    return big.join(F.broadcast(hot), keys).unionByName(
        big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    )


#: Bits of the filter that narrowed() broadcasts, in words of 64.
FILTER_BITS = 1 << 23


def narrowed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is not in ``ids`` (any column
    types, same name): a join that follows shuffles less. The filter is a bitmap
    of hashed keys, at most FILTER_BITS / 64 rows whatever the input."""
    h = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = ids.select(h.alias("_h")).groupBy(F.expr("_h div 64").alias("_word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_h % 64 as int))")).alias("_mask"))
    hashed = rows.withColumn("_h", h).withColumn("_word", F.expr("_h div 64"))
    found = hashed.join(F.broadcast(words), "_word").filter("(shiftright(_mask, cast(_h % 64 as int)) & 1L) = 1")
    return found.select(*rows.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
