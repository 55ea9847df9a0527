"""The data model: one canonical row type for logs, and its order.

The canonical order E is ``user_key ASC, version DESC``: newer versions of a key
come first. Keys are equal when user keys are, whatever the versions; merges
however compare key and version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of the meta byte.
DELETE, VALUE_POINTER, DISCARD_EARLIER, MERGE_ENTRY, TXN, FIN_TXN = 1, 2, 4, 8, 64, 128

KV_LOG = T.StructType(
    [
        T.StructField("user_key", T.StringType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("meta", T.IntegerType(), False),
        T.StructField("user_meta", T.IntegerType(), False),
        T.StructField("expires_at", T.LongType(), False),
        T.StructField("level", T.IntegerType()),
        T.StructField("table_id", T.LongType()),
        T.StructField("fid", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
MANIFEST = "table_id long, level int, smallest string, biggest string, max_version long, key_count long, size long, stale_size long"


def canonical(reverse: bool = False) -> list[Column]:
    """Sort columns of E, or of its reverse."""
    if reverse:
        return [F.col("user_key").desc(), F.col("version").asc()]
    return [F.col("user_key").asc(), F.col("version").desc()]


def has(bit: int, meta: str = "meta") -> Column:
    return F.col(meta).bitwiseAND(F.lit(bit)) != 0


def dead(now: int, meta: str = "meta", expires_at: str = "expires_at") -> Column:
    """Deleted, or expired: an expiry of 0 is never, the second itself is over."""
    e = F.col(expires_at)
    return has(DELETE, meta) | ((e != 0) & (e <= F.lit(now)))
