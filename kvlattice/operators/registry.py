"""Data keys: a small table of encryption keys by id, and its file.

The keys are hidden by a secret (AES in GCM mode); a sanity text beside them
tells a wrong secret before any key is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(keys: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (key_id, data, iv, created_at); a new row replaces its key."""
    return keys.join(new, "key_id", "left_anti").unionByName(new)


def latest(keys: DataFrame, now: int, rotation: int) -> DataFrame:
    """The newest key, and whether it is still within its rotation period."""
    best = keys.agg(F.max_by(F.struct("key_id", "created_at"), F.struct("created_at", "key_id")).alias("_k"))
    return best.select(F.col("_k.key_id").alias("key_id"), F.col("_k.created_at").alias("created_at"), (F.lit(now) - F.col("_k.created_at") < rotation).alias("valid"))


def with_data_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds the data of each row's key (null for key 0, plain text) and whether
    the id is unknown."""
    known = keys.select(F.col("key_id").alias("_id"), F.col("data").alias("key_data"))
    out = rows.join(known, rows["key_id"] == F.col("_id"), "left")
    return out.withColumn("unknown", (F.col("key_id") != 0) & F.col("_id").isNull()).drop("_id")


#: Fixed value: what a registry's file says if the secret is right.
SANITY = "Hello Wisc"


def write(keys: DataFrame, path: str, secret: str) -> None:
    """Writes the keys (key_id, data, created_at) and the sanity text as a new table."""
    hide = lambda c: F.aes_encrypt(c, F.lit(secret), F.lit("GCM"))
    hidden = keys.select("key_id", hide(F.col("data")).alias("hidden"), "created_at")
    check = keys.sparkSession.range(1).select(F.lit(-1).cast("long").alias("key_id"), hide(F.lit(SANITY)).alias("hidden"), F.lit(0).cast("long").alias("created_at"))
    hidden.unionByName(check).write.parquet(path)


def read(spark: SparkSession, path: str, secret: str) -> DataFrame:
    """The keys; fails if the secret is not the one they were written with."""
    rows = spark.read.parquet(path)
    shown = F.try_aes_decrypt("hidden", F.lit(secret), F.lit("GCM")).cast("string")
    found = rows.filter("key_id = -1").select(shown.alias("text")).first()
    if found is None or found.text != SANITY:
        raise ValueError(f"{path}: the secret is wrong")
    return rows.filter("key_id >= 0").select("key_id", shown.alias("data"), "created_at")
