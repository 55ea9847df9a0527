"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers of this session import this package."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only where a local session has none (in tests) is
    an own folder set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kvlattice-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet, deleted when the
    driver ends."""
    path = f"{shared_dir(spark)}/kvlattice/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except (Py4JError, OSError, AttributeError):  # the JVM has ended before; the folder's owner cleans up
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table: what is read twice is computed once, and a lost
    executor costs a task, not the steps before."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._scratch)
