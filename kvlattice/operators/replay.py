"""Replay of logs with transaction frames, and completion marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FIN_TXN, TXN, has
from .ordering import dealt


def _marked(log: DataFrame) -> DataFrame:
    """``log`` with _applied: whether a replay of its file applies a row.

    Rows with the TXN bit wait for the FIN row of their version; a wrong version,
    or a row outside of transactions in the midst of one, ends the file; an
    unfinished transaction at the end is dropped. Before a file's first violation
    the row before tells which transaction is open, and a row with the TXN bit is
    applied if a FIN row follows. So all windows share one sort, in as many
    tasks as the log's size asks for. Files are bounded in size, as they are
    rotated."""
    order = Window.partitionBy("fid").orderBy("seq")
    kind = F.when(has(TXN), "t").when(has(FIN_TXN), "f").otherwise("n")
    rows = dealt(log, "fid").withColumn("_kind", kind)
    open_ = F.lag(F.when(F.col("_kind") == "t", F.col("version"))).over(order)
    rows = rows.withColumn("_open", F.coalesce(open_, F.lit(0)))
    wrong = (
        F.when(F.col("_kind") == "t", (F.col("_open") != 0) & (F.col("_open") != F.col("version")))
        .when(F.col("_kind") == "f", F.col("_open") != F.coalesce("fin_version", F.lit(-1)))
        .otherwise(F.col("_open") != 0)
    )
    rows = rows.withColumn("_bad", F.max(wrong.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_end", F.max(F.when((F.col("_kind") == "f") & (F.col("_bad") == 0), F.col("seq"))).over(whole))
    applied = (F.col("_bad") == 0) & ((F.col("_kind") == "n") | (F.col("_kind") == "t") & (F.col("seq") < F.col("_end")))
    return rows.withColumn("_applied", F.coalesce(applied, F.lit(False))).drop("_kind", "_open", "_bad", "_end")


def replay(log: DataFrame) -> DataFrame:
    """Rows (fid, seq, user_key, version, meta, fin_version) that a replay of
    each file applies (see ``_marked``)."""
    return _marked(log).filter("_applied").drop("_applied")


def replay_in_order(log: DataFrame) -> DataFrame:
    """The same as a fold in order, a file at a time: for comparison in tests
    and where rows carry more state than windows can express."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, waiting, open_ = rows.sort_values("seq"), [], [], 0
        for i, r in zip(rows.index, rows.itertuples(index=False), strict=True):
            if r.meta & TXN:
                if open_ not in (0, r.version):
                    break
                open_, waiting = r.version, [*waiting, i]
            elif r.meta & FIN_TXN:
                if pd.isna(r.fin_version) or r.fin_version != open_:
                    break
                out, waiting, open_ = out + waiting, [], 0
            elif open_:
                break
            else:
                out.append(i)
        return rows.loc[out]

    return log.groupBy("fid").applyInPandas(fold, log.schema)


def valid_end(log: DataFrame) -> DataFrame:
    """Of each file, the number of rows to keep and the largest version: what
    lies behind the last row that a replay applies may be cut."""
    at = lambda c: F.max(F.when(F.col("_applied"), F.col(c)))
    return _marked(log).groupBy("fid").agg((at("seq") + 1).alias("valid_end"), at("version").alias("max_version"))


def done_until(marks: DataFrame) -> DataFrame:
    """marks (idx, done): an index is finished when its done marks are as many
    as its begin marks. The largest index with all before it finished."""
    each = marks.groupBy("idx").agg(F.sum(F.when(F.col("done"), -1).otherwise(1)).alias("open"))
    pending = each.agg(F.min(F.when(F.col("open") > 0, F.col("idx"))).alias("_first"))
    kept = each.join(F.broadcast(pending)).filter(F.col("_first").isNull() | (F.col("idx") < F.col("_first")))  # one row
    return kept.agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long").alias("done_until"))


def stream_progress(messages: DataFrame) -> DataFrame:
    """Rows and completion of each exported stream."""
    return messages.groupBy("stream_id").agg(F.count("*").alias("messages"), F.max("stream_done").alias("done"))
