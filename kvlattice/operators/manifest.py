"""Table metadata: statistics, pruning, overlap, replacement and splits."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs_sql import CHECKSUM, COMPRESSION
from ..model import DELETE, has
from ..sources.scratch import materialize
from ..sources.tables import file_name
from .ordering import MOST, bounds, reached, row_number


def table_stats(log: DataFrame) -> DataFrame:
    """A manifest row for each table."""
    size = F.octet_length("user_key") + F.octet_length("value")
    return log.groupBy("level", "table_id").agg(
        F.min("user_key").alias("smallest"),
        F.max("user_key").alias("biggest"),
        F.max("version").alias("max_version"),
        F.count("*").alias("key_count"),
        F.sum(size).cast("long").alias("size"),
        F.sum(F.when(has(DELETE), F.octet_length("user_key") + F.octet_length("value") + 8).otherwise(0)).cast("long").alias("stale_size"),
    )


def level_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.count("*").alias("tables"), F.sum("size").alias("total_size"), F.sum("stale_size").alias("total_stale_size"))


def key_range(ranges: DataFrame) -> DataFrame:
    """The hull of key ranges (left, right, inf, size), one row."""
    some = F.when((F.col("left") != "") | (F.col("right") != ""), F.col("left")), F.when((F.col("left") != "") | (F.col("right") != ""), F.col("right"))
    return ranges.agg(F.min(some[0]).alias("left"), F.max(some[1]).alias("right"), F.bool_or("inf").alias("inf"), F.sum("size").alias("size"))


def covered_by_prefix(manifest: DataFrame, prefix: str) -> DataFrame:
    return manifest.filter(F.col("smallest").startswith(prefix) & F.col("biggest").startswith(prefix))


def pick_tables(manifest: DataFrame, prefix: str = "", since: int = 0) -> DataFrame:
    """Tables that may hold rows of a prefix, newer than a version."""
    kept = manifest.filter(F.col("max_version") >= since)
    if not prefix:
        return kept
    cut = lambda c: F.substring(c, 1, len(prefix))
    return kept.filter((cut("smallest") <= prefix) & (cut("biggest") >= prefix))


def range_overlaps(left: str, right: str, inf: str, other_left: str, other_right: str, other_inf: str):
    """An empty range overlaps with all, and nothing else with an empty one."""
    empty = lambda a, b, i: (F.col(a) == "") & (F.col(b) == "") & ~F.col(i)
    meets = (F.col(left) <= F.col(other_right)) & (F.col(right) >= F.col(other_left))
    return F.when(empty(left, right, inf), True).when(empty(other_left, other_right, other_inf), False).when(F.col(inf) | F.col(other_inf), True).otherwise(meets)


def range_is_empty(left: str, right: str, inf: str):
    return (F.col(left) == "") & (F.col(right) == "") & ~F.col(inf)


def range_equals(left: str, right: str, inf: str, other_left: str, other_right: str, other_inf: str):
    """Equal ends, whatever the versions (keys here have none)."""
    return (F.col(left) == F.col(other_left)) & (F.col(right) == F.col(other_right)) & (F.col(inf) == F.col(other_inf))


def metadata(manifest: DataFrame, bits_per_key: int = 10, compression: int = 2, checksum: int = 0) -> DataFrame:
    """What a table tells of itself."""
    bits = F.greatest(F.lit(64), F.col("key_count") * bits_per_key)
    return manifest.select(
        F.col("table_id").alias("id"),
        file_name(F.col("table_id")).alias("path"),
        "smallest",
        "biggest",
        "max_version",
        "key_count",
        F.col("size").alias("uncompressed_size"),
        F.col("stale_size").alias("stale_data_size"),
        (F.floor((bits + 7) / 8) + 1).alias("bloom_filter_size"),
        F.lit(COMPRESSION[compression]).alias("compression"),
        F.lit(CHECKSUM[checksum]).alias("checksum"),
        F.lit(False).alias("in_memory"),
    )


def overlapping_tables(manifest: DataFrame, low: str, high: str) -> DataFrame:
    """The tables that meet [low, high], with their place in key order."""
    placed = row_number(manifest, [F.col("smallest"), F.col("table_id")], "n").withColumn("place", F.col("n") - 1).drop("n")
    return placed.filter((F.col("biggest") >= low) & (F.col("smallest") <= high))


#: So many tables of a cell are met by one task, with as many; larger cells are split
#: into blocks.
MET = 1 << 16
#: Pairs in a batch, at least, and those that a partition may have to make.
PAIRS, WORK = 1 << 16, 1 << 30


def overlapping_pairs(manifest: DataFrame) -> DataFrame:
    """Pairs of tables whose ranges meet; the later one, by (smallest, id), asks.
    Keys are cut into ranges. In the ranges where a table begins and ends, keys are
    compared. All tables that begin in a range between meet it: such ranges are
    grouped by halves, as in a segment tree, so a table is in a row for each of a few
    halves, and asks each half that its own range is in. Tables of a cell (a range or
    a half) are read once and meet those before them that have not ended yet. Cells
    of many are dealt into blocks, of a part that is asked and one that asks. So rows
    follow the tables, and beyond them a small share of the pairs; a task holds one
    part."""
    spans = materialize(manifest.select("table_id", "smallest", "biggest").filter("table_id is not null and smallest is not null and biggest is not null"), "spans")
    at = bounds(spans, "smallest")
    placed = materialize(spans.withColumns({"_first": reached(at, "smallest"), "_last": reached(at, "biggest")}), "placed")
    first = {r[0]: r[1] for r in placed.groupBy("_first").count().collect()}  # a row for each range, here and below
    last = {r[0]: r[1] for r in placed.filter("_last > _first").groupBy("_last").count().collect()}
    high = len(at).bit_length()  # halves of halves: node 1 has all ranges, n has 2n and 2n + 1, a range r is 2**high + r
    wide = placed.filter("_last > _first + 1").withColumn("_cell", F.explode(_halves(F.col("_first") + 1, F.col("_last"), high))).filter("_cell is not null")
    held = {r[0]: r[1] for r in wide.groupBy("_cell").count().collect()}
    asking = {(1 << high) + r: n for r, n in first.items()}
    for node in range((1 << high) - 1, 0, -1):
        asking[node] = asking.get(2 * node, 0) + asking.get(2 * node + 1, 0)
    cells = [(r, first.get(r, 0) + last.get(r, 0), first.get(r, 0)) for r in {*first, *last}] + [(-n, x, asking[n]) for n, x in held.items() if asking.get(n)]
    work = sum(x * y for _, x, y in cells) // WORK
    spark = manifest.sparkSession
    parts = F.broadcast(spark.createDataFrame([(c, -(-x // MET), -(-(x if c >= 0 else y) // MET)) for c, x, y in cells], "_cell int, _held int, _asking int"))
    own = lambda n: F.pmod(F.xxhash64("table_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ends = F.array(F.struct(F.col("_first").alias("_cell"), F.lit(True).alias("asks")), F.when(F.col("_last") > F.col("_first"), F.struct(F.col("_last").alias("_cell"), F.lit(False).alias("asks"))))
    keys = ["table_id", "smallest", "biggest"]
    near = placed.select(*keys, F.explode(ends).alias("_end")).filter("_end is not null").select(*keys, "_end.*").join(parts, "_cell").withColumn("_own", own("_held"))
    rows = near.withColumns({"_p": F.col("_own"), "_q": each("_held"), "holds": F.lit(True)}).withColumn("asks", F.col("asks") & (F.col("_q") == F.col("_own")))
    columns = ["_cell", "_p", "_q", *keys, "holds", "asks"]
    rows = rows.select(*columns).unionByName(near.filter("asks").withColumns({"_p": each("_held"), "_q": F.col("_own"), "holds": F.lit(False)}).filter("_p <> _q").select(*columns))
    if held:  # in a half all that are held come first, and none ends
        sign = lambda df: df.withColumn("_cell", -F.col("_cell")).join(parts, "_cell")
        over = sign(wide).withColumns({"_p": own("_held"), "_q": each("_asking"), "smallest": F.lit(""), "biggest": F.lit(" "), "holds": F.lit(True), "asks": F.lit(False)})
        nodes = F.array(*[F.shiftright(F.col("_first") + (1 << high), i) for i in range(high + 1)])
        under = sign(placed.withColumn("_cell", F.explode(nodes))).withColumns({"_p": each("_held"), "_q": own("_asking"), "smallest": F.lit(" "), "biggest": F.lit(" "), "holds": F.lit(False), "asks": F.lit(True)})
        rows = rows.unionByName(over.select(*columns)).unionByName(under.select(*columns))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the number is named, as a row may be the work of many
    dealt = rows.repartition(min(MOST, max(least, work)), "_cell", "_p", "_q")
    # blocks of a cell must have one order: of two equal keys, each would else wait for the other, or both would ask
    return dealt.sortWithinPartitions("_cell", "_p", "_q", "smallest", "table_id").mapInArrow(_met, "a long, b long")


def _halves(low: Column, end: Column, high: int) -> Column:
    """The nodes that make up the ranges from ``low`` to before ``end``, two of each
    height at most; null where there is none."""
    out = []
    for i in range(high + 1):
        a, b = F.shiftright(low + ((1 << high) + (1 << i) - 1), i), F.shiftright(end + (1 << high), i)
        out += [F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)]
    return F.array(*out)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of tables, sorted by (cell, block, smallest, id), that meet."""
    now, live, ends, slots, held, row = None, np.empty(64, np.int64), [], {}, [], 0  # live[:len(held)]: the tables that have not ended
    found, asked = [], []

    def batch_of() -> pa.RecordBatch:
        one, other = np.concatenate(found), np.repeat(np.array(asked, np.int64), [len(x) for x in found])
        same = one == other
        if same.any():
            one, other = one[~same], other[~same]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["a", "b"])

    for batch in batches:
        n = 0
        for *block, table, smallest, biggest, holds, asks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if block != now:
                now, ends, slots, held = block, [], {}, []
            while ends and ends[0][0] < smallest:
                slot, last = slots.pop(heapq.heappop(ends)[1]), held.pop()
                if slot < len(held):  # the last one takes the place
                    live[slot], held[slot] = live[len(held)], last
                    slots[last] = slot
            if asks and held:
                found.append(live[: len(held)].copy())
                asked.append(table)
                n += len(held)
                if n >= PAIRS:
                    yield batch_of()
                    found, asked, n = [], [], 0
            if not holds:
                continue
            if len(held) == len(live):
                live = np.concatenate([live, live])
            live[len(held)], slots[row] = table, len(held)
            held.append(row)
            heapq.heappush(ends, (biggest, row))
            row += 1
        if found:
            yield batch_of()
            found, asked = [], []


def replace_tables(manifest: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Without ``removed`` (table_id; with level, where an id is a table of more
    levels than one), with ``added``."""
    return manifest.join(removed, [c for c in ("level", "table_id") if c in removed.columns], "left_anti").unionByName(added)


def live_set(changes: DataFrame) -> DataFrame:
    """Changelog (seq, table_id, op, level) to the tables whose last change is
    no deletion."""
    last = changes.groupBy("table_id").agg(F.max_by(F.struct("op", "level"), F.col("seq")).alias("_c"))
    return last.filter(F.col("_c.op") != "DELETE").select("table_id", F.col("_c.level").alias("level"))


def stalled(manifest: DataFrame, limit: int) -> DataFrame:
    """Whether level 0 may take no more tables."""
    zero = manifest.filter(F.col("level") == 0)
    return zero.agg((F.count("*") >= limit).alias("stalled"), F.count("*").alias("tables"))


def add_level_zero(manifest: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """The manifest with ``new`` tables on level 0, each unless there are ``limit``
    already; they come in the order of their ids."""
    held = manifest.filter(F.col("level") == 0).agg(F.count("*").alias("_held"))
    placed = row_number(new, [F.col("table_id")], "_n").join(F.broadcast(held)).filter(F.col("_held") + F.col("_n") <= limit)  # one row
    return manifest.unionByName(placed.drop("_n", "_held"))


def table_for_key(manifest: DataFrame, key: str) -> DataFrame:
    """On levels below 0, the first table whose biggest key is >= key; on level
    0 all tables, newest first."""
    lower = manifest.filter((F.col("level") > 0) & (F.col("biggest") >= key))
    first = lower.groupBy("level").agg(F.min_by("table_id", F.struct("biggest", "table_id")).alias("table_id"))
    zero = manifest.filter(F.col("level") == 0).select("level", "table_id")
    return zero.unionByName(first.select("level", "table_id"))


def key_splits(log: DataFrame, n: int, prefix: str = "") -> DataFrame:
    """n - 1 keys that cut the distinct keys of a prefix into n even parts."""
    keys = log.filter(F.col("user_key").startswith(prefix)).select("user_key").distinct()
    total = keys.count()
    placed = row_number(keys, [F.col("user_key")], "place")
    wanted = [total * i // n + 1 for i in range(1, n)]
    return placed.filter(F.col("place").isin(wanted)) if wanted else placed.limit(0)
