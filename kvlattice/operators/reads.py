"""Scans, seeks and versioned reads. Every plan takes a canonical log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import canonical, dead
from .ordering import carry, neighbours, row_number


def scan(log: DataFrame, reverse: bool = False) -> DataFrame:
    """The whole log in the order E, or backwards."""
    return log.orderBy(*canonical(reverse), "seq")


def scan_first(log: DataFrame, n: int, reverse: bool = False) -> DataFrame:
    """The first n rows of a scan (a top-n, no full sort)."""
    return log.orderBy(*canonical(reverse), "seq").limit(n)


def newest(log: DataFrame, read_version: int | None = None) -> DataFrame:
    """The newest version of every key, at ``read_version`` or before. max_by
    keeps one row for each key on the map side, however many versions it has."""
    if read_version is not None:
        log = log.filter(F.col("version") <= read_version)
    rest = [c for c in log.columns if c != "user_key"]
    best = log.groupBy("user_key").agg(F.max_by(F.struct(*rest), F.col("version")).alias("_row"))
    return best.select("user_key", *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_visible(log: DataFrame, now: int, read_version: int | None = None) -> DataFrame:
    """Newest versions first, then without those deleted or expired: a deleted
    key does not show an older value."""
    return newest(log, read_version).filter(~dead(now))


def get_at(log: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (user_key, at): for each different one, the newest version <= at
    of its key; of equal versions the one written last. Requests are sorted among
    the versions and each takes the row before it, so a key with many versions
    and many requests costs their sum, not their product."""
    rest = [c for c in log.columns if c != "user_key"]
    rows = log.select("user_key", F.col("version").alias("at"), F.lit(0).alias("_side"), "seq", F.struct("user_key", *rest).alias("_hit"))
    asked = requests.select("user_key", "at").distinct().withColumns({"_side": F.lit(1), "seq": F.lit(None).cast("long"), "_hit": F.lit(None).cast(rows.schema["_hit"].dataType)})
    found = carry(rows.unionByName(asked), [F.col(c) for c in ("user_key", "at", "_side", "seq")], F.col("_hit"), "_found")
    found = found.filter((F.col("_side") == 1) & (F.col("_found.user_key") == F.col("user_key")))
    return found.select("user_key", "at", *[F.col(f"_found.{c}").alias(c) for c in rest])


def versions_of(log: DataFrame, key: str) -> DataFrame:
    return log.filter(F.col("user_key") == key).orderBy(F.desc("version"))


def since(log: DataFrame, version: int) -> DataFrame:
    """Rows newer than a version."""
    return log.filter(F.col("version") > version)


def scan_until(log: DataFrame, stop) -> DataFrame:
    """Each file's rows up to the first for which ``stop`` holds, and that one."""
    ends = log.filter(stop).groupBy("fid").agg(F.min("seq").alias("_stop"))
    return log.join(ends, "fid", "left").filter(F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop"))).drop("_stop")


def prefix_end(prefix: str) -> str | None:
    """The smallest string above all that start with ``prefix``."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            after = ord(prefix[i]) + 1
            return prefix[:i] + chr(0xE000 if after == 0xD800 else after)  # surrogates are no characters
    return None


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    """Keys with a prefix, as a range, which reaches the Parquet scan."""
    end = prefix_end(prefix)
    kept = log.filter(F.col("user_key") >= prefix)
    return kept.filter(F.col("user_key") < end) if end is not None else kept


def range_scan(log: DataFrame, low: str, high: str) -> DataFrame:
    return log.filter((F.col("user_key") >= low) & (F.col("user_key") < high))


def suffix_filter(log: DataFrame, suffix: str) -> DataFrame:
    return log.filter(F.col("user_key").endswith(suffix))


# The four ways of a search: comparison with the probe, and whether from above.
MODES = {"ge": False, "gt": False, "le": True, "lt": True}


#: Up to so many probes each are an aggregate of one scan.
FEW = 64


def seek(log: DataFrame, probes: DataFrame, mode: str) -> DataFrame:
    """probes (probe): for each, the first row of keys >= or > it, or the last
    row of keys <= or < it, in the order E; probes without one give no row.

    A few probes are answered by one scan that moves a row for each task. Many
    are sorted together with the keys, and the answer is carried along, so
    probes don't meet all keys in either case."""
    some = [r.probe for r in probes.select("probe").distinct().limit(FEW + 1).collect()]
    return _seek_few(log, probes, some, mode) if len(some) <= FEW else _seek_many(log, probes, mode)


def _seek_few(log: DataFrame, probes: DataFrame, some: list[str], mode: str) -> DataFrame:
    if not some:
        return probes.join(log.limit(0).select("user_key", "version", "value"))  # no probes, no rows
    key = F.col("user_key")
    test = {"ge": key.__ge__, "gt": key.__gt__, "le": key.__le__, "lt": key.__lt__}[mode]
    row, at = F.struct("user_key", "version", "value"), F.struct("user_key", (-F.col("version")).alias("v"), *[c for c in ("seq",) if c in log.columns])
    best = F.max_by if MODES[mode] else F.min_by
    found = log.agg(*[best(row, F.when(test(F.lit(p)), at)).alias(f"_{i}") for i, p in enumerate(some)])
    each = found.select(F.explode(F.array(*[F.struct(F.lit(p).alias("probe"), F.col(f"_{i}").alias("hit")) for i, p in enumerate(some)])).alias("r"))
    hits = each.select("r.probe", "r.hit.*").filter("user_key is not null")
    return probes.select("probe").join(F.broadcast(hits), "probe")  # FEW rows at most


def _seek_many(log: DataFrame, probes: DataFrame, mode: str) -> DataFrame:
    from_above = MODES[mode]
    firsts = log.groupBy("user_key").agg((F.min_by if from_above else F.max_by)(F.struct("version", "value"), F.col("version")).alias("_row"))
    keys = firsts.select("user_key", F.struct("user_key", "_row").alias("_hit"), F.lit(None).cast("string").alias("probe"), F.lit(1).alias("_side"))
    # at equal keys the probe stands where equality counts or not
    side = F.lit({"ge": 0, "gt": 2, "le": 2, "lt": 0}[mode])
    asked = probes.select(F.col("probe").alias("user_key"), F.lit(None).cast(keys.schema["_hit"].dataType).alias("_hit"), "probe", side.alias("_side"))
    order = [F.col("user_key"), F.col("_side")] if from_above else [F.desc("user_key"), F.desc("_side")]
    found = carry(keys.unionByName(asked), order, F.col("_hit"), "_found").filter(F.col("probe").isNotNull() & F.col("_found").isNotNull())
    return found.select("probe", F.col("_found.user_key").alias("user_key"), F.col("_found._row.version").alias("version"), F.col("_found._row.value").alias("value"))


def next_prev(log: DataFrame) -> DataFrame:
    """Each row with its neighbours in the order E."""
    return neighbours(log, [*canonical(), F.col("seq")], ["user_key", "version"])


def number(log: DataFrame, name: str = "position") -> DataFrame:
    """Each row with its place in the order E, from 1."""
    return row_number(log, [*canonical(), F.col("seq")], name)
