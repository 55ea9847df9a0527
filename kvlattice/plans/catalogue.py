"""The query catalogue: a Spark plan for each operator and, where SQL can express
it, the same in DuckDB's SQL. ``LOG`` is the events table as a versioned log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, codecs_sql
from ..model import TXN, canonical, dead, has
from ..operators import buffers, gc, manifest, merge, reads, registry, replay, vlog
from ..operators.ordering import dealt, neighbours, row_number
from ..sources.scratch import importable
from ..sources.tables import events_log, file_name, parse_file_id, read

NOW, KEY, PREFIX, AT = 5000, "user:000042", "user:00004", 6000
PROBES = ["user:", "user:000010", "user:0000105", "user:000099", "user:000149", "zzz"]

LOG = """
log AS (
  SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_key, event_id + 1 AS version, props AS value,
         CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 4 ELSE 0 END AS meta, 0 AS user_meta,
         CASE WHEN event_id % 7 = 0 THEN event_id ELSE 0 END AS expires_at, CAST((event_id // 1000) % 3 AS INTEGER) AS level,
         event_id // 1000 AS table_id, event_id // 500 AS fid, event_id AS seq
  FROM events)"""
STATS = """
manifest AS (
  SELECT level, table_id, min(user_key) AS smallest, max(user_key) AS biggest, max(version) AS max_version, count(*) AS key_count,
         CAST(sum(strlen(user_key) + strlen(value)) AS BIGINT) AS size,
         CAST(sum(CASE WHEN meta & 1 <> 0 THEN strlen(user_key) + strlen(value) + 8 ELSE 0 END) AS BIGINT) AS stale_size
  FROM log GROUP BY level, table_id)"""
SPLIT = """
sized AS (
  SELECT *, strlen(value) >= 9 AS in_log,
         CASE WHEN strlen(value) >= 9 THEN 2 + 1 + 1 + CASE WHEN expires_at < 128 THEN 1 WHEN expires_at < 16384 THEN 2 WHEN expires_at < 2097152 THEN 3 ELSE 4 END
           + strlen(user_key) + 8 + strlen(value) + 4 ELSE 0 END AS sz
  FROM log),
split AS (
  SELECT * EXCLUDE (meta, sz), CASE WHEN in_log THEN sz END AS len,
         CASE WHEN in_log THEN CAST(coalesce(sum(sz) OVER (PARTITION BY fid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 20 AS BIGINT) END AS "offset",
         CASE WHEN in_log THEN (meta & 63) | 2 ELSE meta END AS meta
  FROM sized)"""
VISIBLE = "NOT (meta & 1 <> 0 OR (expires_at <> 0 AND expires_at <= 5000))"
COLUMNS = ["user_key", "version", "value"]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        _queries[name] = run
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import storage  # noqa: F401  adds its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import storage  # noqa: F401

    return dict(_sql)


# ---- scans and reads


@query("kv_full_scan", f"WITH {LOG} SELECT user_key, version, value FROM log")
def _(spark, d):
    return reads.scan(events_log(spark, d)).select(*COLUMNS)


@query("kv_reverse_scan_top", f"WITH {LOG} SELECT user_key, version, value FROM log ORDER BY user_key DESC, version LIMIT 100")
def _(spark, d):
    return reads.scan_first(events_log(spark, d), 100, reverse=True).select(*COLUMNS)


@query(
    "kv_latest_visible",
    f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS n FROM log)
SELECT user_key, version, value, meta FROM r WHERE n = 1 AND {VISIBLE}""",
)
def _(spark, d):
    return reads.latest_visible(events_log(spark, d), NOW).select(*COLUMNS, "meta")


@query(
    "kv_get_at_version",
    f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS n FROM log WHERE version <= {AT})
SELECT user_key, {AT} AS "at", version, value FROM r WHERE n = 1""",
)
def _(spark, d):
    log = events_log(spark, d)
    return reads.get_at(log.select(*COLUMNS, "seq"), log.select("user_key").distinct().withColumn("at", F.lit(AT))).select("user_key", "at", "version", "value")


@query("kv_all_versions", f"WITH {LOG} SELECT user_key, version, value FROM log WHERE user_key = '{KEY}'")
def _(spark, d):
    return reads.versions_of(events_log(spark, d), KEY).select(*COLUMNS)


@query("kv_since_version", f"WITH {LOG} SELECT user_key, version, value FROM log WHERE version > {AT}")
def _(spark, d):
    return reads.since(events_log(spark, d), AT).select(*COLUMNS)


@query("kv_prefix_scan", f"WITH {LOG} SELECT user_key, version, value FROM log WHERE starts_with(user_key, '{PREFIX}')")
def _(spark, d):
    return reads.prefix_scan(events_log(spark, d), PREFIX).select(*COLUMNS)


@query("kv_range_scan", f"WITH {LOG} SELECT user_key, version, value FROM log WHERE user_key >= 'user:00002' AND user_key < 'user:00005'")
def _(spark, d):
    return reads.range_scan(events_log(spark, d), "user:00002", "user:00005").select(*COLUMNS)


@query("kv_suffix_filter", f"WITH {LOG} SELECT user_key, version, value FROM log WHERE suffix(user_key, '7')")
def _(spark, d):
    return reads.suffix_filter(events_log(spark, d), "7").select(*COLUMNS)


def _seek_sql(test: str, best: str, version: str) -> str:
    probes = ", ".join(f"('{p}')" for p in PROBES)
    return f"""WITH {LOG}, p(probe) AS (VALUES {probes}),
k AS (SELECT probe, {best}(user_key) AS user_key FROM p JOIN log ON user_key {test} probe GROUP BY probe),
r AS (SELECT k.probe, log.*, row_number() OVER (PARTITION BY probe ORDER BY version {version}) AS n FROM k JOIN log USING (user_key))
SELECT probe, user_key, version, value FROM r WHERE n = 1"""


def _seek(name: str, mode: str) -> None:
    test, best = {"ge": (">=", "min"), "gt": (">", "min"), "le": ("<=", "max"), "lt": ("<", "max")}[mode]

    @query(name, _seek_sql(test, best, "DESC" if best == "min" else "ASC"))
    def _(spark, d):
        return reads.seek(events_log(spark, d), spark.createDataFrame([(p,) for p in PROBES], "probe string"), mode)


for _name, _mode in (("kv_seek_ge", "ge"), ("kv_seek_le", "le"), ("kv_find_lt", "lt"), ("kv_find_gt", "gt")):
    _seek(_name, _mode)


@query(
    "kv_next_prev",
    f"""WITH {LOG} SELECT user_key, version, lag(user_key) OVER e AS prev_user_key, coalesce(lag(version) OVER e, -1) AS prev_version,
  lead(user_key) OVER e AS next_user_key, coalesce(lead(version) OVER e, -1) AS next_version FROM log WINDOW e AS (ORDER BY user_key, version DESC, seq)""",
)
def _(spark, d):
    none = {f"{x}_version": F.coalesce(f"{x}_version", F.lit(-1)) for x in ("prev", "next")}
    return reads.next_prev(events_log(spark, d).select("user_key", "version", "seq")).withColumns(none).select("user_key", "version", "prev_user_key", "prev_version", "next_user_key", "next_version")


# ---- merge


def _halves(spark, d):
    log = events_log(spark, d)
    return log.filter("seq % 3 <> 1"), log.filter("seq % 3 <> 2").withColumn("value", F.concat(F.lit("b"), F.col("value")))


@query("kv_concat", f"WITH {LOG} SELECT user_key, version, value FROM log")
def _(spark, d):
    log = events_log(spark, d)
    parts = ["user_key < 'user:00003'", "user_key >= 'user:00003' and user_key < 'user:00007'", "user_key >= 'user:00007'"]
    return merge.concat([log.filter(p) for p in parts]).select(*COLUMNS)


_TWO = f"""WITH {LOG}, u AS (
  SELECT user_key, version, value, 0 AS src FROM log WHERE seq % 3 <> 1
  UNION ALL SELECT user_key, version, 'b' || value, 1 FROM log WHERE seq % 3 <> 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_key, version ORDER BY src) AS n FROM u)
SELECT user_key, version, value, src FROM r WHERE n = 1"""


@query("kv_merge_two", _TWO)
def _(spark, d):
    return merge.merge(list(_halves(spark, d))).select(*COLUMNS, "src")


@query("kv_merge_reverse", f"SELECT *, row_number() OVER (ORDER BY user_key DESC, version) AS position FROM ({_TWO})")
def _(spark, d):
    """Backwards; the position tells the order."""
    return row_number(merge.merge([t.select(*COLUMNS, "seq") for t in _halves(spark, d)]).select(*COLUMNS, "src"), canonical(True), "position")


@query(
    "kv_merge_k",
    f"""WITH {LOG}, u AS (SELECT user_key, version, value || '-' || i AS value, i AS src FROM log, range(5) AS t(i) WHERE i = seq % 5 OR seq % (i + 2) = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_key, version ORDER BY src) AS n FROM u)
SELECT user_key, version, value, CAST(src AS INTEGER) AS src FROM r WHERE n = 1""",
)
def _(spark, d):
    """Five tables that overlap; each row is in one of them at least."""
    log = events_log(spark, d)
    tables = [log.filter(f"seq % 5 = {i} or seq % {i + 2} = 0").withColumn("value", F.concat("value", F.lit(f"-{i}"))) for i in range(5)]
    return merge.merge(tables).select(*COLUMNS, "src")


# the same over whole tables: no limit, ranges that meet, and every row in the last input at least
@query("kv_concat_whole", f"WITH {LOG} SELECT user_key, version, value FROM log")
def _(spark, d):
    log = events_log(spark, d)
    return merge.concat([log.filter("user_key < 'user:00005'"), log.filter("user_key >= 'user:00005'")]).select(*COLUMNS)


@query("kv_merge_reverse_whole", _TWO + " ORDER BY user_key DESC, version")
def _(spark, d):
    return merge.merge(list(_halves(spark, d))).select(*COLUMNS, "src").orderBy(*canonical(True))


@query(
    "kv_merge_k_whole",
    f"""WITH {LOG}, u AS (SELECT user_key, version, value || '-' || i AS value, i AS src FROM log, range(5) AS t(i) WHERE i = 4 OR seq % (i + 2) = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_key, version ORDER BY src) AS n FROM u)
SELECT user_key, version, value, CAST(src AS INTEGER) AS src FROM r WHERE n = 1""",
)
def _(spark, d):
    log = events_log(spark, d)
    tables = [log.filter(f"{i} = 4 OR seq % {i + 2} = 0").withColumn("value", F.concat("value", F.lit(f"-{i}"))) for i in range(5)]
    return merge.merge(tables).select(*COLUMNS, "src")


@query("kv_l0_get", f"WITH {LOG} SELECT user_key, version, value, table_id FROM log WHERE user_key = '{KEY}' AND version <= {AT} ORDER BY version DESC, table_id DESC LIMIT 1")
def _(spark, d):
    return merge.level_zero_get(events_log(spark, d), KEY, AT).select(*COLUMNS, "table_id")


# ---- manifest


def _manifest(spark, d):
    return manifest.table_stats(events_log(spark, d))


def _segments(spark, d):
    """A manifest of tables with narrow ranges: by key and thousand."""
    log = events_log(spark, d).withColumn("table_id", F.col("table_id") * 1000 + F.substring("user_key", 6, 5).cast("long"))
    return manifest.table_stats(log)


SEGMENTS = STATS.replace("manifest AS", "manifest AS").replace("SELECT level, table_id,", "SELECT level, table_id * 1000 + CAST(substr(user_key, 6, 5) AS BIGINT) AS table_id,").replace("GROUP BY level, table_id", "GROUP BY 1, 2")


@query("manifest_stats", f"WITH {LOG}, {STATS} SELECT * FROM manifest")
def _(spark, d):
    return _manifest(spark, d)


@query("level_totals", f"WITH {LOG}, {STATS} SELECT level, count(*) AS tables, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(stale_size) AS BIGINT) AS total_stale_size FROM manifest GROUP BY level")
def _(spark, d):
    return manifest.level_totals(_manifest(spark, d))


@query("key_range_hull", f"WITH {LOG}, {STATS} SELECT min(smallest) AS \"left\", max(biggest) AS \"right\", false AS inf, CAST(sum(size) AS BIGINT) AS size FROM manifest")
def _(spark, d):
    ranges = _manifest(spark, d).select(F.col("smallest").alias("left"), F.col("biggest").alias("right"), F.lit(False).alias("inf"), "size")
    return manifest.key_range(ranges)


@query("manifest_pick_tables", f"WITH {LOG}, {SEGMENTS} SELECT table_id, level FROM manifest WHERE max_version >= 4000 AND substr(smallest, 1, 10) <= '{PREFIX}' AND substr(biggest, 1, 10) >= '{PREFIX}'")
def _(spark, d):
    return manifest.pick_tables(_segments(spark, d), PREFIX, 4000).select("table_id", "level")


@query("covered_by_prefix", f"WITH {LOG}, {SEGMENTS} SELECT table_id FROM manifest WHERE starts_with(smallest, '{PREFIX}') AND starts_with(biggest, '{PREFIX}')")
def _(spark, d):
    return manifest.covered_by_prefix(_segments(spark, d), PREFIX).select("table_id")


@query("manifest_overlaps", f"WITH {LOG}, {SEGMENTS} SELECT x.table_id AS a, y.table_id AS b FROM manifest x JOIN manifest y ON x.table_id < y.table_id AND x.smallest <= y.biggest AND x.biggest >= y.smallest")
def _(spark, d):
    return manifest.overlapping_pairs(_segments(spark, d))


@query("overlapping_tables", f"WITH {LOG}, {SEGMENTS}, r AS (SELECT *, row_number() OVER (ORDER BY smallest, table_id) - 1 AS place FROM manifest) SELECT table_id, place FROM r WHERE biggest >= 'user:000033' AND smallest <= 'user:000066'")
def _(spark, d):
    return manifest.overlapping_tables(_segments(spark, d), "user:000033", "user:000066").select("table_id", "place")


@query("manifest_replace", f"WITH {LOG}, {SEGMENTS} SELECT table_id, smallest FROM manifest WHERE level <> 0 UNION ALL SELECT table_id + 1000000, smallest FROM manifest WHERE level = 0 AND key_count > 50")
def _(spark, d):
    m = _segments(spark, d)
    zero = m.filter("level = 0")
    added = zero.filter("key_count > 50").withColumn("table_id", F.col("table_id") + 1_000_000)
    return manifest.replace_tables(m, zero.select("level", "table_id"), added).select("table_id", "smallest")


CHANGES = "changes AS (SELECT event_id AS seq, user_id AS table_id, CASE WHEN event_type IN ('error', 'signup') THEN 'DELETE' ELSE 'CREATE' END AS op, CAST(event_id % 4 AS INTEGER) AS level FROM events)"


@query("manifest_live_set", f"WITH {CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY seq DESC) AS n FROM changes) SELECT table_id, level FROM r WHERE n = 1 AND op <> 'DELETE'")
def _(spark, d):
    e = read(spark, d, "events")
    op = F.when(F.col("event_type").isin("error", "signup"), "DELETE").otherwise("CREATE").alias("op")
    return manifest.live_set(e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("table_id"), op, (F.col("event_id") % 4).cast("int").alias("level")))


@query("level_zero_stall", f"WITH {LOG}, {STATS} SELECT count(*) >= 3 AS stalled, count(*) AS tables FROM manifest WHERE level = 0")
def _(spark, d):
    return manifest.stalled(_manifest(spark, d), 3)


@query(
    "table_for_key",
    f"""WITH {LOG}, {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY biggest, table_id) AS n FROM manifest WHERE level > 0 AND biggest >= '{KEY}')
SELECT level, table_id FROM r WHERE n = 1 UNION ALL SELECT level, table_id FROM manifest WHERE level = 0""",
)
def _(spark, d):
    return manifest.table_for_key(_segments(spark, d), KEY)


@query(
    "key_splits",
    f"""WITH {LOG}, k AS (SELECT DISTINCT user_key FROM log), r AS (SELECT user_key, row_number() OVER (ORDER BY user_key) AS place, count(*) OVER () AS n FROM k)
SELECT user_key, place FROM r WHERE place IN (SELECT n * i // 8 + 1 FROM range(1, 8) AS t(i))""",
)
def _(spark, d):
    return manifest.key_splits(events_log(spark, d), 8)


# ---- value log


def _split(spark, d):
    return vlog.split_values(events_log(spark, d), 9)


@query("vlog_split", f'WITH {LOG}, {SPLIT} SELECT user_key, version, in_log, fid, coalesce(len, -1) AS len, coalesce("offset", -1) AS "offset", meta FROM split')
def _(spark, d):
    none = {c: F.coalesce(c, F.lit(-1)) for c in ("len", "offset")}
    return _split(spark, d).withColumns(none).select("user_key", "version", "in_log", "fid", "len", "offset", "meta")


@query("vlog_pointer_read", f'WITH {LOG}, {SPLIT} SELECT user_key, version, value FROM split WHERE in_log')
def _(spark, d):
    rows = _split(spark, d).filter("in_log")
    found = vlog.read_pointers(rows.select("user_key", "version", "fid", "offset", "len"), rows.select("fid", "offset", "len", "value"))
    return found.select(*COLUMNS)


VARINT = "CASE WHEN expires_at < 128 THEN 1 WHEN expires_at < 16384 THEN 2 WHEN expires_at < 2097152 THEN 3 ELSE 4 END"


def _rotate_sql(request: str) -> str:
    """Requests are written whole; a file ends behind the one that passes 4096 bytes."""
    return f"""WITH RECURSIVE {LOG}, s AS (SELECT fid, seq, {request} AS request, strlen(value) >= 9 AS in_log,
  CASE WHEN strlen(value) >= 9 THEN 4 + {VARINT} + strlen(user_key) + 8 + strlen(value) + 4 ELSE 0 END AS sz FROM log),
q AS (SELECT fid, request, row_number() OVER (PARTITION BY fid ORDER BY request) AS n, CAST(sum(sz) AS BIGINT) AS total FROM s GROUP BY fid, request),
f AS (SELECT fid, n, request, CAST(0 AS BIGINT) AS file, CAST(20 AS BIGINT) AS pos, total FROM q WHERE n = 1 UNION ALL
  SELECT q.fid, q.n, q.request, f.file + CASE WHEN f.pos + f.total > 4096 THEN 1 ELSE 0 END, CASE WHEN f.pos + f.total > 4096 THEN 20 ELSE f.pos + f.total END, q.total FROM f JOIN q ON q.fid = f.fid AND q.n = f.n + 1)
SELECT s.fid, seq, CASE WHEN in_log THEN file END AS new_fid,
  CASE WHEN in_log THEN CAST(pos + coalesce(sum(sz) OVER (PARTITION BY s.fid, s.request ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS new_offset
FROM s JOIN f USING (fid, request)"""


@query("vlog_rotate", _rotate_sql("seq"))
def _(spark, d):
    return vlog.rotate(events_log(spark, d), 4096, 9).select("fid", "seq", "new_fid", "new_offset")


@query("vlog_rotate_fold", _rotate_sql("seq // 5"))
def _(spark, d):
    log = events_log(spark, d).withColumn("request", F.floor(F.col("seq") / 5))
    return vlog.rotate_requests(log, 4096, 9).select("fid", "seq", "new_fid", "new_offset")


@query("entry_estimated_size", f"WITH {LOG} SELECT seq, strlen(user_key) + CASE WHEN strlen(value) < 9 THEN strlen(value) + 2 ELSE 14 END AS size FROM log")
def _(spark, d):
    return events_log(spark, d).select("seq", vlog.estimated_size(9).alias("size"))


@query("request_size", "SELECT o_orderkey // 10 AS batch, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR)) + strlen(o_orderpriority) + 25) AS BIGINT) AS size FROM orders GROUP BY 1")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 10).alias("batch"), F.col("o_orderkey").cast("string").alias("user_key"), F.col("o_orderpriority").alias("value"))
    return rows.groupBy("batch").agg(vlog.request_size().alias("size"))


@query("value_encoded_size", f"WITH {LOG} SELECT seq, strlen(value) + 2 + CASE WHEN expires_at < 128 THEN 1 WHEN expires_at < 16384 THEN 2 WHEN expires_at < 2097152 THEN 3 ELSE 4 END AS size FROM log")
def _(spark, d):
    return events_log(spark, d).select("seq", vlog.encoded_value_size().alias("size"))


@query("value_size_percentile", "SELECT CAST(quantile_disc(strlen(text), 0.9) AS BIGINT) AS threshold FROM documents")
def _(spark, d):
    return vlog.size_percentile(read(spark, d, "documents").select(F.col("text").alias("value")), 0.9)


@query(
    "write_batches",
    f"""WITH RECURSIVE {LOG}, e AS (SELECT fid, seq, row_number() OVER (PARTITION BY fid ORDER BY seq) AS n, strlen(user_key) + CASE WHEN strlen(value) < 9 THEN strlen(value) + 2 ELSE 14 END + strlen(value) AS sz FROM log),
b AS (SELECT fid, n, CAST(0 AS BIGINT) AS batch, 1 AS c, sz AS total FROM e WHERE n = 1 UNION ALL
  SELECT fid, n, batch + CASE WHEN opens THEN 1 ELSE 0 END, CASE WHEN opens THEN 1 ELSE c + 1 END, CASE WHEN opens THEN sz ELSE total + sz END
  FROM (SELECT e.fid, e.n, b.batch, b.c, b.total, e.sz, b.c + 1 >= 100 OR b.total + e.sz >= 2048 AS opens FROM b JOIN e ON e.fid = b.fid AND e.n = b.n + 1))
SELECT fid, batch, count(*) AS entries FROM b GROUP BY fid, batch""",
)
def _(spark, d):
    return vlog.batches(events_log(spark, d), 2048, 100, 9).groupBy("fid", "batch").agg(F.count("*").alias("entries"))


# ---- garbage collection


def _updates(spark, d):
    delta = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 0).otherwise(F.floor(F.col("value") * 10)).cast("long")
    return read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("fid"), delta.alias("delta"))


UPDATES = "u AS (SELECT event_id AS seq, user_id AS fid, CAST(CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE floor(value * 10) END AS BIGINT) AS delta FROM events)"
DISCARDS = f"""{UPDATES}, z AS (SELECT fid, max(seq) AS reset FROM u WHERE delta < 0 GROUP BY fid),
stats AS (SELECT u.fid, CAST(coalesce(sum(CASE WHEN delta > 0 AND (reset IS NULL OR seq > reset) THEN delta END), 0) AS BIGINT) AS discard
  FROM u LEFT JOIN z USING (fid) GROUP BY u.fid HAVING bool_or(delta > 0))"""


@query("vlog_discard_stats", f"WITH {DISCARDS} SELECT fid, discard FROM stats")
def _(spark, d):
    return gc.discard_stats(_updates(spark, d))


@query("vlog_max_discard", f"WITH {DISCARDS} SELECT fid, discard FROM stats ORDER BY discard DESC, fid LIMIT 1")
def _(spark, d):
    return gc.max_discard(gc.discard_stats(_updates(spark, d)))


def _entries(spark, d):
    """Log entries, and what the tree has now: every other key's newest version
    points into the log."""
    log = events_log(spark, d)
    current = reads.newest(log)
    return log, current.withColumn("meta", F.when(F.col("seq") % 4 != 0, F.col("meta").bitwiseOR(F.lit(2))).otherwise(F.col("meta")))


ENTRIES = f"""{LOG}, cur AS (
  SELECT user_key, version AS cv, CASE WHEN seq % 4 <> 0 THEN meta | 2 ELSE meta END AS cm, expires_at AS ce, seq AS cs, fid AS cf FROM
  (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS n FROM log) WHERE n = 1),
flags AS (SELECT log.*, cv <> version OR cm & 1 <> 0 OR (ce <> 0 AND ce <= 5000) OR cm & 2 = 0 OR cm & 128 <> 0 AS discard, cv, cm, cs, cf FROM log JOIN cur USING (user_key))"""


@query("discard_flags", f"WITH {ENTRIES} SELECT fid, seq, discard FROM flags")
def _(spark, d):
    return gc.discard_flags(*_entries(spark, d), NOW).select("fid", "seq", "discard")


@query("vlog_discard_ratio", f"WITH {ENTRIES} SELECT fid, round(avg(CAST(discard AS INTEGER)), 9) AS ratio, count(*) AS entries FROM flags GROUP BY fid")
def _(spark, d):
    return gc.discard_ratio(gc.discard_flags(*_entries(spark, d), NOW)).withColumn("ratio", F.round("ratio", 9))


@query("vlog_gc_survivors", f"WITH {ENTRIES} SELECT user_key, version, meta & 61 AS meta FROM flags WHERE NOT discard AND cs = seq AND cf = fid")
def _(spark, d):
    return gc.survivors(*_entries(spark, d), NOW).select("user_key", "version", "meta")


@query(
    "vlog_gc_candidates",
    f"""WITH {LOG}, {DISCARDS}, s AS (SELECT CAST(substr(user_key, 6) AS BIGINT) AS fid, CAST(sum(4 + {VARINT} + strlen(user_key) + 8 + strlen(value) + 4) AS BIGINT) + 20 AS size FROM log GROUP BY 1),
b AS (SELECT * FROM stats ORDER BY discard DESC, fid LIMIT 1) SELECT fid FROM b JOIN s USING (fid) WHERE discard > 0 AND discard >= 0.3 * size AND fid < (SELECT max(fid) FROM u)""",
)
def _(spark, d):
    updates = _updates(spark, d)
    entries, current = (x.withColumn("fid", F.substring("user_key", 6, 20).cast("long")) for x in _entries(spark, d))  # the files of the updates
    sizes = entries.groupBy("fid").agg((F.sum(vlog.record_size()) + vlog.FILE_HEADER).alias("size"))
    ratios = gc.discard_ratio(gc.discard_flags(entries, current, NOW))
    newest = updates.agg(F.max("fid")).first()[0] or 0
    return gc.pick_log(gc.discard_stats(updates), sizes, ratios, max_fid=newest, next_fid=0, ratio=0.3)


@query("ttl_live", f"WITH {LOG} SELECT user_key, version FROM log WHERE {VISIBLE}")
def _(spark, d):
    return events_log(spark, d).filter(~dead(NOW)).select("user_key", "version")


@query(
    "compact_keep_n",
    f"""WITH {LOG}, r AS (SELECT *, row_number() OVER k AS n, coalesce(max(CASE WHEN meta & 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY version DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
  first_value(NOT ({VISIBLE})) OVER k AS gone FROM log WINDOW k AS (PARTITION BY user_key ORDER BY version DESC))
SELECT user_key, version, value FROM r WHERE n <= 3 AND cut = 0 AND NOT gone""",
)
def _(spark, d):
    return gc.compact(events_log(spark, d), 3, NOW).select(*COLUMNS)


def _wanted(spark, d):
    """A compaction for each user: a narrow range of its level, a wider one of the next."""
    u = F.col("user_id")
    at = u * 7 % 100
    three = lambda x: F.lpad(x.cast("string"), 3, "0")
    rows = read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("m"), F.count("*").alias("size"))
    return rows.select((u * 10 + F.col("m") % 7).alias("id"), (u % 3).cast("int").alias("level"), three(at).alias("left"), three(at + 3).alias("right"), (u % 3 + 1).cast("int").alias("next_level"), three(at).alias("next_left"), three(at + 4).alias("next_right"), "size")


WANTED = """w AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM (SELECT user_id * 10 + min(event_id) % 7 AS id, CAST(user_id % 3 AS INTEGER) AS level, lpad(CAST(user_id * 7 % 100 AS VARCHAR), 3, '0') AS l, lpad(CAST(user_id * 7 % 100 + 3 AS VARCHAR), 3, '0') AS r, lpad(CAST(user_id * 7 % 100 + 4 AS VARCHAR), 3, '0') AS nr, count(*) AS size FROM events GROUP BY user_id)),
g AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS STRUCT(level INTEGER, l VARCHAR, r VARCHAR)[]) AS held UNION ALL
  SELECT n, CASE WHEN free THEN id END, CASE WHEN free THEN held || [{'level': level, 'l': l, 'r': r}, {'level': level + 1, 'l': l, 'r': nr}] ELSE held END
  FROM (SELECT w.*, g.held, len(list_filter(g.held, lambda h: (h.level = w.level AND h.l <= w.r AND h.r >= w.l) OR (h.level = w.level + 1 AND h.l <= w.nr AND h.r >= w.l))) = 0 AS free FROM g JOIN w ON w.n = g.n + 1)),
taken AS (SELECT w.* FROM w JOIN g USING (id))"""


@query("compaction_reserve", f"WITH RECURSIVE {WANTED} SELECT id, level FROM taken")
def _(spark, d):
    wanted = _wanted(spark, d)
    return gc.reserve(wanted.limit(0), wanted).select("id", "level")


@query("compaction_del_size", f"WITH RECURSIVE {WANTED} SELECT level, count(*) AS compactions, CAST(sum(size) AS BIGINT) AS del_size FROM taken GROUP BY level")
def _(spark, d):
    wanted = _wanted(spark, d)
    return gc.reserved_size(gc.reserve(wanted.limit(0), wanted))


# ---- replay and marks


def _framed(spark, d):
    """Lineitems as transactions of their orders: a FIN row ends each one, but
    some are missing or have a wrong version."""
    line = read(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("fid"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("user_key"), (F.col("l_orderkey") + 1).alias("version"), F.lit(TXN).alias("meta"), F.lit(None).cast("long").alias("fin_version"))
    o = F.col("o_orderkey")
    ends = read(spark, d, "orders").filter(o % 997 != 5).select(F.floor(o / 100).alias("fid"), (o * 16 + 15).alias("seq"), F.lit("!fin").alias("user_key"), (o + 1).alias("version"), F.lit(128).alias("meta"), F.when(o % 991 == 7, o).otherwise(o + 1).alias("fin_version"))
    has_lines = dealt(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k").distinct()
    return line.unionByName(ends.join(has_lines, F.expr("version - 1 = k"), "left_semi"))


# a file is cut at its first order without an end or with a wrong one
REPLAY = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey // 100 AS fid, o_orderkey % 997 = 5 OR o_orderkey % 991 = 7 AS bad FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
lost AS (SELECT fid, min(k) AS k FROM o WHERE bad GROUP BY fid)
SELECT l_orderkey // 100 AS fid, l_orderkey * 16 + l_linenumber AS seq, 'part:' || l_partkey AS user_key, l_orderkey + 1 AS version
FROM lineitem JOIN o ON l_orderkey = o.k LEFT JOIN lost ON lost.fid = o.fid WHERE lost.k IS NULL OR l_orderkey < lost.k"""


@query("wal_txn_replay", REPLAY)
def _(spark, d):
    return replay.replay(_framed(spark, d)).select("fid", "seq", "user_key", "version")


@query("wal_valid_end", REPLAY.replace("SELECT l_orderkey // 100 AS fid, l_orderkey * 16 + l_linenumber AS seq, 'part:' || l_partkey AS user_key, l_orderkey + 1 AS version", ", a AS (SELECT l_orderkey // 100 AS fid, l_orderkey * 16 + l_linenumber AS seq, l_orderkey + 1 AS version") + ") SELECT f.fid, max(seq) + 1 AS valid_end, max(version) AS max_version FROM (SELECT DISTINCT l_orderkey // 100 AS fid FROM lineitem) f LEFT JOIN a USING (fid) GROUP BY f.fid")
def _(spark, d):
    return replay.valid_end(_framed(spark, d))


@query(
    "watermark_done_until",
    """WITH m AS (SELECT conv_id AS idx, sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE -1 END) AS pending FROM conversations GROUP BY conv_id),
f AS (SELECT min(idx) AS first FROM m WHERE pending > 0 AND idx > 20)
SELECT CAST(coalesce(max(idx), 0) AS BIGINT) AS done_until FROM m, f WHERE first IS NULL OR idx < first""",
)
def _(spark, d):
    c = read(spark, d, "conversations")
    marks = c.select(F.col("conv_id").alias("idx"), (F.col("turn") % 2 != 0).alias("done"))
    open_early = marks.filter("idx <= 20 and not done").select("idx", F.lit(True).alias("done"))  # what is open up to 20 gets done
    return replay.done_until(marks.unionByName(open_early))


@query("stream_progress", "SELECT conv_id AS stream_id, count(*) AS messages, max(turn) >= 4 AS done FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = read(spark, d, "conversations")
    return replay.stream_progress(c.select(F.col("conv_id").alias("stream_id"), (F.col("turn") >= 4).alias("stream_done")))


# ---- buffers


def _records(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.coalesce("text", F.lit("")).alias("rec"))


RECORDS = "r AS (SELECT doc_id AS seq, coalesce(text, '') AS rec FROM documents), p AS (SELECT *, CAST(coalesce(sum(strlen(rec) + 4) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8 AS BIGINT) AS o FROM r)"


@query("buffer_offsets", f'WITH {RECORDS} SELECT seq, o AS "offset" FROM p')
def _(spark, d):
    return buffers.offsets(_records(spark, d)).select("seq", "offset")


@query("buffer_slices", f'WITH {RECORDS} SELECT seq, o AS "offset", o + 4 + strlen(rec) AS next FROM p WHERE rec <> \'\'')
def _(spark, d):
    return buffers.slices(_records(spark, d)).select("seq", "offset", F.col("next").cast("long").alias("next"))


@query("buffer_sort", f"WITH {RECORDS} SELECT seq, row_number() OVER (ORDER BY encode(rec), seq) AS place FROM p")
def _(spark, d):
    return buffers.sort(_records(spark, d)).select("seq", "place")


@query(
    "buffer_range_sort",
    f"""WITH {RECORDS}, i AS (SELECT *, row_number() OVER (ORDER BY seq) AS slot, row_number() OVER (ORDER BY encode(rec), seq) AS moved FROM p WHERE o >= 100000 AND o < 900000)
SELECT a.seq AS "at", md5(b.rec) AS digest FROM i a JOIN i b ON a.slot = b.moved UNION ALL SELECT seq, md5(rec) FROM p WHERE NOT (o >= 100000 AND o < 900000)""",
)
def _(spark, d):
    return buffers.sort_between(_records(spark, d), 100_000, 900_000).select("at", F.md5("rec").alias("digest"))


@query("buffer_sizes", f"WITH {RECORDS} SELECT CAST(sum(strlen(rec) + 4) + 8 AS BIGINT) AS with_padding, CAST(sum(strlen(rec) + 4) AS BIGINT) AS without_padding, count(*) = 0 AS empty FROM p")
def _(spark, d):
    return buffers.sizes(_records(spark, d))


# ---- scalar functions


@query(
    "lcp_adjacent",
    """WITH k AS (SELECT DISTINCT o_orderpriority || o_orderkey AS k FROM orders), r AS (SELECT k, lag(k) OVER (ORDER BY k) AS p FROM k)
SELECT k, CASE WHEN p IS NULL THEN 0 ELSE (SELECT count(*) FROM range(1, 40) AS t(i) WHERE i <= least(length(k), length(p)) AND substr(k, 1, i) = substr(p, 1, i)) END AS lcp FROM r""",
)
def _(spark, d):
    keys = read(spark, d, "orders").select(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("k")).distinct()
    out = neighbours(keys, [F.col("k")], ["k"])
    return out.select("k", F.coalesce(codecs_sql.common_prefix(F.col("k"), F.col("prev_k")), F.lit(0)).cast("long").alias("lcp"))


@query("key_codec", f"WITH {LOG} SELECT seq, lower(hex(encode(user_key))) || printf('%016x', CAST(18446744073709551615 - version AS UBIGINT)) AS encoded, user_key, version FROM log")
def _(spark, d):
    encoded = codecs_sql.with_version(F.col("user_key"), F.col("version"))
    rows = events_log(spark, d).select("seq", encoded.alias("e"))
    return rows.select("seq", F.lower(F.hex("e")).alias("encoded"), codecs_sql.user_key(F.col("e")).cast("string").alias("user_key"), codecs_sql.version(F.col("e")).cast("long").alias("version"))


@query("pointer_codec", f"WITH {LOG}, {SPLIT} SELECT seq, printf('%08x%08x%08x', fid, len, \"offset\") AS pointer FROM split WHERE in_log")
def _(spark, d):
    rows = _split(spark, d).filter("in_log")
    return rows.select("seq", F.lower(F.hex(codecs_sql.pointer_bytes(F.col("fid"), F.col("len"), F.col("offset")))).alias("pointer"))


@query("file_names", "SELECT o_orderkey * 97 AS id, CASE WHEN o_orderkey * 97 < 1000000 THEN lpad(CAST(o_orderkey * 97 AS VARCHAR), 6, '0') ELSE CAST(o_orderkey * 97 AS VARCHAR) END || '.sst' AS name, o_orderkey * 97 AS parsed FROM orders")
def _(spark, d):
    ids = read(spark, d, "orders").select((F.col("o_orderkey") * 97).alias("id"))
    named = ids.withColumn("name", file_name(F.col("id")))
    return named.withColumn("parsed", parse_file_id(F.col("name")))


@query("meta_bits", f"WITH {LOG} SELECT meta, meta & 1 <> 0 AS deleted, meta & 4 <> 0 AS discards, count(*) AS n FROM log GROUP BY ALL")
def _(spark, d):
    return events_log(spark, d).groupBy("meta", has(1).alias("deleted"), has(4).alias("discards")).agg(F.count("*").alias("n"))


@query("crc32_docs")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@query("bloom_probe")
def _(spark, d):
    log = events_log(spark, d)
    keys = F.explode(F.array(*[F.lit(k) for k in (KEY, "user:999999", "other")])).alias("user_key")
    return codecs.probe_filters(codecs.table_filters(log), log.select("table_id").distinct().select("table_id", keys))


# ---- data keys

DATA_KEYS = "keys AS (SELECT c_custkey AS key_id, c_custkey * 3600 AS created_at FROM customer)"


def _keys(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("key_id"), F.concat(F.lit("key-"), k.cast("string")).alias("data"), (k * 3600).alias("created_at"))


@query("registry_latest", f"WITH {DATA_KEYS} SELECT key_id, created_at, 200000 - created_at < 86400 AS valid FROM keys ORDER BY created_at DESC, key_id DESC LIMIT 1")
def _(spark, d):
    return registry.latest(_keys(spark, d), 200_000, 86_400)


@query("registry_lookup", f"WITH {DATA_KEYS} SELECT o_orderkey, o_custkey % 60 AS key_id, CASE WHEN keys.key_id IS NOT NULL THEN 'key-' || keys.key_id END AS key_data, o_custkey % 60 <> 0 AND keys.key_id IS NULL AS \"unknown\" FROM orders LEFT JOIN keys ON o_custkey % 60 = keys.key_id")
def _(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("key_id"))
    return registry.with_data_key(rows, _keys(spark, d))


@query("registry_upsert", f"WITH {DATA_KEYS} SELECT key_id, 'key-' || key_id AS data FROM keys WHERE key_id > 5 UNION ALL SELECT key_id, 'new' FROM keys WHERE key_id <= 5")
def _(spark, d):
    keys = _keys(spark, d)
    return registry.upsert(keys, keys.filter("key_id <= 5").withColumn("data", F.lit("new"))).select("key_id", "data")


# the same with a key for each customer; rows name known keys, unknown ones and none
ALL_KEYS = "keys AS (SELECT c_custkey AS key_id, c_custkey * 3600 AS created_at FROM customer)"
NAMED_KEY = "CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN -o_custkey ELSE o_custkey END"


def _all_keys(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("key_id"), F.concat(F.lit("key-"), k.cast("string")).alias("data"), (k * 3600).alias("created_at"))


@query("registry_latest_whole", f"WITH {ALL_KEYS} SELECT key_id, created_at, 200000 - created_at < 86400 AS valid FROM keys ORDER BY created_at DESC, key_id DESC LIMIT 1")
def _(spark, d):
    return registry.latest(_all_keys(spark, d), 200_000, 86_400)


@query("registry_lookup_whole", f"WITH {ALL_KEYS}, o AS (SELECT o_orderkey, {NAMED_KEY} AS key_id FROM orders) SELECT o_orderkey, o.key_id, 'key-' || keys.key_id AS key_data, o.key_id <> 0 AND keys.key_id IS NULL AS \"unknown\" FROM o LEFT JOIN keys USING (key_id)")
def _(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.expr(NAMED_KEY).alias("key_id"))
    return registry.with_data_key(rows, _all_keys(spark, d))


@query("registry_upsert_whole", f"WITH {ALL_KEYS} SELECT key_id, CASE WHEN key_id % 5 = 0 THEN 'new' ELSE 'key-' || key_id END AS data FROM keys")
def _(spark, d):
    keys = _all_keys(spark, d)
    return registry.upsert(keys, keys.filter("key_id % 5 = 0").withColumn("data", F.lit("new"))).select("key_id", "data")


# ---- predicates and marks


@query(
    "range_overlaps",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS l,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE lpad(CAST(o_custkey + o_orderkey % 50 AS VARCHAR), 6, '0') END AS r, o_orderkey % 13 = 0 AS inf FROM orders)
SELECT o_orderkey, CASE WHEN l = '' AND r = '' AND NOT inf THEN true WHEN inf THEN true ELSE l <= '000700' AND r >= '000600' END AS meets FROM r""",
)
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    six = lambda x: F.when(k % 11 == 0, "").otherwise(F.lpad(x.cast("string"), 6, "0"))
    rows = read(spark, d, "orders").select("o_orderkey", six(c).alias("l"), six(c + k % 50).alias("r"), (k % 13 == 0).alias("inf"), F.lit("000600").alias("ol"), F.lit("000700").alias("orr"), F.lit(False).alias("oi"))
    return rows.select("o_orderkey", manifest.range_overlaps("l", "r", "inf", "ol", "orr", "oi").alias("meets"))


@query("entry_marks", f"WITH {LOG} SELECT seq, meta | 4 AS discarding, meta | 8 AS merging, CASE WHEN seq % 2 = 0 THEN {NOW} + seq ELSE 0 END AS expires FROM log")
def _(spark, d):
    m = F.col("meta")
    expires = F.when(F.col("seq") % 2 == 0, F.lit(NOW) + F.col("seq")).otherwise(0).cast("long")
    return events_log(spark, d).select("seq", m.bitwiseOR(F.lit(4)).alias("discarding"), m.bitwiseOR(F.lit(8)).alias("merging"), expires.alias("expires"))


@query("threshold_flags", f"WITH {LOG} SELECT seq, strlen(value) < 9 AS in_line FROM log")
def _(spark, d):
    return events_log(spark, d).select("seq", (F.octet_length("value") < 9).alias("in_line"))


TABLE_CUT = f"""WITH RECURSIVE {LOG}, e AS (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY user_key, version DESC, seq) AS n, strlen(user_key) + strlen(value) AS sz FROM log),
c AS (SELECT table_id, n, CAST(0 AS BIGINT) AS file, sz AS total FROM e WHERE n = 1 UNION ALL
  SELECT e.table_id, e.n, c.file + CASE WHEN c.total > 3891 THEN 1 ELSE 0 END, CASE WHEN c.total > 3891 THEN e.sz ELSE c.total + e.sz END FROM c JOIN e ON e.table_id = c.table_id AND e.n = c.n + 1)
SELECT table_id, file, count(*) AS n FROM c GROUP BY table_id, file"""


@query("table_cut", TABLE_CUT)
def _(spark, d):
    return vlog.cut_tables(events_log(spark, d), 4096).groupBy("table_id", "file").agg(F.count("*").alias("n"))


@query("table_cut_fold", TABLE_CUT.replace("3891", "972").replace("seq)", "seq)"))
def _(spark, d):
    return vlog.cut_tables(events_log(spark, d), 1024).groupBy("table_id", "file").agg(F.count("*").alias("n"))


@query("get_over_sources", f"""WITH {LOG}, u AS (SELECT user_key, version, value, 0 AS src FROM log WHERE seq % 5 = 0 UNION ALL SELECT user_key, version, 'old ' || value, 1 FROM log),
r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC, src) AS n FROM u WHERE version <= {AT}) SELECT user_key, version, value FROM r WHERE n = 1""")
def _(spark, d):
    log = events_log(spark, d)
    memtable, levels = log.filter("seq % 5 = 0"), log.withColumn("value", F.concat(F.lit("old "), F.col("value")))
    return reads.newest(merge.merge([memtable, levels]), AT).select(*COLUMNS)


@query("versions_per_key", f"WITH {LOG} SELECT user_key, count(*) AS versions, max(version) AS max_version, min(version) AS min_version FROM log GROUP BY user_key")
def _(spark, d):
    return events_log(spark, d).groupBy("user_key").agg(F.count("*").alias("versions"), F.max("version").alias("max_version"), F.min("version").alias("min_version"))


# ---- more scalar functions


@query("bits_per_key", "SELECT o_orderkey + 1 AS n, CAST(floor(-(o_orderkey + 1) * ln(0.01) / pow(ln(2), 2) / (o_orderkey + 1)) AS BIGINT) AS bits FROM orders")
def _(spark, d):
    n = F.col("o_orderkey") + 1
    return read(spark, d, "orders").select(n.alias("n"), codecs_sql.bits_per_key(n, F.lit(0.01)).alias("bits"))


@query("code_names", "SELECT event_id, ['none', 'snappy', 'zstd', 'lz4'][event_id % 4 + 1] AS compression, ['crc32', 'xxhash64', 'seahash'][event_id % 3 + 1] AS checksum, ['CREATE', 'DELETE'][event_id % 2 + 1] AS operation FROM events")
def _(spark, d):
    e = F.col("event_id")
    name = lambda n, names: codecs_sql.code_name((e % n).cast("int"), names)
    return read(spark, d, "events").select("event_id", name(4, codecs_sql.COMPRESSION).alias("compression"), name(3, codecs_sql.CHECKSUM).alias("checksum"), name(2, codecs_sql.OPERATION).alias("operation"))


@query("record_iv", f'WITH {LOG}, {SPLIT} SELECT seq, \'000102030405060708090a0b\' || printf(\'%08x\', "offset") AS iv FROM split WHERE in_log')
def _(spark, d):
    base = F.unhex(F.lit("000102030405060708090a0b"))
    return _split(spark, d).filter("in_log").select("seq", F.lower(F.hex(codecs_sql.file_iv(base, F.col("offset")))).alias("iv"))


@query("value_encryption", f"WITH {LOG} SELECT seq, value, strlen(value) AS hidden_bytes, value <> '' AS hidden FROM log")
def _(spark, d):
    """CTR keeps the length, hides the value, and is its own inverse."""
    key, iv = F.lit(b"0123456789abcdef0123456789abcdef"), codecs_sql.file_iv(F.lit(bytes(range(12))), F.col("seq"))
    rows = events_log(spark, d).select("seq", "value", iv.alias("iv"))
    rows = rows.withColumn("c", codecs_sql.aes_ctr(F.col("value").cast("binary"), key, F.col("iv")))
    shown = codecs_sql.aes_ctr(F.col("c"), key, F.col("iv")).cast("string")
    return rows.select("seq", shown.alias("value"), F.octet_length("c").cast("long").alias("hidden_bytes"), (F.col("c") != F.col("value").cast("binary")).alias("hidden"))


@query("common_suffix", """WITH r AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_orderkey + o_custkey * 100 AS VARCHAR) AS b FROM orders)
SELECT o_orderkey, (SELECT count(*) FROM range(1, 40) AS t(i) WHERE i <= least(length(a), length(b)) AND right(a, i) = right(b, i)) AS lcs FROM r""")
def _(spark, d):
    k = F.col("o_orderkey")
    lcs = codecs_sql.common_suffix(k.cast("string"), (k + F.col("o_custkey") * 100).cast("string"))
    return read(spark, d, "orders").select("o_orderkey", lcs.cast("long").alias("lcs"))
