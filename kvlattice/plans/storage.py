"""Queries over tables, logs and streams that are written and read back, and over
codecs byte for byte."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from ..functions import codecs, codecs_sql
from ..model import FIN_TXN, has
from ..operators import buffers, gc, levels, manifest, merge, reads, vlog
from ..sources import scratch
from ..sources.tables import create_table, events_log, open_in_memory, read, read_tables, write_tables
from ..sources.wal import WalSource, log_files, read_raw, read_wal, write_wal
from ..store import Store
from ..streaming import marks
from .catalogue import AT, COLUMNS, ENTRIES, LOG, NOW, PREFIX, RECORDS, SPLIT, STATS, VARINT, _entries, _records, _split, query

# ---- whole order


@query("kv_scan_positions", f"WITH {LOG} SELECT user_key, version, row_number() OVER (ORDER BY user_key, version DESC, seq) AS position FROM log")
def _(spark, d):
    return reads.number(events_log(spark, d).select("user_key", "version", "seq")).select("user_key", "version", "position")


@query("kv_reverse_positions", f"WITH {LOG} SELECT user_key, version, row_number() OVER (ORDER BY user_key DESC, version, seq) AS position FROM log")
def _(spark, d):
    from ..model import canonical
    from ..operators.ordering import row_number

    return row_number(events_log(spark, d).select("user_key", "version", "seq"), [*canonical(True), F.col("seq")], "position").select("user_key", "version", "position")


@query("kv_seek_many", f"""WITH {LOG}, p AS (SELECT DISTINCT 'user:' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END AS probe FROM orders),
k AS (SELECT DISTINCT user_key FROM log) SELECT probe, (SELECT min(user_key) FROM k WHERE user_key >= probe) AS user_key FROM p WHERE EXISTS (SELECT 1 FROM k WHERE user_key >= probe)""")
def _(spark, d):
    suffix = F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("")
    probes = read(spark, d, "orders").select(F.concat(F.lit("user:"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), suffix).alias("probe")).distinct()
    return reads.seek(events_log(spark, d), probes, "ge").select("probe", "user_key")


@query("kv_get_many", f"""WITH {LOG}, q AS (SELECT DISTINCT 'user:' || lpad(CAST(event_id % 200 AS VARCHAR), 6, '0') AS user_key, event_id % 977 * 9 AS v FROM events),
r AS (SELECT q.user_key, q.v, log.version, log.value, row_number() OVER (PARTITION BY q.user_key, q.v ORDER BY version DESC) AS n FROM q JOIN log ON log.user_key = q.user_key AND log.version <= q.v)
SELECT user_key, v AS "at", version, value FROM r WHERE n = 1""")
def _(spark, d):
    e = F.col("event_id")
    asked = read(spark, d, "events").select(F.concat(F.lit("user:"), F.lpad((e % 200).cast("string"), 6, "0")).alias("user_key"), (e % 977 * 9).alias("at"))
    return reads.get_at(events_log(spark, d).select(*COLUMNS, "seq"), asked).select("user_key", "at", "version", "value")


# ---- tables on storage


def _tables(spark, d):
    """Level 0: a table for each thousand events; lower levels: for each ten users."""
    user = F.substring("user_key", 6, 5).cast("long")
    return events_log(spark, d).withColumn("table_id", F.when(F.col("level") == 0, F.col("table_id")).otherwise(F.col("level") * 1_000_000 + user))


TABLES = "tables AS (SELECT * EXCLUDE (table_id), CASE WHEN level = 0 THEN table_id ELSE level * 1000000 + CAST(substr(user_key, 6, 5) AS BIGINT) END AS table_id FROM log)"
TABLE_STATS = STATS.replace("FROM log", "FROM tables")
PICKED = f"picked AS (SELECT table_id FROM manifest WHERE max_version >= 400 AND substr(smallest, 1, 10) <= '{PREFIX}' AND substr(biggest, 1, 10) >= '{PREFIX}')"


def _written(spark, d):
    log, path = _tables(spark, d), scratch.fresh(spark, "tables")
    write_tables(log, path)
    return log, path, scratch.materialize(manifest.table_stats(log), "manifest")


@query("table_write_read", f"WITH {LOG} SELECT user_key, version, value, meta, expires_at, seq FROM log")
def _(spark, d):
    log = events_log(spark, d)
    return create_table(log, scratch.fresh(spark, "table"), rows_per_file=4000).select(*COLUMNS, "meta", "expires_at", "seq")


@query("table_simple_write_read", f"WITH {LOG} SELECT user_key, version, value FROM log WHERE meta & 1 = 0")
def _(spark, d):
    return create_table(events_log(spark, d), scratch.fresh(spark, "table"), compression="none").filter(~has(1)).select(*COLUMNS)


@query("table_in_memory", "SELECT r_name AS user_key, r_regionkey AS version FROM region")
def _(spark, d):
    regions = read(spark, d, "region").select("r_name", F.col("r_regionkey").cast("long")).limit(100).collect()  # a driver's own few rows
    return open_in_memory(spark, [(n, v, "", 0, 0, 0, 0, 0, 0, v) for n, v in regions], "kv_regions").select("user_key", "version")


@query("table_scan_pruned", f"WITH {LOG}, {TABLES}, {TABLE_STATS}, {PICKED} SELECT user_key, version, value, table_id FROM tables JOIN picked USING (table_id) WHERE starts_with(user_key, '{PREFIX}')")
def _(spark, d):
    log, path, stats = _written(spark, d)
    return levels.scan(spark, path, log.schema, stats, PREFIX, 400).select(*COLUMNS, "table_id")


@query("level_iterators", f"WITH {LOG}, {TABLES}, {TABLE_STATS}, {PICKED} SELECT level, CASE WHEN level = 0 THEN table_id ELSE -1 END AS source, count(*) AS tables FROM manifest JOIN picked USING (table_id) GROUP BY ALL")
def _(spark, d):
    return levels.sources(manifest.pick_tables(manifest.table_stats(_tables(spark, d)), PREFIX, 400)).groupBy("level", "source").agg(F.count("*").alias("tables"))


@query("level_get", f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS n FROM log WHERE version <= {AT})
SELECT user_key, {AT} AS "at", version, value FROM r WHERE n = 1""")
def _(spark, d):
    log, path, stats = _written(spark, d)
    keys = log.select("user_key").distinct()
    absent = keys.withColumn("user_key", F.concat("user_key", F.lit("#")))
    asked = keys.unionByName(absent).withColumn("at", F.lit(AT))
    return levels.get(spark, path, log.schema, stats, codecs.table_filters(log), asked).select("user_key", "at", "version", "value")


@query("table_candidates", f"""WITH {LOG}, {TABLES}, {TABLE_STATS} SELECT user_key, table_id FROM (SELECT DISTINCT user_key FROM log) JOIN manifest ON user_key >= smallest AND user_key <= biggest""")
def _(spark, d):
    log = _tables(spark, d)
    return levels.candidates(log.select("user_key").distinct(), manifest.table_stats(log)).select("user_key", "table_id")


@query("table_metadata", f"""WITH {LOG}, {STATS} SELECT table_id AS id, lpad(CAST(table_id AS VARCHAR), 6, '0') || '.sst' AS path, smallest, biggest, max_version, key_count, size AS uncompressed_size, stale_size AS stale_data_size,
  (greatest(64, key_count * 10) + 7) // 8 + 1 AS bloom_filter_size, 'zstd' AS compression, 'crc32' AS checksum, false AS in_memory FROM manifest""")
def _(spark, d):
    return manifest.metadata(manifest.table_stats(events_log(spark, d)))


@query("bloom_no_false_negative", f"WITH {LOG} SELECT DISTINCT table_id, user_key FROM log")
def _(spark, d):
    log = events_log(spark, d)
    return codecs.probe_filters(codecs.table_filters(log), log.select("table_id", "user_key").distinct()).filter("may").select("table_id", "user_key")


@query("table_checksums", f"WITH {LOG} SELECT table_id, count(*) AS entries, count(*) FILTER (seq % 10 = 3) AS broken FROM log GROUP BY table_id")
def _(spark, d):
    """Every tenth record is changed behind its checksum's back."""
    stored = vlog.with_checksum(events_log(spark, d)).withColumn("value", F.when(F.col("seq") % 10 == 3, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return vlog.verify(stored).groupBy("table_id").agg(F.count("*").alias("entries"), F.count(F.when(~F.col("intact"), 1)).alias("broken"))


@query("store_round_trip", f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS n, coalesce(max(CASE WHEN meta & 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY version DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
  first_value(meta & 1 <> 0 OR (expires_at <> 0 AND expires_at <= 5000)) OVER (PARTITION BY user_key ORDER BY version DESC) AS gone FROM log)
SELECT user_key, version, value, CAST(1 AS INTEGER) AS level FROM r WHERE n <= 2 AND cut = 0 AND NOT gone""")
def _(spark, d):
    """Three writes, a compaction, and a scan of the store as a reader opens it."""
    log, path = events_log(spark, d), scratch.fresh(spark, "store")
    store = Store(spark, path)
    for k in range(3):
        store.write(log.filter(F.col("seq") % 3 == k))
    store.compact(2, NOW)
    return Store.open(spark, path, store.change).scan().select(*COLUMNS, "level")


# ---- memtables


def _writes(spark, d):
    """Versions that several writes share, and ends of transactions."""
    log = events_log(spark, d)
    return log.withColumns({"version": F.floor(F.col("version") / 400), "meta": F.when(F.col("seq") % 17 == 5, F.lit(FIN_TXN)).otherwise(F.col("meta"))})


WRITES = """writes AS (SELECT * EXCLUDE (version, meta), version // 400 AS version, CASE WHEN seq % 17 = 5 THEN 128 ELSE meta END AS meta FROM log),
mem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key, version ORDER BY seq DESC) AS n FROM writes WHERE meta & 128 = 0) WHERE n = 1)"""


@query("memtable_insert", f"WITH {LOG}, {WRITES} SELECT user_key, version, value, meta, seq FROM mem")
def _(spark, d):
    return merge.insert(_writes(spark, d)).select(*COLUMNS, "meta", "seq")


@query("memtable_scan", f"WITH {LOG}, {WRITES} SELECT user_key, version, row_number() OVER (ORDER BY user_key, version DESC) AS position FROM mem")
def _(spark, d):
    return reads.number(merge.insert(_writes(spark, d).select("user_key", "version", "meta", "seq"))).select("user_key", "version", "position")


@query("memtable_stats", f"WITH {LOG}, {WRITES} SELECT count(*) AS entries, CAST(sum(strlen(user_key) + 8 + strlen(value)) AS BIGINT) AS mem_size, max(version) AS max_version FROM mem")
def _(spark, d):
    return merge.memtable_stats(merge.insert(_writes(spark, d)))


@query("memtable_full", f"WITH {LOG} SELECT fid, sum(strlen(user_key) + 8 + strlen(value)) >= 12000 AS is_full FROM log GROUP BY fid")
def _(spark, d):
    size = F.octet_length("user_key") + 8 + F.octet_length("value")
    return events_log(spark, d).groupBy("fid").agg((F.sum(size) >= 12_000).alias("is_full"))


@query("kv_merge_last_write", f"""WITH {LOG}, w AS (SELECT user_key, version // 400 AS version, value, seq, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS src FROM log),
r AS (SELECT *, row_number() OVER (PARTITION BY user_key, version ORDER BY src, seq DESC) AS n FROM w) SELECT user_key, version, value, src FROM r WHERE n = 1""")
def _(spark, d):
    log = events_log(spark, d).withColumn("version", F.floor(F.col("version") / 400))
    return merge.merge([log.filter("seq % 2 = 0"), log.filter("seq % 2 = 1")]).select(*COLUMNS, "src")


# ---- value logs


@query("vlog_validate_writes", f"""WITH RECURSIVE {LOG}, q AS (SELECT fid, seq // 5 AS request, row_number() OVER (PARTITION BY fid ORDER BY seq // 5) AS n, CAST(sum(strlen(user_key) + strlen(value) + 25) AS BIGINT) AS size FROM log GROUP BY fid, seq // 5),
v AS (SELECT fid, request, n, 20 + size AS "end" FROM q WHERE n = 1 UNION ALL
  SELECT q.fid, q.request, q.n, q.size + CASE WHEN v."end" >= 4096 THEN 0 ELSE v."end" END FROM v JOIN q ON q.fid = v.fid AND q.n = v.n + 1)
SELECT fid, request, "end", "end" <= 4294967295 AS valid FROM v""")
def _(spark, d):
    log = events_log(spark, d).withColumn("request", F.floor(F.col("seq") / 5))
    return vlog.validate_writes(log, 4096).select("fid", "request", "end", "valid")


@query("vlog_rewrite_batches", f"""WITH RECURSIVE {LOG}, e AS (SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY seq) AS n, strlen(user_key) + CASE WHEN strlen(value) < 9 THEN strlen(value) + 2 ELSE 14 END AS sz FROM log),
p AS (SELECT fid, n, CAST(sum(sz) OVER (PARTITION BY fid ORDER BY n) AS BIGINT) AS upto, count(*) OVER (PARTITION BY fid) AS all_n FROM e UNION ALL SELECT fid, 0, 0, count(*) FROM e GROUP BY fid),
b AS (SELECT DISTINCT fid, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(1024 AS BIGINT) AS size, CAST(-1 AS BIGINT) AS batch, all_n FROM p UNION ALL
  SELECT b.fid, CASE WHEN ok THEN b.j ELSE b.i END, CASE WHEN ok THEN to_ ELSE b.j END, CASE WHEN ok THEN size ELSE size // 2 END, CASE WHEN ok THEN batch + 1 ELSE batch END, b.all_n
  FROM (SELECT b.*, least(b.j + b.size, b.all_n) AS to_, q.upto - f.upto < 3000 AND least(b.j + b.size, b.all_n) - b.j < 200 AS ok
    FROM b JOIN p AS f ON f.fid = b.fid AND f.n = b.j JOIN p AS q ON q.fid = b.fid AND q.n = least(b.j + b.size, b.all_n) WHERE b.j < b.all_n) AS b)
SELECT fid, batch, max(j - i) AS entries FROM b WHERE batch >= 0 AND i < j GROUP BY fid, batch""")
def _(spark, d):
    return vlog.halved_batches(events_log(spark, d), 3000, 200, 9).groupBy("fid", "batch").agg(F.count("*").alias("entries"))


@query("vlog_open", f"WITH {LOG}, f AS (SELECT fid, 20 + CASE WHEN fid % 3 = 1 THEN 0 ELSE count(*) END AS size FROM log GROUP BY fid) SELECT fid, size, fid = (SELECT max(fid) FROM f) AS writable FROM f WHERE size > 20 OR fid = (SELECT max(fid) FROM f)")
def _(spark, d):
    files = events_log(spark, d).groupBy("fid").agg(F.count("*").alias("n")).select("fid", (F.when(F.col("fid") % 3 == 1, 0).otherwise(F.col("n")) + 20).alias("size"))
    return vlog.open_files(files)


@query("vlog_read_verified", f"WITH {LOG}, {SPLIT} SELECT user_key, version, value FROM split WHERE in_log AND seq % 10 <> 3")
def _(spark, d):
    """A read of pointers that leaves out records whose checksum is wrong."""
    rows = vlog.with_checksum(_split(spark, d).filter("in_log"))
    kept = rows.withColumn("crc", F.when(F.col("seq") % 10 == 3, F.col("crc") + 1).otherwise(F.col("crc")))
    found = vlog.read_pointers(rows.select("version", "fid", "offset", "len"), kept.select("fid", "offset", "len", "user_key", "value", "crc"))
    return vlog.verify(found).filter("intact").select(*COLUMNS)


@query("vlog_gc_first_file", f"WITH {ENTRIES}, r AS (SELECT fid, avg(CAST(discard AS INTEGER)) AS ratio FROM flags GROUP BY fid) SELECT min(fid) AS fid FROM r WHERE fid >= 1 AND fid < (SELECT max(fid) FROM r) AND ratio >= 0.5 HAVING min(fid) IS NOT NULL")
def _(spark, d):
    """Without statistics: the first file in turn with enough to discard."""
    entries, current = _entries(spark, d)
    ratios = gc.discard_ratio(gc.discard_flags(entries, current, NOW))
    newest = entries.agg(F.max("fid")).first()[0] or 0
    none = spark.createDataFrame([], "fid long, discard long")
    return gc.pick_log(none, spark.createDataFrame([], "fid long, size long"), ratios, max_fid=newest, next_fid=1, ratio=0.5)


_RUN = f"""WITH {ENTRIES}, r AS (SELECT fid, avg(CAST(discard AS INTEGER)) AS ratio, count(*) AS n, count(*) FILTER (NOT discard AND cs = seq AND cf = fid) AS moved FROM flags GROUP BY fid),
p AS (SELECT min(fid) AS fid FROM r WHERE fid < (SELECT max(fid) FROM r) AND ratio >= 0.5)
SELECT CASE WHEN p.fid IS NULL THEN 'no_rewrite' ELSE 'rewritten' END AS outcome, p.fid, coalesce(moved, 0) AS moved, coalesce(n - moved, 0) AS dropped FROM p LEFT JOIN r USING (fid)
UNION ALL SELECT 'rejected', NULL, 0, 0 UNION ALL SELECT 'no_rewrite', NULL, 0, 0"""


@query("vlog_gc_run", _RUN)
def _(spark, d):
    """One collection; one asked for meanwhile; one that finds nothing."""
    entries, current = _entries(spark, d)
    ratios = gc.discard_ratio(gc.discard_flags(entries, current, NOW)).filter("ratio >= 0.5")
    newest = entries.agg(F.max("fid")).first()[0] or 0
    picked = ratios.filter(F.col("fid") < newest).agg(F.min("fid").alias("fid")).filter("fid is not null")
    runs = [gc.run(entries, current, picked, NOW), gc.run(entries, current, picked, NOW, busy=True), gc.run(entries, current, picked.limit(0), NOW)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("discard_stats_by_file", """WITH u AS (SELECT event_id AS seq, user_id AS fid, CAST(CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE floor(value * 10) END AS BIGINT) AS delta FROM events),
z AS (SELECT fid, max(seq) AS reset FROM u WHERE delta < 0 GROUP BY fid),
s AS (SELECT u.fid, CAST(coalesce(sum(CASE WHEN delta > 0 AND (reset IS NULL OR seq > reset) THEN delta END), 0) AS BIGINT) AS discard FROM u LEFT JOIN z USING (fid) GROUP BY u.fid HAVING bool_or(delta > 0))
SELECT fid, discard, row_number() OVER (ORDER BY fid) AS place FROM s""")
def _(spark, d):
    from ..operators.ordering import row_number
    from .catalogue import _updates

    return row_number(gc.discard_stats(_updates(spark, d)), [F.col("fid")], "place")


@query("vlog_remove_all", f"WITH {LOG} SELECT count(*) AS removed, CAST(0 AS BIGINT) AS \"left\" FROM log")
def _(spark, d):
    log, path = events_log(spark, d), scratch.fresh(spark, "log")
    log.write.parquet(path)
    before = spark.read.schema(log.schema).parquet(path).count()
    log.limit(0).write.mode("overwrite").parquet(path)
    return spark.read.schema(log.schema).parquet(path).agg(F.lit(before).cast("long").alias("removed"), F.count("*").alias("left"))


# ---- log files

_PLACED = """sized AS (SELECT *, 4 + {v} + strlen(user_key) + 8 + strlen(value) + 4 AS sz FROM log),
placed AS (SELECT *, CAST(coalesce(sum(sz) OVER (PARTITION BY fid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 20 AS BIGINT) AS pos FROM sized)""".format(v=VARINT)


def _logged(spark, d):
    log, folder = events_log(spark, d), scratch.fresh(spark, "wal")
    return log, folder, scratch.materialize(write_wal(log, folder), "placed")


def _text(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("user_key", "value")})


@query("wal_round_trip", f'WITH {LOG}, {_PLACED} SELECT fid, pos AS "offset", CAST(sz AS BIGINT) AS len, user_key, version, value, meta, expires_at FROM placed')
def _(spark, d):
    _, folder, _ = _logged(spark, d)
    return _text(read_wal(spark, folder)).select("fid", "offset", "len", *COLUMNS, "meta", "expires_at")


@query("wal_pointer_read", f"WITH {LOG}, {_PLACED} SELECT fid, seq, CAST(sz AS BIGINT) AS len, substr(printf('%02x', meta), 1, 2) || '00' AS head FROM placed WHERE seq % 3 = 0 UNION ALL SELECT -1, -1, 9, NULL FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM log)")
def _(spark, d):
    """Raw bytes at pointers; one is beyond its file's end."""
    _, folder, placed = _logged(spark, d)
    pointers = placed.filter("seq % 3 = 0").select("fid", "offset", "len", "seq")
    beyond = placed.agg(F.min("fid").alias("fid"), F.lit(1 << 30).cast("long").alias("offset"), F.lit(9).cast("long").alias("len"), F.lit(-1).cast("long").alias("seq")).filter("fid is not null")
    asked = pointers.unionByName(beyond)
    raw = read_raw(log_files(spark, folder), asked.drop("seq"))
    out = asked.join(raw, ["fid", "offset", "len"])
    return out.select(F.when(F.col("seq") < 0, -1).otherwise(F.col("fid")).alias("fid"), "seq", "len", F.lower(F.hex(F.substring("raw", 1, 2))).alias("head"))


@query("wal_headers", f"WITH {LOG}, {_PLACED} SELECT fid, CAST(sum(sz) + 20 AS BIGINT) AS size, CAST(0 AS BIGINT) AS key_id, repeat('00', 12) AS base FROM placed GROUP BY fid")
def _(spark, d):
    _, folder, _ = _logged(spark, d)
    return log_files(spark, folder).select("fid", "size", "key_id", F.lower(F.hex("base")).alias("base"))


@query("wal_data_source", f"WITH {LOG} SELECT fid, user_key, version, value FROM log")
def _(spark, d):
    """Written and read by the Python data source."""
    spark.dataSource.register(WalSource)
    folder = scratch.fresh(spark, "kvwal")
    n = F.lit(0).cast("long")
    rows = events_log(spark, d).select("fid", n.alias("offset"), n.alias("len"), F.col("user_key").cast("binary"), "version", F.col("value").cast("binary"), "meta", "user_meta", "expires_at", "seq")
    rows.repartition("fid").sortWithinPartitions("fid", "seq").drop("seq").write.format("kvwal").mode("append").option("path", folder).save()
    return _text(spark.read.format("kvwal").option("path", folder).load()).select("fid", *COLUMNS)


@query("wal_iter_stop", f"WITH {LOG}, s AS (SELECT fid, min(seq) AS stop FROM log WHERE meta = 1 GROUP BY fid) SELECT log.fid, seq, version FROM log LEFT JOIN s USING (fid) WHERE stop IS NULL OR seq <= stop")
def _(spark, d):
    """Each file up to its first deletion."""
    return reads.scan_until(events_log(spark, d), has(1)).select("fid", "seq", "version")


# ---- streams


def _stream(spark, d, name):
    return spark.readStream.schema(read(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, as a path may name a file or a folder


@query("stream_progress_live", "SELECT conv_id AS stream_id, count(*) AS messages, max(turn) >= 4 AS done FROM conversations GROUP BY conv_id")
def _(spark, d):
    path = scratch.fresh(spark, "progress")
    progress = marks.stream_completion(_stream(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), (F.col("turn") >= 4).alias("stream_done")))
    marks.finish(progress.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/part={n}")), scratch.fresh(spark, "stream"))
    last = spark.read.schema("stream_id long, messages long, done boolean, batch long").parquet(path)
    return last.groupBy("stream_id").agg(F.max_by("messages", "batch").alias("messages"), F.max_by("done", "batch").alias("done"))


@query("done_until_live", """WITH m AS (SELECT CAST(conv_id % 4 AS VARCHAR) AS name, conv_id // 4 AS idx, sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE -1 END) AS pending FROM conversations GROUP BY conv_id),
f AS (SELECT name, min(idx) FILTER (pending > 0) - 1 AS first, max(idx) AS last FROM m GROUP BY name) SELECT name, coalesce(first, last) AS done_until FROM f WHERE coalesce(first, last) > 0""")
def _(spark, d):
    path, c = scratch.fresh(spark, "done"), F.col("conv_id")
    found = marks.done_until_stream(_stream(spark, d, "conversations").select((c % 4).cast("string").alias("name"), F.floor(c / 4).alias("idx"), (F.col("turn") % 2 != 0).alias("done")))
    marks.finish(found.writeStream.format("parquet").outputMode("append").option("path", path), scratch.fresh(spark, "stream"))
    return spark.read.schema(found.schema).parquet(path).groupBy("name").agg(F.max("done_until").alias("done_until"))


@query("threshold_live", """WITH s AS (SELECT CASE WHEN strlen(text) <= 1 THEN 0 ELSE length(bin(strlen(text) - 1)) END AS bits FROM documents),
c AS (SELECT bits, count(*) AS n FROM s GROUP BY bits), u AS (SELECT bits, sum(n) OVER (ORDER BY bits) AS upto, sum(n) OVER () AS total FROM c)
SELECT CAST(pow(2, min(bits)) AS BIGINT) AS threshold FROM u WHERE upto >= 0.9 * total""")
def _(spark, d):
    published: list[int] = []
    sizes = _stream(spark, d, "documents").select(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    marks.finish(marks.follow_threshold(sizes, 0.9, published.append), scratch.fresh(spark, "stream"))
    return spark.createDataFrame([(x,) for x in published[-1:]], "threshold long")


@query("memtable_handover", f"WITH {LOG}, {WRITES} SELECT user_key, version, value, seq FROM mem")
def _(spark, d):
    """Batches of a stream of writes, handed over as tables and read as one."""
    path, e = scratch.fresh(spark, "memtables"), F.col("event_id")
    writes = _stream(spark, d, "events").select(F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("user_key"), F.floor((e + 1) / 400).alias("version"), F.col("props").alias("value"), F.when(e % 17 == 5, F.lit(FIN_TXN)).otherwise(0).alias("meta"), e.alias("seq"))
    marks.finish(marks.handover(writes, path), scratch.fresh(spark, "stream"))
    return merge.insert(spark.read.schema("user_key string, version long, value string, meta int, seq long").parquet(path)).select(*COLUMNS, "seq")


# ---- buffers and keys


@query("buffer_reset", "SELECT CAST(8 AS BIGINT) AS with_padding, CAST(0 AS BIGINT) AS without_padding, true AS empty")
def _(spark, d):
    return buffers.sizes(_records(spark, d).limit(0))


@query("buffer_capped", f"WITH {RECORDS} SELECT seq, o AS \"offset\" FROM p WHERE o + 4 + strlen(rec) <= 200000")
def _(spark, d):
    return buffers.fitting(_records(spark, d), 200_000).select("seq", "offset")


@query("buffer_backings", "SELECT b AS backing, count(*) AS records, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents, (VALUES ('memory'), ('named'), ('temporary')) AS t(b) GROUP BY b")
def _(spark, d):
    """The same buffer under a name of the session, in a named folder, in a scratch table."""
    records, out = _records(spark, d), None
    records.createOrReplaceTempView("kv_buffer")
    named = scratch.fresh(spark, "buffer")
    records.write.parquet(named)
    for name, df in (("memory", spark.table("kv_buffer")), ("named", spark.read.schema(records.schema).parquet(named)), ("temporary", scratch.materialize(records, "buffer"))):
        found = df.agg(F.lit(name).alias("backing"), F.count("*").alias("records"), F.sum(F.octet_length("rec")).cast("long").alias("bytes"))
        out = found if out is None else out.unionByName(found)
    return out


@query("buffer_iterate", "SELECT doc_id AS seq, md5(text) AS digest FROM documents WHERE text <> ''")
def _(spark, d):
    """A function over every record that is not empty."""
    return buffers.for_each(_records(spark, d), F.md5, "digest").select("seq", "digest")


@query("data_key_count", "SELECT count(*) AS data_keys FROM customer")
def _(spark, d):
    return read(spark, d, "customer").agg(F.count("*").alias("data_keys"))


@query("registry_file", "SELECT c_custkey AS key_id, 'key-' || c_custkey AS data, c_custkey * 3600 AS created_at FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, d):
    """Written with its sanity text, rewritten without some keys, read again."""
    from ..operators import registry

    k, path = F.col("c_custkey"), scratch.fresh(spark, "registry")
    keys = read(spark, d, "customer").select(k.alias("key_id"), F.concat(F.lit("key-"), k.cast("string")).alias("data"), (k * 3600).alias("created_at"))
    registry.write(keys, path, "0123456789abcdef")
    kept = registry.read(spark, path, "0123456789abcdef").filter("key_id % 5 <> 0")
    registry.write(kept, path + "-new", "0123456789abcdef")
    return registry.read(spark, path + "-new", "0123456789abcdef")


@query("scan_metrics", f"WITH {LOG} SELECT count(*) AS reads, CAST(sum(strlen(value)) AS BIGINT) AS bytes, count(*) FILTER (meta & 1 <> 0) AS deleted FROM log")
def _(spark, d):
    seen = Observation("scan")
    log = events_log(spark, d).observe(seen, F.count("*").alias("reads"), F.sum(F.octet_length("value")).cast("long").alias("bytes"), F.count(F.when(has(1), 1)).alias("deleted"))
    log.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["reads"], seen.get["bytes"], seen.get["deleted"])], "reads long, bytes long, deleted long")


@query("manifest_add_level_zero", f"""WITH {LOG}, {STATS}, z AS (SELECT count(*) AS held FROM manifest WHERE level = 0), new AS (SELECT table_id + 1000 AS table_id, row_number() OVER (ORDER BY table_id) AS n FROM manifest)
SELECT table_id, level FROM manifest UNION ALL SELECT table_id, 0 FROM new, z WHERE held + n <= 6""")
def _(spark, d):
    tables = manifest.table_stats(events_log(spark, d))
    new = tables.withColumns({"table_id": F.col("table_id") + 1000, "level": F.lit(0)})
    return manifest.add_level_zero(tables, new, 6).select("table_id", "level")


@query("data_key_lengths", "SELECT c_custkey, CAST(length(repeat('k', CAST(c_custkey % 40 AS INTEGER))) AS INTEGER) AS n, c_custkey % 40 IN (16, 24, 32) AS valid FROM customer")
def _(spark, d):
    keys = read(spark, d, "customer").select("c_custkey", F.repeat(F.lit("k"), (F.col("c_custkey") % 40).cast("int")).alias("k"))
    return keys.select("c_custkey", F.length("k").alias("n"), codecs_sql.valid_key_length(F.col("k")).alias("valid"))


@query("table_compressions", f"WITH {LOG} SELECT c AS compression, count(*) AS n, max(version) AS max_version FROM log, (VALUES ('none'), ('snappy'), ('zstd'), ('lz4')) AS t(c) GROUP BY c")
def _(spark, d):
    """The same table by each codec."""
    log, out = events_log(spark, d), None
    for codec in codecs_sql.COMPRESSION.values():
        path = scratch.fresh(spark, "table")
        found = create_table(log, path, compression="lz4_raw" if codec == "lz4" else codec).agg(F.lit(codec).alias("compression"), F.count("*").alias("n"), F.max("version").alias("max_version"))
        out = found if out is None else out.unionByName(found)
    return out


# ---- codecs


@query("checksum_kinds", f"WITH {LOG} SELECT kind, count(*) AS n, count(*) FILTER (seq % 10 = 3) AS broken FROM log, (VALUES ('crc32'), ('xxhash64')) AS t(kind) GROUP BY kind")
def _(spark, d):
    log, out = events_log(spark, d), None
    for kind in ("crc32", "xxhash64"):
        stored = log.withColumn("sum", codecs_sql.checksum(F.col("value"), kind)).withColumn("value", F.when(F.col("seq") % 10 == 3, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
        bad = F.count(F.when(F.col("sum") != codecs_sql.checksum(F.col("value"), kind), 1))
        found = stored.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), bad.alias("broken"))
        out = found if out is None else out.unionByName(found)
    return out


@query("record_encryption", f"WITH {LOG}, {SPLIT} SELECT fid, seq, user_key, value, strlen(user_key) + strlen(value) AS hidden_bytes FROM split WHERE in_log")
def _(spark, d):
    """Records of a log file hidden by its key, with vectors of their offsets."""
    c, secret = F.col, F.lit(b"0123456789abcdef")
    iv = codecs_sql.file_iv(F.lit(bytes(range(12))), c("offset"))
    rows = _split(spark, d).filter("in_log").select("fid", "seq", iv.alias("iv"), F.octet_length("user_key").alias("n"), codecs_sql.encrypt_record(c("user_key"), c("value"), secret, iv).alias("hidden"))
    shown = codecs_sql.decrypt_record(c("hidden"), c("n"), secret, c("iv"))
    return rows.withColumn("r", shown).select("fid", "seq", "r.user_key", "r.value", F.octet_length("hidden").cast("long").alias("hidden_bytes"))


@query("change_marshal", "SELECT event_id AS seq, user_id AS table_id, CASE WHEN event_type IN ('error', 'signup') THEN 'DELETE' ELSE 'CREATE' END AS op, CAST(event_id % 4 AS INTEGER) AS level FROM events")
def _(spark, d):
    """Manifest changes as bytes (of JSON) and back."""
    e = F.col("event_id")
    op = F.when(F.col("event_type").isin("error", "signup"), "DELETE").otherwise("CREATE")
    change = F.struct(e.alias("seq"), F.col("user_id").alias("table_id"), op.alias("op"), (e % 4).cast("int").alias("level"))
    stored = read(spark, d, "events").select(F.to_json(change).cast("binary").alias("bytes"))
    return stored.select(F.from_json(F.col("bytes").cast("string"), "seq long, table_id long, op string, level int").alias("c")).select("c.*")


def _bytes_sql(x: str, n: str) -> str:
    return f"array_to_string(list_transform(range({n}), lambda i: printf('%02x', (({x}) >> CAST(7 * i AS INTEGER)) & 127 | CASE WHEN i < {n} - 1 THEN 128 ELSE 0 END)), '')"


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's bytes (hexadecimal), bit by bit."""
    octets = f"list_transform(range(length({text}) // 2), lambda i: CAST('0x' || substr({text}, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {step}), 4294967295)"


@query("uvarint_codec", f"WITH x AS (SELECT event_id, event_id * event_id * event_id + event_id AS x FROM events), n AS (SELECT *, CASE WHEN x < 128 THEN 1 ELSE (length(bin(x)) + 6) // 7 END AS n FROM x) SELECT event_id, x, {_bytes_sql('x', 'n')} AS encoded, CAST(n AS INTEGER) AS size FROM n")
def _(spark, d):
    """Events whose number does not fit in 64 bits have null in its place, as in its bytes and size."""
    e = F.col("event_id")
    x = F.try_add(F.try_multiply(F.try_multiply(e, e), e), e)
    return read(spark, d, "events").select("event_id", x.alias("x"), F.lower(F.hex(codecs_sql.uvarint(x))).alias("encoded"), F.when(x.isNotNull(), codecs_sql.varint_size(x)).alias("size"))


EXPIRY = f"CASE WHEN expires_at < 128 THEN printf('%02x', expires_at) ELSE {_bytes_sql('expires_at', f'({VARINT})')} END"


@query("value_codec", f"WITH {LOG} SELECT seq, printf('%02x', meta) || '00' || {EXPIRY} || lower(hex(encode(value))) AS encoded FROM log")
def _(spark, d):
    c = F.col
    return events_log(spark, d).select("seq", F.lower(F.hex(codecs_sql.value_bytes(c("meta"), c("user_meta"), c("expires_at"), c("value")))).alias("encoded"))


@query("header_codec", f"WITH {LOG} SELECT seq, printf('%02x', meta) || '00' || printf('%02x%02x', strlen(user_key) + 8, strlen(value)) || {EXPIRY} AS encoded FROM log")
def _(spark, d):
    c = F.col
    return events_log(spark, d).select("seq", F.lower(F.hex(codecs_sql.header_bytes(c("meta"), c("user_meta"), F.octet_length("user_key") + 8, F.octet_length("value"), c("expires_at")))).alias("encoded"))


@query("record_codec", f"""WITH {LOG}, b AS (SELECT seq, printf('%02x', meta) || '00' || printf('%02x%02x', strlen(user_key) + 8, strlen(value)) || {EXPIRY} || lower(hex(encode(user_key))) || printf('%016x', CAST(18446744073709551615 - version AS UBIGINT)) || lower(hex(encode(value))) AS body FROM log)
SELECT seq, body || printf('%08x', {_crc_sql('body')}) AS encoded FROM b""")
def _(spark, d):
    c = F.col
    record = codecs_sql.record_bytes(c("user_key"), c("version"), c("value"), c("meta"), c("user_meta"), c("expires_at"))
    return events_log(spark, d).select("seq", F.lower(F.hex(record)).alias("encoded"))


@query("entry_header_codec", "SELECT o_orderkey, printf('%02x%02x%02x%02x', o_orderkey % 256, o_orderkey // 256 % 256, o_custkey % 256, o_custkey // 256 % 256) AS encoded, CAST(o_orderkey % 65536 AS INTEGER) AS overlap, CAST(o_custkey % 65536 AS INTEGER) AS diff FROM orders")
def _(spark, d):
    encoded = codecs_sql.entry_header_bytes(F.col("o_orderkey") % 65536, F.col("o_custkey") % 65536)
    rows = read(spark, d, "orders").select("o_orderkey", encoded.alias("b"))
    return rows.withColumn("r", codecs_sql.read_entry_header(F.col("b"))).select("o_orderkey", F.lower(F.hex("b")).alias("encoded"), "r.overlap", "r.diff")


@query("crc32_keys", f"WITH {LOG}, k AS (SELECT DISTINCT user_key, lower(hex(encode(user_key))) AS h FROM log) SELECT user_key, {_crc_sql('h')} AS crc FROM k")
def _(spark, d):
    return events_log(spark, d).select("user_key").distinct().select("user_key", F.crc32("user_key").alias("crc"))


@query("bloom_hash", f"""WITH {LOG}, k AS (SELECT DISTINCT user_key AS k FROM log), c AS (SELECT k, list_transform(range(11), lambda i: CAST(ascii(substr(k, CAST(i + 1 AS INTEGER), 1)) AS HUGEINT)) AS c FROM k WHERE strlen(k) = 11),
a AS (SELECT k, c, (CAST(xor(CAST(3164544308 AS BIGINT), CAST((CAST(3332679571 AS HUGEINT) * 11) % 4294967296 AS BIGINT)) AS HUGEINT) + c[1] + c[2] * 256 + c[3] * 65536 + c[4] * 16777216) % 4294967296 * 3332679571 % 4294967296 AS h FROM c),
b AS (SELECT k, c, (CAST(xor(CAST(h AS BIGINT), CAST(h AS BIGINT) >> 16) AS HUGEINT) + c[5] + c[6] * 256 + c[7] * 65536 + c[8] * 16777216) % 4294967296 * 3332679571 % 4294967296 AS h FROM a),
e AS (SELECT k, (CAST(xor(CAST(h AS BIGINT), CAST(h AS BIGINT) >> 16) AS HUGEINT) + c[9] + c[10] * 256 + c[11] * 65536) % 4294967296 * 3332679571 % 4294967296 AS h FROM b)
SELECT k AS user_key, xor(CAST(h AS BIGINT), CAST(h AS BIGINT) >> 24) AS hash FROM e""")
def _(spark, d):
    keys = events_log(spark, d).select("user_key").distinct()
    return keys.filter(F.octet_length("user_key") == 11).select("user_key", codecs_sql.bloom_hash(F.col("user_key")).alias("hash"))


@query("key_times", f"WITH {LOG} SELECT seq, lower(hex(encode(user_key))) || printf('%016x', 1700000000 + seq) AS timed, lower(hex(encode(user_key))) || printf('%016x', CAST(18446744073709551615 - seq AS UBIGINT)) AS renewed FROM log")
def _(spark, d):
    """Keys with a clock's seconds behind them, and with a new version."""
    rows = events_log(spark, d)
    timed = codecs_sql.with_time(F.col("user_key"), F.col("seq") + 1_700_000_000)
    renewed = codecs_sql.set_version(codecs_sql.with_version(F.col("user_key"), F.col("version")), F.col("seq"))
    return rows.select("seq", F.lower(F.hex(timed)).alias("timed"), F.lower(F.hex(renewed)).alias("renewed"))


@query("key_range_equality", "SELECT o_orderkey, o_orderkey % 3 = 0 AS is_empty, o_orderkey % 3 = 0 OR o_custkey % 2 = 0 AS equal FROM orders")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = lambda x: F.when(k % 3 == 0, "").otherwise(x.cast("string"))
    rows = read(spark, d, "orders").select("o_orderkey", side(c).alias("l"), side(c + 1).alias("r"), F.lit(False).alias("i"), side(c).alias("ol"), side(c + 1 + c % 2).alias("orr"), F.lit(False).alias("oi"))
    return rows.select("o_orderkey", manifest.range_is_empty("l", "r", "i").alias("is_empty"), manifest.range_equals("l", "r", "i", "ol", "orr", "oi").alias("equal"))


@query("level_states", f"WITH {LOG}, {STATS} SELECT level, level = (SELECT max(level) FROM manifest) AS is_last, sum(size) >= 60000 AS is_full, count(*) = 0 AS is_empty FROM manifest GROUP BY level")
def _(spark, d):
    totals = manifest.level_totals(manifest.table_stats(events_log(spark, d)))
    return totals.select("level", (F.col("level") == F.max("level").over(Window.partitionBy())).alias("is_last"), (F.col("total_size") >= 60_000).alias("is_full"), (F.col("tables") == 0).alias("is_empty"))  # a row for each level

