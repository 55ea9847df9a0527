"""What must not grow faster than the input: plans, rows made, files opened."""

import random
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kvlattice.functions import codecs, codecs_sql
from kvlattice.model import KV_LOG
from kvlattice.operators import gc, levels, manifest, ordering, replay
from kvlattice.sources import tables, wal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_found_by_halving(spark):
    at = sorted({f"k{random.Random(i).randrange(10**6)}" for i in range(300)} | {'k"\\', "ké", "k𐍈"})
    keys = [*at, "", "a", "z", "k5", None]
    found = ordering.reached(at, "k")
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", found.alias("n")).collect()
    assert [(r.k, r.n) for r in got] == [(k, 0 if k is None else bisect_right(at, k)) for k in keys]
    assert "filter(" not in str(found)


def test_ranges_are_even(spark):
    for n in (0, 1, 2, 64, 65, 127, 200, 5000):  # 127: no whole number of keys for each of 64 ranges
        keys = spark.createDataFrame([(f"k{i:05d}",) for i in range(n)], "k string")
        at = ordering.bounds(keys, "k")
        held = [0] * (len(at) + 1)
        for i in range(n):
            held[bisect_right(at, f"k{i:05d}")] += 1
        assert at == sorted(set(at)) and max(held) <= max(2, 2 * n / 64) and len(at) < 65


def test_overlaps_make_no_other_pairs(spark, monkeypatch):
    monkeypatch.setattr(manifest, "MET", 40)  # ranges of more are split
    rng = random.Random(3)
    rows = [(i % 280, *sorted(f"k{rng.randrange(120):03d}" for _ in range(2))) for i in range(300)]  # some ids twice
    rows += [(1000 + i, "k050", "k050") for i in range(60)] + [(2000, "a", "z"), (2001, None, None)]
    m = spark.createDataFrame(rows, "table_id long, smallest string, biggest string")
    got = manifest.overlapping_pairs(m)
    assert "SortMergeJoin" not in plan(got)
    want = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and None not in (x[1], y[1]) and x[1] <= y[2] and x[2] >= y[1]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_overlaps_of_equal_keys_in_several_parts(spark, monkeypatch):
    def mixed(batches):  # rows as they may come from a shuffle: in any order
        for batch in batches:
            yield batch.take(pa.array(random.Random(batch.num_rows).sample(range(batch.num_rows), batch.num_rows)))

    monkeypatch.setattr(manifest, "MET", 8)
    rows = [(i, f"k{i % 3}", f"k{i % 3 + i % 2}") for i in range(90)] + [(None, "k0", "k9")]
    m = spark.createDataFrame(rows, "table_id long, smallest string, biggest string")
    kind = type(m)
    real = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda df, *by: real(df.mapInArrow(mixed, df.schema), *by))
    want = [(x[0], y[0]) for x in rows[:90] for y in rows[:90] if x[0] < y[0] and x[1] <= y[2] and x[2] >= y[1]]
    assert sorted(map(tuple, manifest.overlapping_pairs(m).collect())) == sorted(want)


def test_wide_tables_are_not_in_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(manifest, "MET", 256)
    rng, n = random.Random(8), 1500
    rows = [(i % 1450, *sorted(f"k{rng.randrange(2000):04d}" for _ in range(2))) for i in range(n)]
    m = spark.createDataFrame(rows, "table_id long, smallest string, biggest string")
    kind, dealt = type(m), []
    real = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda df, *by: dealt.append(df) or real(df, *by))
    got = manifest.overlapping_pairs(m)
    want = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] <= y[2] and x[2] >= y[1]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert dealt[0].count() < 30 * n


def test_numbers_beyond_64_bits(spark, tmp_path):
    ids = [0, 5, 2_097_151, 2_097_152, 6_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r for r in entry.queries()["uvarint_codec"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ids and got[2_097_151].x == 2_097_151**3 + 2_097_151 and got[2_097_151].size == 9
    assert got[6_000_000].x is got[6_000_000].encoded is got[6_000_000].size is None


def test_replaced_tables_are_of_their_level(spark):
    m = spark.createDataFrame([(0, 7), (1, 7), (1, 8)], "level int, table_id long")
    left = manifest.replace_tables(m, m.filter("level = 0"), m.limit(0))
    assert sorted(map(tuple, left.collect())) == [(1, 7), (1, 8)]


def test_reservations_make_no_pairs(spark, monkeypatch):
    rng, names = random.Random(11), "level int, left string, right string, next_level int, next_left string, next_right string"

    def span():
        a, b = sorted(f"k{rng.randrange(60):02d}" for _ in range(2))
        return (b, a) if rng.random() < 0.05 else (a, b) if rng.random() < 0.3 else (a, a)

    def compaction(i):
        level = rng.randrange(3)
        return (i, level, *span(), level + rng.randrange(2), *span())

    wanted = [compaction(i) for i in range(400)]
    wanted += [(1000 + i, *wanted[i % 7][1:]) for i in range(300)] + [(2000, 0, None, None, 1, "k10", "k10"), (2001, 9, "b", "a", 9, "b", "a"), (2002, 9, "b", "a", 9, "b", "a")]
    running = [compaction(5000 + i) for i in range(3)]
    meets = lambda a, b: None not in (*a, *b) and a[0] == b[0] and a[1] <= b[2] and a[2] >= b[1]
    held, want = [s for r in running for s in (r[1:4], r[4:7])], []
    for r in sorted(wanted):
        own = [r[1:4], r[4:7]]
        if not any(meets(a, b) for a in own for b in held):
            want, held = [*want, r[0]], held + own
    made = []
    real = gc.materialize
    monkeypatch.setattr(gc, "materialize", lambda df, name: made.append(real(df, name)) or made[-1])
    monkeypatch.setattr(gc, "delete", lambda *dfs: None)
    for asked in (1 << 16, 50):
        monkeypatch.setattr(gc, "ASKED", asked, raising=False)
        got = gc.reserve(spark.createDataFrame(running, "id long, " + names), spark.createDataFrame(wanted, "id long, " + names))
        assert sorted(r.id for r in got.collect()) == want
    assert max(df.count() for df in made) <= len(wanted)


def test_records_are_mixed_by_batches(spark):
    data = [(i, None if i % 11 == 5 else bytes(random.Random(i).randbytes(i))) for i in range(80)]
    df = spark.createDataFrame(data, "i int, d binary").withColumn("iv", codecs_sql.file_iv(F.lit(bytes(range(12))), F.lit(4294967290)))
    hidden = df.withColumn("h", codecs_sql.aes_ctr(F.col("d"), F.lit(b"0123456789abcdef"), F.col("iv")))
    assert "ArrowEvalPython" in plan(hidden)
    back = hidden.withColumn("b", codecs_sql.aes_ctr(F.col("h"), F.lit(b"0123456789abcdef"), F.col("iv"))).orderBy("i").collect()
    assert [(r.i, r.b if r.b is None else bytes(r.b)) for r in back] == data
    assert all(bytes(r.h) != bytes(r.d) for r in back if r.d and r.i > 3)


def test_replay_sorts_once(spark):
    log = spark.createDataFrame([(1, 1, "k", 1, 64, None), (1, 2, "!", 1, 128, 1), (1, 3, "k", 2, 64, None), (2, 1, "k", 9, 64, None), (2, 2, "k", 8, 0, None)], "fid long, seq long, user_key string, version long, meta int, fin_version long")
    assert plan(replay.replay(log)).count("Sort [") == 1
    assert [(r.fid, r.seq) for r in replay.replay(log).collect()] == [(1, 1)]
    ends = replay.valid_end(log)
    assert plan(ends).count("Sort [") == 1
    assert sorted(map(tuple, ends.collect()), key=str) == [(1, 2, 1), (2, None, None)]


def test_partitions_follow_the_size(spark, tmp_path, monkeypatch):
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(ordering, "DEALT", 10_000)
    parts = ordering.dealt(spark.read.parquet(str(tmp_path / "t")), "id").rdd.getNumPartitions()
    assert parts > 20
    assert ordering.dealt(spark.createDataFrame([(1,)], "id long"), "id").rdd.getNumPartitions() <= 4  # no size is known


def test_log_files_share_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(wal, "OPEN", 2)
    rows = [(i % 5, 0, 0, f"k{i}".encode(), i, b"v" * i, 1, 0, i) for i in range(40)]  # files take turns
    names = ["fid", *wal.FIELDS]
    batches = [wal._batch(rows[:17]), wal._batch(rows[17:])]
    wal._Writer(str(tmp_path)).write(iter(batches))
    reader = wal._Reader(str(tmp_path), wal.HEADER)
    parts = reader.partitions()
    assert len(parts) == 1
    found = pa.Table.from_batches([b for p in parts for b in reader.read(p)]).to_pylist()
    keep = [c for c in names if c not in ("offset", "len")]
    assert [tuple(r[c] for c in keep) for r in found] == [tuple(r[names.index(c)] for c in keep) for r in sorted(rows, key=lambda r: r[0])]
    monkeypatch.setattr(wal, "READ", 1)
    assert len(reader.partitions()) == 5


def test_many_picked_tables_open_no_other(spark, tmp_path, monkeypatch):
    data = [(f"k{i:03d}", i, f"v{i}", 0, 0, 0, i % 2, i % 6 if i % 7 else None, 0, i) for i in range(60)]
    log = spark.createDataFrame(data, KV_LOG)
    tables.write_tables(log, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.schema(KV_LOG).parquet(str(tmp_path / "t")).select(*KV_LOG.names).collect())) == data
    (tmp_path / "t/level=0/table_id=0/broken.parquet").write_bytes(b"not a table")
    picked = log.select("level", "table_id").filter("table_id > 1").distinct()
    monkeypatch.setattr(tables, "NAMED", 2)
    got = tables.read_tables(spark, str(tmp_path / "t"), KV_LOG, picked)
    assert sorted(map(tuple, got.select(*KV_LOG.names).collect())) == [r for r in data if (r[7] or 0) > 1]
    assert "Broadcast" not in plan(got.join(spark.createDataFrame([("k001",)], "user_key string"), "user_key"))
    assert got.rdd.getNumPartitions() == 4  # as many as the session shuffles into


def test_gets_make_no_row_of_a_pair_that_a_filter_rules_out(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    data = [(f"k{rng.randrange(400):03d}é", i, f"v{i}", 0, 0, 0, t % 3, t, 0, i) for i, t in enumerate(i % 40 for i in range(2400))]
    log = spark.createDataFrame(data, KV_LOG)
    tables.write_tables(log, str(tmp_path / "t"))
    stats, filters = manifest.table_stats(log), codecs.table_filters(log).filter("table_id <> 7")  # one has none
    asked = [(f"k{i:03d}é" + end, at) for i in range(400) for end in ("", "#") for at in (900, 2000)] + [(None, 5), ("", 5), ("z", 5)]
    keys = spark.createDataFrame(asked, "user_key string, at long")
    old = codecs.probe_filters(filters, levels.candidates(keys, stats)).filter("may").select("user_key", "at", "level", "table_id")
    want = sorted(map(tuple, old.collect()))
    made = []
    real = levels.materialize
    monkeypatch.setattr(levels, "materialize", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    monkeypatch.setattr(levels, "candidates", None)
    got = levels.get(spark, str(tmp_path / "t"), KV_LOG, stats, filters, keys)
    newest = {}
    for key, version, value, *_ in data:
        for at in (900, 2000):
            if version <= at:
                newest[key, at] = (version, value)
    assert {(r.user_key, r.at): (r.version, r.value) for r in got.collect()} == newest
    for held in (1 << 16, 100, 7):  # ranges of more keys are split
        monkeypatch.setattr(levels, "KEYS", held)
        assert sorted(map(tuple, levels.may_hold(keys, stats, filters).collect())) == want
    assert dict(made)["candidates"].count() == len(want) < len(asked) * 40 / 2
