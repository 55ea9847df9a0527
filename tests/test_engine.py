"""The engine's operators on the fixtures of FIXTURES.md."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlattice.functions import codecs, codecs_sql
from kvlattice.model import KV_LOG, canonical, dead
from kvlattice.operators import buffers, gc, levels, manifest, merge, reads, registry, replay, vlog
from kvlattice.operators.ordering import carry, row_number, running_sum
from kvlattice.sources.tables import file_name, open_table, parse_file_id, write_table, write_tables
from kvlattice.sources.wal import WalSource, WalWriter, read_wal


def rows(spark, data):
    """(key, version, value[, meta[, expires_at]]) to a log."""
    full = [(k, v, x, (m or [0])[0], 0, (m[1] if len(m) > 1 else 0), 0, 0, 0, i) for i, (k, v, x, *m) in enumerate(data)]
    return spark.createDataFrame(full, KV_LOG)


def kv(df):
    return [(r.user_key, r.value) for r in df.collect()]


# Tables, probes and outcomes that merges and seeks must agree with.
T1, T2 = [("k1", "a1"), ("k4", "a4"), ("k5", "a5")], [("k2", "b2"), ("k3", "b3"), ("k4", "b4")]


def table(spark, pairs):
    return rows(spark, [(k, 0, v) for k, v in pairs])


def test_merge_takes_the_left_table(spark):
    out = merge.merge([table(spark, T1), table(spark, T2)]).orderBy(*canonical())
    assert [v for _, v in kv(out)] == ["a1", "b2", "b3", "a4", "a5"]


def test_merge_backwards(spark):
    a = [("k1", "a1"), ("k2", "a2"), ("k4", "a4"), ("k5", "a5")]
    b = [("k1", "b2"), ("k3", "b3"), ("k4", "b4"), ("k5", "b5")]
    out = merge.merge([table(spark, a), table(spark, b)]).orderBy(*canonical(True))
    assert [v for _, v in kv(out)] == ["a5", "a4", "b3", "a2", "a1"]


def test_merge_keeps_versions(spark):
    out = merge.merge([rows(spark, [("k", 1, "x"), ("k", 2, "y")]), rows(spark, [("k", 2, "z")])])
    assert sorted(r.version for r in out.collect()) == [1, 2]


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("ge", {"abc": "k0100", "k0100": "k0100", "k0100b": "k0101", "k1234b": "k1235", "k9999": "k9999"}),
        ("le", {"k0100": "k0100", "k0100b": "k0100", "k1234b": "k1234", "k9999": "k9999", "z": "k9999"}),
        ("gt", {"abc": "k0100", "k0100": "k0101", "k0100b": "k0101", "k1234b": "k1235"}),
        ("lt", {"k0100b": "k0100", "k1234b": "k1234", "k9999": "k9998", "z": "k9999"}),
    ],
)
def test_seek(spark, mode, want):
    log = spark.range(100, 10_000).select(F.format_string("k%04d", "id").alias("user_key"), F.lit(0).cast("long").alias("version"), F.col("id").cast("string").alias("value"))
    probes = spark.createDataFrame([(p,) for p in ("abc", "k0100", "k0100b", "k1234b", "k9999", "z")], "probe string")
    assert {r.probe: r.user_key for r in reads.seek(log, probes, mode).collect()} == want


def test_as_of_get(spark):
    log = rows(spark, [("key1", 0, "42"), ("key2", 2, "52"), ("key3", 0, "62"), ("key3", 1, "72")])
    asked = spark.createDataFrame([("key", 0), ("key1", 0), ("key2", 0), ("key3", 0), ("key3", 1)], "user_key string, at long")
    assert {(r.user_key, r.at): r.value for r in reads.get_at(log, asked).collect()} == {("key1", 0): "42", ("key3", 0): "62", ("key3", 1): "72"}


def test_deleted_keys_do_not_show_older_values(spark):
    log = rows(spark, [("a", 1, "x"), ("a", 2, "y", 1), ("b", 1, "z", 0, 10), ("c", 1, "w", 0, 11)])
    assert kv(reads.latest_visible(log, 10)) == [("c", "w")]
    assert sorted(kv(reads.latest_visible(log, 9, read_version=1))) == [("a", "x"), ("b", "z"), ("c", "w")]


def test_expiry_boundary(spark):
    log = rows(spark, [(str(e), 1, "", 0, e) for e in (0, 9, 10, 11)])
    assert [r.user_key for r in log.filter(dead(10)).orderBy("expires_at").collect()] == ["9", "10"]


@pytest.mark.parametrize("prefix", ["a", "ab", "a\U0010ffff", "퟿", ""])
def test_prefix_scan_is_starts_with(spark, prefix):
    keys = ["", "a", "ab", "abc", "ac", "b", "a\U0010ffff", "a\U0010ffffz", "퟿q", ""]
    got = reads.prefix_scan(rows(spark, [(k, 1, "") for k in keys]), prefix).collect()
    assert sorted(r.user_key for r in got) == sorted(k for k in keys if k.startswith(prefix))


def test_prefix_scan_reaches_the_files(spark, tmp_path):
    write_table(rows(spark, [(f"k{i:03d}", i, "v") for i in range(100)]), str(tmp_path / "t"))
    plan = reads.prefix_scan(open_table(spark, str(tmp_path / "t")), "k01")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_key), GreaterThanOrEqual(user_key,k01), LessThan(user_key,k02)]" in plan


def test_sorted_table_round_trip(spark, tmp_path):
    log = rows(spark, [(f"k{i % 7}", i, str(i)) for i in range(50)])
    write_table(log, str(tmp_path / "t"), rows_per_file=10)
    assert sorted(map(tuple, open_table(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, log.collect()))


def test_neighbours_and_numbers_over_ranges(spark):
    n = 3000
    log = rows(spark, [(f"k{(i * 7919) % n:05d}", 1, "") for i in range(n)])
    got = {r.user_key: (r.prev_user_key, r.next_user_key) for r in reads.next_prev(log).collect()}
    keys = sorted(got)
    assert all(got[k] == (keys[i - 1] if i else None, keys[i + 1] if i + 1 < n else None) for i, k in enumerate(keys))
    placed = row_number(log, [F.col("user_key")], "place").collect()
    assert all(keys[r.place - 1] == r.user_key for r in placed)


@pytest.fixture
def hot(spark):
    """A log of which one key holds half, over more ranges than keys."""
    data = [(f"k{i % 40:03d}" if i % 2 else "k020", i, str(i)) for i in range(4000)]
    return data, rows(spark, data).repartition(7)


def test_order_with_a_hot_key(spark, hot):
    data, log = hot
    want = sorted(((k, -v) for k, v, _ in data))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = reads.number(log).collect()
        parts = log.repartitionByRange(*canonical(), "seq").groupBy(F.spark_partition_id()).count().collect()
        near = {(r.user_key, r.version): (r.prev_version, r.next_version) for r in reads.next_prev(log).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r.user_key, -r.version) for r in sorted(got, key=lambda r: r.position)] == want
    assert max(r["count"] for r in parts) < 2000  # the hot key is in several ranges
    for i, (k, v) in enumerate(want):
        assert near[k, -v] == (-want[i - 1][1] if i else None, -want[i + 1][1] if i + 1 < len(want) else None)


def test_sums_and_carries_over_ranges(spark, hot):
    data, log = hot
    total, want = 0, {}
    for k, v, x in sorted(data, key=lambda r: (r[0], -r[1])):
        want[k, v] = total
        total += len(x)
    got = running_sum(log, [*canonical(), F.col("seq")], F.length("value"), "before").collect()
    assert {(r.user_key, r.version): r.before for r in got} == want
    last, want = None, {}
    for k, v, _ in sorted(data, key=lambda r: (r[0], -r[1])):
        last = v if v % 97 == 0 else last
        want[k, v] = last
    got = carry(log, [*canonical(), F.col("seq")], F.when(F.col("version") % 97 == 0, F.col("version")), "held").collect()
    assert {(r.user_key, r.version): r.held for r in got} == want


@pytest.mark.parametrize("mode", ["ge", "gt", "le", "lt"])
def test_many_probes_equal_few(spark, hot, mode, monkeypatch):
    _, log = hot
    probes = spark.createDataFrame([(f"k{i:03d}{x}",) for i in range(0, 45, 4) for x in ("", "x")], "probe string")
    few = sorted(map(tuple, reads.seek(log, probes, mode).collect()))
    monkeypatch.setattr(reads, "FEW", 3)
    assert sorted(map(tuple, reads.seek(log, probes, mode).collect())) == few and few
    assert reads.seek(log, probes.limit(0), mode).collect() == []


def test_as_of_get_of_a_hot_key(spark, hot):
    data, log = hot
    asked = spark.createDataFrame([(f"k{i % 41:03d}", i * 3) for i in range(900)], "user_key string, at long")
    got = {(r.user_key, r.at): r.version for r in reads.get_at(log, asked).collect()}
    for k, at in {(r.user_key, r.at) for r in asked.collect()}:
        assert got.get((k, at)) == max((v for key, v, _ in data if key == k and v <= at), default=None)


def test_memtable_keeps_the_last_write(spark):
    writes = rows(spark, [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "fin", 128), ("b", 1, "z")])
    assert sorted(kv(merge.insert(writes))) == [("a", "y"), ("b", "z")]
    assert kv(merge.merge([writes.filter("user_key = 'a'")])) == [("a", "y")]
    assert tuple(merge.memtable_stats(merge.insert(writes)).first()) == (2, 20, 1)


def test_reserve_is_in_order(spark):
    """a meets b and b meets c: b is refused, so c is taken."""
    made = lambda *x: spark.createDataFrame([(i, lv, a, b, lv + 1, a, b) for i, lv, a, b in x], "id long, level int, left string, right string, next_level int, next_left string, next_right string")
    none = made((0, 9, "x", "x")).limit(0)
    ids = lambda df: sorted(r.id for r in df.collect())
    wanted = made((1, 1, "a", "c"), (2, 1, "b", "f"), (3, 1, "e", "g"))
    assert ids(gc.reserve(none, wanted)) == [1, 3]
    assert ids(gc.reserve(made((7, 1, "g", "h")), wanted)) == [1]
    assert ids(gc.reserve(made((7, 2, "a", "a")), wanted)) == [2]  # the next level of 1 is busy
    rng = random.Random(5)
    cases = [(i, rng.randint(0, 2), *sorted(f"{rng.randint(0, 60):02d}" for _ in range(2))) for i in range(60)]
    held, want = [], []
    for i, lv, a, b in cases:
        spans = [(lv, a, b), (lv + 1, a, b)]
        if not any(x == y and a1 <= b2 and b1 >= a2 for x, a1, b1 in spans for y, a2, b2 in held):
            held += spans
            want.append(i)
    assert ids(gc.reserve(none, made(*cases))) == want
    assert ids(gc.release(wanted, wanted.filter("id = 2").select("id"))) == [1, 3]


def test_survivors_are_live_pointers(spark):
    """No value in the tree, no expired, deleted or newer key, and no other place moves."""
    log = rows(spark, [(k, 5, "v", 64) for k in "abcdef"])
    now = {"a": (5, 2, 0, 0), "b": (5, 0, 0, 0), "c": (5, 2, 9, 0), "d": (5, 3, 0, 0), "e": (6, 2, 0, 0), "f": (5, 2, 0, 4)}
    current = spark.createDataFrame([(k, v, "", m, 0, e, 0, 0, fid, "abcdef".index(k)) for k, (v, m, e, fid) in now.items()], KV_LOG)
    got = gc.survivors(log, current, 10).collect()
    assert [(r.user_key, r.meta) for r in got] == [("a", 0)]


def test_picked_tables_alone_are_read(spark, tmp_path):
    log = rows(spark, [(f"k{i:03d}", i, "v") for i in range(500)]).withColumn("table_id", F.col("seq") % 10 * 10 + F.floor(F.col("version") / 100))
    write_tables(log, str(tmp_path / "t"))
    stats = manifest.table_stats(log)
    got = levels.scan(spark, str(tmp_path / "t"), log.schema, stats, "k1", 150)
    assert sorted(r.version for r in got.collect()) == [i for i in range(100, 200)]
    assert got.select(F.input_file_name()).distinct().count() == 10 == manifest.pick_tables(stats, "k1", 150).count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "table_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    asked = spark.createDataFrame([("k123", 500), ("k123", 1), ("k9", 500)], "user_key string, at long")
    found = levels.get(spark, str(tmp_path / "t"), log.schema, stats, codecs.table_filters(log), asked).collect()
    assert [(r.user_key, r.at, r.version) for r in found] == [("k123", 500, 123)]


def test_read_of_many_picked_tables(spark, tmp_path, monkeypatch):
    from kvlattice.sources import tables

    log = rows(spark, [(f"k{i:03d}", i, "v") for i in range(60)]).withColumn("table_id", F.col("seq") % 6)
    write_tables(log, str(tmp_path / "t"))
    picked = manifest.table_stats(log).filter("table_id > 1")
    monkeypatch.setattr(tables, "NAMED", 2)
    assert tables.read_tables(spark, str(tmp_path / "t"), log.schema, picked).count() == 40


def test_store(spark, tmp_path, monkeypatch):
    """Writes, reads at versions, compaction, older readers, checksums, a full level 0."""
    from kvlattice import store

    s = store.Store(spark, str(tmp_path))
    s.write(rows(spark, [("a", 1, "a1"), ("b", 1, "b1"), ("b", 1, "b1 again")]))
    s.write(rows(spark, [("a", 2, "a2"), ("c", 2, "c2", 1), ("ab", 2, "x")]))
    asked = spark.createDataFrame([("a", 1), ("a", 9), ("b", 9), ("d", 9)], "user_key string, at long")
    assert {(r.user_key, r.at): r.value for r in s.get(asked).collect()} == {("a", 1): "a1", ("a", 9): "a2", ("b", 9): "b1 again"}
    assert kv(s.scan("a")) == [("a", "a2"), ("a", "a1"), ("ab", "x")]
    assert kv(s.scan("a", since=1, reverse=True)) == [("ab", "x"), ("a", "a2")]
    sums, before = s.checksums().collect(), s.change
    s.compact(keep=1, now=0)
    assert [(r.user_key, r.value, r.level) for r in s.rows().orderBy("user_key").collect()] == [("a", "a2", 1), ("ab", "x", 1), ("b", "b1 again", 1)]
    assert s.live.count() == 1 and store.Store.open(spark, str(tmp_path), before).rows().count() == len(sums) == 5
    s.write(rows(spark, [("a", 2, "a2 new")]))
    assert dict(kv(s.latest(0))) == {"a": "a2 new", "ab": "x", "b": "b1 again"}
    broken = s.verify(spark.createDataFrame(sums))
    assert kv(broken) == [("a", "a2 new")]
    monkeypatch.setattr(store, "STALL", 1)
    with pytest.raises(RuntimeError, match="full"):
        s.write(rows(spark, [("z", 1, "z")]))


def test_batches_are_halved(spark):
    sizes = [10] * 20 + [400] * 3 + [10] * 5
    log = rows(spark, [(f"k{i:02d}", i, "v" * n) for i, n in enumerate(sizes)])
    got = vlog.halved_batches(log, 600, 100, 1 << 20).collect()
    totals, last = {}, -1
    for r in sorted(got, key=lambda r: r.seq):
        assert r.batch in (last, last + 1)
        last = r.batch
        totals[r.batch] = totals.get(r.batch, 0) + 3 + sizes[r.seq] + 2
    assert len(got) == len(sizes) and max(totals.values()) < 600
    with pytest.raises(Exception, match="too large"):
        vlog.halved_batches(log, 300, 100, 1 << 20).collect()


def test_pick_tables(spark):
    m = spark.createDataFrame([(1, 0, "a", "c", 5, 1, 1, 0), (2, 0, "b", "bz", 9, 1, 1, 0), (3, 1, "ca", "d", 9, 1, 1, 0)], "table_id long, level int, smallest string, biggest string, max_version long, key_count long, size long, stale_size long")
    ids = lambda df: sorted(r.table_id for r in df.collect())
    assert ids(manifest.pick_tables(m, "b")) == [1, 2]
    assert ids(manifest.pick_tables(m, "c", 6)) == [3]
    assert ids(manifest.pick_tables(m)) == [1, 2, 3]
    assert sorted(map(tuple, manifest.overlapping_pairs(m).collect())) == [(1, 2)]
    assert ids(manifest.replace_tables(m, m.filter("table_id = 1").select("table_id"), m.filter("table_id = 2").withColumn("table_id", F.lit(9).cast("long")))) == [2, 3, 9]


def test_range_overlaps(spark):
    cases = [("", "", False, "a", "b", False, True), ("a", "b", False, "", "", False, False), ("a", "b", True, "x", "y", False, True), ("a", "b", False, "b", "c", False, True), ("a", "b", False, "c", "d", False, False)]
    df = spark.createDataFrame(cases, "l string, r string, i boolean, ol string, orr string, oi boolean, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", manifest.range_overlaps("l", "r", "i", "ol", "orr", "oi")).collect())


def test_key_range_hull(spark):
    df = spark.createDataFrame([("b", "c", False, 2), ("", "", True, 1), ("a", "b", False, 3)], "left string, right string, inf boolean, size long")
    assert tuple(manifest.key_range(df).first()) == ("a", "c", True, 6)


def test_live_set_and_stall(spark):
    changes = spark.createDataFrame([(1, 7, "CREATE", 0), (2, 8, "CREATE", 1), (3, 7, "DELETE", 0), (4, 7, "CREATE", 2), (5, 8, "DELETE", 1)], "seq long, table_id long, op string, level int")
    assert [tuple(r) for r in manifest.live_set(changes).collect()] == [(7, 2)]


def test_pointers_find_their_records(spark):
    log = rows(spark, [("k", i, "v" * i) for i in range(20)])
    split = vlog.split_values(log, 10)
    out = split.filter("in_log")
    assert out.count() == 10
    found = vlog.read_pointers(out.select("version", "fid", "offset", "len"), out.select("fid", "offset", "len", "value"))
    assert all(len(r.value) == r.version for r in found.collect())
    first = out.orderBy("seq").first()
    assert first.offset == 20
    assert first.len == len(codecs.encode_record(b"k", 10, b"v" * 10))


def test_discard_stats(spark):
    data = [(1, 5, 10), (2, 5, 0), (3, 5, -1), (4, 5, 7), (5, 6, 7), (6, 7, -1), (7, 8, 3), (8, 8, -1)]
    stats = gc.discard_stats(spark.createDataFrame(data, "seq long, fid long, delta long"))
    assert {r.fid: r.discard for r in stats.collect()} == {5: 7, 6: 7, 8: 0}
    assert tuple(gc.max_discard(stats).first()) == (5, 7)
    assert tuple(gc.max_discard(stats.limit(0)).first()) == (0, 0)


def test_pick_log(spark):
    stats = spark.createDataFrame([(2, 60)], "fid long, discard long")
    sizes, ratios = spark.createDataFrame([(2, 100)], "fid long, size long"), spark.createDataFrame([(1, 0.2), (3, 0.9)], "fid long, ratio double")
    pick = lambda s, **k: [r.fid for r in gc.pick_log(s, sizes, ratios, **({"max_fid": 5, "next_fid": 0, "ratio": 0.5} | k)).collect()]
    assert pick(stats) == [2]
    assert pick(stats, ratio=0.7) == []
    assert pick(stats, max_fid=2) == []
    assert pick(stats.limit(0)) == [3]


def test_compaction_keeps_versions(spark):
    log = rows(spark, [("a", 3, "x"), ("a", 2, "y", 4), ("a", 1, "z"), ("b", 2, "p", 1), ("b", 1, "q"), ("c", 3, "r"), ("c", 2, "s"), ("c", 1, "t")])
    assert sorted(kv(gc.compact(log, 2, 0))) == [("a", "x"), ("a", "y"), ("c", "r"), ("c", "s")]


LOG = "fid long, seq long, user_key string, version long, meta int, fin_version long"


def random_log(rng):
    out = []
    for fid in range(40):
        seq, t = 0, 1
        while seq < 30:
            kind = rng.random()
            if kind < 0.5:
                for _ in range(rng.randint(1, 3)):
                    out.append((fid, seq := seq + 1, "k", t if rng.random() < 0.97 else t + 9, 64, None))
                if rng.random() < 0.95:
                    out.append((fid, seq := seq + 1, "!", t, 128, t if rng.random() < 0.95 else t + 1))
            else:
                out.append((fid, seq := seq + 1, "k", t, 0, None))
            t += 1
    return out


def test_replay_equals_the_fold(spark):
    log = spark.createDataFrame(random_log(random.Random(5)), LOG)
    key = lambda df: sorted((r.fid, r.seq) for r in df.collect())
    got = key(replay.replay(log))
    assert got == key(replay.replay_in_order(log))
    assert 0 < len(got) < log.count()


def test_replay_cases(spark):
    cases = {
        0: ([(64, 1, None), (64, 1, None), (128, 1, 1), (0, 2, None)], [1, 2, 4]),
        1: ([(64, 1, None), (64, 1, None)], []),
        2: ([(64, 1, None), (128, 1, 2), (0, 3, None)], []),
        3: ([(64, 1, None), (0, 2, None), (128, 1, 1)], []),
        4: ([(64, 1, None), (64, 2, None), (128, 1, 1)], []),
    }
    data = [(f, i + 1, "k", v, m, e) for f, (items, _) in cases.items() for i, (m, v, e) in enumerate(items)]
    got = replay.replay(spark.createDataFrame(data, LOG)).collect()
    assert sorted((r.fid, r.seq) for r in got) == sorted((f, s) for f, (_, want) in cases.items() for s in want)


@pytest.mark.parametrize(("marks", "want"), [([(1, False), (1, True), (2, False), (3, False), (3, True)], 1), ([(1, False), (1, True), (2, False), (2, True)], 2), ([(1, False), (1, False), (1, True)], 0), ([], 0)])
def test_done_until(spark, marks, want):
    assert replay.done_until(spark.createDataFrame(marks, "idx long, done boolean")).first().done_until == want


def test_buffers(spark):
    rng = random.Random(1)
    recs = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))) for i in range(500)]
    df = spark.createDataFrame(recs, "seq long, rec string")
    at, want = 8, {}
    for i, r in recs:
        want[i] = at
        at += 4 + len(r)
    assert {r.seq: r.offset for r in buffers.offsets(df).collect()} == want
    assert tuple(buffers.sizes(df).first()) == (at, at - 8, False)
    assert [r.seq for r in buffers.sort(df).orderBy("place").collect()] == [i for i, _ in sorted(recs, key=lambda x: (x[1], x[0]))]
    lo, hi = want[100], want[200]
    got = {r["at"]: r.rec for r in buffers.sort_between(df, lo, hi).collect()}
    assert [got[i] for i in range(100, 200)] == sorted(r for _, r in recs[100:200])
    assert all(got[i] == r for i, r in recs if i < 100 or i >= 200)


def test_registry(spark):
    keys = spark.createDataFrame([(1, "a", 100), (2, "b", 200)], "key_id long, data string, created_at long")
    assert tuple(registry.latest(keys, 250, 60).first()) == (2, 200, True)
    assert tuple(registry.latest(keys, 260, 60).first()) == (2, 200, False)
    got = registry.with_data_key(spark.createDataFrame([(0,), (1,), (9,)], "key_id long"), keys).collect()
    assert {r.key_id: (r.key_data, r.unknown) for r in got} == {0: (None, False), 1: ("a", False), 9: (None, True)}


# Hashes of the filter.
HASHES = {"": 3164544308, "r": 1499315714, "ru": 2735451247, "rus": 1743522570, "rust": 3428276233, "rusta": 2505947263, "rustac": 1658958784, "rustace": 1755101662, "rustacea": 2293694788, "rustacean": 2757417412, "I had a dream it would end this way.": 0xE14A9DB9}


def test_bloom(spark):
    assert {k: codecs.bloom_hash(k.encode()) for k in HASHES} == HASHES
    keys = [random.Random(i).randbytes(i % 23) for i in range(200)]
    assert codecs.bloom_hashes(keys).tolist() == [codecs.bloom_hash(k) for k in keys]
    h = lambda *x: np.array([codecs.bloom_hash(k.encode()) for k in x], np.uint64)
    small = codecs.bloom_filter(h("hello", "world"), 10)
    assert codecs.may_contain(small, h("hello", "world", "x", "foo")).tolist() == [True, True, False, False]
    for n in (1, 10, 100, 1000, 10_000):
        keys = np.array([codecs.bloom_hash(i.to_bytes(4, "little")) for i in range(n)], np.uint64)
        bloom = codecs.bloom_filter(keys, 10)
        assert codecs.may_contain(bloom, keys).all()
        others = np.array([codecs.bloom_hash((i + 10**9).to_bytes(4, "little")) for i in range(5000)], np.uint64)
        assert codecs.may_contain(bloom, others).mean() <= 0.02


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=20), st.integers(0, 2**63), st.binary(max_size=50), st.integers(0, 255), st.integers(0, 2**64 - 1))
def test_codecs_round_trip(key, version, value, meta, expires_at):
    assert codecs.uvarint(codecs.put_uvarint(expires_at)) == (expires_at, len(codecs.put_uvarint(expires_at)))
    assert codecs.decode_value(codecs.encode_value(meta, 1, expires_at, value)) == (meta, 1, expires_at, value)
    assert codecs.decode_header(codecs.encode_header(meta, 2, 3, 4, expires_at))[0] == (meta, 2, 3, 4, expires_at)
    record = codecs.encode_record(key, version, value, meta, 0, expires_at)
    found, size = codecs.decode_record(record, 0)
    assert size == len(record) and found["value"] == value
    assert codecs.decode_record(record[:-1], 0) is None
    if key:
        assert (found["user_key"], found["version"]) == (key, version)


def test_codecs_of_spark_are_the_plain_ones(spark):
    """Spark's expressions give the bytes of the plain functions."""
    keys = ["", *HASHES, "漢字", "user:000042"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", codecs_sql.bloom_hash(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in got} == {k: codecs.bloom_hash(k.encode()) for k in keys}
    numbers = [0, 1, 127, 128, 16383, 16384, (1 << 35) + 5, (1 << 62) + 1]
    got = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", codecs_sql.uvarint(F.col("x")).alias("b")).collect()
    assert {r.x: bytes(r.b) for r in got} == {x: codecs.put_uvarint(x) for x in numbers}
    row = spark.createDataFrame([("key1", 77, "value", 5, 1, 300)], "k string, v long, x string, m int, u int, e long")
    c = F.col
    got = row.select(codecs_sql.record_bytes(c("k"), c("v"), c("x"), c("m"), c("u"), c("e")).alias("r"), codecs_sql.value_bytes(c("m"), c("u"), c("e"), c("x")).alias("v")).first()
    assert bytes(got.r) == codecs.encode_record(b"key1", 77, b"value", 5, 1, 300) and bytes(got.v) == codecs.encode_value(5, 1, 300, b"value")
    assert codecs.decode_entry_header(codecs.encode_entry_header(7, 300)) == (7, 300)


def test_counter_mode(spark):
    """Test vectors of NIST SP 800-38A, F.5.1 and F.5.5, and lengths off the block."""
    iv, text = bytes(range(0xF0, 0x100)), bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    for key, want in (("2b7e151628aed2a6abf7158809cf4f3c", "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff"), ("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4", "601ec313775789a5b7a7f504bbf3d228f443e3ca4d62b59aca84e990cacaf5c5")):
        got = spark.range(1).select(codecs_sql.aes_ctr(F.lit(text), F.lit(bytes.fromhex(key)), F.lit(iv)).alias("c")).first().c
        assert bytes(got).hex() == want
        for n in (0, 1, 15, 16, 17):
            part = spark.range(1).select(codecs_sql.aes_ctr(F.lit(text[:n]), F.lit(bytes.fromhex(key)), F.lit(iv)).alias("c")).first().c
            assert bytes(part).hex() == want[: 2 * n]


def test_checksums(spark):
    xxhash = pytest.importorskip("xxhash")
    words = ["", "a", "hash me", "漢字" * 50]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", *[codecs_sql.checksum(F.col("w"), k).alias(k) for k in ("crc32", "xxhash64")]).collect()
    for r in got:
        assert r.crc32 == zlib.crc32(r.w.encode()) and r.xxhash64 % (1 << 64) == xxhash.xxh64(r.w.encode(), seed=42).intdigest()
    with pytest.raises(ValueError, match="seahash"):
        codecs_sql.checksum(F.col("w"), "seahash")


def test_level_zero_is_full(spark):
    made = lambda *ids: spark.createDataFrame([(i, 0) for i in ids], "table_id long, level int")
    ids = lambda df: sorted(r.table_id for r in df.collect())
    assert ids(manifest.add_level_zero(made(1, 2), made(9, 7, 8), 4)) == [1, 2, 7, 8]
    assert ids(manifest.add_level_zero(made(1, 2), made(9), 2)) == [1, 2]


def test_registry_file_needs_its_secret(spark, tmp_path):
    keys = spark.createDataFrame([(1, "one", 10), (2, "two", 20)], "key_id long, data string, created_at long")
    registry.write(keys, str(tmp_path / "r"), "0123456789abcdef")
    assert sorted(map(tuple, registry.read(spark, str(tmp_path / "r"), "0123456789abcdef").collect())) == [(1, "one", 10), (2, "two", 20)]
    with pytest.raises(ValueError, match="secret"):
        registry.read(spark, str(tmp_path / "r"), "fedcba9876543210")


def test_filters_of_tables(spark):
    log = rows(spark, [(f"k{i}", 1, "") for i in range(300)]).withColumn("table_id", F.col("seq") % 3)
    pairs = spark.range(4).crossJoin(spark.range(600).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("user_key"))).withColumnRenamed("id", "table_id")
    got = codecs.probe_filters(codecs.table_filters(log), pairs).collect()
    assert len(got) == 2400
    assert all(r.may for r in got if r.table_id == 3 or int(r.user_key[1:]) < 300 and int(r.user_key[1:]) % 3 == r.table_id)
    assert sum(r.may for r in got if r.table_id < 3) < 300 + 0.03 * 1500


def test_key_order(spark):
    assert codecs.encode_key(b"", 10)[-8:] == bytes([255] * 7 + [245])
    keys = spark.createDataFrame([(bytes(range(8)), v) for v in (10, 1000)], "k binary, v long")
    got = keys.withColumn("e", codecs_sql.with_version(F.col("k"), F.col("v"))).orderBy("e").withColumns({"key": codecs_sql.user_key(F.col("e")), "version": codecs_sql.version(F.col("e"))}).collect()
    assert [(bytes(r.key), int(r.version)) for r in got] == [(bytes(range(8)), 1000), (bytes(range(8)), 10)]
    assert bytes(got[0].e) == codecs.encode_key(bytes(range(8)), 1000)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("abcde", "abxde"), ("abc", "abcde"), ("", "a"), ("x", "y")], "a string, b string")
    got = df.select(codecs_sql.common_prefix(F.col("a"), F.col("b")).alias("p"), codecs_sql.common_suffix(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(r.p, r.s) for r in got] == [(2, 2), (3, 0), (0, 0), (0, 0)]
    sizes = [0, 127, 128, 16383, 16384, 1 << 35, (1 << 63) - 1]
    got = spark.createDataFrame([(x,) for x in sizes], "x long").select(codecs_sql.varint_size(F.col("x")).alias("n")).collect()
    assert [r.n for r in got] == [len(codecs.put_uvarint(x)) for x in sizes]
    pointer = spark.range(1).select(codecs_sql.pointer_bytes(F.lit(1), F.lit(2), F.lit(300)).alias("p")).first().p
    assert codecs.decode_pointer(bytes(pointer)) == (1, 2, 300)
    names = spark.createDataFrame([(42,), (1234567,)], "id long").withColumn("n", file_name(F.col("id")))
    assert [(r.n, r.i) for r in names.withColumn("i", parse_file_id(F.col("n"))).collect()] == [("000042.sst", 42), ("1234567.sst", 1234567)]


def test_log_files(spark, tmp_path):
    spark.dataSource.register(WalSource)
    for fid in (1, 2):
        w = WalWriter(str(tmp_path), fid)
        for i in range(10):
            w.append(str(i).encode(), i, str(i).encode() * fid)
    with open(w.path, "ab") as f:
        f.write(codecs.encode_record(b"cut", 1, b"x")[:-2])
    through_spark = read_wal(spark, str(tmp_path)).orderBy("fid", "offset").collect()
    late = spark.read.format("kvwal").option("path", str(tmp_path)).option("offset", through_spark[4].offset).load().collect()
    assert sorted((r.fid, r.offset) for r in late if r.fid == 1) == [(1, r.offset) for r in through_spark[4:10]]
    got = spark.read.format("kvwal").option("path", str(tmp_path)).load().orderBy("fid", "offset").collect()
    assert list(map(tuple, got)) == list(map(tuple, through_spark))
    assert [(r.fid, bytes(r.user_key), r.version, bytes(r.value)) for r in got] == [(f, str(i).encode(), i, str(i).encode() * f) for f in (1, 2) for i in range(10)]


def test_streams(spark, tmp_path):
    from kvlattice.streaming.marks import done_until_stream, follow_threshold, stream_completion

    data = [("a", 1, False), ("a", 2, False), ("a", 1, True), ("a", 2, True), ("b", 5, False)]
    spark.createDataFrame(data, "name string, idx long, done boolean").write.parquet(str(tmp_path / "m"))
    marks = spark.readStream.schema("name string, idx long, done boolean").parquet(str(tmp_path / "m"))
    q = done_until_stream(marks).writeStream.format("memory").queryName("done_marks").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("done_marks").groupBy("name").agg(F.max("done_until").alias("d")).collect()
    assert {r.name: r.d for r in got} == {"a": 2, "b": 4}
    spark.createDataFrame([(i, i == 3, 10 * i) for i in range(1, 4)], "stream_id long, stream_done boolean, size long").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("stream_id long, stream_done boolean, size long").parquet(str(tmp_path / "s"))
    q = stream_completion(stream).writeStream.format("memory").queryName("streams_done").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.stream_id: r.done for r in spark.table("streams_done").collect()} == {1: False, 2: False, 3: True}
    published = []
    q = follow_threshold(stream, 0.5, published.append).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert published == [32]
    spark.createDataFrame([(i, False, 1000) for i in range(4)], "stream_id long, stream_done boolean, size long").write.mode("append").parquet(str(tmp_path / "s"))
    q = follow_threshold(stream, 0.5, published.append).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert published == [32, 1024]  # a restart goes on with the counts it had


def test_rotation_is_the_fold(spark, monkeypatch):
    """A file starts at 20 behind the request that passes the size; values below
    the threshold are not written."""
    rng = random.Random(3)
    data = [(i, f"k{rng.randint(1, 99)}", "v" * rng.choice([2, 8, 9, 30, 200])) for i in range(600)]
    log = rows(spark, [(k, i, v) for i, k, v in data]).withColumn("fid", F.floor(F.col("seq") / 200)).withColumn("request", F.floor(F.col("seq") / 3))
    want = {}
    for fid in range(3):
        file, at = 0, 20
        for req in sorted({i // 3 for i in range(600) if i // 200 == fid}):
            for i, k, v in data[3 * req : 3 * req + 3]:
                if i // 200 == fid:
                    size = 2 + 1 + (1 if len(v) < 128 else 2) + 1 + len(k) + 8 + len(v) + 4
                    want[i] = (file, at) if len(v) >= 9 else (None, None)
                    at += size if len(v) >= 9 else 0
            if at > 1000:
                file, at = file + 1, 20
    got = {r.seq: (r.new_fid, r.new_offset) for r in vlog.rotate_requests(log, 1000, 9).collect()}
    assert got == want and {at for f, at in want.values() if f} >= {20}
    assert max(r.new_fid or 0 for r in vlog.rotate_requests(log, 1 << 30, 9, max_entries=4).collect()) > 10
    with pytest.raises(Exception, match="beyond"):
        monkeypatch.setattr(vlog, "MAX_OFFSET", 100_000)
        vlog.rotate_requests(log.withColumn("request", F.lit(0)).withColumn("value", F.expr("repeat('x', 1000)")).limit(200), 1 << 33, 1 << 30).select("seq").collect()


def test_table_cut_is_the_fold(spark):
    data = [(f"k{i:04d}", 1, "v" * (i % 37)) for i in range(500)]
    files, file, total = {}, 0, 0
    for k, _, v in data:
        if total > 950:
            file, total = file + 1, 0
        total += len(k) + len(v)
        files[k] = file
    assert {r.user_key: r.file for r in vlog.cut_tables(rows(spark, data), 1000).collect()} == files


@pytest.mark.parametrize("best, value, want", [(200, 1000.0, [200]), (300, 1000.0, []), (200, 0.5, [])])
def test_gc_candidate_follows_the_table(spark, tmp_path, best, value, want):
    """Only the newest file of the table is excluded; sizes are the files' own."""
    from kvlattice.plans import catalogue

    events = [(i, user, "click", v, "props-of-it") for i, (user, v) in enumerate([(best, value), (best, 0.0), (7, 0.2), (300, 0.0)])]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.fid for r in catalogue.queries()["vlog_gc_candidates"](spark, str(tmp_path)).collect()] == want


def test_whole_tables(spark):
    """No row of a table stays out of the whole queries; they equal their SQL."""
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from kvlattice.plans import catalogue

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    n = {t: con.execute(f"select count(*) from {t}").fetchone()[0] for t in ("events", "customer", "orders")}
    want = {"kv_concat_whole": n["events"], "kv_merge_reverse_whole": n["events"], "kv_merge_k_whole": n["events"], "registry_latest_whole": 1, "registry_lookup_whole": n["orders"], "registry_upsert_whole": n["customer"]}
    for name, rows_out in want.items():
        got = catalogue.queries()[name](spark, str(folder))
        found = [tuple(r) for r in got.collect()]
        sql = [tuple(r) for r in con.execute(f"select {', '.join(got.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()]
        assert len(found) == rows_out and sorted(map(str, found)) == sorted(map(str, sql)), name
        if name == "kv_merge_reverse_whole":
            assert [r[:2] for r in found] == sorted((r[:2] for r in sorted(found, key=lambda r: r[1])), key=lambda r: r[0], reverse=True)


def test_catalogue_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from kvlattice.plans import catalogue

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")

    def canon(df):
        df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
        return sorted(str(tuple(float(v) if isinstance(v, float | int | np.number) and not isinstance(v, bool) else str(v) for v in r)) for r in df.itertuples(index=False))

    sql = catalogue.oracle_sql()
    for name, f in catalogue.queries().items():
        got = f(spark, str(folder)).toPandas()
        if name in sql:
            want = con.execute(sql[name]).df()
            assert canon(got) == canon(pd.DataFrame(want)), name
