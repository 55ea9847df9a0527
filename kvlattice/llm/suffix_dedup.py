"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier (in a smaller document, or earlier in the same one).

Anchors. The string that starts at s is assigned an anchor: the place, among the
first ``WINDOW`` ones, of the smallest hash of ``GRAM`` bytes. That depends on the
string alone, so equal strings have their anchors at the same distance. A place
x is the anchor of the starts x - a to x - b; its window is the text that these
strings cover. Windows that don't share the ``CORE`` bytes behind their anchors
have no string in common, and in each group of windows with one core all
strings are aligned at the anchor.

Transforms. A shard of aligned windows has a transform with one column of
symbols for each place, from the last to the first: the symbols at place j in the
sorted order of the suffixes from place j + 1. Shards are merged without
looking at suffixes again: starting from their concatenation, an interleave is
refined place by place, by reading each shard's column from top to bottom in the
order of the interleave and splitting stably by symbol. The common prefix of
two neighbours grows by one from the smallest between them, or starts anew where
their symbols differ; runs of neighbours with LENGTH or more in common are the
repeated intervals. In each the earliest string stays.

On Spark: equal windows are one string of the collection (its earliest place
stays, the others repeat it as a whole), within a batch before anything moves
and then by core. Only windows that share a core with another one travel as
bytes. A core with more than ``GROUP`` windows is split by start: half of the
starts has a longer core in common, down to one start, whose core is the whole
string and whose earliest place is an aggregate. So no group is unbounded.

Windows that have a core in common are told apart by a cryptographic digest
(BLAKE2b, 64 bits of it, beside the 64 bits of the core); the texts of all that
differ meet in the merge, which compares bytes.

Defined cases: null text is empty; nothing is removed from texts shorter than
LENGTH; equal doc_ids, and null ones, which come first, are told apart by text;
repeated rows are documents of their own, of which the later ones lose all;
very long texts are whole; an empty table gives no rows; further columns are ignored or, in
``remove_repeats``, passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, lookup, materialize, settle
from .shingles import mix, powers

LENGTH, WINDOW, GRAM = 100, 64, 20
CORE = LENGTH - WINDOW + 1
PAD = 0xFF  # in no UTF-8 text
WIDTH = WINDOW - 1 + LENGTH
SHARDS, GROUP, MERGE = 4, 2048, 8192
SAMPLE, FREQUENT, SALTS = 1000, 10, 64
_rng = np.random.default_rng(99991)
BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW32 = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place x, a, b, core hash and window hash of each anchor."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype("u8"), none.astype("u8")
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * up[:-1], out=total[1:])
    grams = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    low = (grams & ~LOW32) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step < WINDOW:
        move = min(step, WINDOW - step)
        low = np.minimum(low[:-move], low[move:])
        step += move
    place = (low[: n - LENGTH + 1] & LOW32).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    x = place[first]
    a, b = x - first, x - last
    core = mix((total[x + CORE] - total[x]) * down[x])
    text, digest = data.tobytes(), hashlib.blake2b
    found = b"".join([digest(text[i : j + LENGTH], digest_size=8).digest() for i, j in zip(first.tolist(), last.tolist(), strict=True)])
    return x, a, b, core, np.frombuffer(found, "<u8") ^ mix((a * WINDOW + b).astype(np.uint64))


def pack(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (x << 12) | (a << 6) | b


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 12, (place >> 6) & 63, place & 63


class ShardTransform:
    """Columns of symbols of one shard's windows, from the last place on."""

    def __init__(self, windows: np.ndarray):
        self.size = len(windows)
        text, order = np.ascontiguousarray(windows.T), np.arange(self.size)
        self.columns = np.empty((WIDTH, self.size), np.uint8)
        for j in range(WIDTH - 1, -1, -1):
            self.columns[j] = column = text[j][order]
            order = order[np.argsort(column, kind="stable")]


def smallest_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """min(values[left:right]) for each pair, by a table over powers of two."""
    levels = [values]
    while 2 << (len(levels) - 1) <= int((right - left).max(initial=1)):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    level = np.log2(right - left).astype(np.int64)
    out = np.empty(len(left), values.dtype)
    for k, table in enumerate(levels):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[left[at]], table[right[at] - (1 << k)])
    return out


def merge(shards: list[ShardTransform]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place, from the last one on: the merged order of the suffixes
    that start there, as numbers of windows (shard after shard), and the length
    of each one's common prefix with its predecessor."""
    n = sum(s.size for s in shards)
    source = np.repeat(np.arange(len(shards)), [s.size for s in shards])
    window, common = np.arange(n), np.zeros(n, np.uint8)
    for j in range(WIDTH - 1, -1, -1):
        symbols = np.empty(n, np.uint8)
        for k, shard in enumerate(shards):
            symbols[source == k] = shard.columns[j]
        split = np.argsort(symbols, kind="stable")
        ordered = symbols[split]
        same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        grown = np.zeros(n, np.uint8)
        if len(same):
            grown[same] = 1 + smallest_between(common, split[same - 1] + 1, split[same] + 1) if j < WIDTH - 1 else 1
        source, window, common = source[split], window[split], grown
        yield j, window, common


def repeated_starts(windows: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """Which strings repeat an earlier one: a row for each window, a column for
    each distance of the start from the anchor (``low`` to ``high`` count)."""
    found = np.zeros((len(windows), WINDOW), bool)
    cuts = np.array_split(np.arange(len(windows)), min(shards, max(1, len(windows))))
    for j, order, common in merge([ShardTransform(windows[c]) for c in cuts]):
        back = WINDOW - 1 - j
        if back < 0:
            continue
        run = np.cumsum(common < LENGTH)
        takes = (low[order] <= back) & (back <= high[order])
        order, run = order[takes], run[takes]
        if len(order) > 1:
            starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            first = np.minimum.reduceat(rank[order], starts)
            found[order, back] = rank[order] != np.repeat(first, np.diff(np.append(starts, len(order))))
    return found


def window_rows(data: bytes, place: list[int]) -> list[bytes]:
    """Padded windows of a text's anchors, the anchor at WINDOW - 1."""
    out = []
    for x, a, b in zip(*(v.tolist() for v in unpack(np.array(place, np.int64))), strict=True):
        out.append(b"\xff" * (WINDOW - 1 - a) + data[x - a : x - b + LENGTH] + b"\xff" * b)
    return out


def _ranges(doc: np.ndarray, x: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc and packed range (first start, number of starts less one)."""
    padded = np.pad(found, ((0, 0), (1, 1)))
    row, begin = np.nonzero(padded[:, 1:] & ~padded[:, :-1])
    _, end = np.nonzero(~padded[:, 1:] & padded[:, :-1])
    return doc[row], ((x[row] - end + 1) << 6) | (end - 1 - begin)


SEEN = "core long, whole long, salt int, key long, place long"
FOUND = "core long, key long, place long, kind int"
REPEAT, ASK = 0, 1


def _scan(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """The earliest anchor for each window of a batch, to be dealt by core; the
    others, whose strings all repeat, are already ranges (salt -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, a, b, core, whole = anchors(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8))
                if len(x):
                    parts.append((core, whole, np.full(len(x), key), x, pack(x, a, b)))
            if not parts:
                continue
            core, whole, key, x, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((x, key, whole, core))
            core, whole, key, place = core[order], whole[order], key[order], place[order]
            again = np.concatenate(([False], (core[1:] == core[:-1]) & (whole[1:] == whole[:-1])))
            salt = np.zeros(len(core), "i4")
            if len(hot):
                salt = np.where(np.isin(core, hot), 1 + (whole % np.uint64(SALTS)).astype("i4"), 0).astype("i4")
            x, a, b = unpack(place)
            place = np.where(again, ((x - a) << 6) | (a - b), place)
            core, salt = np.where(again, mix(key.astype("u8")), core), np.where(again, -1, salt).astype("i4")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (core.view("i8"), whole.view("i8"), salt, key.astype("i8"), place.astype("i8"))], ["core", "whole", "salt", "key", "place"])

    return rows.select("key", "text").mapInArrow(run, SEEN)


def _meet(seen: DataFrame) -> DataFrame:
    """Sorted by core, window and place: later anchors of a window repeat as a
    whole, and the first ones are asked for if their core has two windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # core, whole, salt, key, place, whether the core has several windows
        for batch in batches:
            if not batch.num_rows:
                continue
            core, whole, salt, key, place = (batch.column(k).to_numpy() for k in range(5))
            if last is not None:
                core, whole, salt, key, place = (np.concatenate(([v], c)) for v, c in zip(last[:5], (core, whole, salt, key, place), strict=True))
            asked = last is not None and last[5]
            ready = salt < 0
            new_core = np.concatenate(([True], (core[1:] != core[:-1]) | (salt[1:] != salt[:-1])))
            new = new_core | np.concatenate(([True], whole[1:] != whole[:-1]))
            group = np.cumsum(new_core) - 1
            several = np.bincount(group, weights=new) > 1
            several |= np.bincount(group, weights=salt > 0) > 0
            if asked:
                several[0] = True
            ask = new & several[group] & ~ready
            ask[0] &= not asked
            repeat = ~new & ~ready
            x, a, b = unpack(place)
            place = np.where(repeat, ((x - a) << 6) | (a - b), place)
            out = ask | repeat | ready
            first_of_last = np.flatnonzero(new)[-1]
            last = core[-1], whole[-1], salt[-1], key[first_of_last], pack(x[first_of_last], a[first_of_last], b[first_of_last]), bool(several[group[-1]])
            if ready[first_of_last]:
                last = None
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(core[out]), pa.array(key[out]), pa.array(place[out]), pa.array(np.where(ask, ASK, REPEAT).astype("i4")[out])], ["core", "key", "place", "kind"])

    return seen.repartition("core", "salt").sortWithinPartitions("core", "salt", "whole", "key", "place").mapInArrow(run, FOUND)


def _windows(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """core, key, x, low, high, window of each anchor that is asked for."""
    wanted = asks.groupBy("key").agg(F.collect_list(F.struct("core", "place")).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                place = np.array([r["place"] for r in found], np.int64)
                x, a, b = unpack(place)
                cut = window_rows(text.encode("utf-8", "replace"), place)
                yield pa.RecordBatch.from_arrays([pa.array([r["core"] for r in found], pa.int64()), pa.array(np.full(len(x), key, "i8")), pa.array(x), pa.array(b.astype("i4")), pa.array(a.astype("i4")), pa.array(cut, pa.binary())], ["core", "key", "x", "low", "high", "window"])

    return rows.select("key", "text").join(wanted, "key").select("key", "text", "asks").mapInArrow(run, "core long, key long, x long, low int, high int, window binary")


def _merged(groups: DataFrame) -> DataFrame:
    """Ranges of starts that repeat an earlier string of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def work(table: pa.Table) -> pa.RecordBatch | None:
            key, x, low, high = (table.column(k).to_numpy() for k in ("key", "x", "low", "high"))
            windows = np.frombuffer(b"".join(table.column("window").to_pylist()), np.uint8).reshape(len(key), WIDTH)
            rank = np.empty(len(key), np.int64)
            rank[np.lexsort((x, key))] = np.arange(len(key))
            doc, place = _ranges(key, x, repeated_starts(windows, low, high, rank))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place)], ["key", "place"]) if len(doc) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= MERGE:
                table = pa.Table.from_batches(held).combine_chunks()
                group, part = table.column("group").to_numpy(), table.column("part").to_numpy()
                cut = int(np.flatnonzero((group != group[-1]) | (part != part[-1]))[-1] + 1) if (group[0], part[0]) != (group[-1], part[-1]) else 0
                if cut and (out := work(table.slice(0, cut))):
                    yield out
                held, n = table.slice(cut).to_batches(), n - cut
        if n and (out := work(pa.Table.from_batches(held).combine_chunks())):
            yield out

    placed = groups.repartition("group", "part").sortWithinPartitions("group", "part")
    return placed.select("group", "part", "key", "x", "low", "high", "window").mapInArrow(run, "key long, place long")


def _split(windows: DataFrame, half: int) -> DataFrame:
    """Windows by ``half`` starts each: group is a hash of what these have in
    common, part tells which starts they are."""
    ends = [F.floor(F.col(c) / half).cast("int") for c in ("low", "high")]
    each = windows.withColumn("part", F.explode(F.sequence(*ends)))
    begin, size = F.lit(WINDOW) - F.col("part") * half, LENGTH - half + 1
    shared = F.substring(F.col("window"), begin.cast("int"), F.lit(size))
    low, high = F.greatest(F.col("low"), F.col("part") * half), F.least(F.col("high"), F.col("part") * half + half - 1)
    return each.select(F.xxhash64(shared, "core").alias("group"), "part", "core", "key", "x", low.cast("int").alias("low"), high.cast("int").alias("high"), "window")


def _group_repeats(windows: DataFrame) -> list[DataFrame]:
    """Ranges from the merges; groups of more than GROUP windows are split."""
    out, half = [], WINDOW
    now = windows.withColumn("group", F.col("core")).withColumn("part", F.lit(0))
    while True:
        counts = materialize(now.groupBy("group", "part").agg(F.count("*").alias("n")).filter("n > 1"), "group-sizes")
        large = counts.filter(F.col("n") > GROUP)
        if not large.limit(1).count():
            out.append(_merged(now if half == WINDOW else lookup(now, counts, ["group", "part"], "n")))
            return out
        sized = materialize(lookup(now, counts, ["group", "part"], "n"), "sized")
        out.append(_merged(sized.filter(F.col("n") <= GROUP)))
        now, half = sized.filter(F.col("n") > GROUP).drop("group", "part", "n"), half // 2
        now = materialize(_split(now, half), "split")
        if half == 1:
            out.append(_single_starts(now))
            return out


def _single_starts(now: DataFrame) -> DataFrame:
    """One start each: the string itself is the group, and the earliest stays."""
    string = F.substring(F.col("window"), (F.lit(WINDOW) - F.col("part")).cast("int"), F.lit(LENGTH))
    each = materialize(now.select(F.sha2(string, 256).alias("string"), "key", (F.col("x") - F.col("part")).alias("start")), "strings")
    first = each.groupBy("string").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    both = lookup(each, materialize(first, "first-strings"), ["string"], "n")
    later = (F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start"))
    return both.filter(later).select("key", F.shiftleft("start", 6).alias("place"))


def repeats(rows: DataFrame) -> DataFrame:
    """key and packed ranges of starts whose strings repeat an earlier one."""
    spark = rows.sparkSession
    seen = _scan(rows, _hot_cores(rows))
    found = materialize(_meet(seen), "anchors")
    del seen
    settle(spark)
    windows = materialize(_windows(rows, found.filter(F.col("kind") == ASK)), "windows")
    settle(spark)
    out = found.filter(F.col("kind") == REPEAT).select("key", "place")
    for more in _group_repeats(windows):
        out = out.unionByName(materialize(more, "merged"))
    settle(spark)
    return out


def _hot_cores(rows: DataFrame) -> np.ndarray:
    """Cores of several documents of a sample of at most SAMPLE: their windows
    are dealt by window. This moves work and doesn't change the result."""
    ids = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).to_pylist():
                core = np.unique(anchors(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8))[3])
                yield pa.RecordBatch.from_arrays([pa.array(core.view("i8"))], ["core"])

    found = rows.select("key", "text").join(F.broadcast(ids), "key", "left_semi").mapInArrow(run, "core long")
    top = found.groupBy("core").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "core").limit(50_000)
    return np.sort(np.array([r.core for r in top.collect()], "i8").view("u8"))


def kept(data: bytes, ranges: list[int]) -> tuple[bytes, int, int]:
    """What stays, how many bytes go, and in how many maximal runs."""
    if not ranges:
        return data, 0, 0
    packed = np.array(ranges, np.int64)
    start, more = packed >> 6, packed & 63
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + more + LENGTH, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _with_ranges(rows: DataFrame) -> DataFrame:
    """rows (with _key and text) and the ranges of each."""
    found = repeats(rows.select(F.col("_key").alias("key"), "text"))
    found = found.groupBy(F.col("key").alias("_key")).agg(F.collect_list("place").alias("_ranges"))
    return rows.join(found, "_key", "left")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = keyed(rows, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                rest, gone, runs = kept(data, ranges)
                out.append((len(data), gone, runs, hashlib.sha256(rest).hexdigest()))
            n, gone, runs, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_ranges(rows).select("doc_id", "text", "_ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` without the repeated bytes; all rows and columns stay, and
    ``count_col``, if there is one, counts the characters left. A character of
    which a part was removed goes as a whole."""
    kinds, names = docs.dtypes, [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    number = docs.columns.index(count_col) if count_col in docs.columns else None
    plain = docs.toDF(*names)
    rows = keyed(plain.select("*", F.col(names[at]).cast("string").alias("text"), F.col(names[docs.columns.index(id_col)]).cast("long").alias("_id")), "_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.columns[:-1], batch.column(at).to_pylist()
            out = [t if t is None or not r else kept(t.encode("utf-8", "replace"), r)[0].decode("utf-8", "ignore") for t, r in zip(texts, batch.columns[-1].to_pylist(), strict=True)]
            columns[at] = pa.array(out, pa.string())
            if number is not None:
                sizes = [old if t is None or not r else len(t) for t, old, r in zip(out, columns[number].to_pylist(), batch.columns[-1].to_pylist(), strict=True)]
                columns[number] = pa.array(sizes, columns[number].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    done = _with_ranges(rows).select(*names, "_ranges").mapInArrow(run, ", ".join(f"{c} {kind}" for c, (_, kind) in zip(names, kinds, strict=True)))
    return done.toDF(*docs.columns)
