"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers, floor(1024 x). With M the largest norm, the point
(v, sqrt(M^2 - |v|^2)) has distance^2 |q|^2 + M^2 - 2 q.v from (q, 0): the
highest inner products are the nearest points, and a score is a radius.

Index: every point is keyed by its nearest pivot and the distance to it, and the
sorted keys are cut into annuli, blocks of at most ``BLOCK_BYTES`` of vectors
with their smallest and largest distance. ``SHARE`` consecutive annuli of a pivot
are a share, which a task can hold. There are about as many pivots as the root
of the number of rows, ``PIVOTS`` at most, the centres of a bounded sample
(``SAMPLE`` rows with the smallest hash of their id); the index holds every row.

Search: the sample gives each query a first radius. Queries are sorted as the
points are, by nearest pivot and distance, and cut into blocks of neighbours.
By the triangle inequality no point of an annulus [a, b] is nearer than
max(d - b, a - d), d the query's distance from the pivot. First each block goes to
the shares of its own pivot that its radii reach. The k best there give each
query a smaller radius, with which it goes on to those other pivots, and those
shares of theirs, that it still reaches. A task holds one share and takes the
blocks one by one; it expands from the annulus with the nearest bound, the
radius shrinks as better rows are found, and a query leaves out every annulus
beyond it. A share that many blocks reach is held by several tasks, and a pivot
with many rows has many shares, so a vector that a third of all rows share is
no hot spot.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; shorter vectors count as padded with zeros;
candidates are all rows with another id than the query's; ties go to the
smaller id, equal ids may repeat; of several rows with a query's id one is the
query; with fewer than k candidates all are returned; further columns, whatever
their names, are ignored; empty in, empty out. Components must keep scores
within 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE, LEAST_PIVOTS, PIVOTS, SAMPLE, ROUNDS = 1024, 16, 512, 4096, 8
#: Bytes of an annulus, annuli of a share, queries of a block, blocks that one
#: holder of a share takes.
BLOCK_BYTES, SHARE, QUERY_BLOCK, PER_TASK = 64 << 10, 64, 128, 256


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (floor(1024 x) as doubles) of the rows that take part."""
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull())
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * SCALE).cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == len(lists) * dim and (ends == np.arange(1, len(lists) + 1) * dim).all():
        return flat.reshape(len(lists), dim)
    for k, end in enumerate(ends):
        part = flat[(ends[k - 1] if k else 0) : end]
        out[k, : len(part)] = part
    return out


@dataclass
class Pivots:
    """What a worker has to know of the index; its size is bounded."""

    dim: int
    norm2: float  # M^2
    dtype: str
    exact: bool  # doubles hold all scores exactly
    centres: np.ndarray  # a row each, of dim + 1
    sample: np.ndarray
    sample_ids: np.ndarray

    def lift(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm2 - (v * v).sum(axis=1)))
        return np.column_stack([v, rest])

    def distances(self, points: np.ndarray) -> np.ndarray:
        c = self.centres
        d2 = (points * points).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * points @ c.T
        return np.sqrt(np.maximum(0, d2))

    def scores(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return q.astype("f8") @ v.astype("f8").T if self.exact else q.astype("i8") @ v.astype("i8").T

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of a row with this score, a little more for rounding."""
        norm = (q.astype("f8") ** 2).sum(axis=1)
        return np.sqrt(np.maximum(0, norm + self.norm2 - 2 * score)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(self.norm2 + norm))


def fit(rows: DataFrame) -> Pivots | None:
    most = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))
    norm2, dim, top, n = rows.agg(*most, F.count("*")).first()
    if dim is None:
        return None
    norm2, top, dim = norm2 or 0.0, top or 0.0, max(1, dim)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    ids = picked.column("id").to_numpy()
    v = matrix(picked.column("v").combine_chunks() if isinstance(picked.column("v"), pa.ChunkedArray) else picked.column("v"), dim)
    dtype = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    out = Pivots(dim, norm2, dtype, dim * top * top < 2.0**53, np.zeros((1, dim + 1)), v, ids)
    points = out.lift(v)
    many = min(PIVOTS, max(LEAST_PIVOTS, math.isqrt(n)))
    centres = np.unique(points[:: max(1, len(points) // many)][:many], axis=0)
    for _ in range(ROUNDS):
        out.centres = centres
        near = out.distances(points).argmin(axis=1)
        centres = np.array([points[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centres)])
    out.centres = centres
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def build(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """The index, a row for each annulus: pivot, low, high, n, ids, vectors."""
    per_block = max(16, BLOCK_BYTES // (pivots.dim * np.dtype(pivots.dtype).itemsize))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), pivots.dim)
            d = pivots.distances(pivots.lift(v))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype("i4")), pa.array(d[np.arange(len(d)), near]), pa.array([x.tobytes() for x in v.astype(pivots.dtype)], pa.binary())], ["id", "pivot", "d", "v"])

    schema = pa.schema([("pivot", pa.int32()), ("share", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, []
        share, annuli = (TaskContext.get().partitionId() << 24) - 1, SHARE

        def out() -> pa.RecordBatch:
            nonlocal share, annuli
            share, annuli = (share + 1, 1) if annuli == SHARE else (share, annuli + 1)
            row = {"pivot": pivot, "share": share, "low": held[0][0], "high": held[-1][0], "n": len(held), "ids": np.array([x[1] for x in held], "<i8").tobytes(), "vectors": b"".join(x[2] for x in held)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for i, p, d, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (p != pivot or len(held) == per_block):
                    yield out()
                    held = []
                if p != pivot:
                    pivot, annuli = p, SHARE  # a share is of one pivot
                held.append((d, i, v))
        if held:
            yield out()

    keyed = rows.mapInArrow(key, "id long, pivot int, d double, v binary")
    placed = keyed.repartitionByRange("pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
    return materialize(placed.mapInArrow(block, "pivot int, share long, low double, high double, n int, ids binary, vectors binary"), "annuli")


def place(queries: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """id, v, pivot (the nearest), d and radius (from the sample) of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), matrix(batch.column(1), pivots.dim)
            d = pivots.distances(np.column_stack([q, np.zeros(len(q))]))
            near = d.argmin(axis=1)
            s = pivots.scores(q, pivots.sample).astype("f8")
            s[ids[:, None] == pivots.sample_ids] = -np.inf
            kth = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf)
            radius = np.where(np.isfinite(kth), pivots.radius(q, np.where(np.isfinite(kth), kth, 0)), np.inf)
            v = pa.array([x.tobytes() for x in q.astype(pivots.dtype)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(near.astype("i4")), pa.array(d[np.arange(len(d)), near]), pa.array(radius)], ["id", "v", "pivot", "d", "radius"])

    return materialize(queries.mapInArrow(run, "id long, v binary, pivot int, d double, radius double"), "queries")


def query_blocks(placed: DataFrame, pivots: Pivots, spans: dict[int, tuple[float, float]], own: bool) -> DataFrame:
    """placed (id, v, pivot, d, radius, kth): blocks of neighbouring queries for
    their own pivot, or for each other one with those that reach its span; ids,
    vectors, radii and distances of the block, and what the radii reach."""
    fields = [("block", pa.string()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), *((x, pa.binary()) for x in ("ids", "vectors", "radii", "d"))]
    schema = pa.schema(fields)
    low, high = (np.array([spans.get(p, (np.inf, -np.inf))[i] for p in range(len(pivots.centres))]) for i in (0, 1))

    def blocks(part: pa.RecordBatch) -> Iterator[dict]:
        ids, home = part.column("id").to_numpy(), part.column("pivot").to_numpy()
        q = np.frombuffer(b"".join(part.column("v").to_pylist()), pivots.dtype).reshape(len(ids), -1)
        radii = part.column("radius").to_numpy()
        kth = part.column("kth").to_numpy(zero_copy_only=False).astype("f8")  # nan where there is none
        radii = np.where(np.isnan(kth), radii, np.minimum(radii, pivots.radius(q, np.nan_to_num(kth))))
        d = pivots.distances(np.column_stack([q.astype("f8"), np.zeros(len(q))]))
        reaches = (d - radii[:, None] <= high) & (d + radii[:, None] >= low)
        at_home = home[:, None] == np.arange(len(low))
        reaches &= at_home if own else ~at_home
        for p in np.flatnonzero(reaches.any(axis=0)):
            x = reaches[:, p]
            r, dp = radii[x], d[x, p]
            yield {"block": f"{ids[0]}-{ids[-1]}-{len(ids)}", "pivot": int(p), "near": float((dp - r).min()), "far": float((dp + r).max()), "ids": ids[x].astype("<i8").tobytes(), "vectors": np.ascontiguousarray(q[x]).tobytes(), "radii": r.tobytes(), "d": dp.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                rows = list(blocks(batch.slice(at, QUERY_BLOCK)))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    near = placed.repartitionByRange("pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
    return materialize(near.mapInArrow(run, "block string, pivot int, near double, far double, ids binary, vectors binary, radii binary, d binary"), "query-blocks")


def search(blocks: DataFrame, index: DataFrame, shares: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """query_id, vec_id, score: of each block and share it reaches, each query's
    k best. Rows of a share are sorted annuli first, which a task holds."""
    meets = blocks.join(shares, "pivot").filter((F.col("high") >= F.col("near")) & (F.col("low") <= F.col("far"))).drop("low", "high")
    dealt = meets.groupBy("share").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("parts"))
    dealt = materialize(dealt, "share-parts")
    none = F.lit(None).cast("binary")
    held = index.join(dealt, "share").select("share", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "low", "high", "ids", "vectors", none.alias("radii"), none.alias("d"))
    part = F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")
    asks = meets.join(dealt, "share").select("share", part.alias("part"), F.lit(1).alias("kind"), F.col("near").alias("low"), F.col("far").alias("high"), "ids", "vectors", "radii", "d")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def visit(r: dict, annuli: list[tuple]) -> Iterator[pa.RecordBatch]:
        q_ids, radii, d = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["radii"]).copy(), np.frombuffer(r["d"])
        q = np.frombuffer(r["vectors"], pivots.dtype).reshape(len(q_ids), -1)
        low, high = (np.array([x[i] for x in annuli]) for i in (0, 1))
        bound = np.maximum(d[:, None] - high, low - d[:, None])
        found = [(np.zeros(0, "i8"), np.zeros(0, "i8"))] * len(q_ids)
        for a in np.argsort(bound.min(axis=0), kind="stable"):
            live = np.flatnonzero(bound[:, a] <= radii)
            if not len(live):
                continue
            ids, v = annuli[a][2:]
            scores = pivots.scores(q[live], v).astype("i8")
            for i, own in zip(live, scores, strict=True):
                other = ids != q_ids[i]
                vs, ss = np.concatenate([found[i][0], ids[other]]), np.concatenate([found[i][1], own[other]])
                at = best(ss, vs, k)
                found[i] = vs[at], ss[at]
                if len(at) == k:
                    radii[i] = min(radii[i], pivots.radius(q[i : i + 1], ss[at[-1:]].astype("f8"))[0])
        sizes = [len(vs) for vs, _ in found]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([vs for vs, _ in found])), pa.array(np.concatenate([ss for _, ss in found]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, annuli = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["share"], r["part"]) != now:
                    now, annuli = (r["share"], r["part"]), []
                if r["kind"] == 0:
                    ids = np.frombuffer(r["ids"], "<i8")
                    annuli.append((r["low"], r["high"], ids, np.frombuffer(r["vectors"], pivots.dtype).reshape(len(ids), -1)))
                else:
                    yield from visit(r, annuli)

    both = held.unionByName(asks).repartition("share", "part").sortWithinPartitions("share", "part", "kind", "low")
    return both.mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows."""
    rows, asked = integers(vectors, id_col, vector_col), integers(queries, id_col, vector_col).dropDuplicates(["id"])
    pivots = fit(rows)
    if pivots is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = build(rows, pivots)
    shares = materialize(index.groupBy("pivot", "share").agg(F.min("low").alias("low"), F.max("high").alias("high")), "shares")
    spans = {r.pivot: (r.low, r.high) for r in shares.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # PIVOTS rows at most
    placed = place(asked, pivots, k)
    none = F.lit(None).cast("double")
    own = materialize(ranked(search(query_blocks(placed.withColumn("kth", none), pivots, spans, True), index, shares, pivots, k), k), "own-pivot")
    kth = own.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    others = query_blocks(placed.join(kth, "id", "left"), pivots, spans, False)
    more = search(others, index, shares, pivots, k)
    return ranked(own.drop("rank").unionByName(more), k)
