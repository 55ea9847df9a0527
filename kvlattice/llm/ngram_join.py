"""N-gram Jaccard join: a count-vector R-tree over hashed shingle groups.

Two documents link when 100 * intersection >= percent * union of their sets of
word shingles. A set's shingles are hashed into groups; the counts in
the groups are a point, and the summed coordinate minima of two points bound
the overlap of their sets from above. An R-tree over points bounds whole pages
by the maxima of their members. Pairs that no bound rules out are verified by
their sets. Pages and pairs within one component are skipped.

One tree over all documents cannot be searched by many machines without meeting
most page pairs, so documents are first routed, without loss, to cells, and a
cell has a tree of its own. By the prefix principle two linked sets share one
of the first n - ceil(n * percent / 100) + 1 shingles in any common order; here
the order puts shingles that are frequent in a bounded sample last (which
changes the cost, never the result). Documents that share such a shingle are
routed to the smallest of them, and there to a cell of their band of sizes, as
natives, and of the next one, as guests: linked sets are of one band or of
neighbouring ones.

First the points alone go to the cells, and the trees find the pairs that no bound
rules out. Their components are the families within which sets may link; every
document of a family brings its text there, once, and is verified by a tree of
the family; there words themselves are compared with their hashes first. The number of groups grows with the sets (``groups_of``), as chance
differences of counts grow with its root only. Equal sets are one node from the
start. Cells with more than ``POINTS`` points meet in pairs of blocks. A family of
more than ``CELL`` texts is dealt over parts, its smallest document in each of them; what the parts leave
outside the component of that document (mostly nothing) is then compared,
block by block, with all parts. So no task gets an unbounded group. Components
over all cells come from label propagation with shortcuts, on DataFrames.

Defined cases: null and empty text has no shingle and links with nothing; fewer
words than a shingle has are one shingle; repeated rows, rows with one doc_id
and rows with a null one (below all others) are documents of their own, in the
order of their texts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, lookup, materialize, narrowed, only, settle, unique_ids
from .shingles import exact_sets, shingles

WORDS, PERCENT = 4, 85
LEAST_GROUPS, PAGE, CELL, POINTS = 64, 32, 512, 4096
SAMPLE, FREQUENT, LISTED = 16_384, 4, 100_000


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def groups_of(n: int) -> int:
    """Groups for sets of n shingles or more: the power of two from n / 8 on."""
    return max(LEAST_GROUPS, 1 << max(0, (n - 1) // 8).bit_length())


def band_of(n: int, percent: int) -> int:
    return math.floor(math.log(n) / math.log(100 / percent) + 1e-9)


def band_groups(band: int, percent: int) -> int:
    """Groups in cells of a band, from its smallest size."""
    return groups_of(int((100 / percent) ** band))


def counts(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """The point of each set."""
    out = np.zeros((len(sets), groups), np.int32)
    for k, s in enumerate(sets):
        out[k] = np.bincount((s >> np.uint64(32) ^ s) % np.uint64(groups), minlength=groups)
    return out


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    """A point of more groups, a power of two times as many, as one of fewer."""
    return point.reshape(-1, groups).sum(axis=0)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([a, b]))
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


class Components:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


class CountTree:
    """Points packed into pages of neighbours; a page has its members' maxima
    and smallest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        # sort-tile: slices by size, tiles by the two widest coordinates
        wide = np.argsort(-points.std(axis=0))[:2] if len(points) else [0, 1]
        order = np.lexsort((np.arange(len(sizes)), sizes))
        tile = max(1, int(np.ceil(len(order) / max(1, np.sqrt(len(order) / PAGE)))))
        order = np.concatenate([s[np.lexsort((points[s, wide[1]], points[s, wide[0]]))] for s in (order[i : i + tile] for i in range(0, len(order), tile))]) if len(order) else order
        self.pages = [order[i : i + PAGE] for i in range(0, len(order), PAGE)]
        self.most = np.array([points[p].max(axis=0) for p in self.pages])
        self.low = np.array([sizes[p].min() for p in self.pages])

    def page_pairs(self, other: CountTree, percent: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pages whose members may overlap enough to link."""
        for i, page in enumerate(self.pages):
            bound = np.minimum(self.most[i], other.most).sum(axis=1)
            need = percent * (self.low[i] + other.low)
            for j in np.flatnonzero(bound * (100 + percent) >= need):
                if not own or j >= i:
                    yield page, other.pages[j]


def join_points(a: CountTree, b: CountTree, sets_a: list, sets_b: list, at_b: int, parts: Components, percent: int, own: bool) -> None:
    """Unites what links; members of b are numbered from at_b in ``parts``."""
    labels = parts.labels()
    for p, q in a.page_pairs(b, percent, own):
        if labels[p].min() == labels[p].max() == labels[q + at_b].min() == labels[q + at_b].max():
            continue
        bound = np.minimum(a.points[p][:, None, :], b.points[q][None, :, :]).sum(axis=2)
        may = (bound * (100 + percent) >= percent * (a.sizes[p][:, None] + b.sizes[q])) & (labels[p][:, None] != labels[q + at_b])
        new = False
        for i, j in zip(*np.nonzero(may), strict=True):
            if parts.find(p[i]) != parts.find(q[j] + at_b) and linked(sets_a[p[i]], sets_b[q[j]], percent):
                parts.join(p[i], q[j] + at_b)
                new = True
        if new:
            labels = parts.labels()


def cell_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest member of each member's component. The first one is tried with
    all others before the tree, which then skips what is joined already."""
    parts, sizes = Components(len(sets)), np.array([len(s) for s in sets])
    for k in range(1, len(sets)):
        if linked(sets[0], sets[k], percent):
            parts.join(0, k)
    if len(set(parts.labels())) > 1:
        tree = CountTree(counts(sets, groups_of(int(sizes.min()))), sizes)
        join_points(tree, tree, sets, sets, 0, parts, percent, True)
    return parts.labels()


def possible(points: np.ndarray, sizes: np.ndarray, native: np.ndarray, percent: int) -> np.ndarray:
    """Smallest member of each member's family: pairs, one of both a native,
    that no bound rules out. Pages of one family are skipped."""
    parts, tree = Components(len(sizes)), CountTree(points, sizes)
    labels = parts.labels()
    for p, q in tree.page_pairs(tree, percent, True):
        if labels[p].min() == labels[p].max() == labels[q].min() == labels[q].max() or not (native[p].any() or native[q].any()):
            continue
        bound = np.minimum(points[p][:, None, :], points[q][None, :, :]).sum(axis=2)
        may = (bound * (100 + percent) >= percent * (sizes[p][:, None] + sizes[q])) & (native[p][:, None] | native[q])
        while True:
            i, j = np.nonzero(may & (labels[p][:, None] != labels[q]))
            if not len(i):
                break
            _, first = np.unique(i, return_index=True)
            for k in first:
                parts.join(p[i[k]], q[j[k]])
            labels = parts.labels()
    return labels


def among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted list that may be much longer."""
    if not len(listed):
        return np.zeros(len(x), bool)
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x


def _described(docs: DataFrame, words: int, percent: int, frequent: np.ndarray | None) -> DataFrame:
    """doc, n, same (identity of the set), point, and keys (the set's prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, keys, sets = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text or "", words)
                first = s[: prefix_length(len(s), percent)] if len(s) else s
                if frequent is not None and len(s) and among(first, frequent).any():
                    late = among(s, frequent)
                    first = np.concatenate([s[~late], s[late]])[: len(first)]
                n.append(len(s))
                sets.append(s)
                same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(first.astype("<i8"))
            ends = np.cumsum([0, *map(len, keys)])
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, "i8"), pa.int64())
            wide = [counts([x], band_groups(band_of(len(x), percent) + 1, percent))[0] if len(x) else np.zeros(0) for x in sets]
            point = pa.array([x.astype("<u2").tobytes() for x in wide], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), point, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc", "n", "same", "point", "keys"])

    return docs.mapInArrow(run, "doc long, n long, same binary, point binary, keys array<long>")


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of several documents of a sample of at most SAMPLE documents: a
    list of LISTED at most. What a shingle in fewer than FREQUENT / SAMPLE of all
    documents gathers in a cell is so much of them."""
    ids = docs.select("doc").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found.update(shingles(text or "", words).tolist())
        top = found.most_common(LISTED)
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x for x, _ in top], "u8").astype("i8")), pa.array([n for _, n in top], pa.int64())], ["key", "n"])

    found = docs.join(F.broadcast(ids.distinct()), "doc", "left_semi").mapInArrow(run, "key long, n long")
    top = found.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(LISTED)
    return np.sort(np.array([r.key for r in top.collect()], "i8").astype("u8"))


def _grouped(rows: DataFrame, schema: str, make) -> DataFrame:
    """Rows sorted by cell and part, a list of them at a time to ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[:2] != now:
                    if len(held) > 1:
                        yield from make(held)
                    now, held = r[:2], []
                held.append(r)
        if len(held) > 1:
            yield from make(held)

    return rows.mapInArrow(run, schema)


def _edges(docs: list, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = [(d, docs[k]) for d, k in zip(docs, labels, strict=True) if d != docs[k]]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])


def _sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sets to be verified: of hashes, unless two words of these texts share one."""
    return exact_sets(texts, words) or [shingles(t, words) for t in texts]


def _first_links(placed: DataFrame, words: int, percent: int) -> DataFrame:
    """placed: cell, part, doc, text. The naming document is in each part."""

    def make(rows: list) -> Iterator[pa.RecordBatch]:
        rows = list({r[2]: r for r in rows}.values())
        labels = cell_components(_sets([r[3] or "" for r in rows], words), percent)
        yield from _edges([r[2] for r in rows], labels)

    sorted_rows = placed.repartition("cell", "part").sortWithinPartitions("cell", "part", "doc")
    return _grouped(sorted_rows.select("cell", "part", "doc", "text"), "u long, v long", make)


def _late_links(placed: DataFrame, words: int, percent: int) -> DataFrame:
    """placed: cell, part, late, doc, label, text; late rows against the others."""

    def make(rows: list) -> Iterator[pa.RecordBatch]:
        rows = sorted({(r[2], r[3]): r for r in rows}.values(), key=lambda r: r[2:4])
        sets = _sets([r[5] or "" for r in rows], words)
        sizes, cut = np.array([len(s) for s in sets]), sum(not r[2] for r in rows)
        points = counts(sets, groups_of(int(sizes.min())))
        parts, first = Components(len(rows)), {}
        for k, r in enumerate(rows):
            parts.join(first.setdefault(r[4], k), k)
        a, b = CountTree(points[:cut], sizes[:cut]), CountTree(points[cut:], sizes[cut:])
        if cut and cut < len(rows):
            join_points(a, b, sets[:cut], sets[cut:], cut, parts, percent, False)
        yield from _edges([r[4] for r in rows], parts.labels())

    sorted_rows = placed.repartition("cell", "part").sortWithinPartitions("cell", "part", "late", "doc")
    return _grouped(sorted_rows.select("cell", "part", "late", "doc", "label", "text"), "u long, v long", make)


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node it is connected with) for all nodes of edges
    u, v. Labels spread along edges and jump to their labels' labels."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, "edges")
    degrees = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"), F.count("*").alias("n"))
    now = materialize(degrees.select(F.col("u").alias("node"), "label", "n"), "labels-0")
    for k in range(1, 1000):
        near = lookup(both, now.select(F.col("node").alias("v"), "label", "n"), ["v"], "n")
        best = near.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("best"))
        spread = now.join(best, "node").select("node", F.least("label", "best").alias("next"), "n", F.col("label").alias("was"))
        spread = materialize(spread, f"spread-{k}")
        users = spread.groupBy(F.col("next")).agg(F.count("*").alias("m"))
        jump = users.join(spread.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("next", "far", "m")
        new = materialize(lookup(spread, materialize(jump, f"jump-{k}"), ["next"], "m").select("node", F.col("far").alias("label"), "n", "was"), f"labels-{k}")
        now = new.select("node", "label", "n")
        if not new.filter("label <> was").limit(1).count():
            return now.select("node", "label")
    raise RuntimeError("labels did not settle")


def _cells(routed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """cell, band, doc, n, point, native: a row for each cell of a document."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
    both = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("native")), F.struct((band + 1).alias("band"), F.lit(False).alias("native"))))
    each = routed.join(nodes.select("doc", "n"), "doc").withColumn("_b", both)
    return each.select(F.xxhash64("center", "_b.band").alias("cell"), "_b.band", "doc", "n", "_b.native")


def _families(cells: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """u, v: documents and the smallest of their family in a cell."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("m"), F.bool_or("native").alias("natives")).filter("m > 1 and natives")
    sizes = materialize(sizes, "cell-sizes")
    blocks = F.ceil(F.col("m") / POINTS).cast("int")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    rows = lookup(cells, sizes, ["cell"], "m").withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    rows = rows.join(nodes.select("doc", "point"), "doc")

    def make(rows: list) -> Iterator[pa.RecordBatch]:
        groups = band_groups(rows[0][6], percent)
        points = np.array([fold(np.frombuffer(r[4], "<u2").astype(np.int32), groups) for r in rows])
        labels = possible(points, np.array([r[3] for r in rows]), np.array([r[5] for r in rows]), percent)
        yield from _edges([r[2] for r in rows], labels)

    placed = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "doc")
    return _grouped(placed.select("cell", "part", "doc", "n", "point", "native", "band"), "u long, v long", make).distinct()


def _placed(routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """cell, head (its smallest doc), m, doc, part, parts: cells of more than
    CELL documents are dealt out."""
    parts = F.ceil(F.col("m") / CELL).cast("int").alias("parts")
    named = lookup(routed, sizes, ["cell"], "m").select("cell", "head", "doc", "m", parts)
    return named.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))


def _linked(base: DataFrame, words: int, percent: int) -> DataFrame:
    """base (doc, text; doc tells rows apart) to doc, n, component."""
    spark = base.sparkSession
    each = materialize(_described(base, words, percent, _frequent(base, words)), "sets")
    groups = each.filter("n > 0").groupBy("same").agg(F.min("doc").alias("node"), F.count("*").alias("copies"))
    groups = materialize(groups, "set-groups")
    # merge joins at every size: what is moved grows as the input does
    chosen = groups.select(F.col("node").alias("doc")).hint("merge")
    nodes = materialize(each.join(chosen, "doc", "left_semi").select("doc", "n", "point", "keys"), "nodes")
    whole, each = each, materialize(each.select("doc", "n", "same"), "slim-sets")
    discard(whole)
    settle(spark)
    keys = nodes.select("doc", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc").alias("center"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(shared, "shared-keys")
    routed = materialize(lookup(keys, shared, ["key"], "n").select("center", "doc").distinct(), "routed")
    discard(shared)
    settle(spark)
    cells = materialize(_cells(routed, nodes, percent), "cells")
    possible_links = materialize(_families(cells, nodes, percent), "families")
    discard(routed, cells, nodes)
    settle(spark)
    routed = components(possible_links).select(F.col("label").alias("cell"), F.col("node").alias("doc"))
    sizes = materialize(routed.groupBy("cell").agg(F.count("*").alias("m"), F.min("doc").alias("head")), "partner-sizes")
    placed = materialize(_placed(routed, sizes), "placed")
    texts = narrowed(base, placed.select("doc"), "doc")
    heads = placed.filter("parts > 1 and head = doc").select("cell", "doc", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = placed.select("cell", "doc", "part").unionByName(heads.select("cell", "doc", "part"))
    links = materialize(_first_links(first.hint("merge").join(texts, "doc"), words, percent), "links")
    settle(spark)
    found = components(links)
    large = placed.filter("parts > 1")
    if large.limit(1).count():
        found = _compare_late(large, found, links, texts, words, percent)
    named = groups.join(found.withColumnRenamed("label", "to"), groups["node"] == found["node"], "left").select("same", "copies", F.coalesce("to", groups["node"]).alias("component"))
    rest = lookup(each.filter("n > 0").select("doc", "n", "same"), materialize(named, "labelled"), ["same"], "copies")
    own = each.filter("n = 0").select("doc", "n", F.col("doc").alias("component"))
    return own.unionByName(rest.select("doc", "n", "component"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if unique_ids(rows, "doc_id"):
        found = _linked(rows.select(F.col("doc_id").alias("doc"), "text"), words, percent)
        return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    rows = keyed(rows, "doc_id", "text")
    found = _linked(rows.select(F.col("_key").alias("doc"), "text"), words, percent)
    ids = rows.select(F.col("_key").alias("doc"), "doc_id")
    names = rows.select(F.col("_key").alias("component"), F.col("doc_id").alias("component_id"))
    return found.join(ids, "doc").join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _compare_late(large: DataFrame, found: DataFrame, links: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Members of dealt cells outside the component of the smallest document,
    block by block, with all members of another component."""
    labels = found.withColumnRenamed("node", "doc")
    members = large.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    members = materialize(members, "members")
    main = materialize(members.filter("head = doc").select("cell", F.col("label").alias("main"), "m"), "main")
    late = lookup(members.drop("m"), main, ["cell"], "m").filter("label <> main")
    late = materialize(late.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts")).cast("int")), "late")
    blocks = materialize(late.select("cell", "block").distinct(), "late-blocks")
    if not blocks.limit(1).count():
        return found
    code = (F.col("block").cast("long") * (1 << 31) + F.col("part")).alias("part")
    left = members.join(blocks, "cell").select("cell", code, F.lit(False).alias("late"), "doc", "label")
    right = late.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", code, F.lit(True).alias("late"), "doc", "label")
    more = _late_links(left.unionByName(right).join(texts, "doc"), words, percent)
    return components(links.unionByName(materialize(more, "late-links")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The smallest document of each component, all columns as they are."""
    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    key, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    if not unique_ids(rows, key):
        rows, key = keyed(rows, key, text_col), "_key"
    found = _linked(rows.select(F.col(key).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), words, percent)
    kept = materialize(found.filter("component = doc").select(F.col("doc").alias("id")), "representatives")
    return only(rows, kept, key).drop("_key").toDF(*names)
