"""Operators on pairs and groups of rows, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlattice.llm import block_naming, ngram_join, pivot_topk, suffix_dedup
from kvlattice.llm.common import documents, prepare
from kvlattice.llm.shingles import shingles

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def order(i):
    return (i is not None, i or 0)


# ---- exact


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=order)
        kept = sorted(ids, key=order)[:-1]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), False, sha) for i in kept] + [(keep, keep, len(ids), True, sha)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("which", "block", "bits"), [("odd", 4096, 64), ("odd", 16, 64), ("odd", 16, 4), ("repeated", 64, 3), ("repeated", 4096, 64), ("empty", 4096, 64)])
def test_exact_dedup(spark, which, block, bits, request):
    docs = request.getfixturevalue(which)
    prepare(spark)
    got = block_naming.exact_dedup(docs, block_bytes=block, hash_bits=bits).collect()
    assert sorted(str(tuple(r)) for r in got) == exact_brute(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("which", ["odd", "repeated"])
def test_exact_keep_one(spark, which, request):
    docs = request.getfixturevalue(which)
    prepare(spark)
    kept = block_naming.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.select("text").collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").translate(LOWER) for r in docs.select("text").collect()})


# ---- n-gram join


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def join_brute(rows, k, percent):
    rows = sorted(rows, key=lambda r: (order(r.doc_id), r.text is not None, (r.text or "").encode()))
    sets = [shingle_set(r.text, k) for r in rows]
    parts, inverted = ngram_join.Components(len(rows)), defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parts.join(i, j)
        for x in s:
            inverted[x].append(i)
    return sorted(str((r.doc_id, len(sets[i]), rows[parts.find(i)].doc_id)) for i, r in enumerate(rows))


@pytest.mark.parametrize(("which", "k", "percent", "cell"), [("odd", 4, 85, 512), ("odd", 5, 80, 3), ("odd", 1, 60, 2), ("repeated", 4, 85, 512), ("empty", 4, 85, 512), ("small", 4, 85, 512), ("small", 5, 80, 4)])
def test_ngram_join(spark, which, k, percent, cell, request, monkeypatch):
    source = request.getfixturevalue(which)
    docs = documents(spark, source) if which == "small" else source
    prepare(spark)
    monkeypatch.setattr(ngram_join, "CELL", cell)
    monkeypatch.setattr(ngram_join, "POINTS", 2 * cell)
    got = ngram_join.join(docs, k, percent).collect()
    assert sorted(str(tuple(r)) for r in got) == join_brute(docs.select("doc_id", "text").collect(), k, percent)


@pytest.mark.parametrize("which", ["odd", "repeated"])
def test_ngram_keep_one(spark, which, request):
    docs = request.getfixturevalue(which)
    prepare(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert [k for _, k in kept.dtypes] == [k for _, k in docs.dtypes]
    rows = docs.select("doc_id", "text").collect()
    heads = Counter(x.rpartition(", ")[2] for x in join_brute(rows, 4, 85))
    assert {str(r.doc_id) + ")" for r in kept.collect()} == set(heads)
    assert kept.count() == kept.filter("doc_id is not null").select("doc_id").count() + kept.filter("doc_id is null").count()


def test_ngram_join_links_a_hot_family(spark, monkeypatch):
    """Many variants of one text, each near some others, over several parts."""
    prepare(spark)
    rng = random.Random(7)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "CELL", 16)
    got = ngram_join.join(docs, 4, 85).collect()
    assert sorted(str(tuple(r)) for r in got) == join_brute(docs.collect(), 4, 85)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=70), st.sampled_from([50, 80, 85, 100]))
def test_cells_by_tree(sets, percent):
    arrays = [np.unique(np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    labels, want = ngram_join.cell_components(arrays, percent), ngram_join.Components(len(sets))
    for i, a in enumerate(arrays):
        for j, b in enumerate(arrays[:i]):
            n = len(np.intersect1d(a, b))
            if 100 * n >= percent * (len(a) + len(b) - n):
                want.join(i, j)
    assert (labels == want.labels()).all()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbé \t\n\x0b", max_size=60), st.integers(1, 5))
def test_shingles_are_sets(text, k):
    assert len(shingles(text, k)) == len(shingle_set(text, k))
    assert (shingles(text, k) == shingles(text.translate(LOWER), k)).all()


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    import kvlattice.llm.shingles as module

    texts = ["a b c d e", "a b c d f", "", "a b c d e f", "A b\tc d e"]
    assert module.exact_sets(texts, 4) is None
    monkeypatch.setattr(module, "word_hashes", lambda text: np.ones(len(text.split()), np.uint64))
    sets = module.exact_sets(texts, 4)
    assert [len(s) for s in sets] == [2, 2, 0, 3, 2]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(np.intersect1d(a, b)) == len(shingle_set(texts[i], 4) & shingle_set(texts[j], 4))


# ---- suffixes


def repeat_brute(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (order(r.doc_id), r.text is not None, (r.text or "").encode())):
        data = (r.text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((r.doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("which", "group"), [("odd", 2048), ("odd", 2), ("repeated", 2048), ("empty", 2048), ("small", 2048), ("small", 3)])
def test_suffix_dedup(spark, which, group, request, monkeypatch):
    source = request.getfixturevalue(which)
    docs = documents(spark, source) if which == "small" else source
    prepare(spark)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.dedup(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == repeat_brute(docs.select("doc_id", "text").collect())


def test_remove_repeats_keeps_rows_and_columns(spark, repeated):
    prepare(spark)
    got = suffix_dedup.remove_repeats(repeated)
    assert got.columns == repeated.columns and got.count() == repeated.count()
    assert [k for _, k in got.dtypes] == [k for _, k in repeated.dtypes]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5))
def test_merged_order_is_the_sorted_order(seed, shards):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    windows = rng.integers(97, 99, (n, suffix_dedup.WIDTH)).astype(np.uint8)
    windows[rng.random(n) < 0.5] = windows[0]
    windows[:, : int(rng.integers(0, 30))] = suffix_dedup.PAD
    cuts = np.array_split(np.arange(n), min(shards, n))
    for j, rank, common in suffix_dedup.merge([suffix_dedup.ShardTransform(windows[c]) for c in cuts]):
        text = [windows[i, j:].tobytes() for i in rank]
        assert text == sorted(text)
        for a, b, k in zip(text, text[1:], common[1:].tolist(), strict=False):
            assert a[:k] == b[:k] and (k == len(a) or a[k] != b[k])


# ---- top-k


def top_brute(rows, k=10):
    vectors = [(r.vec_id, np.floor(1024 * np.array(r.embedding, float))) for r in rows if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    dim, out = max((len(v) for _, v in vectors), default=0), []
    flat = [(i, np.pad(v, (0, dim - len(v)))) for i, v in vectors]
    for q, v in {i: v for i, v in flat if i % 100 == 0}.items():
        best = sorted(((-int(v @ w), i) for i, w in flat if i != q))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("n", "dim", "hot"), [(1500, 8, 0.0), (1200, 16, 0.4), (5, 3, 0.0), (0, 3, 0.0)])
def test_top_k(spark, n, dim, hot, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(0, 1, dim).astype(float).tolist() if rng.random() >= hot else [0.5] * dim, 1) for i in range(n)]
    if n > 100:
        rows += [(None, [1.0] * dim, 1), (5000, None, 1), (5001, [None] * dim, 1), (5002, [float("nan")] * dim, 1), (5003, [float("inf")] * dim, 1), (5004, [1.0], 1), (5005, [], 1), (5006, rows[7][1], 1)]
    monkeypatch.setattr(pivot_topk, "SAMPLE", 64)
    monkeypatch.setattr(pivot_topk, "BLOCK_BYTES", 1024)
    monkeypatch.setattr(pivot_topk, "SHARE", 3)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(pivot_topk, "PER_TASK", 2)  # several tasks hold a share
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("id", "v", "pivot", "rank", "block", "share"):
        df = df.withColumn(c, F.lit("x"))
    got = pivot_topk.top_k(df, df.filter("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == top_brute(df.collect())


def test_index_prunes(spark, monkeypatch):
    """Clusters whose members' ids lie apart: blocks of neighbouring queries reach
    few shares, and the shares grow with the rows."""
    prepare(spark)
    monkeypatch.setattr(pivot_topk, "BLOCK_BYTES", 1024)
    monkeypatch.setattr(pivot_topk, "SHARE", 2)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 8)
    counts = []
    for n in (1500, 3000):
        rng = np.random.default_rng(1)
        centres = rng.normal(0, 1, (8, 16)) * 5
        df = spark.createDataFrame([(i, (centres[i % 8] + rng.normal(0, 0.05, 16)).tolist(), 1) for i in range(n)], VECTORS)
        rows = pivot_topk.integers(df, "vec_id", "embedding")
        pivots = pivot_topk.fit(rows)
        assert pivot_topk.LEAST_PIVOTS <= len(pivots.centres) <= 64
        index = pivot_topk.build(rows, pivots)
        assert index.agg(F.sum("n")).first()[0] == n
        assert index.groupBy("share").agg(F.countDistinct("pivot").alias("p"), F.count("*").alias("a")).filter("p > 1 or a > 2").count() == 0
        shares = index.groupBy("pivot", "share").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        spans = {r.pivot: (r.low, r.high) for r in shares.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        placed = pivot_topk.place(rows.filter("id % 50 = 0"), pivots, 10).withColumn("kth", F.lit(None).cast("double"))
        blocks = [pivot_topk.query_blocks(placed, pivots, spans, own) for own in (True, False)]
        pairs = sum(b.join(shares, "pivot").filter("high >= near and low <= far").count() for b in blocks)
        every = blocks[0].select("block").distinct().count() * shares.count()
        assert 0 < pairs < 0.4 * every
        counts.append(shares.count())
    assert counts[1] > 1.4 * counts[0]
