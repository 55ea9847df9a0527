"""The pipeline over a small folder, and the registration of queries."""

import zlib

import numpy as np
import pytest
from test_pairs import LOWER, join_brute
from tokenizers import Tokenizer

from kvlattice.llm.common import documents, materialize


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} >= {f"op{i}" for i in (1, 2, 3, 5, 6, 7, 8, 9, 10)}


def test_stages(spark, small):
    import corpus_pipeline as p

    docs = documents(spark, small)
    before, texts = docs, None
    for name, stage in p.STAGES:
        after = stage(spark, before, small)
        if name != "packing":
            assert after.dtypes == docs.dtypes, name
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
            if name in ("exact_dedup", "ngram_join"):
                assert 0 < len(ids) < before.count()
            if name == "suffix_dedup":
                texts = {r.doc_id: r.text for r in after.collect()}
                assert len(texts) == before.count()
            before = after
    assert {r.doc_id for r in after.select("doc_id").collect()} == set(texts)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_stages_equal_brute_force(spark, which, request, tokenizers):
    """From what the language stage keeps, each stage against a plain version of it."""
    import corpus_pipeline as p

    source = request.getfixturevalue(which)
    docs = documents(spark, source) if which == "small" else source
    stages = dict(p.STAGES)
    kept = materialize(stages["language_id"](spark, docs, ""), "language")
    texts = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
    assert texts and all(any(c.isalpha() for c in t) for t in texts.values())

    exact = materialize(stages["exact_dedup"](spark, kept, ""), "exact")
    last = {}
    for i in sorted(texts):
        last[texts[i].translate(LOWER)] = i
    assert ids(exact) == sorted(last.values())

    near = materialize(stages["ngram_join"](spark, exact, ""), "near")
    links = [x.strip("()").split(", ") for x in join_brute(exact.select("doc_id", "text").collect(), 5, 80)]
    assert ids(near) == sorted({int(c) for _, _, c in links})

    rest = materialize(stages["suffix_dedup"](spark, near, ""), "rest")
    want, seen = {}, set()
    for r in near.orderBy("doc_id").collect():
        data = r.text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"x" * 100
            seen.add(data[s : s + 100])
        want[r.doc_id] = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in rest.select("doc_id", "text").collect()} == want

    fresh = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    left = {i: np.array([*fresh.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in want.items()}
    for r in sorted(stages["packing"](spark, rest, "").collect(), key=lambda r: (r.doc_id, r.start)):
        part, left[r.doc_id] = left[r.doc_id][: r.length], left[r.doc_id][r.length :]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    assert not any(map(len, left.values()))


@pytest.mark.parametrize("which", ["odd", "repeated", "empty"])
def test_stages_on_odd_rows(spark, which, request):
    import corpus_pipeline as p

    docs = request.getfixturevalue(which)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
    assert docs.columns[:3] == ["doc_id", "start", "length"]
    docs.collect()
