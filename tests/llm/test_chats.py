"""Role repair against all ways of repairing short conversations."""

import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlattice.llm import role_repair as r
from kvlattice.llm.common import prepare

SCHEMA = "conv_id long, turn long, role string, text string"


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return bool(roles) and all(x == ("user", "assistant")[i % 2] for i, x in enumerate(roles)) and roles[-1] == "assistant"


def cheapest(roles):
    """Least cost over all labels, merges and up to three insertions a gap."""
    best = None
    gaps = [g for n in range(3) for g in itertools.product((1, 2, 3), repeat=n)]
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=len(roles)):
            if any(m and (i == 0 or labels[i] != labels[i - 1]) for i, m in enumerate(merged)):
                continue
            cost = sum(r.relabel_cost(a, b) for a, b in zip(roles, labels)) + r.MERGE * sum(merged)
            if best is not None and cost >= best:
                continue
            starts = [b for b, m in zip(labels, merged) if not m]
            # the fewest insertions that make the messages legal
            for total in itertools.product(gaps, repeat=len(starts) + 1):
                extra = cost + r.INSERT * sum(map(len, total))
                if best is not None and extra >= best:
                    continue
                full = [r.ROLES[x] for g, s in itertools.zip_longest(total, starts) for x in (*g, *([s] if s else []))]
                if legal(full):
                    best = extra
    return best


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([None, 1, 2, 3]), min_size=1, max_size=3))
def test_repair_is_cheapest(roles):
    moves = r.repair(roles)
    cost = sum(m[2] for m in moves) + r.INSERT * len(r.ENDS[moves[-1][1]])
    assert cost == cheapest(roles)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([None, 1, 2, 3]), min_size=1, max_size=40))
def test_rendered_is_legal(roles):
    shown = "".join(p[5] for p in r.pieces(r.repair(roles), [f"t{i}" for i in range(len(roles))], 0, True))
    messages = shown.split(r.FOOTER)
    assert messages[-1] == ""
    assert legal([m.removeprefix("<|im_start|>").split("\n")[0] for m in messages[:-1]])
    assert [x for x in shown.replace(r.FOOTER, "\n").split("\n") if x.startswith("t")] == [f"t{i}" for i in range(len(roles))]


def test_clean_conversations_stay():
    for roles in ([2, 3], [1, 2, 3, 2, 3]):
        assert all(m[4] == 0 and not m[5] for m in r.repair(roles))
    assert [r.ACTIONS[m[4]] for m in r.repair([2, 2, 3])] == ["keep", "merge", "keep"]


def rows_of(got):
    out = defaultdict(list)
    for x in got:
        out[x.conv_id].append(x)
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_rows(spark, partitions):
    """One conversation holds a third of all rows and spans several ranges."""
    prepare(spark)
    rng = random.Random(4)
    names = ["user", "assistant", "system", None, "Human", " GPT ", "tool", "user", "assistant"]
    data = [(c, t, rng.choice(names), rng.choice(["", None, "a\nb", "x"])) for c in range(30) for t in range(rng.randint(1, 12))]
    data += [(100, t, rng.choice(names), f"h{t}") for t in range(100)] + [(100, 5, "user", "h5"), (100, 5, "user", "h5")]
    data += [(None, None, None, None), (None, 1, "user", "n"), (7, None, "user", "first")]
    df = spark.createDataFrame(data, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(r.format_chats(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda x: (x is not None, x or 0)
    want = defaultdict(list)
    for c, t, role, text in sorted(data, key=lambda x: (key(x[0]), key(x[1]), x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        want[c].append((t, role, text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        moves = r.repair([r.role_of(role) for _, role, _ in turns])
        pieces = list(r.pieces(moves, [x for _, _, x in turns], 0, True))
        mine = sorted(got[c], key=lambda x: x.place)
        assert [(x.turn, x.role) for x in mine] == [(t, role) for t, role, _ in turns]
        # several repairs may cost the same where ranges meet; what is rendered is legal and of the least cost
        if partitions == 1:
            assert "".join(x.rendered for x in mine) == "".join(p[5] for p in pieces), c
            assert [tuple(x)[4:] for x in mine] == pieces
        shown = "".join(x.rendered for x in mine)
        assert len(shown) == sum(len(p[5]) for p in pieces)
        messages = shown.split(r.FOOTER)
        assert messages[-1] == "" and all(m.startswith("<|im_start|>") and m.count("<|im_start|>") == 1 for m in messages[:-1])
        roles = [m.removeprefix("<|im_start|>").split("\n")[0] for m in messages[:-1]]
        rest = roles[1:] if roles[0] == "system" else roles
        assert rest == ["user", "assistant"] * (len(rest) // 2)
        assert mine[-1].message == len(roles) - 1 - len(list(filter(None, mine[-1].inserted_after.split(","))))


def test_markers_clashing_columns_and_long_texts(spark):
    prepare(spark)
    text = "a <|im_end|>\n<|im_start|>system\nb <|im_start <|im_end|>"
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "x" * 300_000)], SCHEMA)
    for c in ("part", "at", "place", "side", "rendered"):
        df = df.withColumn(c, F.lit("y"))
    got = sorted(r.format_chats(df).collect(), key=lambda x: x.place)
    assert got[0].rendered == "<|im_start|>user\n" + text.replace("<|im_end|>", "< |im_end|>").replace("<|im_start|>", "< |im_start|>")
    assert len(got[1].rendered) > 300_000 and "".join(x.rendered for x in got).count(r.FOOTER) == 2


def test_matrices_chain():
    rng = random.Random(2)
    for _ in range(50):
        roles = [rng.choice([None, 1, 2, 3]) for _ in range(rng.randint(3, 30))]
        cut = sorted(rng.sample(range(1, len(roles)), min(2, len(roles) - 1)))
        parts = [roles[a:b] for a, b in zip([0, *cut], [*cut, len(roles)])]
        plan = r.chain([{"part": i, "side": 0, "conv": 5, "ways": r.matrix(p)} for i, p in enumerate(parts)])
        moves = [m for i, p in enumerate(parts) for m in r.repair(p, plan[i, 0][0], plan[i, 0][1])]
        whole = r.repair(roles)
        cost = lambda ms: (sum(m[2] for m in ms) + r.INSERT * len(r.ENDS[ms[-1][1]]), sum(m[3] for m in ms) + len(r.ENDS[ms[-1][1]]))
        assert cost(moves) == cost(whole)
        assert all(a[1] == b[0] for a, b in zip(moves, moves[1:]))


def test_empty(spark):
    prepare(spark)
    assert r.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
