import random
from pathlib import Path

import pytest

EXTRA = ["key", "_key", "_text", "node", "label", "group", "count", "rank", "text_sha256"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def odd_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6)))
    base = " ".join(word() for _ in range(80))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", " ", "\n\t", "a", "A", "a b", "A b c", "one two three four", "ÀÉ", "àé", "x" * 500, "ab" * 400, "0 1 2", "!!! ???", "<|endoftext|> x", "under the MIT license. Under the MIT License"]
    texts += [base, base, base.upper(), base + " more", base.replace(" ", "  ", 3), base[5:]]
    texts += [word() + " " + passage + " " + word() for _ in range(12)]
    texts += [" ".join([*base.split(" ")[:70], *[word() for _ in range(k)]]) for k in range(8)]
    texts += [base + " " + " ".join(word() for _ in range(5000)), passage * 9, "😀 漢字   x　 y   z\r\n  q"]
    thue = ["ab"[bin(i).count("1") % 2] for i in range(2048)]
    for n in (1024, 2048):  # words that meet in sums of powers modulo 2^64
        word_a = "".join(thue[:n])
        texts += [word_a, word_a.translate(str.maketrans("ab", "ba"))]
    return texts


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, short, very long and repeated texts, beside columns whose
    names clash with those that operators use."""
    rows = [(i * 3, t, "en" if i % 2 else None, None, None, *["x"] * len(EXTRA)) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def repeated(odd, spark):
    """The same with rows twice, one id for several texts, and null ids."""
    more = spark.createDataFrame([(None, "no id", *[None] * 12), (None, None, *[None] * 12), (9, "another text with the id nine", *[None] * 12)], SCHEMA)
    return odd.unionByName(odd.filter("doc_id < 60")).unionByName(more).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test data")
    return folder


@pytest.fixture(scope="session")
def tokenizers():
    return pytest.importorskip("public_tokenizers")
