"""Language identification: averaged embeddings of hashed subwords, linear softmax.

A text's subwords are the n-grams of 1 to 4 bytes of its lower-cased (A-Z)
UTF-8 form, hashed into ``BUCKETS``. The mean of their embeddings goes through
a linear layer and a softmax. Both layers are trained by stochastic gradient
descent in numpy, on the driver, from at most ``PER_LANGUAGE`` documents of each
language and at most ``MAX_ROWS`` in all (with more than MAX_ROWS / PER_LANGUAGE
languages an equal part of them for each, one at least): those with the smallest
hash of their doc_id. Their features are made on the executors from whole texts.
A fifth of the sample sets the softmax temperature and the score under which a
prediction is rejected.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
is rejected; a table without labelled rows makes every prediction ``und``, and
then ``keep_identified`` keeps every text with a letter; ties go to the language
that sorts first; repeated rows are predicted one by one, and of rows with one
doc_id one is learned from; rows without doc_id are predicted only; very long
texts are read whole, in chunks; further columns, whatever their names, are
ignored or, in ``keep_identified``, passed on; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, ORDERS = 8192, 16, (1, 2, 3, 4)
PER_LANGUAGE, MAX_ROWS = 500, 4000
EPOCHS, RATE, BATCH, SEED = 30, 20.0, 32, 7
#: Share of correctly predicted calibration rows that rejection may cost, and
#: the score above which nothing is rejected.
REJECT_SHARE, REJECT_MOST = 0.001, 0.5
CHUNK = 1 << 20
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32


def features(text: str) -> np.ndarray:
    """Subwords in each bucket, over the whole text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out, longest = np.zeros(BUCKETS, np.int64), max(ORDERS)
    for at in range(0, len(data), CHUNK):
        part = FOLD[data[at : at + CHUNK + longest - 1]]
        own = min(CHUNK, len(data) - at)
        h = np.full(len(part), 2166136261, np.uint32)
        for n in range(1, longest + 1):
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * np.uint32(16777619)
            if n in ORDERS:
                out += np.bincount((h[:own] ^ (h[:own] >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # of each bucket, the part that a subword has in each language's logit
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, whether it is rejected."""
        if not text or not self.languages or not LETTER.search(text):
            return UND, 0.0, True
        counts = features(text)
        logits = (counts @ self.table / counts.sum() + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        k = int(p.argmax())
        score = float(p[k] / p.sum())
        return self.languages[k], score, score < self.threshold


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, labels: list[str]) -> LanguageModel:
    """x: subword frequencies, a row for each label."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([languages.index(v) for v in labels])
    check = np.arange(len(y)) % 5 == 4
    if len(y) < 20:
        check[:] = False
    rng = np.random.default_rng(SEED)
    e = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    own = np.flatnonzero(~check)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            mean = x[part] @ e
            d = softmax(mean @ w + b)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            back = d @ w.T
            w -= rate * (mean.T @ d)
            b -= 0.1 * rate / RATE * d.sum(axis=0)
            used = np.flatnonzero(x[part].any(axis=0))
            e[used] -= rate * (x[part][:, used].T @ back)
    held = np.flatnonzero(check) if check.any() else own
    logits = x[held] @ e @ w + b
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(1, 20, 40), key=loss))
    p = softmax(logits / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[held]])
    threshold = min(REJECT_MOST, float(right[int(REJECT_SHARE * len(right))])) if len(right) else 0.0
    return LanguageModel(languages, (e @ w).astype(np.float64), b.astype(np.float64), temperature, threshold * 0.999)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trains on rows of ``docs`` for which ``usable`` holds."""
    labelled = docs.filter(usable & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long")).alias("h"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_ROWS).collect()}
    if not sizes:
        return train(np.zeros((0, BUCKETS)), [])
    quota = max(1, min(PER_LANGUAGE, MAX_ROWS // len(sizes)))
    # somewhat more than is wanted of each language, by the place of the hash in its range
    wanted = quota + 4 * math.sqrt(quota) + 8
    shares = spark_rows(docs, [(lang, min(1.0, wanted / n)) for lang, n in sizes.items()], "lang string, share double")  # MAX_ROWS rows at most
    near = rows.join(F.broadcast(shares), "lang").filter(F.col("h") / float(1 << 64) + 0.5 <= F.col("share"))
    near = near.select("lang", "h", "id").distinct().orderBy("h", "lang", "id").limit(4 * MAX_ROWS)
    ranked: dict[str, list[int]] = {}
    for r in near.collect():
        ranked.setdefault(r.lang, []).append(r.id)
    ids = sorted({i for found in ranked.values() for i in found[:quota]})[:MAX_ROWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if LETTER.search(text):
                    c = features(text)
                    at = np.flatnonzero(c)
                    out.append({"id": i, "lang": lang, "at": at.astype("<u2").tobytes(), "share": (c[at] / c.sum()).astype("<f4").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("share", pa.binary())]))

    chosen = spark_rows(docs, [(i,) for i in ids], "id long")  # MAX_ROWS ids at most
    texts = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = texts.join(F.broadcast(chosen), "id", "left_semi")
    # one row for each id, however many have it
    one = texts.groupBy("id").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text", "lang"), F.col("lang"))).alias("r"))
    made = one.select("id", "r.text", "r.lang").mapInArrow(run, "id long, lang string, at binary, share binary").collect()
    made = sorted(made, key=lambda r: hash_order(r.id))
    x = np.zeros((len(made), BUCKETS), np.float32)
    for k, r in enumerate(made):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["share"], "<f4")
    return train(x, [r.lang for r in made])


def spark_rows(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return docs.sparkSession.createDataFrame(rows, schema)


def hash_order(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x) for x in batch.column(2).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the rows that are not held out and predicts every row."""
    return predict(docs, fit(docs, ~held_out(id_col), id_col, text_col, lang_col), id_col, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs``, all columns as they are, without those rejected."""
    model = fit(docs, ~held_out(id_col), id_col, text_col, lang_col)
    kinds, at = docs.dtypes, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [not model.predict(x)[2] for x in texts] if model.languages else [bool(x and LETTER.search(x)) for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in kinds))
