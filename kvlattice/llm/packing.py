"""Harmonic packing of documents into sequences of at most ``capacity`` tokens.

A document of length n is of class j = capacity // n: its length is in
(capacity / (j + 1), capacity / j], and a bin of class j takes j such documents,
whole. So a bin is closed by count alone, and each worker fills its own bins: no
document ever moves between workers.

What j documents leave free is filled with pieces of documents that are cut: first
the rests of those longer than the capacity, whose full sequences are cut off
anyway, then, only while more than ``WAITING`` bins wait to be filled, the
documents that come next: of class 1, whose bins waste most, or of any class if
more than 4 * WAITING wait. A space of at most
``capacity // SLACK`` tokens is padded.
When a worker's rows end, the pieces of bins that are still open, and then of
the last waiting ones, fill the bins that wait, so one sequence of a worker is
partly filled.

Defined cases: null text is empty text and a document always has its end id;
each row is a document of its own, also a repeated one; a very long text is cut
at each full sequence; an empty table gives no piece; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hf_words import encoder

CAPACITY, END_ID = 2048, 1
#: Bins that wait for a filling, rests that wait to be one, and the share of a
#: sequence (1 / SLACK) under which a space is not worth a cut. The first two
#: bound a worker's memory; a rest beyond them is packed in its own class.
WAITING, RESTS, SLACK = 64, 256, 14
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
SCHEMA = pa.schema([(x, pa.int64()) for x in NAMES])
ROWS = 8192

Piece = tuple[int, int, np.ndarray, int]  # doc_id, start, ids, doc_tokens


class HarmonicBins:
    """The bins of one worker: an open one of each class, those that wait for a
    filling, and the rests they are filled with."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.slack, self.next_id = capacity, capacity // SLACK, first_id
        self.open: dict[int, list[Piece]] = {}
        self.waiting: deque[tuple[list[Piece], int]] = deque()
        self.rests: deque[Piece] = deque()

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[tuple]:
        start, n = 0, len(ids)
        while n - start >= self.capacity:
            yield from self._close([(doc_id, start, ids[start : start + self.capacity], n)])
            start += self.capacity
        if start == n:
            return
        rest = doc_id, start, ids[start:].copy(), n
        kind, waits = self.capacity // (n - start), len(self.waiting)
        if len(self.rests) < RESTS and (start or waits > WAITING and kind == 1 or waits > 4 * WAITING):
            self.rests.append(rest)
        else:
            yield from self._place(rest)
        yield from self._fill()

    def _place(self, piece: Piece) -> Iterator[tuple]:
        """Into the open bin of the piece's class."""
        kind = self.capacity // len(piece[2])
        pieces = self.open.setdefault(kind, [])
        pieces.append(piece)
        if len(pieces) == kind:
            del self.open[kind]
            free = self.capacity - sum(len(x[2]) for x in pieces)
            if free <= self.slack:
                yield from self._close(pieces)
            else:
                self.waiting.append((pieces, free))

    def _fill(self) -> Iterator[tuple]:
        while self.waiting and self.rests:
            pieces, free = self.waiting.popleft()
            while free > self.slack and self.rests:
                doc_id, start, ids, n = self.rests.popleft()
                pieces.append((doc_id, start, ids[:free], n))
                if len(ids) > free:
                    self.rests.appendleft((doc_id, start + free, ids[free:], n))
                free -= len(pieces[-1][2])
            if free > self.slack:
                self.waiting.appendleft((pieces, free))
            else:
                yield from self._close(pieces)

    def finish(self) -> Iterator[tuple]:
        """What is open fills the bins that wait, then the last of these fill the
        first; so one sequence at most is left partly filled."""
        self.rests.extend(p for kind in sorted(self.open, reverse=True) for p in self.open[kind])
        self.open = {}
        while self.rests or self.waiting:
            if not self.waiting:
                self.waiting.append(([], self.capacity))
            elif not self.rests:
                if len(self.waiting) == 1:
                    yield from self._close(self.waiting.pop()[0])
                    return
                self.rests.extend(self.waiting.pop()[0])
            yield from self._fill()

    def _close(self, pieces: list[Piece]) -> Iterator[tuple]:
        filled, offset = sum(len(x[2]) for x in pieces), 0
        for doc_id, start, ids, n in pieces:
            yield doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), n, self.next_id, offset, filled
            offset += len(ids)
        self.next_id += 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece. A worker is a partition of ``docs``; its sequences
    are numbered from partition << 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, rows = encoder(tokenizer), []
        bins = HarmonicBins(TaskContext.get().partitionId() << 32, capacity)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=SCHEMA)

        for block, ids, counts in tool.encode_rows(batches, end_id):
            at = 0
            for doc_id, n in zip(block.column(0).to_pylist(), counts.tolist(), strict=True):
                rows += bins.add(doc_id, ids[at : at + n])
                at += n
            if len(rows) >= ROWS:
                yield table()
                rows = []
        rows += bins.finish()
        if rows:
            yield table()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, ", ".join(f"{x} long" for x in NAMES))
