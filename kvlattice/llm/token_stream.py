"""Token ids in Arrow's file format, for random access without copies.

All ids, in ascending document order, are one long sequence, cut into files by
ranges of doc_id. A file holds record batches of two fixed-size-list columns:
``tokens`` (``length`` ids) and ``mask`` (which of them are real: only the last
sequence of a file is padded). A memory-mapped file gives any sequence as a
view of the mapping. A second file lists doc_id and n_tokens of its documents.

Files are written under fresh names in the shared folder, so a task that runs
again, or twice, never touches the files of another attempt; the manifest names
the attempt that won.

Defined cases: null text is empty text, and a document always has its end id;
null doc_ids come first; repeated rows are documents of their own; rows with
one doc_id are in the order of their texts; a very long text spans sequences and
record batches; further columns, whatever their names, are ignored; an empty
table writes no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .hf_words import encoder

LENGTH, SEQUENCES, END_ID = 2048, 256, 0


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Appends ids to one file of fixed-length sequences. Each record batch but
    the last has SEQUENCES of them, so a sequence is found by its number."""

    def __init__(self, folder: str, length: int = LENGTH, dtype: str = "<u4"):
        self.length, self.dtype, self.path = length, np.dtype(dtype), f"{folder}/{uuid.uuid4().hex}"
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        store, path = _open(self.path)
        kind = pa.from_numpy_dtype(self.dtype)
        self.tokens, self.mask = pa.list_(kind, length), pa.list_(pa.bool_(), length)
        self.sink = store.open_output_stream(path + ".ids.arrow")
        self.file = pa.ipc.new_file(self.sink, pa.schema([("tokens", self.tokens), ("mask", self.mask)]))
        self.docs_sink = store.open_output_stream(path + ".docs.arrow")
        self.docs = pa.ipc.new_file(self.docs_sink, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.length * SEQUENCES:
            self._flush(self.n_waiting // (self.length * SEQUENCES) * SEQUENCES)

    def add_documents(self, doc_ids: pa.Array, n_tokens: np.ndarray) -> None:
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(n_tokens, pa.int64())], ["doc_id", "n_tokens"]))

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        for at in range(0, n, SEQUENCES):
            part = ids[at * self.length : min(at + SEQUENCES, n) * self.length]
            self._write(part, np.ones(len(part), bool))
        self.waiting, self.n_waiting = [ids[n * self.length :]], self.n_waiting - n * self.length

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        cells = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.record_batch(cells, ["tokens", "mask"]))

    def close(self) -> None:
        if self.n_waiting:  # less than a batch, with the one padded sequence
            rest = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._write(padded, np.arange(len(padded)) < len(rest))
        for x in (self.file, self.sink, self.docs, self.docs_sink):
            x.close()


class SequenceReader:
    """Random access to the sequences of one file; local files are mapped."""

    def __init__(self, path: str):
        store, at = _open(path)
        if isinstance(store, fs.LocalFileSystem):
            self.source = pa.memory_map(at + ".ids.arrow")
            self.docs = pa.ipc.open_file(pa.memory_map(at + ".docs.arrow"))
        else:
            self.source = store.open_input_file(at + ".ids.arrow")
            self.docs = pa.ipc.open_file(store.open_input_file(at + ".docs.arrow"))
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("tokens").type.list_size

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * SEQUENCES + self.file.get_batch(n - 1).num_rows if n else 0

    def batch(self, k: int) -> tuple[np.ndarray, int]:
        """The ids of record batch k, as a view, and how many of them are real."""
        found = self.file.get_batch(k)
        mask = found.column(1).values
        return found.column(0).values.to_numpy(), mask.true_count

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence k, as a view, and its mask."""
        found = self.file.get_batch(k // SEQUENCES)
        at = slice(k % SEQUENCES * self.length, (k % SEQUENCES + 1) * self.length)
        return found.column(0).values.to_numpy()[at], found.column(1).values.slice(at.start, self.length).to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[list, list[int]]]:
        for k in range(self.docs.num_record_batches):
            found = self.docs.get_batch(k)
            yield found.column(0).to_pylist(), found.column(1).to_pylist()

    def ids(self) -> Iterator[np.ndarray]:
        for k in range(self.file.num_record_batches):
            ids, n = self.batch(k)
            yield ids[:n]


@dataclass(frozen=True)
class TokenStream:
    """Files in the order of their documents: path, first id's place, ids, documents."""

    files: list[tuple[str, int, int, int]]


def write_stream(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> TokenStream:
    """Encodes and writes all documents; the driver gets a row for each file."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        dtype = "<u2" if max(tool.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"
        out, n_docs = None, 0
        for block, ids, counts in tool.encode_rows(batches, end_id):
            out = out or SequenceWriter(folder, length, dtype)
            out.add(ids)
            out.add_documents(block.column(0), counts)
            n_docs += len(counts)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": out.path, "n_ids": out.n_ids, "n_docs": n_docs}])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # by the text's start too, so rows that share a doc_id can be dealt out
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    files, start = [], 0
    for x in sorted(rows.mapInArrow(run, "part long, path string, n_ids long, n_docs long").collect()):
        files.append((x.path, start, x.n_ids, x.n_docs))
        start += x.n_ids
    return TokenStream(files)


def read_documents(stream: TokenStream, spark) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SequenceReader(path)
                parts, part = reader.ids(), np.zeros(0, "<u4")
                for doc_ids, counts in reader.documents():
                    starts, sums = [], []
                    for n in counts:
                        left, total = n, 0
                        while left:
                            if not len(part):
                                part = next(parts).astype("<u4")
                            total = zlib.crc32(part[:left], total)
                            part, left = part[left:], left - min(left, len(part))
                        starts.append(start)
                        sums.append(total)
                        start += n
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not stream.files:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([x[:2] for x in stream.files], "path string, start long")
    return files.repartition(len(stream.files)).mapInArrow(run, schema)
