"""Byte-exact codecs as plain functions, and filters of tables.

Variable-length integers have seven bits a byte, the lowest first; other
integers are big-endian, but for the lengths in a block's entry header."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codecs_sql import FACTOR, SEED


def put_uvarint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The integer at a place, and its size; size 0 if it does not end, or
    less than 0 if it is over 64 bits."""
    x = 0
    for n, b in enumerate(data[at : at + 10]):
        x |= (b & 127) << (7 * n)
        if b < 128:
            return (x, n + 1) if x < 1 << 64 else (0, -(n + 1))
    return (0, -10) if len(data) - at >= 10 else (0, 0)


def encode_value(meta: int, user_meta: int, expires_at: int, data: bytes) -> bytes:
    return bytes([meta, user_meta]) + put_uvarint(expires_at) + data


def decode_value(encoded: bytes) -> tuple[int, int, int, bytes]:
    expires_at, n = uvarint(encoded, 2)
    return encoded[0], encoded[1], expires_at, encoded[2 + n :]


def encode_header(meta: int, user_meta: int, key_len: int, value_len: int, expires_at: int) -> bytes:
    return bytes([meta, user_meta]) + put_uvarint(key_len) + put_uvarint(value_len) + put_uvarint(expires_at)


def decode_header(data: bytes, at: int = 0) -> tuple[tuple[int, int, int, int, int], int]:
    place, found = at + 2, []
    for _ in range(3):
        x, n = uvarint(data, place)
        if n <= 0:
            raise EOFError("header")
        found.append(x)
        place += n
    return (data[at], data[at + 1], *found), place - at


def encode_pointer(fid: int, length: int, offset: int) -> bytes:
    return struct.pack(">III", fid, length, offset)


def decode_pointer(data: bytes) -> tuple[int, int, int]:
    return struct.unpack(">III", data[:12])


def encode_entry_header(overlap: int, diff: int) -> bytes:
    return struct.pack("<HH", overlap, diff)


def decode_entry_header(data: bytes) -> tuple[int, int]:
    return struct.unpack("<HH", data[:4])


def encode_key(key: bytes, version: int) -> bytes:
    return key + struct.pack(">Q", (1 << 64) - 1 - version)


def decode_key(encoded: bytes) -> tuple[bytes, int]:
    if len(encoded) <= 8:
        return encoded if len(encoded) < 8 else b"", 0
    return encoded[:-8], (1 << 64) - 1 - struct.unpack(">Q", encoded[-8:])[0]


def encode_record(key: bytes, version: int, value: bytes, meta: int = 0, user_meta: int = 0, expires_at: int = 0) -> bytes:
    """A log record: header, key with version, value, checksum."""
    k = encode_key(key, version)
    body = encode_header(meta, user_meta, len(k), len(value), expires_at) + k + value
    return body + struct.pack(">I", zlib.crc32(body))


def decode_record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record at a place, and its size; None at the end, or where it is cut
    off or its checksum is wrong."""
    try:
        (meta, user_meta, k, v, expires_at), n = decode_header(data, at)
    except (EOFError, IndexError):
        return None
    end = at + n + k + v
    if end + 4 > len(data) or struct.unpack(">I", data[end : end + 4])[0] != zlib.crc32(data[at:end]):
        return None
    key, version = decode_key(data[at + n : at + n + k])
    row = {"user_key": key, "version": version, "value": data[at + n + k : end], "meta": meta, "user_meta": user_meta, "expires_at": expires_at, "offset": at, "len": end + 4 - at}
    return row, end + 4 - at



def bloom_hash(key: bytes) -> int:
    word, h = 0xFFFFFFFF, SEED ^ (FACTOR * len(key)) & 0xFFFFFFFF
    whole = len(key) // 4 * 4
    for (x,) in struct.iter_unpack("<I", key[:whole]):
        h = (h + x) * FACTOR & word
        h ^= h >> 16
    if rest := key[whole:]:
        h = (h + int.from_bytes(rest, "little")) * FACTOR & word
        h ^= h >> 24
    return h


def bloom_hashes(keys: list[bytes]) -> np.ndarray:
    """The same of many keys, those of one length at a time."""
    out, lengths = np.zeros(len(keys), np.uint64), np.fromiter(map(len, keys), np.int64, len(keys))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        octets = np.frombuffer(b"".join([keys[i] for i in at]), np.uint8).reshape(len(at), n) if n else np.zeros((len(at), 0), np.uint8)
        h = np.full(len(at), SEED ^ (FACTOR * n) & 0xFFFFFFFF, np.uint32)
        for j in range(0, n, 4):
            word = sum(octets[:, j + k].astype(np.uint32) << np.uint32(8 * k) for k in range(min(4, n - j)))
            h = (h + word) * np.uint32(FACTOR)
            h ^= h >> np.uint32(16 if n - j >= 4 else 24)
        out[at] = h
    return out


def _probes(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    h = hashes.astype(np.uint32)[:, None]
    step = (h >> np.uint32(17)) | (h << np.uint32(15))
    return (h + step * np.arange(k, dtype=np.uint32)) % np.uint32(bits)


def bloom_filter(hashes: np.ndarray, bits_per_key: int) -> bytes:
    k = min(30, max(1, int(0.69 * bits_per_key)))
    size = (max(64, len(hashes) * bits_per_key) + 7) // 8
    flags = np.zeros(size * 8, np.uint8)
    flags[_probes(hashes, k, size * 8).ravel()] = 1
    return np.packbits(flags, bitorder="little").tobytes() + bytes([k])


def may_contain(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    if len(bloom) < 2:
        return np.zeros(len(hashes), bool)
    if bloom[-1] > 30:
        return np.ones(len(hashes), bool)
    flags = np.unpackbits(np.frombuffer(bloom[:-1], np.uint8), bitorder="little")
    return flags[_probes(hashes, bloom[-1], len(flags))].all(axis=1)


def passed(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter may hold; a probe is made for those only
    that the ones before have left."""
    at = np.arange(len(hashes) if len(bloom) >= 2 else 0)
    if not len(at) or bloom[-1] > 30:
        return at
    flags = np.unpackbits(np.frombuffer(bloom[:-1], np.uint8), bitorder="little").view(bool)
    h, bits = hashes.astype(np.uint32), np.uint32(len(flags))
    step = (h >> np.uint32(17)) | (h << np.uint32(15))
    for _ in range(bloom[-1]):
        left = np.flatnonzero(flags[h % bits])
        at, step = at[left], step[left]
        h = h[left] + step
    return at


def table_filters(log, bits_per_key: int = 10):
    """table_id, bloom: a filter over each table's distinct keys. A table, which is
    bounded in size, sends its keys to one task."""
    keys = log.select("table_id", F.col("user_key").cast("binary").alias("k")).distinct()

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"table_id": rows["table_id"].iloc[:1], "bloom": [bloom_filter(bloom_hashes(rows["k"].tolist()), bits_per_key)]})

    return keys.groupBy("table_id").applyInPandas(build, "table_id long, bloom binary")


def probe_filters(filters, pairs):
    """Adds to pairs (table_id, user_key, ...) whether their table may hold the
    key; without a filter it may. Sorted by table, the filter first, so a task
    holds one filter at a time, whatever the number of probes."""
    rest = [c for c in pairs.columns if c != "table_id"]
    asked = pairs.select("table_id", F.lit(1).alias("_kind"), F.col("user_key").cast("binary").alias("_data"), F.struct(*rest).alias("_row"))
    held = filters.select("table_id", F.lit(0).alias("_kind"), F.col("bloom").alias("_data"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in asked.schema.fields] + [T.StructField("may", T.BooleanType())])

    def run(batches):
        now, bloom = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tables, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            may = np.ones(batch.num_rows, bool)
            edges = np.flatnonzero(np.concatenate(([True], (tables[1:] != tables[:-1]) | (kinds[1:] != kinds[:-1]), [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if tables[a] != now:
                    now, bloom = tables[a], None
                if kinds[a] == 0:
                    bloom = batch.column(2)[int(a)].as_py()
                elif bloom is not None:
                    may[a:b] = may_contain(bloom, bloom_hashes(batch.column(2).slice(a, b - a).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], [*batch.schema.names, "may"])

    both = held.unionByName(asked).repartition("table_id").sortWithinPartitions("table_id", "_kind")
    return both.mapInArrow(run, schema).filter("_kind = 1").select("table_id", "_row.*", "may")
