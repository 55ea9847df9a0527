"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U64 = "18446744073709551615"


def varint_size(x: Column) -> Column:
    """Bytes of an unsigned variable-length integer: one for each 7 bits."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(x < F.lit(1 << (7 * n)), n).otherwise(out)
    return out


def be_bytes(x: Column, n: int) -> Column:
    """The n big-endian bytes of a non-negative integer."""
    return F.unhex(F.lpad(F.hex(x), 2 * n, "0"))


def u64_big_endian(b: Column) -> Column:
    """decimal(20,0) of eight big-endian bytes."""
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def with_version(key: Column, version: Column) -> Column:
    """Key bytes with the 8-byte suffix that sorts newer versions first."""
    inverted = F.lit(MAX_U64).cast("decimal(20,0)") - version.cast("decimal(20,0)")
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.conv(inverted.cast("string"), 10, 16), 16, "0")))


def user_key(encoded: Column) -> Column:
    """Without the version; shorter keys stay as they are."""
    n = F.length(encoded)
    return F.when(n >= 8, F.substring(encoded, F.lit(1), n - 8)).otherwise(encoded)


def version(encoded: Column) -> Column:
    """The version in an encoded key; 0 if it has no user key."""
    n = F.length(encoded)
    found = F.lit(MAX_U64).cast("decimal(20,0)") - u64_big_endian(F.substring(encoded, n - 7, F.lit(8)))
    return F.when(n <= 8, F.lit(0).cast("decimal(20,0)")).otherwise(found)


def common_prefix(a: Column, b: Column) -> Column:
    """Length in characters of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    far = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc))
    return F.when(n == 0, 0).otherwise(far)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def pointer_bytes(fid: Column, length: Column, offset: Column) -> Column:
    """Twelve bytes: file, length and offset, big-endian."""
    return F.concat(be_bytes(fid, 4), be_bytes(length, 4), be_bytes(offset, 4))


def file_iv(base: Column, offset: Column) -> Column:
    """A record's initialisation vector: the file's 12 bytes and its offset."""
    return F.concat(base, be_bytes(offset, 4))


def _byte(b: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(b, at, F.lit(1))), 16, 10).cast("int")


def _low_byte(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2, "0")


def _mixed(data: pa.Array, stream: pa.Array) -> pa.Array:
    """Each of ``data`` XOR the first bytes of its stream, null where one is null."""
    there = data.is_valid().to_numpy(zero_copy_only=False) & stream.is_valid().to_numpy(zero_copy_only=False)
    at, octets = [], []
    for x in (data.cast(pa.large_binary()), stream.cast(pa.large_binary())):
        at.append(np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1])
        octets.append(np.frombuffer(x.buffers()[2] or b"", np.uint8))
    n = np.where(there, at[0][1:] - at[0][:-1], 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(ends[-1])
    out = octets[0][place + np.repeat(at[0][:-1] - ends[:-1], n)] ^ octets[1][place + np.repeat(at[1][:-1] - ends[:-1], n)]
    mask = pa.py_buffer(np.packbits(there, bitorder="little"))
    return pa.Array.from_buffers(pa.large_binary(), len(data), [mask, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(data.type)


def aes_ctr(data: Column, key: Column, iv: Column) -> Column:
    """AES in CTR mode: data XOR the encrypted counter, which starts at the 16
    bytes of ``iv`` and counts in its last four. The same call decrypts. Counters
    are encrypted as one ECB text, whose blocks do not depend on each other; the
    bytes of a batch of rows are mixed at once."""
    blocks = F.greatest(F.ceil(F.octet_length(data) / 16), F.lit(1)).cast("int")
    first = F.conv(F.hex(F.substring(iv, 13, 4)), 16, 10).cast("long")
    count = lambda i: F.concat(F.hex(F.substring(iv, 1, 12)), F.lpad(F.hex((first + i) % (1 << 32)), 8, "0"))
    counters = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), blocks - 1), count), ""))
    stream = F.aes_encrypt(counters, key, F.lit("ECB"), F.lit("PKCS"))
    return F.arrow_udf(_mixed, "binary")(data, stream)


def uvarint(x: Column) -> Column:
    """The bytes of an unsigned variable-length integer (below 2^63)."""
    part = lambda i: F.shiftrightunsigned(x, 7 * i).bitwiseAND(F.lit(127)) if i else x.bitwiseAND(F.lit(127))
    n = varint_size(x)
    text = [F.when(F.lit(i) < n, _low_byte(F.when(F.lit(i + 1) < n, part(i) + 128).otherwise(part(i)))).otherwise("") for i in range(9)]
    return F.unhex(F.concat(*text))


def value_bytes(meta: Column, user_meta: Column, expires_at: Column, data: Column) -> Column:
    """An encoded value: two metas, the expiry, the data."""
    return F.concat(be_bytes(meta, 1), be_bytes(user_meta, 1), uvarint(expires_at), data.cast("binary"))


def header_bytes(meta: Column, user_meta: Column, key_len: Column, value_len: Column, expires_at: Column) -> Column:
    """A record's header: two metas, key and value lengths, the expiry."""
    return F.concat(be_bytes(meta, 1), be_bytes(user_meta, 1), uvarint(key_len.cast("long")), uvarint(value_len.cast("long")), uvarint(expires_at))


def record_bytes(key: Column, version: Column, value: Column, meta: Column, user_meta: Column, expires_at: Column) -> Column:
    """A log record: header, key with version, value, CRC-32 of all these."""
    full = with_version(key, version)
    body = F.concat(header_bytes(meta, user_meta, F.octet_length(full), F.octet_length(value), expires_at), full, value.cast("binary"))
    return F.concat(body, be_bytes(F.crc32(body), 4))


def entry_header_bytes(overlap: Column, diff: Column) -> Column:
    """A block entry's header: two little-endian shorts."""
    little = lambda x: F.concat(be_bytes(x % 256, 1), be_bytes(F.floor(x / 256), 1))
    return F.concat(little(overlap), little(diff))


def read_entry_header(b: Column) -> Column:
    """overlap and diff of a block entry's header."""
    short = lambda i: _byte(b, F.lit(i)) + 256 * _byte(b, F.lit(i + 1))
    return F.struct(short(1).alias("overlap"), short(3).alias("diff"))


#: Seed and multiplier of the filter's hash.
SEED, FACTOR = 0xBC9F1D34, 0xC6A4A793
WORD = 0xFFFFFFFF


def _times(x: Column) -> Column:
    """x * FACTOR modulo 2^32, in halves, so that 64 bits hold all products."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * FACTOR
    high = F.shiftrightunsigned(x, 16) * FACTOR % (1 << 16) * (1 << 16)
    return (low + high) % (1 << 32)


def bloom_hash(key: Column) -> Column:
    """The 32-bit hash that filters are made of, as a long."""
    b, n = key.cast("binary"), F.octet_length(key).cast("long")
    at = lambda i: _byte(b, i).cast("long")
    seed = _times(n).bitwiseXOR(F.lit(SEED))
    words = F.floor(n / 4).cast("int")

    def word(h: Column, i: Column) -> Column:
        x = sum((at(4 * i + k + 1) * (1 << 8 * k) for k in range(1, 4)), at(4 * i + 1))
        h = _times((h + x) % (1 << 32))
        return h.bitwiseXOR(F.shiftrightunsigned(h, 16))

    h = F.when(words == 0, seed).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0))), seed, word))
    rest = sum((F.when(n % 4 > k, at(words * 4 + k + 1) * (1 << 8 * k)).otherwise(F.lit(0).cast("long")) for k in range(3)), F.lit(0).cast("long"))
    last = _times((h + rest) % (1 << 32))
    return F.when(n % 4 == 0, h).otherwise(last.bitwiseXOR(F.shiftrightunsigned(last, 24)))


def with_time(key: Column, seconds: Column) -> Column:
    """Key bytes with the seconds of a clock behind them, as they are (a version
    is inverted instead)."""
    return F.concat(key.cast("binary"), be_bytes(seconds, 8))


def set_version(encoded: Column, version_: Column) -> Column:
    """The same key with another version in place of its own."""
    return with_version(user_key(encoded), version_)


def checksum(data: Column, kind: str) -> Column:
    """CRC-32, or XXH64 (with the seed 42, as Spark's), as a long. seahash is not there."""
    if kind not in ("crc32", "xxhash64"):
        raise ValueError(f"no checksum {kind}")
    return F.crc32(data) if kind == "crc32" else F.xxhash64(data)


def encrypt_record(key: Column, value: Column, secret: Column, iv: Column) -> Column:
    """Key and value as one hidden text, as a log file holds them."""
    return aes_ctr(F.concat(key.cast("binary"), value.cast("binary")), secret, iv)


def decrypt_record(hidden: Column, key_len: Column, secret: Column, iv: Column) -> Column:
    """user_key and value of a hidden record."""
    shown = aes_ctr(hidden, secret, iv)
    rest = F.octet_length(shown) - key_len
    return F.struct(F.substring(shown, F.lit(1), key_len).cast("string").alias("user_key"), F.substring(shown, key_len + 1, rest).cast("string").alias("value"))


def valid_key_length(key: Column) -> Column:
    return F.length(key).isin(16, 24, 32)


# Names of the codes in manifests and messages.
COMPRESSION = {0: "none", 1: "snappy", 2: "zstd", 3: "lz4"}
CHECKSUM = {0: "crc32", 1: "xxhash64", 2: "seahash"}
ENCRYPTION = {0: "none", 1: "aes"}
OPERATION = {0: "CREATE", 1: "DELETE"}
KIND = {0: "key", 1: "data_key", 2: "file"}


def code_name(code: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), code)


def bits_per_key(n: Column, fp: Column) -> Column:
    """Bits of a Bloom filter for each of n keys at a false-positive rate."""
    size = -n * F.log(fp) / F.pow(F.log(F.lit(2.0)), F.lit(2))
    return F.floor(size / n).cast("long")
