"""Many texts at once, for encoders whose pieces do not depend on each other.

The pieces of a block of texts are numbered by Arrow, each distinct one is
encoded once, and the ids of all texts are gathered by number. What is kept
between blocks is a small cache, so memory depends on the size of a block, and of
the longest text, and not on how many different pieces a corpus has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

#: Bytes of Arrow data in a block, and entries that are gathered at a time.
BLOCK_BYTES, STEP = 2 << 20, 1 << 18
# The patterns of the vocabularies' pre-tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Longer pieces (texts without spaces, say) are not kept.
LONG = 64


class Memo(dict):
    """``make(key)`` with a cache of two generations: when the young one holds
    ``limit`` keys it becomes the old one, and keys still in use come back. A key
    is a number or a string of LONG characters at most, so the bytes are bounded."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > LONG:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together to blocks of about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def gather(index: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for each i of ``index``, end to end."""
    parts = [flat[:0]]
    for at in range(0, len(index), STEP):
        i = index[at : at + STEP]
        n = lengths[i]
        ends = np.cumsum(n)
        parts.append(flat[np.arange(ends[-1]) + np.repeat(starts[i] - (ends - n), n)])
    return np.concatenate(parts)


def laid(units: list[bytes], width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, in items of ``width`` bytes, of units laid end to end."""
    lengths = np.fromiter(map(len, units), np.int64, len(units)) // width
    return np.cumsum(lengths) - lengths, lengths


@cache
def kinds() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])  # surrogates are no text
    text, out = points.astype("<u4").tobytes().decode("utf-32-le"), np.zeros(0x110000, np.uint8)
    for kind, name in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for m in regex.finditer(name, text):
            out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[0xD800:0xE000] = 0
    return out


def cut_pieces(texts: list[str], word_level: bool) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and their number in each: the matches of
    WORD_LEVEL or else of BYTE_LEVEL, found by the kinds of neighbouring characters."""
    if not texts:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    joined = "\0".join(texts) + "\0"
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    kind = kinds()[points]
    kind[stops] = 4
    begins = np.concatenate(([True], kind[1:] != kind[:-1], [True]))
    begins[stops] = begins[stops + 1] = True
    if word_level:
        begins[:-1] |= kind == 2
    else:  # the last white space of several begins a piece, and if it is a space the next one's
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & (kind[1:] != 4))
        begins[last] = True
        begins[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points[:-1] == 39) & begins[: len(points) - 1])
    if len(quote):
        one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[quote[short | long] + 1] = False
        begins[quote[short] + 2] = begins[quote[long] + 3] = True
    at = np.flatnonzero(begins)
    data = joined.encode("utf-8", "replace")
    if len(data) == len(points):
        offsets = at
    else:
        sizes = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        offsets = at + np.concatenate(([0], np.cumsum(sizes, dtype=np.int32)))[at]
    every = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    first = kind[at[:-1]]
    keep = first < (3 if word_level else 4)
    counts = np.diff(np.concatenate(([0], np.cumsum(keep)[first == 4])))
    return every.filter(pa.array(keep)), counts


def find_pieces(texts: list[str], find: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray]:
    """The same for any pattern."""
    found = [pa.array(find(t), pa.string()) for t in texts]
    return pa.concat_arrays([pa.array([], pa.string()), *found]), np.fromiter(map(len, found), np.int64, len(found))


def encode_block(texts: list[str], cut: Callable[[list[str]], tuple[pa.Array, np.ndarray]], encode: Callable[[str], bytes], end: int | None = None, apart: dict[int, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and the number of each text's ids, with
    ``end`` behind each text. ``encode`` gives a piece's little-endian ids; texts
    in ``apart`` have theirs already."""
    apart = apart or {}
    pieces, sizes = cut(["" if k in apart else t for k, t in enumerate(texts)] if apart else texts)
    numbered = pieces.dictionary_encode()
    index, borders = numbered.indices.to_numpy().astype(np.int64), np.cumsum(sizes)
    units = list(map(encode, numbered.dictionary.to_pylist()))
    more = [(int(borders[k]), len(units) + i) for i, k in enumerate(apart)]
    index = np.insert(index, [x for x, _ in more], [x for _, x in more])
    borders += np.searchsorted(np.array(sorted(apart), np.int64), np.arange(len(texts)), side="right")
    units += apart.values()
    if end is not None:
        index = np.insert(index, borders, len(units))
        borders += np.arange(1, len(borders) + 1)
        units.append(np.array([end], "<u4").tobytes())
    starts, lengths = laid(units, 4)
    upto = np.concatenate(([0], np.cumsum(lengths[index])))[np.concatenate(([0], borders))]
    return gather(index, starts, lengths, np.frombuffer(b"".join(units), "<u4")), np.diff(upto)
