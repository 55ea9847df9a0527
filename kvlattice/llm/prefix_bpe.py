"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text BPE's result ends in one certain token.
Those last tokens are all that has to be stored: the token before the last one
is the last token of the prefix without it, and so on to the start. A token t
that ends at i is the last token of prefix i exactly when BPE keeps the
boundary between t and the last token of the prefix in front of t.

BPE keeps a boundary between two tokens if, undoing their merges from the
latest to the earliest, the two parts that face each other could at no time
have been merged before the merge that was undone last.

So a text can grow (``append`` reads only the new bytes) and change in place
(``replace`` stops as soon as the last tokens are what they were before).

Pieces are the matches of the tokenizer's pattern.

Defined cases: null text is empty text and has no tokens; strings of special
tokens are ordinary text; repeated rows are encoded one by one; a very long text
is encoded whole, with memory in proportion to it; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import BYTE_LEVEL, Memo, blocks, cut_pieces, encode_block, find_pieces, gather, laid

#: Distinct pieces, and pairs of tokens, that a worker keeps, for each of two
#: generations: some 150 MB at most.
MEMO_PIECES, MEMO_PAIRS = 300_000, 600_000


class PrefixBPE:
    """A vocabulary of ranks, with the split of each token and its prefix tables."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[int, int] = {}
        self.ends: set[bytes] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.ends.update(token[i:] for i in range(len(token)))
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i], rank), ranks.get(token[i:], rank)
                if a < rank and b < rank and self._kept(a, b):
                    self.left[rank], self.right[rank], self.made[rank] = a, b, rank
                    self.merge[a * size + b] = rank
                    break
        self.pairs = Memo(lambda key: self._kept(*divmod(key, size)), MEMO_PAIRS)

    def _kept(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between the tokens a and b."""
        undone = self.size
        while True:
            if self.merge.get(a * self.size + b, self.size) < undone:
                return False
            ma, mb = self.made[a], self.made[b]
            if ma > mb:
                undone, a = ma, self.right[a]
            elif mb >= 0:  # of equal merges the left one comes first
                undone, b = mb + 1, self.left[b]
            else:
                return True

    def extend(self, piece: bytes, last: list[int], stop: int | None = None) -> None:
        """Appends to ``last`` the last tokens of the prefixes it doesn't have."""
        ranks, ends, pairs, size = self.ranks, self.ends, self.pairs, self.size
        for i in range(len(last) + 1, (len(piece) if stop is None else stop) + 1):
            fits, at = [], i - 1
            while at >= 0 and (part := piece[at:i]) in ends:
                if (token := ranks.get(part)) is not None:
                    fits.append((at, token))
                at -= 1
            for at, token in reversed(fits):
                if not at or pairs[last[at - 1] * size + token]:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")

    def path(self, last: list[int]) -> list[int]:
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.tokens[last[i - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece; a piece that is a token is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.path(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixEncoding:
    """A piece that grows and changes, with the last token of each prefix."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replaces piece[start:end]; returns how many prefixes were computed."""
        old, moved = self.last, start + len(new) - end
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last, same, i = old[:start], 0, start
        while i < len(self.piece):
            i += 1
            self.bpe.extend(self.piece, self.last, i)
            # behind the edit, as many equal states as a token can look back
            same = same + 1 if i - moved > end and self.last[-1] == old[i - moved - 1] else 0
            if same >= self.bpe.longest:
                self.last += old[i - moved :]
                break
        return i - start

    def tokens(self) -> list[int]:
        return self.bpe.path(self.last)


class TextCodec:
    """Encodes and decodes whole texts; the pieces of a block are encoded once."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bpe, self.find = PrefixBPE(ranks), None if pattern == BYTE_LEVEL else regex.compile(pattern).findall
        self.memo = Memo(lambda piece: np.array(self.bpe.encode(piece.encode()), "<u4").tobytes(), MEMO_PIECES)
        tokens, decimals = self.bpe.tokens, [b" %d" % k for k in range(self.bpe.size)]
        self.bytes = *laid(tokens), np.frombuffer(b"".join(tokens), np.uint8)
        self.decimals = *laid(decimals), np.frombuffer(b"".join(decimals), np.uint8)

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        return find_pieces(texts, self.find) if self.find else cut_pieces(texts, False)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each one has."""
        return encode_block(texts, self._cut, self.memo.__getitem__)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_texts([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(ids.astype(np.int64), *self.bytes).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimals with one space between."""
        return gather(ids.astype(np.int64), *self.decimals).tobytes()[1:]


_codecs: dict[tuple[str, str], TextCodec] = {}


def codec(path: str, pattern: str) -> TextCodec:
    """One for each worker process, whose tasks share its caches."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TextCodec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, one space between) and
    decoded_sha256 (of the bytes decoded from the ids), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for block in blocks(batches):
            ids, counts = tool.encode_texts([t or "" for t in block.column(1).to_pylist()])
            out, at = [], 0
            for n in counts.tolist():
                own, at = ids[at : at + n], at + n
                out.append((n, hashlib.sha256(tool.decimal(own)).hexdigest(), hashlib.sha256(tool.decode(own)).hexdigest()))
            n, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
