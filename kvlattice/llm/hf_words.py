"""Whole texts to token ids by the tokenizers library's models, piece by piece.

The library's own encode() takes 5 to 10 microseconds a word, most of it for
offsets that are not needed here. So texts are normalised and cut by the
pre-tokenizer's pattern, and the library's model encodes the distinct pieces of
a block of texts (``units``). Strings of the file's added tokens get their ids
first, as in the library."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .units import Memo, blocks, cut_pieces, encode_block

#: Distinct pieces that are kept between blocks, for each of two generations.
#: With strings of 64 characters at most these are some 40 MB of a worker.
MEMO_PIECES = 100_000
#: Code points whose case and composition no version of Unicode changes.
SETTLED = ((0, 0x530), (0x2000, 0x2070), (0x3040, 0xA000), (0xAC00, 0xD7A4))


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 stands for itself, the others follow from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.letters = dict(enumerate(byte_letters()))
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError(f"{path}: added tokens must be plain strings")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        # the longest of those that start at a place, as in the library
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.memo = Memo(self._piece, MEMO_PIECES)

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(letters)]).tobytes()

    def _normal(self, text: str) -> str:
        """As the file's normalizer, but for white space, which is dropped."""
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        settled = np.logical_or.reduce([(points >= a) & (points < b) for a, b in SETTLED])
        if settled.all() and "Σ" not in text and is_normalized("NFC", text):  # Python looks at what stands around a sigma
            return text.lower()
        return self.normalizer.normalize_str(text)

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        return cut_pieces([self._normal(t) for t in texts] if self.normalizer else texts, bool(self.normalizer))

    def _apart(self, text: str) -> bytes:
        return b"".join(self.added[x] if i % 2 else self.encode(x) for i, x in enumerate(self.at_added(text)))  # every other one is an added token

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0].tobytes()

    def encode_texts(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each one has, with ``end``
        behind each."""
        apart = {k: self._apart(t) for k, t in enumerate(texts) if any(x in t for x in self.added)}
        return encode_block(texts, self._cut, self.memo.__getitem__, end, apart)

    def encode_rows(self, batches: Iterator[pa.RecordBatch], end: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Blocks of rows (id, text) with the ids and counts of their texts. The
        cache goes when the rows end, so idle workers hold the vocabulary only."""
        try:
            for block in blocks(batches):
                yield block, *self.encode_texts([t or "" for t in block.column(1).to_pylist()], end)
        finally:
            self.memo.forget()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
