"""Words of texts: maximal runs of letters and digits after NFKC, without format characters, in lower case."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_RUN = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _format_characters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c)) == "Cf" for c in range(0x110000)), bool, 0x110000)


def _folded(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    formats = _format_characters()[codes]
    return (codes[~formats].tobytes().decode("utf-32-le") if formats.any() else text).lower()


def words(text: str | None) -> list:
    """Words of a text; those of a plain ASCII text come as bytes, those of any other as str. Null has none."""
    if not text:
        return []
    if text.isascii():
        return text.encode("ascii").translate(_LOWER).split()
    return _RUN.findall(_folded(text))


def word_strings(text: str | None) -> list[str]:
    return [w.decode() if isinstance(w, bytes) else w for w in words(text)]


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _ascii_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Where words begin and end in the joined texts, their letters end to end, and their lengths in bytes."""
    data = b" " + "\n".join(texts).encode("ascii").translate(_LOWER) + b" "
    word = np.frombuffer(data, np.uint8) != 32
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    return edges[::2], edges[1::2], data.translate(None, b" "), edges[1::2] - edges[::2]


def _other_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    codes = np.frombuffer(f" {chr(10).join(texts)} ".encode("utf-32-le"), np.uint32)
    word = _word_characters()[codes]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    wide = (1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)) * word
    upto = np.concatenate(([0], np.cumsum(wide)))
    return edges[::2], edges[1::2], codes[word].tobytes().decode("utf-32-le").encode(), upto[edges[1::2]] - upto[edges[::2]]


class Vocabulary:
    """Words to numbers from 1; 0 is any other word."""

    AT_ONCE = 1 << 22  # characters

    def __init__(self, texts: list[list[str]]):
        self.ids: dict[str, int] = {}
        for text in texts:
            for w in text:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.size = len(self.ids)
        self._values = pa.array([w.encode() for w in self.ids], pa.binary())

    def encode(self, text: str | None) -> list[int]:
        return [self.ids.get(w, 0) for w in word_strings(text)]

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, how many words each row has, their numbers)`` of consecutive rows with about AT_ONCE characters; the
        same as :meth:`encode` row by row, in columns."""
        rows, chars, first = [], 0, 0
        for i, text in enumerate(texts.to_pylist()):
            rows.append(text or "")
            chars += len(rows[-1])
            if chars >= self.AT_ONCE or i + 1 == len(texts):
                yield first, *self._numbers(rows)
                rows, chars, first = [], 0, i + 1

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((t.isascii() for t in texts), bool, len(texts))
        counts, found = np.zeros(len(texts), np.int64), {}
        for ascii_ in (True, False):
            at = np.flatnonzero(plain == ascii_)
            if not len(at):
                continue
            mine = [texts[i] for i in at]
            if not ascii_:
                mine = list(map(_folded, mine))
            begin, _, letters, sizes = (_ascii_words if ascii_ else _other_words)(mine)
            ends = np.cumsum([len(t) + 1 for t in mine]) + 1
            counts[at] = np.diff(np.concatenate(([0], np.searchsorted(begin, ends))))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            words_ = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
            found[ascii_] = pc.fill_null(pc.index_in(words_, value_set=self._values), -1).to_numpy() + 1
        if len(found) < 2:
            return counts, next(iter(found.values()), np.empty(0, np.int32))
        numbers = np.empty(counts.sum(), np.int32)
        of_plain = np.repeat(plain, counts)
        numbers[of_plain], numbers[~of_plain] = found[True], found[False]
        return counts, numbers
