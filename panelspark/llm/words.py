"""Words of whole Arrow batches as arrays of 64-bit hashes, without a Python object for each word.

A word is a run of bytes other than ASCII white space (9 to 13 and 32); in UTF-8 no other character holds these bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=_U)
_LOWER = _LETTERS.copy()
_LOWER[65:91] = _LETTERS[97:123]
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are handled at once.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    if len(_powers.get(inverse, ())) < n:
        x = np.full(max(n, CHUNK + 1), _INVERSE if inverse else _BASE, _U)
        x[0] = 1
        _powers[inverse] = np.multiply.accumulate(x)
    return _powers[inverse][:n]


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of texts that begin at the offsets."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = word[begin]
    end = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[end] = word[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A polynomial hash of each word modulo 2^64 over random letters, mixed with its length."""
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((_LOWER if lower else _LETTERS)[data] * powers(len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(data) + 1, True)[starts] + (ends - starts).astype(_U) * _LETTERS[7])


class Chunk:
    """Some texts: rows first to last of the batch, their bytes, and the words' hashes, starts and ends; offsets gives
    each text's first word."""

    def __init__(self, first: int, last: int, data: np.ndarray, text_offsets: np.ndarray, lower: bool):
        self.first, self.last, self.data, self.text_offsets = first, last, data, text_offsets
        if len(data) <= 2 * CHUNK:
            self.starts, self.ends = bounds(data, text_offsets)
            self.hashes = hashes(data, self.starts, self.ends, lower)
        else:  # a single long text, cut at white space
            found, at = [], 0
            while at < len(data):
                end, space = min(at + CHUNK, len(data)), np.empty(0, np.int64)
                while end < len(data) and not len(space := np.flatnonzero(_SPACE[data[end - CHUNK // 2 : end]])):
                    end = min(end + CHUNK // 2, len(data))
                if len(space) and end < len(data):
                    end = end - CHUNK // 2 + int(space[-1]) + 1
                part = data[at:end]
                s, e = bounds(part, np.array([0, len(part)]))
                found.append((hashes(part, s, e, lower), s + at, e + at))
                at = end
            self.hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*found))
        self.offsets = np.searchsorted(self.starts, text_offsets)

    def __len__(self) -> int:
        return self.last - self.first


def chunks(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Iterator[Chunk]:
    """The texts of a batch, null as empty, in chunks of about CHUNK bytes or one longer text."""
    text = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower)
        first = last


def grams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text each, and the offsets of the texts' first ones."""
    counts = np.diff(offsets)
    if len(h) < n:
        return np.empty(0, _U), np.zeros(len(offsets), np.int64)
    out = np.zeros(len(h) - n + 1, _U)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _LETTERS[100 + k]
    of = np.repeat(np.arange(len(counts)), counts)
    inside = of[: len(out)] == of[n - 1 :]
    return mix(out[inside]), np.concatenate(([0], np.cumsum(np.maximum(counts - n + 1, 0))))
