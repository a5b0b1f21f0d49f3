"""Vectorised 64-bit hashes of words and word shingles over the UTF-8 bytes of a batch of texts.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. A hash depends on the
bytes alone, so it is equal on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15 | 1)
_STEP = [_U(pow(0xD6E8FEB86659FD93, k, 2**64)) for k in range(SHINGLE)]

with np.errstate(over="ignore"):
    _INVERSE = _U(pow(int(_MULT), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = np.arange(256, dtype=np.uint64)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + _U(32), _BYTES)
with np.errstate(over="ignore"):
    _VALUE = mix((_LOWER + _U(1)) * _MULT)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Powers:
    """Powers of the base and of its inverse, grown as longer inputs come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            steps = np.full(n, _MULT, dtype=np.uint64)
            steps[0] = 1
            back = np.full(n, _INVERSE, dtype=np.uint64)
            back[0] = 1
            self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        return self.up, self.down


_POWERS = _Powers()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `limit` bytes each (a longer text stands alone): bounds the scratch memory."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, index of the first word of each text, with one more at the end).

    offsets are absolute into data; starts and ends are relative to offsets[0].
    """
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    n = len(part)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~_SPACE[part]
    edges = (offsets[1:-1] - base).astype(np.int64)
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    np.logical_not(solid[:-1], out=fresh[1:])
    fresh[edges[edges < n]] = True
    starts = np.flatnonzero(solid & fresh)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[edges[(edges > 0)] - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    up, down = _POWERS.get(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[part] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    firsts = np.searchsorted(starts, (offsets - base).astype(np.int64))
    return hashes, starts, ends, firsts


def shingles(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, index of the first shingle of each text, with one more at the end).

    A text of 1 to 4 words has one shingle, its whole sequence; an empty one has none.
    """
    counts = np.diff(firsts)
    number = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(number)))
    out = np.zeros(int(begin[-1]), dtype=np.uint64)
    n = len(hashes)
    with np.errstate(over="ignore"):
        if n >= SHINGLE:
            rolled = hashes[: n - SHINGLE + 1] * _STEP[0]
            for k in range(1, SHINGLE):
                rolled = rolled + hashes[k : n - SHINGLE + 1 + k] * _STEP[k]
            rolled = mix(rolled)
            owner = np.repeat(np.arange(len(counts)), counts)[: n - SHINGLE + 1]
            inside = np.arange(n - SHINGLE + 1) + SHINGLE <= firsts[owner + 1]
            full = rolled[inside]
        else:
            full = out[:0]
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(short):
            whole = np.ones(len(out), dtype=bool)
            whole[begin[short]] = False
            out[whole] = full
            for i in short:
                value = _U(counts[i])
                for h in hashes[firsts[i] : firsts[i + 1]]:
                    value = (value * _MULT + h) & _U(0xFFFFFFFFFFFFFFFF)
                out[begin[i]] = mix(np.array([value], dtype=np.uint64))[0]
        else:
            out = full
    return out, begin
