"""Vectorised text kernels over Arrow string buffers: words, their hashes and n-grams, without a Python loop a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Lower-cased word byte, 0 for a byte that separates words. Bytes of non-ASCII characters belong to words.
WORD = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        WORD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
#: As WORD, but digits separate as well.
LETTERS = WORD.copy()
LETTERS[ord("0") : ord("9") + 1] = 0

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection), so that all bits depend on all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 16)
        _powers["up"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _BASE, np.uint64))])
        _powers["down"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _INVERSE, np.uint64))])
    return _powers["up"][:n], _powers["down"][:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each range: a polynomial modulo 2**64 that doesn't depend on where the range lies."""
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Texts:
    """Some rows of an Arrow batch: rows lo..hi, their bytes, and where each row's bytes begin (one more entry ends the last)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 21, max_rows: int = 1 << 16) -> Iterator[Texts]:
    """The rows of a string column in runs of about max_bytes and at most max_rows; a longer text forms its own run, whole."""
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(array):
            continue
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        _, where, data = array.buffers()
        offsets = np.frombuffer(where, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        null = np.asarray(array.is_null())
        lo = 0
        while lo < len(array):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
            hi = min(hi, len(array), lo + max_rows)
            part = offsets[lo : hi + 1]
            yield Texts(lo, hi, data[part[0] : part[-1]], part - part[0], null[lo:hi])
            lo = hi


@dataclass
class Words:
    """The words of some texts: byte ranges, 64-bit hashes, and for each text the range of its words."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words bounds[i]:bounds[i + 1] belong to text i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(t: Texts, letters: np.ndarray = WORD) -> Words:
    low = letters[t.data]
    n = len(low)
    inside = np.zeros(n + 1, bool)
    inside[:n] = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = t.offsets[1:-1]
    begins[edges] = inside[edges]  # a word doesn't go on in the next text
    ends_at = np.zeros(n + 1, bool)
    ends_at[1:] = inside[:-1] & (~inside[1:] | begins[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends_at)
    hashes = range_hash(_BYTE[low], starts, ends)
    return Words(low, starts, ends, hashes, np.searchsorted(starts, t.offsets))


def sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]] along the first axis; 0 for an empty range."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, bounds[:-1][some], axis=0)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
