"""Vectorised word and n-gram hashing over Arrow string columns.

Words are maximal runs of bytes outside x20 and x09-x0D, which on UTF-8 equals the
pattern ``[^\\x20\\x09-\\x0D]+`` on characters. Every text is read whole: a slice ends
between two texts, and a text longer than ``SLICE_BYTES`` is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 18
#: Bytes whose words are hashed at once, few enough for arrays that stay in a core's cache.
HASHED = 1 << 16
#: Words above this length are hashed by xxhash, others as a sum over a table of places and bytes; a word's hash depends on the word alone.
LONG_WORD = 64

_U = np.uint64
_tables: dict[str, np.ndarray] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _places() -> np.ndarray:
    """A random 64-bit value for each place in a word and byte there: two different words of one length differ in a term of their sums at least."""
    if "places" not in _tables:
        _tables["places"] = mix(mix(np.arange(1, LONG_WORD * 256 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)))
    return _tables["places"]


@dataclass
class Words:
    """Words of rows [lo, hi): word k of the slice is data[start[k]:end[k]]; row r has words first[r]:first[r + 1]."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    valid: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row of each word, from 0."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, row bounds and validity of a string column; null rows have no bytes."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    valid = np.asarray(texts.is_valid().to_numpy(zero_copy_only=False), bool)
    if not valid.all():
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0], valid


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    long = end - start > LONG_WORD
    at, table = 0, _places()
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + HASHED, side="right")))
        a, b = start[at], end[stop - 1]
        if stop > at + 1 or not long[at]:
            s, e, n = start[at:stop] - a, end[at:stop] - a, int(b - a)
            # the place of each byte counts from the last start; those between words are in no sum
            place = np.arange(n, dtype=np.int32)
            place -= np.repeat(s.astype(np.int32), np.diff(np.append(s, n)))
            np.minimum(place, LONG_WORD - 1, out=place)
            place <<= 8
            place |= data[a:b]
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[place], out=sums[1:])
            out[at:stop] = mix(sums[e] - sums[s] + (e - s).astype(np.uint64))
        at = stop
    for k in np.flatnonzero(long):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    at, n = 0, len(bounds) - 1
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1))
        yield at, stop
        at = stop


def words(texts: pa.Array, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of each slice, A-Z lower-cased before hashing if ``lower``; data is as in the text."""
    raw, bounds, valid = buffers(texts)
    for lo, hi in slices(bounds, limit):
        own, edge = raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        inside = np.zeros(len(own) + 2, bool)
        np.greater((own - np.uint8(9)), 4, out=inside[1:-1])
        inside[1:-1] &= own != 32
        change = inside[1:] != inside[:-1]
        # a word also ends where its text ends
        cut = edge[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(own))])
        cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
        at = np.flatnonzero(change)
        if len(cut):
            twice = np.repeat(cut, 2)
            at = np.insert(at, np.searchsorted(at, twice), twice)
        start, end = at[0::2], at[1::2]
        h = _hash_words(own + (((own - np.uint8(65)) < 26).view(np.uint8) << 5) if lower else own, start, end)
        yield Words(lo, hi, own, edge, start, end, h, np.searchsorted(start, edge), valid[lo:hi])
    pa.default_memory_pool().release_unused()


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row, in order, and where each row's begin; a row of 1 to n - 1 words has one window of all of them."""
    count = np.diff(w.first)
    full = np.maximum(count - n + 1, 0)
    bound = np.zeros(len(count) + 1, np.int64)
    np.cumsum(np.where(count > 0, np.maximum(full, 1), 0), out=bound[1:])
    out = np.zeros(bound[-1], np.uint64)
    src = np.arange(bound[-1]) - np.repeat(bound[:-1] - w.first[:-1], np.diff(bound))
    long_enough = np.repeat(full > 0, np.diff(bound))
    at = src[long_enough]
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = mix(h * _U(0xD6E8FEB86659FD93) + w.hash[at + k]) if k in (n // 2, n - 1) else h * _U(0xD6E8FEB86659FD93) + w.hash[at + k]
    out[long_enough] = h
    for r in np.flatnonzero((full == 0) & (count > 0)):
        h = _U(count[r])
        with np.errstate(over="ignore"):
            for x in w.hash[w.first[r] : w.first[r + 1]]:
                h = mix(np.array([h * _U(0xD6E8FEB86659FD93) + x]))[0]
        out[bound[r]] = h
    return out, bound


def set_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit fingerprints of each set of distinct hashes h[first[k] : first[k + 1]], whatever their order."""
    out = []
    for seed in (_U(0xA5A5B1C3D7E9F123), _U(0x3C79AC492BA7B653)):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ seed), out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` parities of a set of hashes, as int64 words. Two sets differ in at least as many elements as parities."""
    counts = np.bincount((h % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view(np.int64)
