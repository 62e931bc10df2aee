"""Vectorised words and hashes over the bytes of a batch of texts.

A batch is handled in slices of about two million bytes (one text at least), so that the arrays made from a
slice stay small however long a batch is. Words are ``[^\\x20\\x09-\\x0D]+``; none crosses a text's end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts and ends (n + 1 offsets). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes, or of one text."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, BASE_INVERSE if inverse else BASE, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[key] = have
    return have[:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """n + 1 sums; ``range_hash`` turns two of them into the hash of the bytes between."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * powers(len(raw)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of the bytes [start, end), the same wherever they stand; lengths count."""
    inverse = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * BYTE_CODE[0])


class Words:
    """The words of the texts of a slice: byte ranges, the first word of each text, hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        """``offsets`` count from the first byte of ``raw``."""
        self.raw = LOWER[raw] if lower else raw
        self.offsets = offsets
        solid = ~SPACE[self.raw]
        edges = np.zeros(len(raw) + 1, bool)
        edges[1:-1] = solid[1:] != solid[:-1]
        edges[offsets] = True
        cuts = np.flatnonzero(edges)
        first, last = cuts[:-1], cuts[1:]
        keep = solid[first] if len(first) else np.zeros(0, bool)
        self.start, self.end = first[keep], last[keep]
        self.of_text = np.searchsorted(self.start, offsets)  # n + 1 places in the word list
        self.counts = np.diff(self.of_text)
        self._prefix = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = prefix_hash(self.raw)
        return self._prefix

    def hashes(self) -> np.ndarray:
        return range_hash(self.prefix, self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def word_slices(column, lower: bool = False, limit: int = SLICE_BYTES):
    """(first row, row behind the last, Words) for each slice of a batch's text column."""
    raw, offsets = text_bytes(column)
    for a, b in slices(offsets, limit):
        yield a, b, Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def segment_sum(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums between n + 1 cuts."""
    if values.dtype == bool or np.issubdtype(values.dtype, np.integer):
        total = np.zeros(len(values) + 1, np.int64)
    else:
        total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]
