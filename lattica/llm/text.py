"""Vectorised word handling on Arrow string columns, used inside Spark tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is
``[^\\x20\\x09-\\x0D]+`` on UTF-8 text.  Nothing here loops over words in Python:
a batch is cut into chunks of a few megabytes and handled with NumPy.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks that keep the first n bytes of a little-endian 64-bit lane.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijective finaliser (splitmix64), element by element."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes.

    A longer text makes a chunk by itself; every row is in exactly one chunk.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


#: Bytes of a text that are worked on at once where words can be handled piece by piece.
SEGMENT_BYTES = 8 << 20


def segments(data: np.ndarray, limit: int | None = None) -> Iterator[np.ndarray]:
    """A text in pieces of about ``limit`` bytes, cut behind white space only; words of any length stay whole."""
    limit, at = limit or SEGMENT_BYTES, 0
    while len(data) - at > limit:
        end = at + limit
        while end < len(data):
            hit = np.flatnonzero(_SPACE[data[end : end + 4096]])
            if len(hit):
                end += int(hit[0]) + 1
                break
            end += 4096
        end = min(end, len(data))
        yield data[at:end]
        at = end
    if at < len(data) or not len(data):
        yield data[at:]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and leave every other byte."""
    return _LOWER[data]


class Words:
    """Words of a chunk: byte ranges ``start``/``end`` and, per text, ``first`` (n + 1 word indexes).

    ``inside`` marks the bytes that words are made of; by default all but white space.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data] if inside is None else inside
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges], after[edges - 1] = False, False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Row of each word within the chunk."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.per_text)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_ranges(self.data, self.start, self.end, seed)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, inverse): a word index for each distinct word, and each word's place among them.

        Words are told apart by 128 bits of hash.
        """
        a, b = self.hashes(1), self.hashes(2)
        _, first, inverse = np.unique(a, return_index=True, return_inverse=True)
        if (b[first][inverse] != b).any():
            both = np.stack([a, b], axis=1)
            _, first, inverse = np.unique(both, axis=0, return_index=True, return_inverse=True)
        return first, inverse.ravel()

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kept words of each text joined by one space: bytes, text offsets, word starts, word ends."""
        keep = np.ones(len(self), bool) if keep is None else keep
        start, end, text = self.start[keep], self.end[keep], self.text_of()[keep]
        step = np.zeros(len(self.data) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        mask = np.zeros(len(self.data) + 1, bool)
        mask[:-1] = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        gap = end[:-1][text[1:] == text[:-1]]  # a word that another kept word of its text follows
        mask[gap] = True
        data = self.data.copy()
        data[gap] = 0x20
        place = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=place[1:])
        return data[mask[:-1]], place[self.offsets], place[start], place[end]


def lanes_of(data: np.ndarray) -> np.ndarray:
    """Every unaligned little-endian 64-bit word of ``data``, padded with zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes and seed give equal hashes everywhere."""
    lanes, length = lanes_of(data), end - start
    h = mix(length.astype(_U) + _U((seed * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % 2**64))
    at, left, rows = start, length, None
    while len(at):
        part = mix((lanes[at] & _KEEP[np.minimum(left, 8)]) ^ (h if rows is None else h[rows]))
        if rows is None:
            h, rows = part, np.flatnonzero(left > 8)
            at, left = at[rows] + 8, left[rows] - 8
        else:
            h[rows] = part
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return h


_P = [_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def xxh64_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range, as its public specification defines it."""
    with np.errstate(over="ignore"):
        lanes, length, at, seed = lanes_of(data), end - start, start.copy(), _U(seed)
        h = np.full(len(start), seed + _P[4], _U)
        rows = np.flatnonzero(length >= 32)
        if len(rows):
            v = [np.full(len(rows), seed + x, _U) for x in (_P[0] + _P[1], _P[1], _U(0), _U(0) - _P[0])]
            live, left = np.arange(len(rows)), length[rows]
            while len(live):
                for k in range(4):
                    v[k][live] = _rotate(v[k][live] + lanes[at[rows[live]] + 8 * k] * _P[1], 31) * _P[0]
                at[rows[live]] += 32
                left[live] -= 32
                live = live[left[live] >= 32]
            x = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
            for k in range(4):
                x = (x ^ (_rotate(v[k] * _P[1], 31) * _P[0])) * _P[0] + _P[3]
            h[rows] = x
        h += length.astype(_U)
        left = end - at
        for _ in range(3):
            rows = np.flatnonzero(left >= 8)
            if not len(rows):
                break
            h[rows] = _rotate(h[rows] ^ (_rotate(lanes[at[rows]] * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3]
            at[rows] += 8
            left[rows] -= 8
        rows = np.flatnonzero(left >= 4)
        h[rows] = _rotate(h[rows] ^ ((lanes[at[rows]] & _KEEP[4]) * _P[0]), 23) * _P[1] + _P[2]
        at[rows] += 4
        left[rows] -= 4
        for _ in range(3):
            rows = np.flatnonzero(left > 0)
            h[rows] = _rotate(h[rows] ^ ((lanes[at[rows]] & _KEEP[1]) * _P[4]), 11) * _P[0]
            at[rows] += 1
            left[rows] -= 1
        h ^= h >> _U(33)
        h *= _P[1]
        h ^= h >> _U(29)
        h *= _P[2]
        h ^= h >> _U(32)
        return h
