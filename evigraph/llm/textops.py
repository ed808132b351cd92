"""Vectorised text primitives shared by the operators (numpy on Arrow buffers).

Texts are handled as UTF-8 bytes: words are maximal runs of bytes other than
space and 0x09-0x0D, so multi-byte characters are always inside words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes from which a word is hashed by digest.
LONG_WORD = 256
#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK_BYTES = 2_000_000


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes separate words: space and 0x09-0x0D."""
    return (data - np.uint8(9) < 5) | (data == 32)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or ends[0] == ends[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def give_back() -> None:
    """Returns memory that is free again to the system, as Python workers live on and share the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text"):
    """Slices of a batch of about CHUNK_BYTES of text each, so memory stays bounded."""
    if not batch.num_rows:
        return
    _, ends = _bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + CHUNK_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


class Words:
    """Words of a column of texts: hashes, and the first word of each text.

    ``hash`` is uint64 per word, ``first`` has one entry more than texts (CSR).
    With ``lines=True`` a text's lines (cut at newlines) are the units instead;
    ``unit_text`` then names the text of each unit and ``unit_no`` its number.
    ``unit_start``/``unit_end`` are byte positions of units in ``data``.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, lines: bool = False):
        data, ends = _bytes(texts)
        self.data = data
        if lines:
            cut = np.flatnonzero(data == 10)
            inside = np.searchsorted(cut, ends[1:], "left") - np.searchsorted(cut, ends[:-1], "left")
            count = inside + 1
            self.unit_text = np.repeat(np.arange(len(texts)), count)
            begin = np.concatenate(([0], np.cumsum(count)))
            self.unit_no = np.arange(begin[-1]) - begin[:-1][self.unit_text]
            self.unit_start, self.unit_end = np.empty(begin[-1], np.int64), np.empty(begin[-1], np.int64)
            self.unit_start[begin[:-1]], self.unit_end[begin[1:] - 1] = ends[:-1], ends[1:]
            rest = np.ones(begin[-1], bool)
            rest[begin[:-1]] = False
            self.unit_start[rest] = cut + 1
            rest = np.ones(begin[-1], bool)
            rest[begin[1:] - 1] = False
            self.unit_end[rest] = cut
        else:
            self.unit_text, self.unit_no = np.arange(len(texts)), np.zeros(len(texts), np.int64)
            self.unit_start, self.unit_end = ends[:-1], ends[1:]
        if not len(data):
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, np.uint64), np.zeros(len(self.unit_start) + 1, np.int64)
            return
        word = ~is_space(data)
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edge = ends[1:-1]
        at = edge[edge < len(data)]
        opens[at] = word[at]
        at = edge[edge > 0] - 1
        closes[at] = word[at]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.append(np.searchsorted(self.start, self.unit_start), len(self.start))
        self.hash = self._hashes(lowered(data) if lower else data)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of each word's length and bytes, eight bytes at a time; long words by digest."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + np.uint64(1))
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))  # those from each place on
        todo, at, left = np.flatnonzero(size <= LONG_WORD), 0, size
        while len(todo):
            left = size[todo] - at
            value = eight[self.start[todo] + at] & _FIRST[np.minimum(left, 8)]
            h[todo] = mix(h[todo] * _R + value)
            todo, at = todo[left > 8], at + 8
        for k in np.flatnonzero(size > LONG_WORD):
            digest = hashlib.blake2b(data[self.start[k] : self.end[k]], digest_size=8).digest()
            h[k] = np.frombuffer(digest, np.uint64)[0]
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, unit) of every k-word shingle; a unit of fewer words gives its whole sequence."""
        h, counts = self.hash, self.counts()
        unit = np.repeat(np.arange(len(counts)), counts)
        if k == 1:
            return h, unit
        left = self.first[1:][unit] - np.arange(len(h))
        out, of = [], []
        long = np.flatnonzero(left >= k)
        value = np.full(len(long), np.uint64(k), np.uint64)
        for j in range(k):
            value = value * _R + h[long + j]
        out.append(mix(value))
        of.append(unit[long])
        for n in range(1, k):
            at = self.first[:-1][counts == n]
            value = np.full(len(at), np.uint64(n), np.uint64)
            for j in range(n):
                value = value * _R + h[at + j]
            out.append(mix(value))
            of.append(np.flatnonzero(counts == n))
        return np.concatenate(out), np.concatenate(of)


def distinct_sets(values: np.ndarray, unit: np.ndarray, n_units: int, common: tuple[np.ndarray, np.ndarray] | None = None):
    """Distinct values of each unit in the global order (rare first, then by value).

    Returns (values, first) in CSR form. ``common`` has values known to be
    frequent, sorted, and their ranks (1 to 127, higher: more frequent); they
    sort after all others, by rank. Any such table gives right results; a good
    one gives short posting lists.
    """
    late = np.zeros(len(values), np.uint64)
    if common is not None and len(common[0]) and len(values):
        at = np.minimum(np.searchsorted(common[0], values), len(common[0]) - 1)
        late = np.where(common[0][at] == values, common[1][at], 0).astype(np.uint64)
    bits = np.uint64(max(1, int(n_units).bit_length()))
    key = (unit.astype(np.uint64) << (np.uint64(64) - bits)) | (late << (np.uint64(57) - bits)) | (values >> (bits + np.uint64(7)))
    order = np.argsort(key)
    key, tied = key[order], values[order]
    if np.any((key[1:] == key[:-1]) & (tied[1:] != tied[:-1])):  # the shortened key ties: sort by all bits
        order = np.lexsort((values, late, unit))
    values, unit = values[order], unit[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (unit[1:] != unit[:-1])
    values, unit = values[keep], unit[keep]
    return values, np.searchsorted(unit, np.arange(n_units + 1))


def block_sizes(values: np.ndarray, first: np.ndarray, blocks: int) -> pa.Array:
    """How many values of each unit fall into each of ``blocks`` column blocks, as packed uint8 (255: that or more)."""
    n = len(first) - 1
    unit = np.repeat(np.arange(n), np.diff(first))
    sizes = np.bincount(unit * blocks + (values & np.uint64(blocks - 1)).astype(np.int64), minlength=n * blocks)
    packed = np.minimum(sizes, 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * blocks).astype(np.int32)), pa.py_buffer(packed.tobytes())])


def block_overlap(one: pa.Array, other: pa.Array) -> np.ndarray:
    """The most that two sets can share, block by block: the sum of the smaller sizes."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (one, other))
    return bound_of_blocks(x, y)


def bound_of_blocks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same of unpacked rows."""
    if not len(x):
        return np.zeros(0, np.int64)
    least = np.minimum(x, y)
    total = least.sum(1, dtype=np.int64)
    return np.where((least == 255).any(1), np.iinfo(np.int64).max, total)


def heads(values: np.ndarray, first: np.ndarray, length: np.ndarray):
    """The first ``length`` values of each unit, as an Arrow list column."""
    ends = np.concatenate(([0], np.cumsum(length)))
    at = np.repeat(first[:-1] - ends[:-1], length) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values[at].view(np.int64)))


def fingerprints(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each unit's set: equal sets have equal fingerprints."""
    with np.errstate(over="ignore"):
        out = []
        for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ salt), dtype=np.uint64)))
            out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]
