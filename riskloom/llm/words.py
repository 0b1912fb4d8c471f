"""Vectorised words over Arrow string buffers.

A batch of texts is one byte buffer with offsets. Words are found with a 256-entry class table and hashed
eight bytes at a time, all in numpy, so no Python object is made for a word (but for words over
``LONG_WORD`` bytes, which go to XXH64 whole). Words of at most eight bytes never share a hash with another
of their length. Memory is a small multiple of one block (``BLOCK_BYTES``, or the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
LONG_WORD = 512

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but ASCII white space (tab to carriage return, and space).
SPACED = np.ones(256, dtype=np.bool_)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: 0-9, a-z and every byte over 0x7F: after lower-casing this is [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.zeros(256, dtype=np.bool_)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Letters: a-z (after lower-casing) and every byte over 0x7F.
LETTERS = np.zeros(256, dtype=np.bool_)
LETTERS[97:123] = LETTERS[128:] = True

#: Two classes of words: 1 is letters of either case, digits and every byte over 0x7F; 2 is all else but white space.
LETTERS_OR_MARKS = np.where(SPACED, 2, 0).astype(np.int8)
LETTERS_OR_MARKS[48:58] = LETTERS_OR_MARKS[65:91] = LETTERS_OR_MARKS[97:123] = LETTERS_OR_MARKS[128:] = 1


#: By number of bytes, what of eight bytes read is theirs.
_OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, dtype=np.uint8)
    return data, offsets - lo


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    data, off = buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """The words of a block: byte ``start`` and ``end``, the ``doc`` (row in the block) of each.

    ``kind`` tells the bytes of words (true), or the numbers of several classes of them: then a word ends where
    the class changes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.n_docs = len(offsets) - 1
        inside = kind[self.data]
        before, after = np.zeros(len(data), dtype=kind.dtype), np.zeros(len(data), dtype=kind.dtype)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before[cuts] = 0
        after[cuts - 1] = 0
        self.start = np.flatnonzero((inside != 0) & (inside != before))
        self.end = np.flatnonzero((inside != 0) & (inside != after)) + 1
        self.first = np.searchsorted(self.start, offsets)  # first word of each row, and the total at the end
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, prefix: int | None = None, suffix: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first or last so many bytes."""
        start, end = self.start, self.end
        if prefix is not None:
            end = np.minimum(end, start + prefix)
        if suffix is not None:
            start = np.maximum(start, end - suffix)
        return self.spans([(start, end)])[0]

    def spans(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Hashes of byte spans inside the words, one array for each pair of starts and ends."""
        padded = np.r_[self.data, np.zeros(8, dtype=np.uint8)]
        eight = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
        return [self._span(eight, start, end) for start, end in pairs]

    def _span(self, eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        left = np.where(size > LONG_WORD, 0, size)
        on = np.flatnonzero(left > 0)
        at = start[on]
        while len(on):
            n = left[on]
            h[on] = mix(h[on] ^ (eight[at] & _OWN[np.minimum(n, 8)]))
            more = n > 8
            left[on] = n - 8
            on, at = on[more], at[more] + 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[start[i] : end[i]].tobytes(), 20240229)
        return mix(h + np.uint64(0x51ED270B))


def hash_tokens(tokens: list[bytes]) -> np.ndarray:
    """The same hashes for given byte strings."""
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in tokens], dtype=np.int64) if tokens else np.zeros(0, dtype=np.int64)
    w = Words.__new__(Words)
    w.data, w.end, w.start = data, ends, ends - np.array([len(t) for t in tokens], dtype=np.int64)
    return w.hashes()


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys; the keys come back sorted."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts
