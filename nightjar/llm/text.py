"""Words and hashes of whole texts as numpy arrays, for Arrow functions.

A block is one byte buffer of several texts put end to end with the offset of each text. Words and pieces
are hashed by a chain of mixed eight-byte steps. ``Rolling`` is a polynomial over bytes modulo 2^64 whose slices
all follow from prefix sums; such sums clash on strings built by repeated complement from 1,024 bytes
on, so it serves short windows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def symbol_values(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices whose texts hold about ``limit`` bytes (one longer text stands alone): rows, bytes, offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            a = b


class Rolling:
    """Prefix sums from which the hash of any slice of a block follows."""

    _powers: dict = {}

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        base = (_BASE + 2 * 0x5851F42D4C957F2D * seed) % (1 << 64)
        known = Rolling._powers.get(seed)
        if known is None or len(known[0]) <= n:
            size = max(1 << 16, 1 << int(n).bit_length())
            p = np.full(size, base, np.uint64)
            q = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            known = Rolling._powers[seed] = (np.multiply.accumulate(p), np.multiply.accumulate(q), symbol_values(seed))
        powers, self.inverse, values = known
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * powers[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all(self, q: int) -> np.ndarray:
        """Hashes of every slice of ``q`` bytes, by start."""
        n = len(self.sums) - q
        return (self.sums[q:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, short: int = 64) -> np.ndarray:
    """A 64-bit hash of every slice ``data[start:end]``: by its bytes and length alone.

    Slices of up to ``short`` bytes are worked through eight bytes at a time, all side by side; longer ones,
    which are few, are hashed one by one.
    """
    import xxhash

    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(_BASE))
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", room, strides=(1,))
    at = np.flatnonzero(size <= short)
    for done in range(0, short, 8):
        at = at[size[at] > done]
        if not len(at):
            break
        step = eight[start[at] + done] & _LAST[np.minimum(size[at] - done, 8)]
        h[at] = mix((h[at] ^ mix(step + np.uint64(done + 1))) * np.uint64(0x9FB21C651E98DF25))
    for i in np.flatnonzero(size > short).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].tobytes())
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of word bytes."""
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:n] | ~np.concatenate([[False], inside[:-1]]))) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 if n else start
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of every word; ``data`` should be lower-cased already."""
    start, end, text = word_spans(data, offsets, is_word)
    return start, end, text, slice_hashes(data, start, end)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes, whatever text they belong to."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[i:i + n])
    return h
