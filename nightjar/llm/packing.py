"""Harmonic packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightjar.llm.common import arrow_map, typed
from nightjar.llm.text import blocks
from nightjar.llm.tokens import UNIT, PieceEncoder

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, ids binary")


def cut_lengths(n: int, capacity: int, smallest: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: full sequences, halves of ``capacity`` down to ``smallest``, and the rest."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    size = capacity // 2
    while size >= smallest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class _Worker:
    """The open bins of one worker: one per class, a class being all pieces of one length.

    Piece lengths are capacity/2, capacity/4, ... and every number below ``smallest``; pieces of length
    t lie in the class of reciprocal floor(capacity / t), whose bins take exactly that many of them.
    """

    def __init__(self, capacity: int, smallest: int, worker: int):
        self.capacity, self.smallest = capacity, smallest
        self.next_sequence = worker << 32
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next_sequence, offset, raw))
            offset += len(ids)
        self.next_sequence += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        start = 0
        for length in cut_lengths(len(ids), self.capacity, self.smallest):
            pieces = self.open.setdefault(length, [])
            pieces.append((doc, start, ids[start:start + length].copy(), len(ids)))
            start += length
            if len(pieces) == self.capacity // length:
                gap = self.capacity - length * len(pieces)
                if gap:
                    self._fill(pieces, gap)
                self._emit(pieces)
                self.open[length] = []

    def _fill(self, pieces: list[tuple], gap: int) -> None:
        """Close the gap of a tail class, below one of its pieces, with one open piece of just that length."""
        other = self.open.get(gap)
        if other:
            pieces.append(other.pop())

    def finish(self) -> None:
        """The open bins, a bounded rest, are laid end to end and cut at the capacity, the last of it at powers of two."""
        rest = [p for length in sorted(self.open, reverse=True) for p in self.open[length]]
        total = sum(len(p[2]) for p in rest)
        room = [self.capacity] * (total // self.capacity)
        room += [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        bins: list[list[tuple]] = []
        k, left = 0, 0
        for doc, start, ids, n in rest:
            while len(ids):
                if left == 0:
                    bins.append([])
                    left, k = room[k], k + 1
                bins[-1].append((doc, start, ids[:left], n))
                start, taken = start + len(ids[:left]), min(left, len(ids))
                ids, left = ids[taken:], left - taken
        for pieces in bins:
            self._emit(pieces)
        self.open = {}

    def take(self) -> pa.Table:
        types = [pa.int64()] * 7 + [pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        columns = list(zip(*self.rows)) or [[]] * len(names)
        self.rows = []
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, smallest: int = 64, spaces: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids; one row per piece.

    A document is its ids and then ``end_id``; a null text counts as empty and gives the end id alone. It
    is cut into full sequences, pieces of capacity/2, capacity/4, ..., ``smallest`` and a rest below
    ``smallest``. Pieces of one length form a class of reciprocal capacity and a bin of the class takes
    floor(capacity / length) of them, so each worker fills its bins on its own, without a shuffle, and
    holds fewer than one bin of each class. What is open at a worker's end (at most one bin a class) is
    laid end to end and cut at the capacity; its last ids go into sequences whose lengths are powers of
    two, so the only padding is that of full tail bins, below ``smallest`` ids each. Sequence ids are
    the worker's number times 2^32 and up: unique, not dense. Repeated doc_ids are packed as they come,
    an empty table gives no rows, extra columns are ignored, and a text of any length is cut as needed.
    ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers.
    """
    assert capacity & (capacity - 1) == 0 and smallest & (smallest - 1) == 0 and 1 < smallest <= capacity

    def run(batches):
        from pyspark import TaskContext

        encoder = PieceEncoder(tokenizer, spaces)
        worker = _Worker(capacity, smallest, TaskContext.get().partitionId())
        for rows, data, offsets in blocks(batches, "text", UNIT):
            ids, counts = encoder.encode(data, offsets)
            at = 0
            for doc, n in zip(rows.column("doc_id").to_pylist(), counts.tolist()):
                worker.add(doc, np.append(ids[at:at + n], np.int32(end_id)))
                at += n
            yield worker.take()
        worker.finish()
        yield worker.take()

    return arrow_map(typed(docs, doc_id="bigint", text="string"), run, SCHEMA)
