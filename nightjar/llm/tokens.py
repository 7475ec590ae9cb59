"""Whole-text encoding with a public tokenizer file."""

from __future__ import annotations

import itertools
import os

import numpy as np

from nightjar.llm.text import LOWER, slice_hashes

UNIT = 1 << 19  # bytes of text encoded at once
_LETTER, _MARK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = _MARK
_KIND[[*range(48, 58), 39]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[*range(9, 14), *range(28, 33)]] = True


def _after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is white space in Unicode's sense."""
    back = [np.where(at >= k, data[np.maximum(at - k, 0)], 0).astype(np.int64) for k in (1, 2, 3)]
    two = back[1] << 8 | back[0]
    three = back[2] << 16 | two
    return (_ASCII_WHITE[back[0]] | (two == 0xC2A0) | (two == 0xC285) | (three == 0xE19A80) | (three == 0xE2819F) | (three == 0xE38080)
            | ((three >= 0xE28080) & (three <= 0xE2808A)) | (three == 0xE280A8) | (three == 0xE280A9) | (three == 0xE280AF))


class PieceEncoder:
    """Encode whole texts, giving the tokenizer every distinct piece of text only once.

    A text is cut where the pre-tokenizers of the public byte and word vocabularies always end a match: before a
    space that follows a character other than white space; between an ASCII letter and an ASCII character that is
    neither a letter, a digit nor an apostrophe; and between a single line end and an ASCII letter. The
    ids of the pieces put together are the ids of the text. A text with a space after white space, or
    with the opening of a special token, is encoded in one go. ``spaces`` is False for tokenizers that
    drop white space and letter case. Pieces are known by a 64-bit hash with their length in it; at most
    ``limit`` are remembered.
    """

    def __init__(self, path: str, spaces: bool, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaces, self.limit = spaces, limit
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, text: str) -> list[int] | None:
        """Ids of a piece of ASCII letters, perhaps after a space: one pre-token as it stands, so the model alone decides."""
        body = text[1:] if text[0] == " " else text
        if not (body.isascii() and body.isalpha()):
            return None
        if self.spaces and text[0] == " ":
            body = "\u0120" + body  # the byte alphabet's letter for a space
        return [t.id for t in self.model.tokenize(body)]

    def _learn(self, hashes: np.ndarray, texts: list[str], lot: int = 20_000) -> None:
        ids = [self._piece_ids(t) for t in texts]
        rest = [i for i, own in enumerate(ids) if own is None]
        for a in range(0, len(rest), lot):
            for i, own in zip(rest[a:a + lot], self._ids([texts[i] for i in rest[a:a + lot]])):
                ids[i] = own
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(length.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.int32, total)
        at = self.used + np.cumsum(length, dtype=np.int64) - length
        self.used += total
        spot = np.searchsorted(self.known, hashes)
        self.known, self.at, self.length = (np.insert(x, spot, y) for x, y in ((self.known, hashes), (self.at, at), (self.length, length)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts in one array, and the number of ids of each text."""
        if len(self.known) > self.limit:
            self._forget()
        n_texts, n = len(offsets) - 1, len(data)
        if not self.spaces:
            data = LOWER[data]
        lead = np.zeros(n + 1, bool)
        lead[:n] = data == 32
        kind = _KIND[data]
        lead[1:n] |= (kind[:-1] == _LETTER) & (kind[1:] == _MARK)
        lead[2:n] |= (data[1:-1] == 10) & (kind[2:] == _LETTER) & _VISIBLE[data[:-2]]
        lead[offsets] = True
        start = np.flatnonzero(lead[:n])
        end = np.append(start[1:], n) if len(start) else start
        text = np.searchsorted(offsets, start, "right") - 1
        hashes = slice_hashes(data, start, end)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, distinct)
        fresh = np.flatnonzero(self.known[np.minimum(spot, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(fresh):
            raw = data.tobytes()
            self._learn(distinct[fresh], [raw[a:b].decode() for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist())])
            spot = np.searchsorted(self.known, distinct)
        k = spot[back]
        length = self.length[k].astype(np.int64)
        stops = np.cumsum(length)
        ids = self.flat[np.repeat(self.at[k] - stops + length, length) + np.arange(int(stops[-1]) if len(stops) else 0)]
        counts = np.bincount(text, weights=length, minlength=n_texts).astype(np.int64)
        inner = start[(data[start] == 32) & ~np.isin(start, offsets)] if self.spaces else start[:0]
        opening = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        odd = np.unique(np.searchsorted(offsets, np.concatenate([inner[_after_white(data, inner)], opening]), "right") - 1)
        if len(odd):
            each = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in zip(odd, self._ids([data[offsets[i]:offsets[i + 1]].tobytes().decode() for i in odd])):
                each[i], counts[i] = np.array(own, np.int32), len(own)
            ids = np.concatenate(each)
        return ids, counts
