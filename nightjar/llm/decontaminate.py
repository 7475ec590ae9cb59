"""Benchmark decontamination: CGK embedding and bit-sampling LSH of item-sized windows, then exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightjar.llm.common import arrow_map, typed
from nightjar.llm.text import blocks, mix, shingle_hashes, utf8, word_hashes

UNIT = 2 << 20
SCHEMA = "doc_id bigint, item_id bigint, distance int, item_words int, first_word bigint, last_word bigint, similarity double"

#: Letters and digits; every byte of a character beyond ASCII counts as a letter.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def folded(texts: pa.Array) -> pa.Array:
    """Texts without case, by Unicode's case folding."""
    return pa.array([t if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


def edit_budget(words: int, similarity: float) -> int:
    """Most word edits that leave an item of so many words at ``similarity``."""
    return int(np.floor((1 - similarity) * words + 1e-9))


def embed(windows: np.ndarray, length: np.ndarray, walk: int) -> np.ndarray:
    """CGK: each row walks its symbols for 3 x length steps, at each step moving on or staying by a random bit
    that depends on the step and the symbol alone. Equal rests of two strings fall into step again soon
    after an edit, so edit distance becomes Hamming distance.
    """
    n, width = windows.shape
    symbols = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    symbols[np.arange(width + 1) >= length[:, None]] = 0
    rows, at = np.arange(n), np.zeros(n, np.int64)
    out = np.zeros((n, 3 * width), np.uint64)
    for step in range(3 * int(length.max(initial=0))):
        here = symbols[rows, at]
        out[:, step] = here
        coin = mix(here + np.uint64(0x9E3779B97F4A7C15 * (walk * 100_003 + step + 1) % (1 << 64)))
        at = np.minimum(at + (coin >> np.uint64(63)).astype(np.int64), length)
    return out


def sampled_keys(walked: np.ndarray, length: np.ndarray, walk: int, tables: int, bits: int) -> np.ndarray:
    """Per row and table a hash of ``bits`` coordinates of the walk, the same share of the walk for all rows."""
    share = np.random.default_rng(1000 + walk).random((tables, bits))
    rows = np.arange(len(walked))
    out = np.empty((len(walked), tables), np.uint64)
    for t in range(tables):
        h = mix(length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(walk * tables + t))
        for f in share[t]:
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + walked[rows, (f * 3 * length).astype(np.int64)])
        out[:, t] = h
    return out


def closest(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any run of ``region``; the end of the first such run, exclusive, and its start."""
    def ends(pattern: list, text: list) -> tuple[int, int]:
        m = len(pattern)
        where: dict = {}
        for i, x in enumerate(pattern):
            where[x] = where.get(x, 0) | 1 << i
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best, at = full, 0, m, m, 0
        for j, x in enumerate(text):
            same = where.get(x, 0)
            zero = (((same & up) + up) ^ up) | same | down
            plus, minus = down | ~(zero | up) & full, up & zero
            score += (plus & top > 0) - (minus & top > 0)
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = minus | ~(zero | plus) & full, plus & zero
            if score < best:
                best, at = score, j + 1
        return best, at

    a, b = item.tolist(), region.tolist()
    best, end = ends(a, b)
    _, back = ends(a[::-1], b[:end][::-1])
    return best, end, end - back


class Items:
    """Benchmark items as word hashes with their seeds and LSH keys."""

    def __init__(self, ids: list[int], words: list[np.ndarray], similarity: float, walks: int, tables: int, bits: int):
        self.ids, self.words = ids, words
        self.length = np.array([len(w) for w in words], np.int64)
        self.budget = np.array([edit_budget(len(w), similarity) for w in words], np.int64)
        self.walks, self.tables, self.bits = walks, tables, bits
        self.seeds = self._seeds()
        matrix = np.zeros((len(words), int(self.length.max(initial=1))), np.uint64)
        for i, w in enumerate(words):
            matrix[i, :len(w)] = w
        keys = self.keys(matrix, self.length)
        order = np.argsort(keys.reshape(-1), kind="stable")
        self.sorted_keys, self.key_item = keys.reshape(-1)[order], order // max(1, keys.shape[1])

    def keys(self, matrix: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.concatenate([sampled_keys(embed(matrix, length, w), length, w, self.tables, self.bits) for w in range(self.walks)], axis=1)

    def _seeds(self) -> dict[int, tuple]:
        """Per seed length the hashes, items and offsets of the seeds.

        An item within its budget of e edits of a window shares at least one of any e + 1 disjoint pieces
        with it, word for word; a seed is the first words of such a piece, four at most.
        """
        found: dict[int, list] = {}
        for i, (w, e) in enumerate(zip(self.words, self.budget)):
            size = len(w) // (int(e) + 1)
            k = min(4, size)
            runs = shingle_hashes(w, k)
            found.setdefault(k, []).extend((runs[o], i, o) for o in range(0, size * (int(e) + 1), size))
        out = {}
        for k, rows in found.items():
            rows.sort(key=lambda r: r[0])
            h = np.array([r[0] for r in rows], np.uint64)
            mask = np.zeros(1 << 22, bool)
            mask[h >> np.uint64(42)] = True
            out[k] = (h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), mask)
        return out

    def windows(self, words: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Distinct (start, item) of the windows that some seed points at; starts count the block's words."""
        out = []
        for k, (h, item, offset, mask) in self.seeds.items():
            runs = shingle_hashes(words, k)
            if not len(runs):
                continue
            at = np.flatnonzero(mask[runs >> np.uint64(42)] & (text[:len(runs)] == text[k - 1:]))
            lo, hi = np.searchsorted(h, runs[at], "left"), np.searchsorted(h, runs[at], "right")
            n = hi - lo
            which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append(np.stack([np.repeat(at, n) - offset[which], item[which], np.repeat(text[at], n)], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def near(self, words: np.ndarray, bounds: np.ndarray, found: np.ndarray) -> np.ndarray:
        """(text, item, start) of the windows that share an LSH key with an item."""
        if not len(found):
            return found
        start, length = found[:, 0], self.length[found[:, 1]]
        low, high = bounds[found[:, 2]], bounds[found[:, 2] + 1]
        at = start[:, None] + np.arange(int(length.max()))
        inside = (at >= low[:, None]) & (at < high[:, None])
        matrix = np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(1))
        keys = self.keys(matrix, length).reshape(-1)
        lo, hi = np.searchsorted(self.sorted_keys, keys, "left"), np.searchsorted(self.sorted_keys, keys, "right")
        n = hi - lo
        which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(np.arange(len(keys)) // (self.walks * self.tables), n)
        return np.unique(np.stack([found[row, 2], self.key_item[which], start[row]], axis=1), axis=0)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(text, item, distance, first word, last word) of the best run of each text, without case, for each item within budget."""
        _, _, text, words = word_hashes(data, offsets, WORD)
        bounds = np.searchsorted(text, np.arange(len(offsets)))
        best: dict[tuple, tuple] = {}
        for t, i, s in self.near(words, bounds, self.windows(words, text)).tolist():
            e = int(self.budget[i])
            if best.get((t, i), (e + 1,))[0] == 0:
                continue
            a, b = max(int(bounds[t]), s - e), min(int(bounds[t + 1]), s + int(self.length[i]) + e)
            d, end, begin = closest(self.words[i], words[a:b])
            if d <= e:
                row = (d, a + begin - int(bounds[t]), a + end - 1 - int(bounds[t]))
                best[t, i] = min(best.get((t, i), row), row)
        return [(t, i, *row) for (t, i), row in sorted(best.items())]


def _item_blocks(items: DataFrame, similarity: float, min_words: int, words_per_block: int, **lsh) -> Iterator[Items]:
    ids, words, n = [], [], 0
    for row in typed(items, item_id="bigint", text="string").toLocalIterator():
        data, offsets = utf8(folded(pa.array([row.text], pa.string())))
        own = word_hashes(data, offsets, WORD)[3]
        if len(own) < min_words:
            continue
        ids.append(row.item_id)
        words.append(own)
        n += len(own)
        if n >= words_per_block:
            yield Items(ids, words, similarity, **lsh)
            ids, words, n = [], [], 0
    if ids:
        yield Items(ids, words, similarity, **lsh)


def contamination(docs: DataFrame, items: DataFrame, similarity: float = 0.8, min_words: int = 5, walks: int = 6, tables: int = 8,
                  bits: int = 3, words_per_block: int = 1_000_000) -> DataFrame:
    """Which documents (doc_id, text) hold a benchmark item (item_id, text), allowing for edits.

    Texts are compared by words (ASCII letters and digits and all characters beyond ASCII), without regard to
    case in any script.
    An item of m words is held if some run of the document's words is within floor((1 - similarity) * m)
    word insertions, deletions and substitutions. One row per document row and item: the distance, the
    run's first and last word and 1 - distance / m.

    Windows of the item's own size are embedded by ``walks`` random walks and each walk is sampled by
    ``tables`` hashes of ``bits`` coordinates; a window that shares a key with an item is checked by exact
    edit distance in the words around it. Only windows that some seed points at are embedded: by the
    pigeonhole rule no window within the budget lacks one, so that loses nothing. Items go to the tasks in
    blocks of about ``words_per_block`` words, so what is broadcast does not grow with the benchmark; a
    document is read once per block and nothing is shuffled.

    Items under ``min_words`` words, null or empty ones included, take no part: they occur by chance.
    Null and empty documents give no rows, equal rows give equal results, extra columns are ignored.
    """
    docs = typed(docs, doc_id="bigint", text="string")

    def found(block: Items) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            own = sent.value
            lowered = (pa.record_batch([b.column("doc_id"), folded(b.column("text"))], names=["doc_id", "text"]) for b in batches)
            for part, data, offsets in blocks(lowered, "text", UNIT):
                rows = own.matches(data, offsets)
                doc = part.column("doc_id").to_pylist()
                cells = [(doc[t], own.ids[i], d, int(own.length[i]), a, b, 1 - d / int(own.length[i])) for t, i, d, a, b in rows]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.table([pa.array(c, t) for c, t in zip(list(zip(*cells)) or [[]] * 7, types)], names=names)

        return arrow_map(docs, run, SCHEMA)

    frames = [found(b) for b in _item_blocks(items, similarity, min_words, words_per_block, walks=walks, tables=tables, bits=bits)]
    return reduce(DataFrame.unionByName, frames) if frames else docs.sparkSession.createDataFrame([], SCHEMA)
