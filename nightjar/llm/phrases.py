"""Phrase collocations counted by direct-address tiles of ranked ids, level by level."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage, typed
from nightjar.llm.text import mix

BLOCK = 2 << 20     # bytes of text in a block
TILE = 256          # ids on each side of a tile
DENSE = 4           # a tile with a DENSE-th of its cells' number in pairs is counted by direct address
LOT = 2_000_000     # positions whose codes are counted together, about

#: Byte table: A-Z to lower case, separators of pieces to \n, the tab to a space.
_FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

BLOCKS = "block bigint, lang string, n bigint, seq binary, lot int, first bigint, left binary, right binary, count binary"
LEVEL = "lang string, id bigint, left bigint, right bigint, word string, total bigint, block bigint, places binary, ids binary"


def pack(x: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest of four widths, which the first byte names."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[raw[0]], offset=1).astype(np.int64)


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (left, right) with their counts, and for every input pair the number of its distinct one.

    The plane of ids, most frequent first, is cut into tiles of TILE x TILE. The cells of a tile that holds
    many pairs are counted by ``bincount`` over the cell's address; all other tiles as sorted (tile, cell) coordinates.
    """
    _, rows = np.unique(left // TILE, return_inverse=True)
    columns, cols = np.unique(right // TILE, return_inverse=True)
    tiles, tile = np.unique(rows * len(columns) + cols, return_inverse=True)
    cell = left % TILE * TILE + right % TILE
    size = np.bincount(tile, minlength=len(tiles))
    dense = np.flatnonzero(size >= TILE * TILE // DENSE)
    number, base = np.empty(len(left), np.int64), 0
    firsts, counts = [], []
    for t in dense.tolist():
        at = np.flatnonzero(tile == t)
        n = np.bincount(cell[at], minlength=TILE * TILE)
        place = np.cumsum(n > 0) - 1
        number[at] = base + place[cell[at]]
        one = np.empty(int(place[-1]) + 1, np.int64)
        one[place[cell[at]]] = at
        firsts.append(one)
        counts.append(n[n > 0])
        base += len(one)
    rest = np.flatnonzero(size[tile] < TILE * TILE // DENSE)
    _, first, back, n = np.unique(tile[rest] * (TILE * TILE) + cell[rest], return_index=True, return_inverse=True, return_counts=True)
    number[rest] = base + back
    one = np.concatenate([*firsts, rest[first]])
    return left[one], right[one], np.concatenate([*counts, n]), number


def numbered(seq: np.ndarray, lot: np.ndarray) -> np.ndarray:
    """The sequence with its codes numbered lot by lot from 1, and 0 where there is none."""
    number = np.zeros(len(lot) + 1, np.int64)
    number[np.argsort(lot, kind="stable")] = np.arange(1, len(lot) + 1)
    return number[seq]


def _dealt(block: int, lang: str, seq: np.ndarray, lot: np.ndarray, count: np.ndarray, left, right=None, keep: bool = True) -> list[dict]:
    """Rows of a block: its codes by lot, and its sequence with the codes' numbers (unless it is to be derived again)."""
    order = np.argsort(lot, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(lot[order])) + 1).tolist(), len(order)]
    out = [{"block": block, "lang": lang, "n": int((seq >= 0).sum()), "seq": pack(numbered(seq, lot)) if keep else None}]
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        codes = {"left": b"\n".join(left[i] for i in own)} if right is None else {"left": pack(left[own]), "right": pack(right[own])}
        out.append({"block": block, "lang": lang, "lot": int(lot[own[0]]), "first": a + 1, "count": pack(count[own])} | codes)
    return out


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [part.strip().split(" ") for part in schema.split(",")]
    return pa.table([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def word_blocks(docs: DataFrame, lots: int) -> DataFrame:
    """Blocks of pieces of one language with their words' counts, dealt into ``lots`` by the word's hash.

    A task gathers texts per language and cuts them between pieces after about BLOCK bytes, so a text of any length
    is spread over blocks; only a single piece is always held whole.
    """

    def counted(body: bytes, block: int, lang: str) -> pa.Table:
        import xxhash

        coded = pa.array(body.replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
        words, seq = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        names = np.array([0 if w == b"" else -1 if w == b"\n" else 1 for w in words], np.int64)
        place = np.where(names == 1, np.cumsum(names == 1) - 1, -1)
        seq = place[seq[names[seq] != 0]]
        words = [w for w in words if w not in (b"", b"\n")]
        lot = np.array([xxhash.xxh64_intdigest(w) % lots for w in words], np.int64)
        return _table(_dealt(block, lang, seq, lot, np.bincount(seq[seq >= 0], minlength=len(words)), words), BLOCKS)

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        block = TaskContext.get().partitionId() << 32

        def cut(lang: str, all_of_it: bool):
            nonlocal block
            body, a = b"\n".join(held.pop(lang)), 0
            size.pop(lang)
            while a < len(body):
                b = body.find(b"\n", a + BLOCK)
                if b < 0:
                    b = len(body)
                    if not all_of_it and b - a < BLOCK:
                        held[lang], size[lang] = [body[a:]], b - a
                        return
                if body[a:b].strip(b" \n"):
                    yield counted(body[a:b], block, lang)
                    block += 1
                a = b + 1

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())):
                raw = (text.as_py() or b"").translate(_FOLD)
                held.setdefault(lang, []).append(raw)
                size[lang] = size.get(lang, 0) + len(raw) + 1
                if size[lang] >= BLOCK:
                    yield from cut(lang, False)
            if sum(size.values()) >= 16 * BLOCK:
                for lang in list(held):
                    yield from cut(lang, True)
        for lang in list(held):
            yield from cut(lang, True)

    rows = typed(docs, lang="string", text="string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    return arrow_map(rows, run, BLOCKS)


def _count_lots(blocks: DataFrame, lots: int, least: int) -> DataFrame:
    """The frequent codes of every lot with new ids, most frequent first, and for every block the ids of its codes.

    All blocks' entries of a code meet in one lot, so no code is split and a hot one adds one entry a block. The
    r-th code of lot g gets id r * lots + g: ids are unique, and as lots are dealt by a hash they follow the
    ranks of all codes closely.
    """

    def count(rows: pa.Table) -> pa.Table:
        lang, lot = rows.column("lang")[0].as_py(), rows.column("lot")[0].as_py()
        left, right = (rows.column(c).to_pylist() for c in ("left", "right"))
        counts = [unpack(x) for x in rows.column("count").to_pylist()]
        if right[0] is None:
            coded = pa.array([w for x in left for w in x.split(b"\n")], pa.binary()).dictionary_encode()
            code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            code, words = np.argsort(order)[code], [words[i] for i in order]  # ties in rank go by the word
        else:
            a, b = (np.concatenate([unpack(x) for x in side]) for side in (left, right))
            (l, x), (r, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
            codes, code = np.unique(x * len(r) + y, return_inverse=True)
        total = np.zeros(int(code.max()) + 1, np.int64)
        np.add.at(total, code, np.concatenate(counts))
        best = np.argsort(-total, kind="stable")[:int((total >= least).sum())]
        ids = np.full(len(total), -1, np.int64)
        ids[best] = np.arange(len(best)) * lots + lot
        out = []
        for i in best.tolist():
            own = {"word": words[i].decode()} if right[0] is None else {"left": int(l[codes[i] // len(r)]), "right": int(r[codes[i] % len(r)])}
            out.append({"lang": lang, "id": int(ids[i]), "total": int(total[i])} | own)
        ends = np.cumsum([len(c) for c in counts]).tolist()
        for block, first, n, end in zip(rows.column("block").to_pylist(), rows.column("first").to_pylist(), map(len, counts), ends):
            own = ids[code[end - n:end]]
            kept = np.flatnonzero(own >= 0)
            if len(kept):
                out.append({"block": block, "places": pack(first + kept), "ids": pack(own[kept])})
        return _table(out, LEVEL)

    return blocks.where("lot is not null").drop("seq").groupBy("lang", "lot").applyInArrow(count, LEVEL)


def _pairs(seq: np.ndarray, places: np.ndarray, ids: np.ndarray, lots: int):
    """One word longer: the sequence of pairs of neighbouring codes that are both frequent, the pairs, their counts and lots."""
    known = np.full(max(int(seq.max(initial=0)), int(places.max(initial=0))) + 1, -1, np.int64)
    known[places] = ids
    seq = known[seq]
    both = (seq[:-1] >= 0) & (seq[1:] >= 0)
    left, right, count, number = count_pairs(seq[:-1][both], seq[1:][both])
    longer = np.full(len(both), -1, np.int64)
    longer[both] = number
    longer = longer[both | np.append(True, both[:-1])]  # of a run without codes one place keeps its neighbours apart
    lot = mix(mix(left.astype(np.uint64)) + right.astype(np.uint64)) % np.uint64(lots)
    return longer, lot.astype(np.int64), count, left, right


def _longer(blocks: DataFrame, levels: list[tuple[DataFrame, int]], keep: bool) -> DataFrame:
    """Blocks longer by one word per level: a level holds the frequent codes of its length and says how many lots the next has.

    Pairs of words are by far the most codes, and most stand once in their block: their sequences take more room than the
    words'. So they are not kept (``keep``) but derived a second time from the words when triples are counted.
    """
    lots = [n for _, n in levels]

    def pair(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _table([], BLOCKS)
        seq = unpack(block.column("seq")[0].as_py())
        step = found.column("step").to_numpy()
        for i, n in enumerate(lots):
            own = np.flatnonzero(step == i)
            if not len(own):
                return _table([], BLOCKS)
            places, ids = (np.concatenate([unpack(found.column(c)[j].as_py()) for j in own.tolist()]) for c in ("places", "ids"))
            longer, lot, count, left, right = _pairs(seq, places, ids, n)
            if not len(count):
                return _table([], BLOCKS)
            seq = numbered(longer, lot)
        return _table(_dealt(block.column("block")[0].as_py(), block.column("lang")[0].as_py(), longer, lot, count, left, right, keep), BLOCKS)

    state = blocks.where("lot is null").select("block", "lang", "seq")
    found = None
    for i, (level, _) in enumerate(levels):
        own = level.where("block is not null").select("block", "places", "ids", F.lit(i).alias("step"))
        found = own if found is None else found.union(own)
    return state.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(pair, BLOCKS)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[list[DataFrame], DataFrame]:
    """Per length the phrases found ``least`` times or more, and (lang, n): all word occurrences.

    A row holds lang, id, the ids of its first and last part (left, right), phrase, tail (its last word),
    a (its count) and the counts of its beginnings and endings by length (pre, suf).

    Each level pairs the ids of neighbouring phrases of the level below, which overlap in all but their outer words:
    a phrase can be frequent only if both are. Blocks number their codes themselves, lots of codes count them over all
    blocks, and what comes back to a block are the ids of its own codes: nothing is broadcast.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    lots = max(1, math.ceil(size / 40 / LOT))  # a word has some six bytes and recurs in its block
    blocks = held = cut_lineage(word_blocks(docs, lots))
    pending: list[tuple[DataFrame, int]] = []
    words = blocks.where("lot is null").groupBy("lang").agg(F.sum("n").alias("n"))
    levels: list[DataFrame] = []
    for length in range(1, longest + 1):
        level = cut_lineage(_count_lots(blocks, lots, least))
        codes = level.where("block is null").select("lang", "id", "left", "right", "word", F.col("total").alias("a"))
        if length == 1:
            levels.append(codes.select("lang", "id", "left", "right", F.col("word").alias("phrase"), F.col("word").alias("tail"), "a", F.array("a").alias("pre"), F.array("a").alias("suf")))
        else:
            first = levels[-1].select("lang", F.col("id").alias("left"), F.col("phrase").alias("head"), F.col("pre").alias("before"))
            last = levels[-1].select("lang", F.col("id").alias("right"), "tail", F.col("suf").alias("behind"))
            named = codes.drop("word").join(first, ["lang", "left"]).join(last, ["lang", "right"])
            levels.append(cut_lineage(named.select("lang", "id", "left", "right", F.concat_ws(" ", "head", "tail").alias("phrase"), "tail", "a",
                                                   F.concat("before", F.array("a")).alias("pre"), F.concat(F.array("a"), "behind").alias("suf"))))
        if length < longest:
            places = blocks.where("lot is null").agg(F.sum("n")).first()[0] or 0
            lots = max(1, math.ceil(places / LOT))
            pending.append((level, lots))
            blocks = cut_lineage(_longer(held, pending, keep=length > 1))
            if length > 1:
                held, pending = blocks, []
    return levels, words


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, covered_percent: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of every language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into
    words. Phrases of 2 to ``longest`` words found at least ``least`` times (a) are candidates. Cut after k words, a
    candidate's parts have counts l and r and score floor(1000 * a * n / (l * r)), n being the words of the
    language; the lowest score of all cuts counts, of equal ones the shortest first part. A candidate inside a longer
    one with ``100 * f(longer) >= covered_percent * a`` is dropped; a phrase one word longer decides, as counts only
    fall with length. Order: score and a descending, phrase ascending by bytes. All sums are integers of up to 38 digits.

    A null text counts as empty, a null lang as ``und``; texts of any length are counted whole; repeated rows count as
    often as they stand; an empty table, or one without candidates, gives an empty one; extra columns are ignored.
    """
    levels, words = frequent_phrases(docs, longest, least)
    kept = []
    for i, phrases in enumerate(levels[1:], 1):
        if i + 1 < len(levels):
            above = levels[i + 1]
            cover = above.select("lang", F.col("left").alias("id"), "a").union(above.select("lang", "right", "a")).groupBy("lang", "id").agg(F.max("a").alias("cover"))
            phrases = phrases.join(cover, ["lang", "id"], "left").where(F.coalesce(100 * F.col("cover") < covered_percent * F.col("a"), F.lit(True)))
        kept.append(phrases.select("lang", "phrase", "a", "pre", "suf"))
    candidates = kept[0]
    for other in kept[1:]:
        candidates = candidates.union(other)
    wide = "cast({} as decimal(19, 0))"
    share = f"cast(cast(1000 as decimal(4, 0)) * {wide.format('a')} as decimal(22, 0)) * cast(n as decimal(16, 0)) div ({wide.format('pre[k - 1]')} * {wide.format('suf[k]')})"
    cuts = f"array_min(transform(sequence(1, size(pre) - 1), k -> struct({share} as score, k as k, pre[k - 1] as l, suf[k] as r)))"
    scored = candidates.join(words, "lang").withColumn("cut", F.expr(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("bigint").alias("score"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*by)  # what is in the first rows of all is in those of its share
    first = scored.withColumn("rank", F.row_number().over(share_of)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
