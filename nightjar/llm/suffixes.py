"""Repeated-substring removal by bucket-pointer refinement over sampled suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage, typed
from nightjar.llm.text import Rolling, blocks, mix

UNIT = 1 << 20
CHUNK = 1 << 23  # bytes of one text looked at together; a place in it takes 24 bits
PLACE = np.uint64((1 << 24) - 1)
FLUSH = 1_000_000
BYTES_PER_SHARD = 8 << 20
MEMBERS = [("bucket", np.uint64, 8), ("name", np.uint64, 6), ("doc", np.uint32, 4), ("start", np.uint32, 4),
           ("count", np.uint16, 2), ("left", np.uint16, 2), ("right", np.uint16, 2)]


def _planes(x: np.ndarray, width: int) -> bytes:
    """Bytes of equal weight put together: high bytes, mostly zero, cost next to nothing once compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def _unplanes(raw: memoryview, n: int, dtype, width: int) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view(dtype).reshape(n)


def _pack(columns: dict[str, np.ndarray]) -> tuple[bytes, bytes]:
    docs, index = np.unique(columns["doc"], return_inverse=True)
    body = b"".join(_planes((index if c == "doc" else columns[c]).astype(t), width) for c, t, width in MEMBERS)
    return docs.astype("<i8").tobytes(), body


def _unpack(rows: Iterator[tuple[bytes, bytes]]) -> dict[str, np.ndarray]:
    size = sum(width for *_, width in MEMBERS)
    parts: dict[str, list] = {c: [] for c, *_ in MEMBERS}
    for docs, body in rows:
        n, at = len(body) // size, 0
        for c, t, width in MEMBERS:
            x = _unplanes(memoryview(body)[at:at + n * width], n, t, width)
            at += n * width
            parts[c].append(np.frombuffer(docs, "<i8")[x] if c == "doc" else x)
    return {c: np.concatenate(x) for c, x in parts.items()}


def _take(columns: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {c: x[which] for c, x in columns.items()}


def _same_as_before(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys]) if len(keys[0]) > 1 else False
    return out


def sampled_suffixes(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> dict[str, np.ndarray]:
    """The anchors of a block: per window of ``length`` bytes its least-hash q-gram, equal neighbours as one run.

    Equal windows have their anchor at the same place within them, so two equal windows always meet in
    the bucket of one q-gram. ``start`` and ``count`` are the run's windows, ``name`` is the identifier of
    all the run's bytes, and ``left`` and ``right`` identify the bytes next to the anchor that any window
    has on one of the two sides.
    """
    n = len(data)
    if n > CHUNK:
        step = CHUNK - length + 1
        parts = [sampled_suffixes(data[a:a + CHUNK], np.array([0, min(CHUNK, n - a)]), length, q) | {"from": a} for a in range(0, n - length + 1, step)]
        starts = [p["start"].astype(np.int64) + p.pop("from") for p in parts]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0] if c != "start"} | {"start": np.concatenate(starts)}
    width = length - q + 1
    if n < length:
        return {c: np.zeros(0, t) for c, t, _ in MEMBERS}
    one, two = Rolling(data), Rolling(data, 1)
    grams = mix(one.all(q) if n > q else one.slices(np.array([0]), np.array([q])))
    least, span = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    least = least[:n - length + 1]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = doc[:len(least)] == doc[length - 1:length - 1 + len(least)]
    place = (least & PLACE).astype(np.int64)
    edge = np.ones(len(place) + 1, bool)
    edge[1:-1] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1]) | (doc[1:len(place)] != doc[:len(place) - 1])
    cut = np.flatnonzero(edge)
    first, last = cut[:-1], cut[1:] - 1
    first, last = first[whole[first]], last[whole[first]]
    anchor = place[first]
    side = -(-(length - q) // 2)
    short = lambda ok, a, b: np.where(ok, mix(two.slices(np.clip(a, 0, n), np.clip(b, 0, n))) >> np.uint64(49), 0).astype(np.uint16) | (ok.astype(np.uint16) << 15)
    return {
        "bucket": grams[anchor], "name": mix(two.slices(first, last + length) + (last - first).astype(np.uint64)) & np.uint64((1 << 48) - 1),
        "doc": doc[first], "start": first - offsets[doc[first]], "count": last - first + 1,
        "left": short(anchor - first >= side, anchor - side, anchor), "right": short(last + length - anchor - q >= side, anchor + q, anchor + q + side),
    }


def window_names(data: np.ndarray, length: int) -> np.ndarray:
    """Identifier of every window of one text, doubled up from buckets of a quarter of it: the identifier of a longer
    string is made of that of its beginning and that at a later offset."""
    quarter = -(-length // 4)
    n = len(data) - length + 1
    names = Rolling(data, 2).slices(np.arange(len(data) - quarter + 1), np.arange(quarter, len(data) + 1))
    half = mix(mix(names[:len(names) - quarter]) * np.uint64(0x9FB21C651E98DF25) + names[quarter:])
    return mix(half[:n] * np.uint64(0x9FB21C651E98DF25) + half[length - 2 * quarter:length - 2 * quarter + n])


def _fold(m: dict[str, np.ndarray], length: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Members sorted by bucket, then by identifier, then by place: the first of each equal lot, and the byte
    spans (doc, start, end) of all others, which an earlier one repeats."""
    order = np.lexsort((m["start"], m["doc"], m["name"], m["bucket"]))
    m = _take(m, order)
    again = _same_as_before(m["bucket"], m["name"])
    start = m["start"][again].astype(np.int64)
    spans = np.stack([m["doc"][again].astype(np.int64), start, start + m["count"][again] + (length - 1)], axis=1)
    return _take(m, ~again), spans


def _unsettled(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Members of buckets with several identifiers that share the bytes on one side of the anchor with another."""
    keep = np.zeros(len(m["bucket"]), bool)
    for side in ("left", "right"):
        has = np.flatnonzero(m[side] >> 15)
        order = has[np.lexsort((m[side][has], m["bucket"][has]))]
        same = _same_as_before(m["bucket"][order], m[side][order])
        keep[order[same]] = True
        keep[order[np.flatnonzero(same) - 1]] = True
    return _take(m, keep)


ROW = "kind int, shard int, docs binary, body binary"


def _rows(kind: int, shard: np.ndarray, shards: int, pack) -> pa.Table:
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    cells = [(s, *pack(order[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    s, docs, body = zip(*cells) if cells else ((), (), ())
    return pa.table([pa.array([kind] * len(s), pa.int32()), pa.array(s, pa.int32()), pa.array(docs, pa.binary()), pa.array(body, pa.binary())],
                    names=["kind", "shard", "docs", "body"])


def _member_rows(m: dict[str, np.ndarray], shards: int) -> pa.Table:
    return _rows(0, (m["bucket"] & np.uint64(shards - 1)).astype(np.int64), shards, lambda w: _pack(_take(m, w)))


def _span_rows(spans: np.ndarray, shards: int) -> pa.Table:
    """Byte spans dealt by document, those of one document merged."""
    spans = _merged(spans)
    shard = (mix(spans[:, 0].astype(np.uint64)) & np.uint64(shards - 1)).astype(np.int64)
    return _rows(1, shard, shards, lambda w: (b"", b"".join(_planes(spans[w, i], 8) for i in range(3))))


def _spans_of(bodies: list[bytes]) -> np.ndarray:
    parts = [np.stack([_unplanes(memoryview(b)[i * len(b) // 3:(i + 1) * len(b) // 3], len(b) // 24, np.int64, 8) for i in range(3)], axis=1) for b in bodies]
    return np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal covered runs per document: spans that overlap or touch become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] != spans[:-1, 0]]))
    room = int(spans[:, 2].max()) + 2
    rank = np.cumsum(np.concatenate([[0], (spans[1:, 0] != spans[:-1, 0])]))
    start, end = spans[:, 1] + rank * room, spans[:, 2] + rank * room
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    new[first] = True
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[at, 0], spans[at, 1], reach[last] - rank[last] * room], axis=1)


def _folding(parts: Iterator[dict[str, np.ndarray]], shards: int, length: int) -> Iterator[pa.Table]:
    """Members folded ``FLUSH`` at a time before the shuffle, so a passage found everywhere is sent once a flush."""
    held: list[dict] = []

    def flush() -> Iterator[pa.Table]:
        m, spans = _fold({c: np.concatenate([h[c] for h in held]) for c, *_ in MEMBERS}, length)
        held.clear()
        yield _member_rows(m, shards)
        yield _span_rows(spans, shards)

    for m in parts:
        held.append(m)
        if sum(len(h["doc"]) for h in held) >= FLUSH:
            yield from flush()
    if held:
        yield from flush()


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): a unique key in the order of doc_id, the id itself where it is unique and not null."""
    docs = typed(docs, doc_id="bigint", text="string")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null or doc_id < 0")
    if not odd.take(1):
        return docs.withColumn("key", F.col("doc_id"))
    return cut_lineage(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("key", F.monotonically_increasing_id()))


def repeated_spans(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(key, spans): per document of (key, text) the merged byte runs covered by windows that also start earlier."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(6, int(np.ceil(np.log2(max(1, total / BYTES_PER_SHARD)))))

    def sample(batches):
        def parts():
            for part, data, offsets in blocks(batches, "text", min(UNIT, CHUNK)):
                m = sampled_suffixes(data, offsets, length, q)
                yield m | {"doc": part.column("key").to_numpy()[m["doc"].astype(np.int64)]}
        return _folding(parts(), shards, length)

    def refine(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py() == 1:
            return group.append_column("windows", pa.nulls(group.num_rows, pa.binary())).append_column("key", pa.nulls(group.num_rows, pa.int64())).select(names)
        m, spans = _fold(_unpack(zip(group.column("docs").to_pylist(), group.column("body").to_pylist())), length)
        m = _unsettled(m)
        order = np.argsort(m["doc"], kind="stable")
        m = _take(m, order)
        cuts = np.flatnonzero(np.concatenate([[True], m["doc"][1:] != m["doc"][:-1], [True]])) if len(order) else np.zeros(1, int)
        packed = [np.stack([m["bucket"][a:b], m["start"][a:b].astype(np.uint64), m["count"][a:b].astype(np.uint64)]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        covered = _span_rows(spans, shards)
        n = len(packed)
        return pa.table({
            "kind": pa.concat_arrays([*covered.column("kind").chunks, pa.array([2] * n, pa.int32())]), "shard": pa.concat_arrays([*covered.column("shard").chunks, pa.array([0] * n, pa.int32())]),
            "body": pa.concat_arrays([*covered.column("body").chunks, pa.nulls(n, pa.binary())]), "windows": pa.array([None] * covered.num_rows + packed, pa.binary()),
            "key": pa.array([None] * covered.num_rows + m["doc"][cuts[:-1]].tolist(), pa.int64())}).select(names)

    names = ["kind", "shard", "body", "windows", "key"]
    first = cut_lineage(arrow_map(docs, sample, ROW).groupBy("kind", "shard").applyInArrow(refine, "kind int, shard int, body binary, windows binary, key bigint"))

    def name(batches):
        def parts():
            for batch in batches:
                for key, text, lists in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist(), batch.column("windows").to_pylist()):
                    names = window_names(np.frombuffer(text, np.uint8), length)
                    bucket, start, count = np.concatenate([np.frombuffer(x, np.uint64).reshape(3, -1) for x in lists], axis=1)
                    count = count.astype(np.int64)
                    at = np.repeat(start.astype(np.int64) - np.cumsum(count) + count, count) + np.arange(count.sum())
                    zero = np.zeros(len(at), np.uint16)
                    yield {"bucket": np.repeat(bucket, count), "name": names[at] & np.uint64((1 << 48) - 1), "doc": np.full(len(at), key, np.int64), "start": at,
                           "count": zero + 1, "left": zero, "right": zero}
        return _folding(parts(), shards, length)

    def settle(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py() == 1:
            return group.select(["shard", "body"])
        _, spans = _fold(_unpack(zip(group.column("docs").to_pylist(), group.column("body").to_pylist())), length)
        return _span_rows(spans, shards).select(["shard", "body"])

    lists = first.where("kind = 2").groupBy("key").agg(F.collect_list("windows").alias("windows"))
    texts = docs.select("key", F.col("text").cast("binary").alias("body")).join(lists, "key")
    second = arrow_map(texts, name, ROW).groupBy("kind", "shard").applyInArrow(settle, "shard int, body binary")

    def cover(group: pa.Table) -> pa.Table:
        spans = _merged(_spans_of(group.column("body").to_pylist()))
        cuts = np.flatnonzero(np.concatenate([[True], spans[1:, 0] != spans[:-1, 0], [True]])) if len(spans) else np.zeros(1, int)
        return pa.table([pa.array(spans[cuts[:-1], 0], pa.int64()), pa.array([spans[a:b, 1:].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["key", "spans"])

    return first.where("kind = 1").select("shard", "body").union(second).groupBy("shard").applyInArrow(cover, "key bigint, spans binary")


def remove_repeats(docs: DataFrame, length: int = 100, q: int = 24) -> DataFrame:
    """``docs`` (doc_id, text) without the bytes covered by a ``length``-byte string that also starts earlier.

    One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the
    bytes that stay, perhaps cut inside a character). Earlier means a smaller doc_id, or an earlier start
    in the same document; strings lie within one document's UTF-8 bytes and are judged on the input.

    Suffixes are sampled: of the q-grams of each window the one of least hash is the window's anchor, and
    initial buckets hold the anchors of one q-gram. A bucket is refined by sorting its members on the
    identifier of the later bytes of their whole run of windows; members still together repeat each
    other. Those left apart are refined again, window by window, on identifiers doubled up from the
    buckets at later offsets, but only if the bytes beside the anchor are shared with another member.
    Every task folds equal members before the shuffle, so a hot passage arrives once per flush.

    Identifiers have 48 bits within a 64-bit bucket. A null or empty text has no bytes and keeps none.
    Rows with equal or null doc_ids are ordered among themselves by place; nulls come first. Texts of any
    length are looked at in overlapping chunks. An empty table gives an empty one; extra columns are ignored.
    """
    assert 4 <= q < length
    docs = _numbered(docs)
    spans = repeated_spans(docs.select("key", "text"), length, q)

    def run(batches):
        for batch in batches:
            out = []
            for body, raw in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
                body = body or b""
                cuts = np.frombuffer(raw, np.int64).reshape(-1, 2).tolist() if raw else []
                at, kept = 0, []
                for a, b in cuts:
                    kept.append(body[at:a])
                    at = b
                kept.append(body[at:])
                left = b"".join(kept)
                out.append((len(body), len(body) - len(left), len(cuts), left))
            types, names = [pa.int64()] * 3 + [pa.binary()], ["n_bytes", "n_removed", "n_spans", "kept"]
            columns = list(zip(*out)) or [()] * 4
            yield pa.table([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", *names])

    rows = docs.select("key", "doc_id", F.col("text").cast("binary").alias("body")).join(spans, "key", "left").select("doc_id", "body", "spans")
    return arrow_map(rows, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
