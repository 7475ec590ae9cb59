"""Token ids in compressed files: canonical length-limited Huffman coding with bit-offset checkpoints."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, typed
from nightjar.llm.text import blocks
from nightjar.llm.tokens import UNIT, PieceEncoder
from nightjar.session import ensure_checkpoint_dir

STEP = 512  # ids between two checkpoints
BLOCK_IDS = 1 << 16
IDS_PER_BUCKET = 1 << 22
LOT = 500  # documents encoded together
BLOCKS = 16  # blocks decoded together
BLOCK = ("bucket int, block int, first bigint, doc_ids array<bigint>, counts array<bigint>, payload binary, checkpoints array<bigint>")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with the given counts (package-merge); 0 for count 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    leaves = used[np.argsort(counts[used], kind="stable")]
    weights = counts[leaves].astype(np.float64)
    merged, is_leaf = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        order = np.argsort(np.concatenate([weights, pairs]), kind="stable")
        merged = np.concatenate([weights, pairs])[order]
        is_leaf.append(order < len(weights))
    take = 2 * len(weights) - 2
    for leaf in reversed(is_leaf):
        k = int(leaf[:take].sum())
        lengths[leaves[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.uint64)
    if len(order):
        top = int(own.max())
        slots = np.uint64(1) << (np.uint64(top) - own)  # each code's share of the code space
        codes[order] = (np.cumsum(slots) - slots) >> (np.uint64(top) - own)
    return codes


@dataclass
class Code:
    """A canonical code; the lengths alone say all of it."""

    lengths: np.ndarray

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The bits of texts of ``counts`` ids each, every text from a byte border and most significant bit first.

        Returns all bytes, the number of bytes of each text and the bit offset of every STEP-th id in its text.
        """
        if not hasattr(self, "codes"):
            self.codes = canonical_codes(self.lengths)
        size = self.lengths[ids].astype(np.int64)
        after = np.concatenate([[0], np.cumsum(size)])
        stops = np.cumsum(counts)
        bits = after[stops] - after[stops - counts]
        width = (bits + 7) >> 3
        base = (np.cumsum(width) - width) * 8
        at = after[:-1] + np.repeat(base - after[stops - counts], counts)
        # a code of at most 25 bits from bit ``at`` lies in four bytes; codes do not overlap, so sums put them together
        word = self.codes[ids] << (32 - size - (at & 7)).astype(np.uint64)
        place = at >> 3
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
        out = np.zeros(int(width.sum()) + 4, np.uint8)
        if len(place):
            word = np.add.reduceat(word, first)
            for k in range(4):
                out[place[first] + k] += (word >> np.uint64(24 - 8 * k)).astype(np.uint8)
        marks = [after[e - n:e:STEP] - after[e - n] for e, n in zip(stops.tolist(), counts.tolist())]
        return out[:len(out) - 4], width, marks

    def decode(self, payload: bytes, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Decode from every checkpoint side by side: ``counts`` ids, STEP at most, from bit ``at`` each."""
        if not hasattr(self, "symbol"):
            top = int(self.lengths.max(initial=1))
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            span = 1 << (top - self.lengths[order].astype(np.int64))
            self.top, self.symbol, self.size = top, np.zeros(1 << top, np.int64), np.ones(1 << top, np.int64)
            self.symbol[:span.sum()], self.size[:span.sum()] = np.repeat(order, span), np.repeat(self.lengths[order], span)
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        word = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.zeros((len(at), int(counts.max(initial=0))), np.int64)
        at = at.astype(np.int64)
        for i in range(out.shape[1]):
            here = np.minimum(at >> 3, len(word) - 1)
            entry = (word[here].astype(np.int64) >> (32 - self.top - (at & 7))) & ((1 << self.top) - 1)
            out[:, i] = self.symbol[entry]
            at = at + self.size[entry]
        return out[np.arange(out.shape[1]) < counts[:, None]]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, spaces: bool) -> DataFrame:
    """(doc_id, n, share, ids): whole texts as little-endian 16-bit ids (32-bit for larger vocabularies), the end id
    last; ``share`` in [0, 1) deals out rows of one doc_id."""
    def run(batches):
        encoder = PieceEncoder(tokenizer, spaces)
        kind = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for rows, data, offsets in blocks(batches, "text", UNIT):
            ids, counts = encoder.encode(data, offsets)
            raw, at = [], 0
            for n in counts.tolist():
                raw.append(np.append(ids[at:at + n], end_id).astype(kind).tobytes())
                at += n
            share = [zlib.crc32(x) % 1024 / 1024 for x in raw]
            yield pa.table([rows.column("doc_id"), pa.array(counts + 1, pa.int64()), pa.array(share, pa.float64()),
                            pa.array([np.dtype(kind).itemsize] * len(raw), pa.int32()), pa.array(raw, pa.binary())],
                           names=["doc_id", "n", "share", "width", "ids"])

    return arrow_map(typed(docs, doc_id="bigint", text="string"), run, "doc_id bigint, n bigint, share double, width int, ids binary")


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents: one row per id of the vocabulary."""
    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            raw, width = batch.column("ids").to_pylist(), batch.column("width").to_pylist()
            for a in range(0, len(raw), LOT):
                own = np.bincount(_ids(b"".join(raw[a:a + LOT]), width[a]))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[:len(own)] += own
        used = np.flatnonzero(total)
        yield pa.table([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = arrow_map(tokens.select("ids", "width"), run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaces: bool = True, limit: int = 18) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids under ``path`` in ascending doc_id order.

    ``path/code`` holds each id's code length, which fixes the canonical code, made from the counts of all
    documents. ``path/blocks`` holds blocks of whole documents, BLOCK_IDS ids or more, in buckets of
    neighbouring doc_ids: document ids and counts, the payload in which each document starts at a byte
    border, and the bit offset of every STEP-th id of each document. Any block can be decoded on its own,
    from any checkpoint.

    A null or empty text is the end id alone. Rows with equal doc_ids all stay, in the order of a hash of
    their ids; a null doc_id comes first. An empty table writes a code and no blocks; extra columns are
    ignored. The tokens are written once, since counts must be known before the first code: read from there,
    a lost executor costs no second encoding.
    """
    spark = docs.sparkSession
    tokenized(docs, tokenizer, end_id, spaces).write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    counts = id_counts(tokens)
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    code = Code(code_lengths(dense, limit))
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(code.lengths.tolist()) if n], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    order = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))) + F.col("share")
    buckets = max(1, -(-sum(counts.values()) // IDS_PER_BUCKET))
    bounds = []
    if buckets > 1:
        bounds = sorted(set(tokens.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []))
    edges = np.array(bounds)

    def encode(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, LOT):
                part = batch.slice(a, LOT)
                n = part.column("n").to_numpy()
                ids = _ids(b"".join(part.column("ids").to_pylist()), part.column("width")[0].as_py())
                payload, width, marks = code.encode(ids, n)
                ends = np.cumsum(width)
                bits = [payload[e - w:e].tobytes() for e, w in zip(ends.tolist(), width.tolist())]
                yield pa.table([pa.array(np.searchsorted(edges, part.column("order").to_numpy(), "right"), pa.int32()), part.column("doc_id"), part.column("share"),
                                part.column("n"), pa.array(bits, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["bucket", "doc_id", "share", "n", "bits", "marks"])

    def join(batches):
        bucket, block, first, held, size = None, 0, 0, [], 0

        def made() -> pa.Table:
            payload = b"".join(h[2] for h in held)
            base = np.cumsum([0] + [len(h[2]) for h in held[:-1]]) * 8
            marks = np.concatenate([np.array(h[3], np.int64) + b for h, b in zip(held, base)])
            return pa.table([pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([[h[0] for h in held]], pa.list_(pa.int64())),
                             pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([marks], pa.list_(pa.int64()))],
                            names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for b, *row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "bits", "marks")]):
                if held and (b != bucket or size >= BLOCK_IDS):
                    yield made()
                    block, first, held, size = block + 1, first + size, [], 0
                if b != bucket:
                    bucket, block, first = b, 0, 0
                held.append(row)
                size += row[1]
        if held:
            yield made()

    coded = arrow_map(tokens.withColumn("order", order), encode, "bucket int, doc_id bigint, share double, n bigint, bits binary, marks array<bigint>")
    placed = coded.repartition(max(1, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "share", "bits")
    arrow_map(placed.drop("share"), join, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> Code:
    rows = spark.read.parquet(f"{path}/code").collect()  # one row per id of the vocabulary
    lengths = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
    lengths[[r.id for r in rows]] = [r.length for r in rows]
    return Code(lengths)


def decoded_blocks(spark: SparkSession, path: str, per_document) -> DataFrame:
    """Decode every block and return (doc_id, bucket, first, n_tokens, value) with ``per_document`` of its ids."""
    code = read_code(spark, path)
    fn, kind, arrow = per_document

    def run(batches):
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", "first", "doc_ids", "counts", "payload", "checkpoints")]))
            for a in range(0, len(rows), BLOCKS):  # blocks stand alone; some are decoded side by side for speed
                lot = rows[a:a + BLOCKS]
                n = np.concatenate([np.array(r[3], np.int64) for r in lot])
                lots = -(-n // STEP)
                each = np.full(int(lots.sum()), STEP)
                each[np.cumsum(lots) - 1] = n - (lots - 1) * STEP
                base = np.cumsum([0] + [len(r[4]) for r in lot[:-1]]) * 8
                at = np.concatenate([np.array(r[5], np.int64) + b for r, b in zip(lot, base)])
                out = np.split(code.decode(b"".join(r[4] for r in lot), at, each), np.cumsum(n)[:-1])
                before = np.concatenate([r[1] + np.cumsum(r[3]) - r[3] for r in lot])
                bucket = np.repeat([r[0] for r in lot], [len(r[3]) for r in lot])
                yield pa.table([pa.array([i for r in lot for i in r[2]], pa.int64()), pa.array(bucket, pa.int32()), pa.array(before, pa.int64()), pa.array(n),
                                pa.array([fn(x) for x in out], arrow)], names=["doc_id", "bucket", "first", "n_tokens", "value"])

    return arrow_map(spark.read.parquet(f"{path}/blocks"), run, f"doc_id bigint, bucket int, first bigint, n_tokens bigint, value {kind}")


def read_ids(spark: SparkSession, path: str, per_document=(lambda ids: ids, "array<int>", pa.list_(pa.int32()))) -> DataFrame:
    """(doc_id, start, n_tokens, value) of every document from its files; ``start`` counts all ids before it.

    The sizes of the buckets, one small row each, give the buckets' starts.
    """
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("bucket").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return decoded_blocks(spark, path, per_document).join(starts, "bucket").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "value")


def id_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, spaces: bool = True) -> DataFrame:
    """Write ``docs`` as id files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id, spaces)
    return read_ids(spark, path, (id_crc32, "bigint", pa.int64())).withColumnRenamed("value", "ids_crc32")
