"""Reversible line dedup: exact reference counts of line keys behind sharded cuckoo filters."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage, typed

SLOTS = 4
WHITE_BYTES = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 1 << 16


def line_key(line: bytes) -> bytes:
    """128-bit key of a line: white space stripped at both ends, A-Z lower-cased; empty for a blank line."""
    import xxhash

    body = line.strip(WHITE_BYTES).lower()
    return xxhash.xxh3_128_digest(body) if body else b""


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (never 0) and bucket numbers before masking, from n x 2 key words."""
    return (keys[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), keys[:, 1]


def _as_words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


class CuckooFilter:
    """A cuckoo filter over 128-bit keys: 32-bit fingerprints, four slots a bucket, insert, remove, contains."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for ``keys`` at half load, where insertion does not fail in practice."""
        return cls(np.zeros((1 << max(4, int(np.ceil(np.log2(max(1, keys) * 2 / SLOTS)))), SLOTS), np.uint32))

    @classmethod
    def loads(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, "<u4").reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.astype("<u4").tobytes()

    def _other(self, bucket, fp):
        return (bucket ^ (np.asarray(fp, np.uint64) * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(13))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, bucket = _halves(keys)
        one = bucket & self.mask
        return ((self.table[one] == fp[:, None]) | (self.table[self._other(one, fp)] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key finds no place; the filter must then be built anew with more room."""
        for fp, bucket in zip(*_halves(keys)):
            here = bucket & self.mask
            for turn in range(500):
                free = np.flatnonzero(self.table[here] == 0)
                if len(free):
                    self.table[here, free[0]] = fp
                    break
                if turn:  # both buckets are full: take the place of one that lies here
                    fp, self.table[here, turn % SLOTS] = self.table[here, turn % SLOTS], fp
                here = self._other(here, fp)
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        for fp, bucket in zip(*_halves(keys)):
            one = bucket & self.mask
            for here in (one, self._other(one, fp)):
                hit = np.flatnonzero(self.table[here] == fp)
                if len(hit):
                    self.table[here, hit[0]] = 0
                    break


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n_docs): in how many rows of ``docs`` a non-blank line occurs, folded per task before the shuffle."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0).cast(pa.large_binary()).to_pylist():
                seen.update({line_key(x) for x in (value or b"").split(b"\n")})
            seen.pop(b"", None)
            yield pa.table([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["key", "n_docs"])

    return arrow_map(typed(docs, **{text: "string"}), run, "key binary, n_docs bigint").groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


@dataclass
class LineStore:
    """Exact reference counts (key, n_docs) and, per shard, a filter of the keys found in ``min_docs`` documents or more."""

    counts: DataFrame
    filters: DataFrame  # shard, room, filter
    shards: int
    min_docs: int

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = 10) -> LineStore:
        counts = spark.createDataFrame([], "key binary, n_docs bigint")
        return cls(counts, spark.createDataFrame([], "shard int, room bigint, filter binary"), 1, min_docs)

    @property
    def live(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("key")

    def insert(self, docs: DataFrame, text: str = "text") -> LineStore:
        """Count the documents in; the old store stays valid."""
        return self._changed(line_counts(docs, text))

    def delete(self, docs: DataFrame, text: str = "text") -> LineStore:
        """Take documents out that were inserted before; a key without documents leaves the table."""
        return self._changed(line_counts(docs, text).withColumn("n_docs", -F.col("n_docs")))

    def _changed(self, delta: DataFrame) -> LineStore:
        merged = (
            self.counts.select("key", F.col("n_docs").alias("old"), F.col("n_docs").alias("new"))
            .unionByName(delta.select("key", F.lit(0).cast("bigint").alias("old"), F.col("n_docs").alias("new")))
            .groupBy("key").agg(F.sum("old").alias("old"), F.sum("new").alias("n_docs"))
            .where("old > 0 or n_docs > 0")
        )
        merged = cut_lineage(merged)
        counts = merged.where("n_docs > 0").select("key", "n_docs")
        flips = merged.select("key", (F.col("n_docs") >= self.min_docs).cast("int").alias("now"), (F.col("old") >= self.min_docs).cast("int").alias("was"))
        store = LineStore(counts, self.filters, self.shards, self.min_docs)
        need = store.live.groupBy(shard_of(self.shards).alias("shard")).count()
        full = need.join(self.filters.select("shard", "room"), "shard", "left").where("room is null or count > room")
        if not full.take(1):
            store.filters = cut_lineage(store._updated(flips.where("now != was")))
        else:
            store._build()
        return store

    def _build(self) -> None:
        """All filters anew, with shards of a bounded number of keys."""
        self.shards = max(1, -(-self.live.count() // KEYS_PER_SHARD))
        room = 2 * KEYS_PER_SHARD if self.shards > 1 else KEYS_PER_SHARD

        def fill(keys: pa.Table) -> pa.Table:
            words = _as_words(keys.column("key").to_pylist())
            size = max(room, len(words))
            while not (f := CuckooFilter.sized(size)).insert(words):
                size *= 2
            return pa.table([pa.array(keys.column("shard")[:1].to_pylist(), pa.int32()), pa.array([size], pa.int64()), pa.array([f.dumps()], pa.binary())],
                            names=["shard", "room", "filter"])

        built = self.live.withColumn("shard", shard_of(self.shards)).groupBy("shard").applyInArrow(fill, "shard int, room bigint, filter binary")
        self.filters = cut_lineage(built)

    def _updated(self, flips: DataFrame) -> DataFrame:
        def change(filters: pa.Table, keys: pa.Table) -> pa.Table:
            f = CuckooFilter.loads(filters.column("filter")[0].as_py())
            now = np.array(keys.column("now").to_pylist(), bool)
            words = _as_words(keys.column("key").to_pylist())
            f.remove(words[~now])
            if not f.insert(words[now]):
                raise RuntimeError("a filter below its room took no more keys")
            return pa.table([filters.column("shard"), filters.column("room"), pa.array([f.dumps()], pa.binary())], names=["shard", "room", "filter"])

        keyed = flips.withColumn("shard", shard_of(self.shards)).groupBy("shard")
        return self.filters.groupBy("shard").cogroup(keyed).applyInArrow(change, "shard int, room bigint, filter binary")


def drop_frequent_lines(docs: DataFrame, store: LineStore, text: str = "text", broadcast_limit: int = 64 << 20, spare: bool = False) -> DataFrame:
    """``docs`` without the lines whose key the store counts in ``min_docs`` documents or more.

    Returns the columns of ``docs``, with ``text`` replaced by the lines that stay, joined by newline,
    and two more, ``n_lines`` and ``n_dropped`` (they replace input columns of those names). A null or
    empty text is one empty line, which always stays; blank lines have no key and always stay. Equal
    rows are separate documents; an empty table gives an empty one. With ``spare`` a text of which nothing but
    white space would stay is returned whole, with all its lines counted as dropped.

    The filters answer for nearly every line. What a filter wrongly takes for frequent is found exactly by
    asking it about every rare key of the count table. If the filters and those keys are smaller than
    ``broadcast_limit`` bytes they go to every task and nothing is shuffled. Otherwise lines meet their
    shard's filter in a shuffle, salted by how many lines the shard holds, and the hits are joined to the
    counts.
    """
    size = store.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= broadcast_limit:
        filters = {r.shard: CuckooFilter.loads(bytes(r["filter"])) for r in store.filters.collect()}
        wrong = _wrongly_hit(store, filters)
        n = wrong.count()
        if n * 16 <= broadcast_limit:
            return _drop_in_tasks(docs, store, text, filters, {bytes(r.key) for r in wrong.collect()}, spare)
    return _drop_by_join(docs, store, text, spare)


def _shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    """The same shard numbers as ``shard_of``, when there is one shard or by Spark's hash of binary values."""
    if shards == 1:
        return np.zeros(len(keys), np.int64)
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(k, seed=42) for k in keys], np.uint64).astype(np.int64)
    return np.mod(h, shards)


def _hits(keys: list[bytes], filters: dict, shards: int) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    if not keys:
        return out
    words, shard = _as_words(keys), _shards_of(keys, shards)
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        if s in filters:
            out[at] = filters[s].contains(words[at])
    return out


def _wrongly_hit(store: LineStore, filters: dict) -> DataFrame:
    shards = store.shards

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            hit = np.flatnonzero(_hits(keys, filters, shards))
            yield pa.table([pa.array([keys[i] for i in hit], pa.binary())], names=["key"])

    return cut_lineage(arrow_map(store.counts.where(F.col("n_docs") < store.min_docs).select("key"), run, "key binary"))


def _kept(value: bytes | None, dropped, spare: bool) -> tuple[bytes, int, int]:
    lines = (value or b"").split(b"\n")
    left = [x for x, out in zip(lines, dropped(lines)) if not out]
    if spare and len(left) < len(lines) and not any(x.strip(WHITE_BYTES) for x in left):
        return value, len(lines), len(lines)
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _result(batch: pa.RecordBatch, names: list[str], text: str, rows: list[tuple]) -> pa.Table:
    columns = {n: batch.column(n) for n in names}
    kept, lines, dropped = zip(*rows) if rows else ((), (), ())
    columns[text] = pa.array(kept, pa.binary()).cast(pa.string())
    columns |= {"n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
    return pa.table(columns)


def _schema(docs: DataFrame, text: str) -> tuple[list[str], str]:
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    kinds = dict(docs.dtypes) | {text: "string"}
    return names, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_lines bigint, n_dropped bigint"


def _drop_in_tasks(docs: DataFrame, store: LineStore, text: str, filters: dict, wrong: set, spare: bool) -> DataFrame:
    names, schema = _schema(docs, text)
    shards, sent = store.shards, docs.sparkSession.sparkContext.broadcast((filters, wrong))

    def run(batches):
        filters, wrong = sent.value
        for batch in batches:
            values = batch.column(text).cast(pa.large_binary()).to_pylist()
            keys = list({k for v in values for k in map(line_key, (v or b"").split(b"\n")) if k})
            frequent = {k for k, hit in zip(keys, _hits(keys, filters, shards)) if hit and k not in wrong}
            rows = [_kept(v, lambda lines: [line_key(x) in frequent for x in lines], spare) for v in values]
            yield _result(batch, names, text, rows)

    return arrow_map(docs.select(*[F.col(f"`{c}`") for c in names]), run, schema)


def _drop_by_join(docs: DataFrame, store: LineStore, text: str, spare: bool, rows_per_group: int = 200_000) -> DataFrame:
    names, schema = _schema(docs, text)
    rows = cut_lineage(docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("_row", F.expr("uuid()")))

    def keys_of(batches):
        for batch in batches:
            pairs = [(r, k) for r, v in zip(batch.column("_row").to_pylist(), batch.column("_text").cast(pa.large_binary()).to_pylist())
                     for k in {line_key(x) for x in (v or b"").split(b"\n")} if k]
            yield pa.table([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.binary())], names=["_row", "key"])

    salts = store.counts.groupBy(shard_of(store.shards).alias("shard")).agg(F.ceil(F.sum("n_docs") / rows_per_group).cast("int").alias("salts"))
    probes = (
        arrow_map(rows.select("_row", F.col(text).cast("string").alias("_text")), keys_of, "_row string, key binary")
        .withColumn("shard", shard_of(store.shards)).join(salts, "shard")
        .withColumn("salt", F.pmod(F.xxhash64("_row"), F.col("salts")).cast("int")).drop("salts")
    )
    copies = store.filters.join(salts, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def probe(filters: pa.Table, keys: pa.Table) -> pa.Table:
        if not filters.num_rows or not keys.num_rows:
            return keys.slice(0, 0).select(["_row", "key"])
        hit = CuckooFilter.loads(filters.column("filter")[0].as_py()).contains(_as_words(keys.column("key").to_pylist()))
        return keys.filter(pa.array(hit)).select(["_row", "key"])

    hits = copies.groupBy("shard", "salt").cogroup(probes.groupBy("shard", "salt")).applyInArrow(probe, "_row string, key binary")
    lists = hits.join(store.live, "key").groupBy("_row").agg(F.collect_list("key").alias("_keys"))

    def run(batches):
        for batch in batches:
            out = []
            for v, keys in zip(batch.column(text).cast(pa.large_binary()).to_pylist(), batch.column("_keys").to_pylist()):
                frequent = set(keys or ())
                out.append(_kept(v, lambda lines: [line_key(x) in frequent for x in lines], spare))
            yield _result(batch, names, text, out)

    return arrow_map(rows.join(lists, "_row", "left").select(*[F.col(f"`{c}`") for c in names], "_keys"), run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", broadcast_limit: int = 64 << 20) -> DataFrame:
    """Count every line of ``docs`` in a new store and drop those found in ``min_docs`` documents or more."""
    store = LineStore.empty(docs.sparkSession, min_docs).insert(docs, text)
    return drop_frequent_lines(docs, store, text, broadcast_limit)


def dedup_lines_sparing_copies(docs: DataFrame, min_docs: int = 10, text: str = "text", broadcast_limit: int = 64 << 20) -> DataFrame:
    """``dedup_lines``, but a line that stands only in documents that would be left without text stays.

    Such documents are copies of one another: dropping their lines would lose the text in all of them. A
    document whose lines all stand in documents with other text too is left empty.
    """
    store = LineStore.empty(docs.sparkSession, min_docs).insert(docs, text)
    out = cut_lineage(drop_frequent_lines(docs, store, text, broadcast_limit, spare=True))
    bare = out.where("n_dropped = n_lines")
    held = line_counts(bare, text).withColumnRenamed("n_docs", "here").join(store.counts, "key")
    shared = LineStore.empty(docs.sparkSession, min_docs)
    shared.counts = cut_lineage(held.select("key", F.when(F.col("here") < F.col("n_docs"), F.col("n_docs")).otherwise(F.lit(1)).cast("bigint").alias("n_docs")))
    shared._build()
    return out.where("n_dropped < n_lines").unionByName(drop_frequent_lines(bare, shared, text, broadcast_limit))
