"""SimHash fingerprints and near copies found by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage, typed
from nightjar.llm.components import connected_components

BITS = 64
ALL = (1 << BITS) - 1
PIECE = 50_000  # shingles whose hashes are held as bits at once
SMALL = 512     # members of a bucket that are compared with one another inside a task


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the text's ``k``-word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    body, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(body, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-k]]
    votes = np.zeros(BITS, np.int64)
    for a in range(0, len(starts), PIECE):
        own = np.array([digest(body[x:y - 1], seed) for x, y in zip(starts[a:a + PIECE], ends[a + k - 1:a + k - 1 + PIECE])], "<u8")
        votes += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); ``fp`` holds the 64 bits as a bigint."""

    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            own = np.array([fingerprint(t.as_py() or b"", k, seed) for t in text], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(typed(docs, doc_id="bigint", text="string"), run, "doc_id bigint, fp bigint")


def covering_masks(free: int, radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of ``free`` such that any ``radius`` of its bits are left out by one mask whole.

    Bit j of ``free`` carries a nonzero vector of radius + 1 bits, mask v takes the bits whose vector has
    odd overlap with v. The vectors of ``radius`` bits span at most ``radius`` dimensions, so some v
    overlaps evenly with all of them. Vectors are dealt in turn: every mask takes about half the bits.
    """
    vectors = (2 << radius) - 1
    where = [b for b in range(BITS) if free >> b & 1]
    return [sum(1 << b for j, b in enumerate(where) if (v & (1 + j % vectors)).bit_count() & 1) for v in range(1, vectors + 1)]


def _bucketed(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, comp, free) dealt into the tables of the masks of ``free``: fp, comp, the bits still free, the others' value."""
    if "free" not in rows.columns:
        tables = [F.struct(F.lit(signed(ALL & ~m)).alias("free"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for m in covering_masks(ALL, radius)]
        return rows.select("*", F.explode(F.array(*tables)).alias("t")).select("fp", "comp", "t.free", "t.key")

    def run(batches):
        known: dict = {}
        for batch in batches:
            fp, comp, free = (batch.column(c).to_numpy() for c in ("fp", "comp", "free"))
            for f in np.unique(free).tolist():
                if f not in known:
                    known[f] = np.array([signed(f & ~m & ALL) for m in covering_masks(f & ALL, radius)], np.int64)
                own = np.flatnonzero(free == f)
                left = np.tile(known[f], len(own))
                x = np.repeat(fp[own], len(known[f]))
                yield pa.table([pa.array(x), pa.array(np.repeat(comp[own], len(known[f]))), pa.array(left), pa.array(x & ~left)], names=["fp", "comp", "free", "key"])

    return arrow_map(rows.select("fp", "comp", "free"), run, "fp bigint, comp bigint, free bigint, key bigint")


def bucket_links(fp: np.ndarray, comp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest over the components of one bucket: those with members within ``radius`` bits of one another."""
    names, flat = np.unique(comp, return_inverse=True)
    x = fp.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    a, b = np.nonzero(near & (flat[:, None] < flat[None, :]))
    root = np.arange(len(names))
    while len(a):
        low = np.minimum(root[flat[a]], root[flat[b]])
        before = root.copy()
        np.minimum.at(root, root[flat[a]], low)
        np.minimum.at(root, root[flat[b]], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return [(int(names[i]), int(names[root[i]])) for i in np.flatnonzero(root != np.arange(len(names)))]


def _small_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links between components inside buckets of at most SMALL members, streamed bucket by bucket."""

    def run(batches):
        held = None

        def solved(table: np.ndarray, cuts: list[int]) -> pa.Table:
            links = [x for a, b in zip(cuts[:-1], cuts[1:]) for x in bucket_links(table[0, a:b], table[1, a:b], radius)]
            a, b = zip(*links) if links else ((), ())
            return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in ("fp", "comp", "free", "key")])
            own = own if held is None else np.concatenate([held, own], axis=1)
            cuts = [0, *(np.flatnonzero((own[2:, 1:] != own[2:, :-1]).any(axis=0)) + 1).tolist()]
            yield solved(own, cuts)
            held = own[:, cuts[-1]:]  # the last bucket may go on in the next batch
        if held is not None:
            yield solved(held, [0, held.shape[1]])

    dealt = rows.select("fp", "comp", "free", "key").repartition("free", "key").sortWithinPartitions("free", "key")
    return arrow_map(dealt, run, "a bigint, b bigint")


def fingerprint_groups(prints: DataFrame, radius: int = 4, small: int = SMALL) -> DataFrame:
    """(fp, root) of every fingerprint of the distinct ``prints`` (fp) that has others within ``radius`` differing bits.

    Fingerprints are dealt into one table per covering mask, so a pair within the radius shares a bucket of
    some table for certain. All members of a bucket meet its least fingerprint, in the JVM; this settles buckets of two
    and joins most of a dense group at once. A bucket that still holds several components and at most ``small``
    members compares them inside a task. A larger one is dealt again by covering masks of the bits its
    members may still differ in: 32, then 16, then 8 of them, so after three rounds a bucket holds 256 different
    fingerprints at most; ``small`` may not be less. No step drops a member or compares all members of an unbounded bucket.
    """
    if small < 256:
        raise ValueError("buckets of 256 members are the smallest that the tables can leave")
    n = F.count("*").alias("n")
    buckets = _bucketed(prints.select("fp", F.col("fp").alias("comp")), radius)
    sizes = buckets.groupBy("free", "key").agg(n, F.min("fp").alias("pivot")).where("n > 1")
    # by a hint, since Spark sizes both tables as if a fingerprint were not repeated per mask, and would send them to the driver
    shared = cut_lineage(buckets.join(sizes.hint("merge"), ["free", "key"]).select("fp", "free", "key", "n", "pivot"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot")))
    stars = shared.where((F.col("fp") != F.col("pivot")) & (apart <= radius)).select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
    groups = connected_components(stars)
    rows = shared.where("n > 2").select("fp", "free", "key").join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root")
    links = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    while True:
        mixed = rows.groupBy("free", "key").agg(n, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("free", "key", "n")
        open_ = cut_lineage(rows.join(mixed.hint("merge"), ["free", "key"]).select("fp", "comp", "free", "key", "n"))
        links = links.union(_small_links(open_.where(F.col("n") <= small), radius))
        large = open_.where(F.col("n") > small)
        if large.isEmpty():
            break
        rows = cut_lineage(_bucketed(large, radius))
    return connected_components(links).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Fingerprint and group of every row of ``docs`` (doc_id, text): doc_id, fp, fingerprint, component_id.

    A-Z are lower-cased, words are runs of anything but ASCII white space. The fingerprint is that of the
    ``k``-word shingles with their repeats; fewer words are one shingle, none give fingerprint zero,
    linked like any other. Documents are linked if their fingerprints differ in at most ``radius`` bits (exactly: see
    ``fingerprint_groups``); ``component_id`` is the least doc_id reachable. Rows with equal fingerprints are one
    node, so copies are never compared.

    A null text counts as empty; texts of any length are hashed whole, in pieces; equal doc_ids are separate rows; a
    null doc_id is kept and is never the least unless all of its group are null. An empty table gives an empty
    one; extra columns are ignored.
    """
    rows = cut_lineage(fingerprints(docs, k, seed))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = fingerprint_groups(prints.select("fp"), radius)
    rooted = prints.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
